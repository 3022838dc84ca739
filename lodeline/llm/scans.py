"""Repair of text from scanned pages.

Method: the lines of a paper are labelled as body, header, page number or break by a hidden Markov model over
layout symbols (page-number shape and series, likeness to title, journal or other heads, nearness of a page end).
The model is fitted by Viterbi training on a bounded sample of papers. Words come from statistics of the whole
corpus: a word is misread if a far more frequent word of the corpus turns into it by known misreadings; a hyphen
at a line end is a break unless the corpus holds the compound. Paragraphs are reassembled from body lines.

Words meet the corpus lexicon in a shuffled join; the words of the bounded list of most frequent ones are only
spared the journey, which changes no result. Each misread word is tried against all more frequent words that share its
key. A head holds at most the paper's title, its journal and a number, which bounds the length of lines that can be one.

Defined results: a paper without signs of a scanned page is returned unchanged; null texts stay null and give no
damaged lines; empty texts are empty; repeated rows give the same lines and count once; very long lines are
lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import staged

BODY, HEADER, PAGE_NO, BREAK = 0, 1, 2, 3
SAMPLE_PAPERS = 400
COMMON_WORDS = 50_000
LEAST_TIMES = 8  # a word must be this many times as frequent as what is taken for its misreading
# What a scanner reads for what was printed.
MISREADINGS = (("e", "c"), ("t", "f"), ("o", "0"), ("i", "l"), ("a", "o"), ("l", "1"), ("i", "1"), ("d", "cl"), ("s", "5"), ("u", "ii"), ("g", "q"), ("m", "rn"), ("h", "li"), ("y", "v"), ("w", "vv"), ("ri", "n"), ("li", "h"), ("fi", "h"), ("nn", "rm"), ("b", "6"), ("in", "m"), ("ll", "U"), ("z", "2"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "l"), ("g", "9"))
# Digits and the letters that are read for them.
DIGIT_LETTERS = {"l": "1", "I": "1", "O": "0", "o": "0", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "6", "g": "9", "q": "9"}

_D = "[0-9lIOoZzSsBbgq]"
_PAGE = {k: re.compile(rf"\s*{v}\s*$") for k, v in {"bare": rf"({_D}{{1,4}})", "dash": rf"[-–] ?({_D}{{1,4}}) ?[-–]", "em": rf"— ?({_D}{{1,4}}) ?—", "round": rf"\(({_D}{{1,4}})\)", "square": rf"\[({_D}{{1,4}})\]", "p": rf"p\. ?({_D}{{1,4}})", "page": rf"Page ({_D}{{1,4}})(?: of {_D}{{1,4}})?"}.items()}
_ALL_LETTERS = re.compile(r"[lOZSBb]{2,}")  # a number of which no digit was read
_TO_DIGITS = str.maketrans(DIGIT_LETTERS)
_SOFT = re.compile(r"[^\W\d_]([¬‐­]\s*|- +)$")
_HARD = re.compile(r"[^\W_]-$")
_HARD_END = re.compile(r"(?m)[^\W\d_]-$")
_HAS_SOFT = re.compile(r"(?m)[^\W\d_](?:[¬‐­]|- )\s*$")
_WORDS = re.compile(r"[A-Za-zÄÖÜäöüßÀ-ÿ0-9]+")
_PLACED = re.compile(r"et al\.? ?/|, Vol\.|· Article ")
_ID = re.compile(r"[A-Z][0-9][a-z][0-9]+|[A-Z]{2}[0-9]+|[a-z][A-Z]{2}[0-9]+")
_NUMBER_LIKE = re.compile(r"[0-9lIOoZSBbgq]+")
_NUMBER_HERE = re.compile(r"(?:\b(?:by|at|of|near|about|than|to|equals|above|once|and|von|um|bei|mit) |\| ?)$")
_KEY_SINGLE = str.maketrans({"1": "l", "i": "l", "0": "o", "a": "o", "c": "e", "f": "t", "5": "s", "q": "g", "9": "g", "v": "y", "6": "b", "2": "z", "8": "b"})


def misreading_key(word: str) -> str:
    """A key that a word and all its misreadings share."""
    w = word.replace("U", "ll").lower().translate(_KEY_SINGLE)
    # ri-n and in-m first fall to their wide letters, whatever they were
    for a, b in (("rl", "n"), ("ln", "m"), ("rn", "m"), ("ll", "h"), ("el", "d"), ("yy", "w")):
        w = w.replace(a, b)
    return w.replace("uu", "w").replace("h", "u") if "u" in w or "h" in w else w


def is_misreading(word: str, true: str) -> bool:
    """Whether `true` turns into `word` by one or more of the known misreadings, all else being equal."""
    if word == true:
        return False
    n = len(true)
    reach = {(0, 0)}
    for i in range(n):
        for ti, j in [r for r in reach if r[0] == i]:
            if j < len(word) and word[j] == true[i]:
                reach.add((i + 1, j + 1))
            for printed, read in MISREADINGS:
                if true.startswith(printed, i) and word.startswith(read, j):
                    reach.add((i + len(printed), j + len(read)))
    return (n, len(word)) in reach


def misread_number(token: str, before: str) -> bool:
    """A number with letters among its digits that is no identifier."""
    if not _NUMBER_LIKE.fullmatch(token) or token.isdigit() or not any(c.isdigit() for c in token) or _ID.fullmatch(token):
        return False
    return not (before == "-" and not token[0].isdigit())


def _canon(text: str) -> str:
    return re.sub(r"[^a-zäöüß一-鿿]", "", text.lower().translate(_KEY_SINGLE))


def _like(a: str, b: str) -> bool:
    """Whether one canonical form begins or is contained like the other, misreadings allowed."""
    if len(a) < 8 or len(b) < 8:
        return False
    if a in b or b in a:
        return True
    if not any(b[k : k + 5] in a for k in range(0, min(len(b), len(a)) - 4, 5)):
        return False
    s = SequenceMatcher(None, a, b[: len(a) + 2], autojunk=False)
    return s.real_quick_ratio() >= 0.8 and s.quick_ratio() >= 0.8 and s.ratio() >= 0.82


class Page:
    """Layout evidence of the lines of one paper."""

    def __init__(self, text: str, journal: str | None):
        self.lines = lines = text.split("\n")
        n = len(lines)
        self.shape = shape = np.zeros(n, np.int8)  # 1 page-number shape, 2 in a series
        self.head = head = np.zeros(n, np.int8)  # 1 weak, 2 strong
        self.blank = np.array([not s.strip() for s in lines])
        self.feed = np.array(["\f" in s for s in lines])
        series: dict[str, list[tuple[int, int]]] = {}
        canon: dict[int, str] = {}
        first = next((i for i in range(n) if not self.blank[i]), 0)
        title = _canon(lines[first].lstrip("# ")) if n else ""
        own = _canon(journal) if journal and journal != "Unknown" else ""
        seen: Counter = Counter()
        longest = max(100, len(lines[first].strip()) + len(journal or "") + 45)
        for i, s in enumerate(lines):
            bare = len(s.strip())
            if bare > longest or self.blank[i] or s[0] in "|#":
                continue
            size = len(s)
            if bare <= 24:  # "Page 1234 of 1234" and less
                for kind, pattern in _PAGE.items():
                    if m := pattern.match(s):
                        digits = any(c.isdigit() for c in m.group(1))
                        if kind == "bare" and size - len(s.lstrip()) >= 5:
                            kind = "set"  # far from the margin
                        if digits or kind != "bare" and _ALL_LETTERS.fullmatch(m.group(1)):
                            shape[i] = 1
                            series.setdefault(kind, []).append((i, int(m.group(1).translate(_TO_DIGITS))))
                        break
                if shape[i]:
                    continue
            if i != first and size >= 10:
                canon[i] = c = _canon(s)
                if len(c) >= 8:
                    seen[c] += 1
        follows: dict[str, int] = {}
        for kind, places in series.items():
            values: dict[int, list[int]] = {}
            for i, v in places:
                values.setdefault(v, []).append(i)
            apart = 6 if kind == "bare" else 4
            for i, v in places:
                if any(any(j - i >= apart for j in values.get(v + step, ())) or any(i - j >= apart for j in values.get(v - step, ())) for step in (1, 2)):
                    shape[i] = 2
                    follows[kind] = follows.get(kind, 0) + 1
        # a paper numbers its pages in one way; other lines of such a shape are text
        own_kind = max(follows, key=lambda k: (follows[k], k)) if follows else None
        for kind, places in series.items():
            for i, _ in places:
                if own_kind is not None and kind != own_kind:
                    shape[i] = 0
                elif own_kind is not None and kind != "bare" or kind == "set":
                    shape[i] = 2
                elif kind == "bare" and shape[i] == 1 and (own_kind is not None or _listed(lines, i)):
                    shape[i] = 0
        for i, c in canon.items():
            s = lines[i]
            stripped = s.strip()
            upper = stripped.isupper() and sum(ch.isalpha() for ch in stripped) >= 10
            ends = stripped[-1:] in ".;:,"
            if own and len(c) >= 8 and _near(c, own) and not ends and len(stripped) <= len(journal) + 45:
                head[i] = 2
            elif _PLACED.search(s) and re.search(r"\d", s) and not ends:
                head[i] = 2
            elif title and len(c) >= 10 and not ends and _like(c, title):
                head[i] = 2
            elif upper and len(stripped.split()) > 1:
                head[i] = 1
            elif seen[c] >= 2 and not ends and len(c) >= 14:
                head[i] = 1
        self.n = n
        self.scanned = bool((shape == 2).any() or (head == 2).any() or self.feed.any() or _HAS_SOFT.search(text))

    def symbols(self) -> np.ndarray:
        """One symbol per line: shape, head and nearness of a page's end."""
        strong = (self.shape == 2) | (self.head == 2) | self.feed
        near = np.zeros(self.n, bool)
        filled = [i for i in range(self.n) if not self.blank[i] or self.feed[i]]
        for a, b in zip(filled, filled[1:]):
            if strong[a]:
                near[b] = True
            if strong[b]:
                near[a] = True
        s = self.shape.astype(np.int64) * 6 + self.head * 2 + near
        s[self.blank] = 18
        return s


def _listed(lines: list[str], i: int) -> bool:
    """Whether a bare number stands in a list: after another one, or after a line that announces a list."""
    return i > 0 and (lines[i - 1].strip().isdigit() or lines[i - 1].rstrip().endswith(":"))


def _near(c: str, own: str) -> bool:
    if own in c:
        return True
    if not any(own[k : k + 5] in c for k in range(0, len(own) - 4, 5)):
        return False
    for cut in (c, c[-len(own) :], c[: len(own)]):
        if abs(len(cut) - len(own)) <= 3:
            m = SequenceMatcher(None, cut, own, autojunk=False)
            if m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and m.ratio() >= 0.82:
                return True
    return False


SYMBOLS = 19


class LineModel:
    """A hidden Markov model of the kinds of lines, fitted by Viterbi training from layout evidence."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first_guess(symbols: np.ndarray) -> np.ndarray:
        shape, head = symbols // 6, symbols // 2 % 3
        near = symbols % 2
        labels = np.full(len(symbols), BODY)
        labels[(head == 2) | (head == 1) & (near == 1)] = HEADER
        labels[(shape == 2) | (shape == 1) & (near == 1)] = PAGE_NO
        labels[symbols == 18] = BREAK
        return labels

    @classmethod
    def count(cls, sequences: list[np.ndarray], labels: list[np.ndarray]) -> LineModel:
        start, move, emit = np.full(4, 1.0), np.full((4, 4), 1.0), np.full((4, SYMBOLS), 0.02)
        for s, y in zip(sequences, labels):
            if len(s):
                start[y[0]] += 1
                np.add.at(move, (y[:-1], y[1:]), 1)
                np.add.at(emit, (y, s), 1)
        return cls(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True)))

    @classmethod
    def fit(cls, sequences: list[np.ndarray], rounds: int = 4) -> LineModel:
        labels = [cls.first_guess(s) for s in sequences]
        model = cls.count(sequences, labels)
        for _ in range(rounds - 1):
            model = cls.count(sequences, [model.label(s) for s in sequences])
        return model

    def label(self, symbols: np.ndarray) -> np.ndarray:
        """The most likely kinds of the lines."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int64)
        move, emit = self.move.T.tolist(), self.emit.T.tolist()
        score, back = (self.start + self.emit[:, symbols[0]]).tolist(), []
        a, b, c, d = score
        for x in symbols[1:].tolist():
            told, came, e = [], [], emit[x]
            for k in range(4):
                m = move[k]
                best, at = a + m[0], 0
                if (y := b + m[1]) > best:
                    best, at = y, 1
                if (y := c + m[2]) > best:
                    best, at = y, 2
                if (y := d + m[3]) > best:
                    best, at = y, 3
                told.append(best + e[k])
                came.append(at)
            a, b, c, d = told
            back.append(came)
        at = max(range(4), key=(a, b, c, d).__getitem__)
        out = [at]
        for came in reversed(back):
            at = came[at]
            out.append(at)
        return np.array(out[::-1], np.int64)


def _questionable(w: str) -> bool:
    """Whether a token that is not among the common words may be a misread word."""
    return len(w) >= 3 and sum(c.isdigit() for c in w) <= 2 and sum(c.isalpha() for c in w) >= 2 and not _ID.fullmatch(w)


def _split_word(lines: list[str], kinds: np.ndarray, i: int) -> tuple[str, str, int, bool] | None:
    """The parts of a word that the end of line i cuts, the line of the second, and whether the mark is soft."""
    s = lines[i]
    soft = bool(_SOFT.search(s))
    if not soft and not _HARD.search(s):
        return None
    left = re.search(r"([^\W_]+(?:-[^\W_]+)*)(?:[¬‐­]\s*|-\s*)$", s)
    j = i + 1
    while j < len(lines) and kinds[j] != BODY:
        j += 1
    if left is None or j == len(lines):
        return None
    right = re.match(r"\s*([^\W_]+)", lines[j])
    return (left.group(1), right.group(1), j, soft) if right else None


def _columns(df: DataFrame, key: str, text: str, journal: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("string").alias("paper_id"), F.col(f"`{journal}`").alias("journal"), F.col(f"`{text}`").alias("text")).where("paper_id is not null and text is not null and text != ''")


def word_counts(papers: DataFrame) -> DataFrame:
    """(word, n, whole): how often the corpus holds a word, and how often as a compound with a hyphen (word with '-')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = re.compile(r"[A-Za-zÄÖÜäöüßÀ-ÿ0-9]+(?:-[A-Za-zÄÖÜäöüßÀ-ÿ]+)*")
        for b in batches:
            counts: Counter = Counter()
            for t in b.column(0).to_pylist():
                counts.update(tokens.findall(t))
            inside: Counter = Counter()
            for w, n in counts.items():
                if "-" in w:
                    parts = w.split("-")
                    for pair in zip(parts, parts[1:]):
                        inside["-".join(pair)] += n
                    for part in parts:
                        inside[part] += n
                else:
                    inside[w] += n
            rows = [(w, n) for w, n in inside.items() if len(w) >= 3 and sum(c.isdigit() for c in w) <= 2 and sum(c.isalpha() for c in w) >= 2]
            if rows:
                ws, ns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(ns, pa.int64())], ["word", "n"])

    return papers.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def misreadings(word: str) -> set[str]:
    """All words that one misreading makes of a word."""
    out = set()
    for printed, read in MISREADINGS:
        i = word.find(printed)
        while i >= 0:
            out.add(word[:i] + read + word[i + len(printed) :])
            i = word.find(printed, i + 1)
    out.discard(word)
    return out


def one_misreading(counts: DataFrame) -> DataFrame:
    """(word, true, n_true): what one misreading makes of the words that the corpus holds LEAST_TIMES or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(v, w, n) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()) for v in misreadings(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["word", "true", "n_true"])

    made = counts.where(rf"n >= {LEAST_TIMES} and word rlike '^[^0-9-]+$'").mapInArrow(run, "word string, true string, n_true bigint")
    return made.groupBy("word").agg(F.max(F.struct("n_true", "true")).alias("m")).select("word", "m.true", "m.n_true")


def misread_words(words: DataFrame, counts: DataFrame, made: DataFrame) -> DataFrame:
    """(word, true): those of `words` (word, n) that a far more frequent word of the corpus turns into by misreading.

    One misreading is found among `made`, all that can be made; several in a word by a key that all readings of it
    share: every more frequent word of the key is tried, and the most frequent that fits counts.
    """

    def keyed(df: DataFrame, word: str, n: str) -> DataFrame:
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([misreading_key(w) for w in b.column(0).to_pylist()], pa.string()), *b.columns], ["k", word, n])

        return df.select(F.col("word").alias(word), F.col("n").alias(n)).where(F.instr(word, "-") == 0).mapInArrow(keys, f"k string, `{word}` string, {n} bigint")

    # the true word has letters only
    true = keyed(counts.where(r"n >= 3 and word rlike '^[^0-9]+$'"), "true", "n_true")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = [is_misreading(w, t) for w, t in zip(b.column("word").to_pylist(), b.column("true").to_pylist())]
            yield b.filter(pa.array(fits, pa.bool_()))

    tried = keyed(words, "word", "n").join(true, "k").where(f"n_true >= {LEAST_TIMES} * n and word != `true`").select("word", "true", "n_true")
    several = tried.mapInArrow(tell, "word string, true string, n_true bigint").groupBy("word").agg(F.max(F.struct("n_true", "true")).alias("m")).select("word", "m.true")
    one = words.join(made, "word").where(F.col("n_true") >= LEAST_TIMES * F.col("n")).select("word", "true")
    return one.unionByName(several.join(one.select("word"), "word", "left_anti"))


def _is_code(token: str) -> bool:
    """Whether a token between blanks is a code or a link: it has parts of digits and letters that no number is misread as."""
    return any(any(c.isdigit() for c in p) and any(c.isalpha() for c in p) and not _NUMBER_LIKE.fullmatch(p) for p in _WORDS.findall(token))


class Evidence:
    """What the labelled lines of a paper need from the lexicon."""

    def __init__(self, page: Page, kinds: np.ndarray, common: frozenset[str]):
        self.words: list[tuple[int, str]] = []  # line, word that may be misread
        self.numbers: list[int] = []
        self.splits: list[tuple[int, str, str, int, bool]] = []
        lines = page.lines
        second: dict[int, str] = {}
        for i, s in enumerate(lines):
            if kinds[i] != BODY:
                continue
            got = _split_word(lines, kinds, i)
            if got:
                left, right, j, soft = got
                self.splits.append((i, left, right, j, soft))
                second[j] = right
            body = s
            start = 0
            if i in second:
                start = s.find(second[i]) + len(second[i])
            end = len(body.rstrip())
            if got:
                end = body.rstrip(" -¬‐­").rfind(got[0].split("-")[-1])
            z, code = -1, False  # the end of the token between blanks, and whether it is a code or a link
            for m in _WORDS.finditer(body, start, max(start, end)):
                w = m.group()
                if w.isdigit():
                    continue
                if w not in common and _ALL_LETTERS.fullmatch(w) and (_NUMBER_HERE.search(body[: m.start()]) or body.strip() == w):
                    self.numbers.append(i)
                elif any(c.isdigit() for c in w) and misread_number(w, body[m.start() - 1 : m.start()]):
                    if m.start() >= z:
                        a, z = body.rfind(" ", 0, m.start()) + 1, body.find(" ", m.end())
                        z = z if z >= 0 else len(body)
                        code = _is_code(body[a:z])
                    if not code:
                        self.numbers.append(i)
                elif w not in common and _questionable(w):
                    self.words.append((i, w))


def fit_model(papers: DataFrame, sample: int = SAMPLE_PAPERS) -> LineModel:
    """The line model, fitted on at most `sample` scanned-looking papers out of about 12 times as many papers taken by hash; only their symbols come to the driver."""
    looks = papers.where(F.col("text").rlike(r"\f|(?m)^\s*(?:- \w+ -|— \w+ —|\[\w+\]|p\. \w+|Page \w+ of \w+)\s*$|\w[¬‐­]\s*$"))
    share = min(1.0, 12 * sample / max(1, papers.count()))
    space = F.xxhash64("paper_id")
    taken = looks.where(space < F.lit(int(-(2**63) + share * (2**64 - 2048)))).select(space.alias("h"), "paper_id", "journal", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [Page(t, j) for j, t in zip(b.column("journal").to_pylist(), b.column("text").to_pylist())]
            at = pa.array([i for i, p in enumerate(pages) if p.scanned], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("h").take(at), b.column("paper_id").take(at), pa.array([bytes(p.symbols().astype(np.uint8)) for p in pages if p.scanned], pa.binary())], ["h", "paper_id", "s"])

    rows = taken.mapInArrow(run, "h bigint, paper_id string, s binary").orderBy("h", "paper_id").limit(sample).collect()
    return LineModel.fit([np.frombuffer(r.s, np.uint8).astype(np.int64) for r in rows])


def _common(counts: DataFrame, misread: DataFrame) -> frozenset[str]:
    """At most COMMON_WORDS of the most frequent words that are no misreading of another and don't look like numbers."""
    top = counts.join(misread.select("word"), "word", "left_anti").where(f"n >= 8 and instr(word, '-') = 0 and not (word rlike '^(?:{_ALL_LETTERS.pattern})$') and not (word rlike '[0-9]' and word rlike '^{_NUMBER_LIKE.pattern}$')").orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    return frozenset(r.word for r in top.select("word").collect())


def damaged_lines(df: DataFrame, key: str = "paper_id", text: str = "paper_md", journal: str = "journal") -> DataFrame:
    """(paper_id, line_no, kind, old, new): hyphen, misread, header and page_no lines of scanned papers.

    For hyphen, `old` are the parts of the word with a blank between, `new` the word; for misread, `old` is what
    was read and `new` the word, null for a number.
    """
    papers = _columns(df, key, text, journal)
    counts = staged(word_counts(papers), "words")
    made = staged(one_misreading(counts), "made")
    misread = staged(misread_words(counts, counts, made), "misread")
    model = fit_model(papers)
    common = df.sparkSession.sparkContext.broadcast(_common(counts, misread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for pid, j, t in zip(*(b.column(c).to_pylist() for c in ("paper_id", "journal", "text"))):
                page = Page(t, j)
                sure = page.scanned
                if sure:
                    kinds = model.label(page.symbols())
                    kinds[page.blank] = BREAK
                    for i in np.flatnonzero((kinds == HEADER) | (kinds == PAGE_NO)):
                        rows.append((pid, int(i) + 1, "header" if kinds[i] == HEADER else "page_no", None, None, 0, False, sure))
                elif _HARD_END.search(t) or any(map(_questionable, set(_WORDS.findall(t)) - common.value)):
                    kinds = np.where(page.blank, BREAK, BODY)
                else:
                    continue
                e = Evidence(page, kinds, common.value)
                rows += [(pid, i + 1, "number", None, None, 0, False, sure) for i in sorted(set(e.numbers))]
                rows += [(pid, i + 1, "word", w, None, 0, False, sure) for i, w in sorted(set(e.words))]
                rows += [(pid, i + 1, "split", a, b_, j_ + 1, soft, sure) for i, a, b_, j_, soft in e.splits]
            cols = list(zip(*rows)) if rows else [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], ["paper_id", "line_no", "what", "a", "b", "other", "soft", "sure"])

    seen = staged(papers.mapInArrow(run, "paper_id string, line_no bigint, what string, a string, b string, other bigint, soft boolean, sure boolean"), "lines")
    # a paper without layout of pages is scanned if it holds misread words, or words of the corpus broken at line ends
    unsure = seen.where("not sure")
    doubt = unsure.where("what = 'word'").join(misread.select(F.col("word").alias("a")), "a").select("paper_id")
    broken = unsure.where("what = 'split' and b rlike '^[^0-9]' and length(a) > 1").select("paper_id", F.concat(F.element_at(F.split("a", "-"), -1), "b").alias("word"), F.concat_ws("-", F.element_at(F.split("a", "-"), -1), "b").alias("compound"))
    broken = broken.join(counts.where(f"n >= {LEAST_TIMES}").select("word"), "word").join(counts.select(F.col("word").alias("compound")), "compound", "left_anti").select("paper_id")
    seen = seen.where("sure").unionByName(unsure.join(doubt.unionByName(broken).distinct(), "paper_id", "left_semi"))
    plain = seen.where("what in ('header', 'page_no', 'number')").select("paper_id", "line_no", F.when(F.col("what") == "number", "misread").otherwise(F.col("what")).alias("kind"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    words = seen.where("what = 'word'").join(misread, F.col("a") == misread.word).select("paper_id", "line_no", F.lit("misread").alias("kind"), F.col("a").alias("old"), F.col("true").alias("new"))
    # split words: the joined word, the compound, and the last part before the cut
    splits = seen.where("what = 'split'").withColumn("last", F.element_at(F.split("a", "-"), -1))
    splits = splits.withColumn("joined", F.concat("last", "b")).withColumn("compound", F.concat_ws("-", "last", "b"))
    n = lambda c, name: counts.select(F.col("word").alias(c), F.col("n").alias(name))
    known = splits.join(n("joined", "n_joined"), "joined", "left").join(n("compound", "n_compound"), "compound", "left").join(n("b", "n_right"), "b", "left").join(n("last", "n_left"), "last", "left").na.fill(0, ["n_joined", "n_compound", "n_left", "n_right"])
    both = F.least("n_left", "n_right")
    is_word = F.col("soft") | (~F.col("b").rlike("^[0-9]") & ~F.col("last").rlike("^[A-Z]$") & ((F.col("n_joined") > F.col("n_compound")) | ((F.col("n_compound") == 0) & (both < 3))))
    hyphens = known.where(is_word).select("paper_id", "line_no", "other", "last", "b", "joined")
    cut = hyphens.select("paper_id", "line_no", F.lit("hyphen").alias("kind"), F.concat_ws(" ", "last", "b").alias("old"), F.col("joined").alias("new"))
    # misread letters inside a word that was cut: the joined word against the lexicon
    joined = _joined_misread(hyphens, counts, made)
    # a compound's right part, and the parts of compounds, are words of their own
    loose = known.where(~is_word).select("paper_id", F.explode(F.array(F.struct("line_no", F.col("last").alias("w")), F.struct(F.col("other").alias("line_no"), F.col("b").alias("w")))).alias("x")).select("paper_id", "x.line_no", "x.w")
    loose = loose.join(misread, F.col("w") == misread.word).select("paper_id", "line_no", F.lit("misread").alias("kind"), F.col("w").alias("old"), F.col("true").alias("new"))
    return plain.unionByName(words).unionByName(cut).unionByName(joined).unionByName(loose).distinct()


def _joined_misread(hyphens: DataFrame, counts: DataFrame, made: DataFrame) -> DataFrame:
    """Misread rows of words that a line end cuts: the line of the part that differs from the true word."""
    whole = hyphens.select(F.col("joined").alias("word")).distinct().join(counts, "word", "left").select("word", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("n"))
    told = hyphens.join(misread_words(whole, counts, made).withColumnRenamed("word", "joined"), "joined")
    first = F.when(~F.startswith("true", "last"), F.struct(F.col("line_no"), F.col("last").alias("old")))
    second = F.when(~F.endswith("true", "b"), F.struct(F.col("other").alias("line_no"), F.col("b").alias("old")))
    # where both parts differ the misreading lies across the cut and belongs to the first line
    parts = F.array_compact(F.array(first, F.when(first.isNull(), second)))
    return told.select("paper_id", F.explode(parts).alias("x"), "true").select("paper_id", "x.line_no", F.lit("misread").alias("kind"), "x.old", F.col("true").alias("new"))


_SENTENCE_END = re.compile(r"[.!?。！？:：][\"'”’)\]]*$")
_OWN_LINE = re.compile(r"\s*(?:\||#|[-*] |\d+[.)] |```)")


def _whole_text(text: str, marks: dict[int, list[tuple[str, str | None, str | None]]]) -> str:
    """Continuous paragraphs of a scanned paper, given its damaged lines."""
    lines = text.split("\n")
    hyphen: set[int] = set()
    out: list[str] = []
    drop = [False] * len(lines)
    for i in range(len(lines)):
        for kind, old, new in marks.get(i + 1, ()):
            if kind in ("header", "page_no"):
                drop[i] = True
            elif kind == "hyphen":
                hyphen.add(i)
            elif kind == "misread" and old and new and not drop[i]:
                lines[i] = re.sub(rf"(?<![^\W_]){re.escape(old)}(?![^\W_])", lambda _, new=new: new, lines[i])
            elif kind == "misread" and not old:
                lines[i] = _WORDS.sub(lambda m, s=lines[i]: m.group().translate(_TO_DIGITS) if misread_number(m.group(), s[m.start() - 1 : m.start()]) else m.group(), lines[i])
    para, glue, page_end = "", False, False
    for i, s in enumerate(lines):
        if drop[i] or "\f" in s:
            page_end = True
            continue
        bare = s.strip()
        if not bare:
            if not page_end and not glue and para and (_SENTENCE_END.search(para) or len(para) < 40 or not _goes_on(lines, drop, i)):
                out.append(para)
                para = ""
            continue
        single = _OWN_LINE.match(s) or len(bare) < 24 and not glue and (not para or _SENTENCE_END.search(para)) and (bare.isdigit() or bare.istitle())
        if single and not glue:
            if para:
                out.append(para)
            para = ""
            out.append(bare)
        else:
            part = bare
            if i in hyphen:
                part = re.sub(r"[-¬‐­]\s*$", "", part)
            para = para + part if glue else (f"{para} {part}" if para else part)
            glue = i in hyphen or bool(_HARD.search(bare))
        page_end = False
    if para:
        out.append(para)
    text = ""
    for prev, cur in zip([None, *out], out):
        text += cur if prev is None else ("\n" if prev[:1] == "|" and cur[:1] == "|" or prev.isdigit() and cur.isdigit() else "\n\n") + cur
    return text


def _goes_on(lines: list[str], drop: list[bool], i: int) -> bool:
    """Whether the text after blank line i begins in small letters after page furniture."""
    furniture = False
    for j in range(i + 1, min(i + 6, len(lines))):
        if drop[j] or "\f" in lines[j]:
            furniture = True
        elif lines[j].strip():
            return furniture or lines[j].lstrip()[:1].islower()
    return False


def repaired(df: DataFrame, damage: DataFrame, key: str = "paper_id", text: str = "paper_md", out: str = "repaired") -> DataFrame:
    """(paper_id, repaired): each paper's text as continuous paragraphs; papers without damage unchanged."""
    papers = df.select(F.col(f"`{key}`").cast("string").alias("paper_id"), F.col(f"`{text}`").alias("text")).where("paper_id is not null")
    marks = damage.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "kind", "old", "new"))).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for t, ms in zip(b.column("text").to_pylist(), b.column("marks").to_pylist()):
                if t is None or not ms:
                    done.append(t)
                    continue
                at: dict[int, list] = {}
                for m in ms:
                    at.setdefault(m["line_no"], []).append((m["kind"], m["old"], m["new"]))
                done.append(_whole_text(t, at))
            yield pa.RecordBatch.from_arrays([b.column("paper_id"), pa.array(done, pa.string())], ["paper_id", out])

    return papers.join(marks, "paper_id", "left").select("paper_id", "text", "marks").mapInArrow(run, f"paper_id string, `{out}` string")
