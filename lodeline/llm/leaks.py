"""Evaluation texts inside a training corpus: suffix arrays over shards of the corpus.

Method: every shard of documents becomes one sequence of word numbers with a suffix array, sorted to its full depth by
prefix doubling; suffixes of the evaluation texts are found in it by binary search, and the longest verbatim match of a
suffix lies beside the place where it would be inserted. A word is a maximal run of letters and digits of the text's
skeleton without case and markup. Words that no evaluation text holds stand for a break, and only corpus positions that
are followed by enough other words enter the array: no other suffix can match. There is no shuffle but that of the few
matches.

First the distinct beginnings of `least` words tell which documents hold which items; then the suffixes of such an
item are searched in that document's part of the array alone. So neither a phrase that a document repeats nor one that
many items share is compared copy by copy.

Defined results: null or empty texts hold no words and are in no match; items shorter than the least match can't leak;
repeated rows count once; of equally long matches the first in the document, then the first in the item is told.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skeleton import skeleton

# a tag with its attributes, of any length; a character reference; marks of emphasis
_TAG = re.compile(r"""</?[A-Za-z][\w:-]*(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))?)*\s*/?>|&(?:[A-Za-z]{2,8}|#\d{1,6});|\*{1,3}|~~|`+""")
_WORD = re.compile(r"[^\W_]+")
LEAST_WORDS = 12
ITEM_BLOCK_WORDS = 1_000_000


def words(text: str) -> list[str]:
    """The words of a text as compared here."""
    if "<" in text or "*" in text or "&" in text or "`" in text or "~" in text:
        text = _TAG.sub("", text)
    form = skeleton(text)
    if not form.isascii():
        form = unicodedata.normalize("NFC", form)
        return _WORD.findall(form.casefold())
    return _WORD.findall(form.lower())


class Probe:
    """The evaluation side: word numbers, all suffixes of at least `least` words, and their distinct beginnings."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.number, self.items = least, {}, [i for i, _ in items]
        tokens, owner, offset, left = [], [], [], []
        for n, (_, text) in enumerate(items):
            own = words(text)
            tokens += [self.number.setdefault(w, len(self.number) + 1) for w in own]
            owner += [n] * len(own)
            offset += range(len(own))
            left += range(len(own), 0, -1)
        self.tokens = np.array(tokens + [-1] * least, np.int32)  # -1 equals no word of the corpus
        left_a = np.array(left, np.int32)
        self.starts = np.flatnonzero(left_a >= least)
        self.owner, self.offset, self.left = np.array(owner, np.int32)[self.starts], np.array(offset, np.int32)[self.starts], left_a[self.starts]
        begins = np.stack([self.tokens[self.starts + i] for i in range(least)], 1)
        _, first, gram = np.unique(begins, axis=0, return_index=True, return_inverse=True)
        self.grams = self.starts[first]  # a place of each distinct beginning
        self.by_gram = np.argsort(gram.ravel(), kind="stable")
        self.gram_ends = np.searchsorted(gram.ravel()[self.by_gram], np.arange(len(first) + 1))


def suffix_array(seq: np.ndarray, longest: int) -> np.ndarray:
    """All places in the order of their suffixes, by prefix doubling up to `longest` words; ties by place."""
    rank, size = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.zeros(len(seq), np.int64)
        second[:-size] = rank[size:] + 1
        key = rank * (len(seq) + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(len(seq), np.int64)
        rank[order] = new
        size *= 2
        if size >= longest or size >= len(seq) or new[-1] == len(seq) - 1:
            return order


def _common(seq: np.ndarray, place: np.ndarray, tokens: np.ndarray, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """How many words the suffix at each place shares with the suffix at `start`, up to `depth`. A break ends every match."""
    length = np.zeros(len(place), np.int64)
    going = np.flatnonzero(length < depth)
    while len(going):
        n = length[going]
        going = going[seq[place[going] + n] == tokens[start[going] + n]]
        length[going] += 1
        going = going[length[going] < depth[going]]
    return length


def _insertion(seq: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, tokens: np.ndarray, start: np.ndarray, depth: np.ndarray, after: bool = False) -> np.ndarray:
    """Where in order[low:high] the first `depth` words from `start` belong, before or after their equals, by binary search."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        there, asked, deep = order[mid], start[open_], depth[open_]
        n = _common(seq, there, tokens, asked, deep)
        whole = n == deep
        m = np.minimum(n, deep - 1)
        right = np.where(whole, after, seq[there + m] < tokens[asked + m])
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, value) of all values of the ranges [low, high)."""
    size = high - low
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[which]


def match_shard(probe: Probe, doc_ids: list, texts: list[str | None]) -> list[tuple]:
    """(doc, item, longest match in words, its word offset in the document, in the item) of one shard."""
    number, least = probe.number, probe.least
    parts, begin = [], [0]
    for t in texts:
        got = [number.get(w, 0) for w in words(t)] if t else []
        parts.append(np.array(got + [0], np.int32))  # 0 breaks between documents and at foreign words
        begin.append(begin[-1] + len(got) + 1)
    if not len(probe.starts) or not parts:
        return []
    whole = np.concatenate(parts)
    breaks = np.flatnonzero(whole == 0)
    size = np.diff(np.concatenate([[-1], breaks])) - 1  # known words before each break
    runs = np.flatnonzero(size >= least)
    if not len(runs):
        return []
    # only the runs that are long enough, each with its break
    run, place = _expand(breaks[runs] - size[runs], breaks[runs] + 1)
    seq, known = whole[place], (breaks[runs][run] - place).astype(np.int64)
    doc = np.searchsorted(np.array(begin), place, side="right") - 1
    order = suffix_array(seq, int(size[runs].max()) + 1)
    order = order[known[order] >= least]
    # which documents hold which distinct beginnings
    zeros, deep = np.zeros(len(probe.grams), np.int64), np.full(len(probe.grams), least)
    full = zeros + len(order)
    low, high = (_insertion(seq, order, zeros, full, probe.tokens, probe.grams, deep, after) for after in (False, True))
    gram, at = _expand(low, high)
    if not len(gram):
        return []
    pairs = np.unique(gram * len(texts) + doc[order[at]])
    gram, held = pairs // len(texts), pairs % len(texts)
    # every suffix with such a beginning in that document's part of the array
    order = order[np.argsort(doc[order], kind="stable")]
    ends = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    which, k = _expand(probe.gram_ends[gram], probe.gram_ends[gram + 1])
    suffix, held = probe.by_gram[k], held[which]
    start, left, low, high = probe.starts[suffix], probe.left[suffix].astype(np.int64), ends[held], ends[held + 1]
    here = _insertion(seq, order, low, high, probe.tokens, start, left)
    length = np.zeros(len(suffix), np.int64)
    for beside, there in ((here - 1, here > low), (here, here < high)):
        i = np.flatnonzero(there)
        length[i] = np.maximum(length[i], _common(seq, order[beside[i]], probe.tokens, start[i], left[i]))
    # the longest of each document and item, and its first place
    pair = np.unique(held * len(probe.items) + probe.owner[suffix], return_inverse=True)[1]
    most = np.zeros(int(pair.max()) + 1, np.int64)
    np.maximum.at(most, pair, length)
    top = np.flatnonzero(length == most[pair])
    first, last = (_insertion(seq, order, low[top], high[top], probe.tokens, start[top], length[top], after) for after in (False, True))
    which, at = _expand(first, last)
    best: dict[tuple, tuple] = {}
    for i, p in zip(top[which].tolist(), place[order[at]].tolist()):
        d, item = int(held[i]), int(probe.owner[suffix[i]])
        row = (p - begin[d], int(probe.offset[suffix[i]]), int(length[i]))
        if row < best.get((d, item), (p + 1,)):
            best[d, item] = row
    return [(doc_ids[d], probe.items[i], n, p, o) for (d, i), (p, o, n) in best.items()]


def item_blocks(items: DataFrame, key: str, text: str, size: int = ITEM_BLOCK_WORDS) -> Iterator[list[tuple]]:
    """The evaluation texts in blocks of about `size` words, one at a time on the driver."""
    block, n = [], 0
    for row in items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k is not null and t is not null").distinct().toLocalIterator():
        block.append((row.k, row.t))
        n += len(row.t) // 2 + 1
        if n >= size:
            yield block
            block, n = [], 0
    yield block


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS, shard_docs: int = 2048) -> DataFrame:
    """(doc_id, item_id, words, doc_word, item_word): the longest verbatim match of each document and item.

    The evaluation set goes to the executors in blocks of about ITEM_BLOCK_WORDS words, one pass for each,
    so its size is bounded whatever the number of items.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k is not null and t is not null")
    kind, item_kind = docs.schema["k"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, words int, doc_word int, item_word int"
    found = None
    for block in item_blocks(items, item_key, item_text):
        held = spark.sparkContext.broadcast(Probe(block, least))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            probe = held.value
            for b in batches:
                for i in range(0, b.num_rows, shard_docs):
                    part = b.slice(i, shard_docs)
                    rows = match_shard(probe, part.column(0).to_pylist(), part.column(1).to_pylist())
                    if rows:
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(list(c)) if n == 0 else pa.array(list(c), pa.int32()) for n, c in enumerate(cols[1:]))], ["doc_id", "item_id", "words", "doc_word", "item_word"])

        one = docs.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", -F.col("doc_word"), -F.col("item_word"))).alias("m")).select("doc_id", "item_id", F.col("m.words").alias("words"), (-F.col("m.col2")).alias("doc_word"), (-F.col("m.col3")).alias("item_word"))


def without_leaks(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the affected documents; a document of null key is kept."""
    return docs.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
