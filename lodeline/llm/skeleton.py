"""Texts that look the same in one form: a confusables skeleton.

Method: decompose canonically, replace every character by the prototype of its look-alike class, decompose
again; texts with equal skeletons look equal. Letter case, line breaks and raised or lowered digits are kept,
because they show.

Defined results: a null text has a null skeleton and is in no pair; an empty text has the empty skeleton and
pairs only with texts of nothing but invisible characters or blanks. Repeated rows are one document.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import staged

# Look-alike letters and signs and their prototypes (Unicode security mechanisms, UTS 39).
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    # Greek
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Coptic
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮢ": "R", "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Armenian, Latin and letter-like
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ſ": "f",
    "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ꞵ": "ß",
    # signs drawn alike
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "˗": "-", "⁃": "-", "⁄": "/", "∕": "/", "╱": "/", "∶": ":", "․": ".", "·": "·", "⋅": "·", "∙": "·",
    "‘": "'", "’": "'", "ʼ": "'", "ʹ": "'", "′": "'", "‛": "'", "＇": "'", "ǃ": "!", "⁎": "*", "∗": "*", "∼": "~", "∣": "|", "ǀ": "|",
}
# The kinds of compatibility decompositions that keep the look. Raised, lowered, encircled, rotated and small forms show.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<compat>", "<square>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
# Ranges of characters that don't show.
INVISIBLE = ((0, 8), (14, 31), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
# Ranges that hold all characters with such decompositions, blanks and look-alikes; the rest is ideographs, syllables and private use.
MAPPED = ((0, 0x33FF), (0xA000, 0xABFF), (0xF900, 0xFFFF), (0x1D000, 0x1F2FF), (0x1FB00, 0x1FBFF))

_LINE_ENDS = re.compile("[\x85\u2028\u2029]")
_BLANKS = re.compile(" {2,}")
_BEFORE_END = re.compile(" +(?=\n|$)")


def _shown(c: str) -> str | None:
    """What one character is drawn as, in one step; None if it stands for itself."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in "\t\v\f" or unicodedata.category(c) == "Zs":
        return " "
    kind, *codes = unicodedata.decomposition(c).split() or [""]
    if kind in SAME_LOOK and codes[0] != "0020":  # a sign over a blank is a sign of its own
        return "".join(chr(int(x, 16)) for x in codes)
    return None


def _prototypes() -> dict[int, str | None]:
    """The whole mapping, by rule: fixed look-alikes, compatible forms of the same look, blanks and invisible characters, followed to their ends."""
    hidden = {code for low, high in INVISIBLE for code in range(low, high + 1)}
    table: dict[int, str | None] = dict.fromkeys(hidden)
    for code in (x for low, high in MAPPED for x in range(low, high + 1) if x not in hidden):
        if (told := _shown(c := chr(code))) is not None and told != c:
            before = None
            while told != before:
                before = told
                told = "".join("" if ord(x) in hidden else x if (y := _shown(x)) is None else y for x in unicodedata.normalize("NFD", told))
            table[code] = told or None
    return table


PROTOTYPES = _prototypes()


_TO_MAP = frozenset(map(chr, PROTOTYPES))


def _prototyped(text: str) -> str:
    """Every character by its prototype; texts with few different such characters go the short way."""
    here = _TO_MAP.intersection(text)
    if len(here) > 8:
        return text.translate(PROTOTYPES)
    for c in here:
        text = text.replace(c, PROTOTYPES[ord(c)] or "")
    return text


def skeleton(text: str) -> str:
    """The one form of all texts that look like this one."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        text = _prototyped(text)
    else:
        if not unicodedata.is_normalized("NFD", text):
            text = unicodedata.normalize("NFD", text)
        text = _prototyped(text)
        if not unicodedata.is_normalized("NFD", text):
            text = unicodedata.normalize("NFD", text)
        text = _LINE_ENDS.sub("\n", text)
    if "  " in text:
        text = _BLANKS.sub(" ", text)
    return _BEFORE_END.sub("", text) if " \n" in text or text[-1:] == " " else text


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def with_skeleton(df: DataFrame, text: str = "text", out: str = "skeleton") -> DataFrame:
    """df with the skeleton of `text` as a further column `out`, which must be a new name."""
    if out in df.columns:
        raise ValueError(f"column {out} exists already")

    @F.pandas_udf("string")
    def form(values):
        return values.map(skeleton, na_action="ignore")

    return df.withColumn(out, form(F.col(f"`{text}`")))


def skeleton_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, look, exact): 16-byte digests of the skeleton and of the stored text; only these are shuffled."""
    df = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    kind = df.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            looks, exact = [], []
            for t in b.column(1).to_pylist():
                looks.append(_digest(skeleton(t)))
                exact.append(_digest(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(looks, pa.binary()), pa.array(exact, pa.binary())], ["id", "look", "exact"])

    return df.mapInArrow(run, f"id {kind.simpleString()}, look binary, exact binary")


def staged_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each document's digests once, written, so that no text is read again."""
    return staged(skeleton_digests(df, key, text).distinct(), "looks")


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: documents whose stored texts differ but look the same.

    Only groups of one skeleton with at least two stored texts enter the join; a group of exact copies
    yields no rows, however large, because the join's sides are classes of equal stored texts.
    """
    digests = staged_digests(df, key, text)
    forms = digests.select("look", "exact").distinct()
    mixed = forms.groupBy("look").agg(F.count("*").alias("forms")).where("forms > 1").select("look")
    rows = digests.join(mixed, "look", "left_semi")
    forms = rows.select("look", "exact").distinct()
    # classes meet classes first, so that a large class of exact copies is never compared with itself
    ways = forms.alias("a").join(forms.alias("b"), "look").where("a.exact < b.exact").select("look", F.col("a.exact").alias("exact"), F.col("b.exact").alias("other"))
    left = rows.join(ways, ["look", "exact"])
    right = rows.select("look", F.col("exact").alias("other"), F.col("id").alias("id_b"))
    pairs = left.join(right, ["look", "other"])
    return pairs.select(F.least("id", "id_b").alias("doc_id_a"), F.greatest("id", "id_b").alias("doc_id_b"))


def look_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, form_id, forms, links): one row per document, however many look alike.

    class_id is the smallest id that looks the same, form_id the smallest id of the same stored text, links the number
    of documents that look the same and are stored otherwise: all pairs, as members and counts.
    """
    digests = staged_digests(df, key, text)
    forms = digests.groupBy("look", "exact").agg(F.min("id").alias("form_id"), F.count("*").alias("same"))
    classes = forms.groupBy("look").agg(F.min("form_id").alias("class_id"), F.count("*").alias("forms"), F.sum("same").alias("all"))
    told = forms.join(classes, "look").select("look", "exact", "form_id", "class_id", "forms", (F.col("all") - F.col("same")).alias("links"))
    return digests.join(told, ["look", "exact"]).select(F.col("id").alias("doc_id"), "class_id", "form_id", "forms", "links")
