"""Oversized texts in pieces: content-defined chunking.

Method: a rolling hash over a window of characters marks landmarks by content alone. Where a piece is due to end,
the first landmark between its least and greatest size is taken and moved to the nearest natural boundary: the end
of a paragraph before a sentence, a sentence before a clause, a clause before a blank. So an edit alters only the
pieces near it. Without any natural boundary between the sizes the cut falls on the landmark itself, which is a
forced cut; where the stretch without boundary that it falls in is longer than the limit, no cut could have spared it.
Every piece but the first begins with the last `overlap` characters of what precedes its cut.

Defined results: null texts and texts of at most `limit` characters give no pieces; an empty key gives none;
texts may be of any length, with no natural boundary at all, or of blanks only; repeated rows give their pieces
once each time and count once in `oversized`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"[.!?][\"'”’)\]]*(?=\s)|[。！？]")
_CLAUSE = re.compile(r"[;:,](?=\s)|[；，]|\n")
_BLANK = re.compile(r"\s+")
_STOPS = re.compile(r"[\s。！？；，]")


def landmarks(text: str) -> np.ndarray:
    """A 32-bit number for every character, made of the WINDOW characters up to it alone."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(1)) * _BASE
    codes ^= codes >> np.uint64(29)
    # windowed sum of codes, each turned by its distance: doubling keeps it vectorised
    rolled, size = codes.copy(), 1
    while size < WINDOW:
        shifted = np.zeros_like(rolled)
        shifted[size:] = rolled[:-size]
        rolled = rolled + (shifted * np.uint64(pow(0xD6E8FEB86659FD93, size, 1 << 64)))
        size *= 2
    rolled *= _BASE
    return (rolled >> np.uint64(32)).astype(np.uint32)


def _boundaries(text: str) -> list[np.ndarray]:
    """Places at which a piece may end, by rank: paragraphs, sentences, clauses, blanks."""
    return [np.array([m.end() for m in p.finditer(text)], np.int64) for p in (_PARAGRAPH, _SENTENCE, _CLAUSE, _BLANK)]


def cuts(text: str, limit: int, overlap: int, least: int | None = None) -> list[tuple[int, int]]:
    """The ends of all pieces, each with 0 for a natural cut, 1 for one forced by the overlap, or 2 for one forced by a stretch above the limit.

    New text of a piece is at most limit - overlap, of the first at most limit.
    """
    n = len(text)
    if n <= limit:
        return [(n, 0)]
    room = limit - overlap
    least = max(overlap, min(least or room // 3, room - 1))
    mask = np.uint32((1 << max(2, int(np.log2(max(4, room // 3))))) - 1)
    marks = landmarks(text)
    chosen = np.flatnonzero((marks & mask) == 0) + 1
    ranks = _boundaries(text)
    stops = None
    reach = max(16, room // 6)
    ends: list[tuple[int, int]] = []
    at = 0
    while True:
        most = at + (limit if at == 0 else room)
        if n <= most:
            ends.append((n, 0))
            return ends
        low = at + least
        i = np.searchsorted(chosen, low)
        # the first landmark in reach, else the place of the least number: content decides either way
        target = int(chosen[i]) if i < len(chosen) and chosen[i] <= most else low + int(marks[low - 1 : most].argmin())
        end = -1
        for b in ranks:  # near the landmark
            lo, hi = np.searchsorted(b, max(low, target - reach)), np.searchsorted(b, min(most, target + reach), side="right")
            if hi > lo:
                near = b[lo:hi]
                end = int(near[np.abs(near - target).argmin()])
                break
        if end < 0:  # anywhere between the sizes, even below the least
            for b in ranks:
                lo, hi = np.searchsorted(b, at + 1 if at else overlap + 1), np.searchsorted(b, most, side="right")
                if hi > lo:
                    near = b[lo:hi]
                    end = int(near[np.abs(near - target).argmin()])
                    break
        forced = 0
        if end < 0:
            end = target
            if stops is None:
                stops = np.array([-1, *(m.start() for m in _STOPS.finditer(text)), n], np.int64)
            j = np.searchsorted(stops, end)
            forced = 2 if stops[j] - stops[j - 1] - 1 > limit else 1
        ends.append((end, forced))
        at = end


def split(text: str, limit: int, overlap: int, least: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, forced as in cuts) of all pieces; consecutive pieces share `overlap` characters."""
    at, out = 0, []
    for end, forced in cuts(text, limit, overlap, least):
        out.append((at - overlap if at else 0, end, forced))
        at = end
    return out


def _oversized(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("string").alias("item_id"), F.col(f"`{text}`").alias("text")).where(F.col("item_id").isNotNull() & (F.length("text") > limit))


def pieces(df: DataFrame, key: str, text: str, limit: int, overlap: int, least: int | None = None, bodies: bool = True) -> DataFrame:
    """(item_id, piece_no, start, end, forced[, piece]): all pieces of all texts above the limit, in Unicode characters."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no, start, end, forced, body = [], [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (s, e, f) in enumerate(split(t, limit, overlap, least)):
                    ids.append(k)
                    no.append(i + 1)
                    start.append(s)
                    end.append(e)
                    forced.append(f > 0)
                    if bodies:
                        body.append(t[s:e])
            cols = [pa.array(ids, pa.string()), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(forced, pa.bool_())]
            names = ["item_id", "piece_no", "start", "end", "forced"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(body, pa.string())] * bodies, names + ["piece"] * bodies)

    return _oversized(df, key, text, limit).mapInArrow(run, "item_id string, piece_no int, start bigint, end bigint, forced boolean" + ", piece string" * bodies)


def oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """(item_id, cut, pieces, forced_cuts): items that were cut, and whether a cut was forced by a stretch longer than the limit.

    A forced cut in a stretch between limit - overlap and limit is owed to the overlap alone; it counts in forced_cuts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kinds = [f for _, f in cuts(t, limit, overlap)]
                if len(kinds) > 1:
                    rows.append((k, "forced" if 2 in kinds else "natural", len(kinds), sum(f > 0 for f in kinds)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()))], ["item_id", "cut", "pieces", "forced_cuts"])

    return _oversized(df, key, text, limit).mapInArrow(run, "item_id string, cut string, pieces int, forced_cuts int").distinct()
