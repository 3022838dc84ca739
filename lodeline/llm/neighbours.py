"""The most similar vectors of every vector: additive quantisation.

Method: vectors are coded as a sum of full-dimensional words, one from each of several residual codebooks, by beam
search; the norm of the sum is stored beside the codes. An asker's products with all words make a lookup table, and
the score of a resident is the sum of its words' entries over its norm. The best scores are reranked exactly. The
first codebook holds centroids of the collection; an index of cells tells who is compared with whom.

Codebooks and cells are fitted on a bounded sample; every row is coded once, in the task where it lives, and asks.
Where a whole cell passes, only the exact rerank decides the order; ties go to the smaller key. Without a least cosine,
rows that don't find k neighbours from `SURE` on look again, by exact products, in far larger cells and without a
margin. `ask=None` is the exact way: every row asks every cell and no score replaces a product.

Defined results: null, short, zero or non-finite vectors count as absent; repeated rows of one key count once; an
empty table gives no rows; exact copies under other keys are neighbours with cosine 1, of a vector with very many
copies those of smallest key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tables import staged
from . import cells as cl

BOOKS, WORDS, BEAM, RERANK = 24, 64, 2, 192
FIRST_WORDS = 1024
MARGIN, ASK = 0.17, 8
SURE = 0.8
WIDE_ROWS, WIDE_ASK = 64_000, 4


def _one_hot(own: np.ndarray, size: int) -> np.ndarray:
    hot = np.zeros((len(own), size), np.float32)
    hot[np.arange(len(own)), own] = 1
    return hot


class Codebooks:
    """Residual codebooks of full dimension, improved together by least squares."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # (books, words, dim)
        self.norms = (self.books**2).sum(2)

    @classmethod
    def fit(cls, residuals: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = 3) -> Codebooks:
        rng = np.random.default_rng(seed)
        x = residuals.astype(np.float32)
        rest, out = x.copy(), []
        words = max(1, min(words, len(rest)))
        for _ in range(books):
            c = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(5):
                hot = _one_hot(((c**2).sum(1) - 2 * rest @ c.T).argmin(1), words)
                n = hot.sum(0)
                c = np.where(n[:, None] > 0, hot.T @ rest / np.maximum(n, 1)[:, None], c)
            rest = rest - c[((c**2).sum(1) - 2 * rest @ c.T).argmin(1)]
            out.append(c)
        self = cls(np.array(out))
        for _ in range(rounds):  # given the codes, all words at once by least squares
            codes = self.encode(x)
            hot = np.concatenate([_one_hot(codes[:, m], words) for m in range(books)], 1)
            gram = (hot.T @ hot).astype(np.float64) + np.eye(books * words) * 0.5
            solved = np.linalg.solve(gram, (hot.T @ x).astype(np.float64) + 0.5 * self.books.reshape(books * words, -1))
            self = cls(solved.reshape(self.books.shape))
        return self

    def encode(self, x: np.ndarray, beam: int = BEAM, step: int = 1024) -> np.ndarray:
        """Codes by beam search: at every codebook the best sums so far are kept."""
        books, words, dim = self.books.shape
        out = np.zeros((len(x), books), np.uint8)
        for i in range(0, len(x), step):
            part = x[i : i + step]
            n = len(part)
            row = np.arange(n)
            rest, cost = part[:, None, :], np.zeros((n, 1), np.float32)
            codes = np.zeros((n, 1, books), np.uint8)
            for m in range(books):
                width = rest.shape[1]
                total = np.ascontiguousarray(rest).reshape(-1, dim) @ (-2 * self.books[m].T)
                total += self.norms[m]
                total = total.reshape(n, width, words)
                total += cost[:, :, None]
                total = total.reshape(n, -1)
                keep = min(beam, total.shape[1])
                best, low = np.empty((n, keep), np.int64), np.empty((n, keep), np.float32)
                for j in range(keep):
                    best[:, j] = total.argmin(1)
                    low[:, j] = total[row, best[:, j]]
                    total[row, best[:, j]] = np.inf
                parent, word = best // words, best % words
                cost = low
                rest = rest[row[:, None], parent] - self.books[m][word]
                codes = codes[row[:, None], parent]
                codes[:, :, m] = word
            out[i : i + step] = codes[row, cost.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))


def search(q: np.ndarray, v: np.ndarray, first: np.ndarray, codebooks: Codebooks, k: int, least: float, rerank: int = RERANK, slack: float = 0.22, skip: np.ndarray | None = None, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asker, resident, cosine) of the k best residents with cosine >= least of each asker.

    `first` is the first codebook, whose words are centroids of the whole collection. Scores come from codes by
    lookup tables; `rerank` residents of best score are compared exactly. skip[i] is the
    resident that asker i is itself, or -1. Residents come in the order of their keys.
    """
    out_q, out_v, out_s = [], [], []
    if not len(v) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    used, code = np.unique(cl.nearest(v, first), return_inverse=True)
    first = first[used]
    codes = codebooks.encode(v - first[code])
    inverse = 1.0 / np.maximum(np.linalg.norm(codebooks.decode(codes) + first[code], axis=1), 1e-6).astype(np.float32)
    books, words, dim = codebooks.books.shape
    flat = codebooks.books.reshape(-1, dim)
    for i in range(0, len(q), step):
        part = q[i : i + step]
        table = np.ascontiguousarray((part @ flat.T).T)  # (books * words, askers)
        score = np.ascontiguousarray((part @ first.T).T)[code]
        for m in range(books):
            score += table[codes[:, m].astype(np.int64) + m * words]
        score *= inverse[:, None]
        rows = np.flatnonzero(score.max(0) >= least - slack)
        if not len(rows):
            continue
        score = np.ascontiguousarray(score[:, rows].T)
        if len(v) > rerank:
            near = np.argpartition(-score, rerank, axis=1)[:, :rerank]
            near.sort(axis=1)
        else:
            near = np.broadcast_to(np.arange(len(v)), (len(rows), len(v)))
        exact = np.einsum("qd,qrd->qr", part[rows].astype(np.float64), v[near].astype(np.float64), optimize=False) if len(rows) * near.shape[1] < 4096 else np.matmul(v[near], part[rows][:, :, None])[:, :, 0].astype(np.float64)
        if skip is not None:
            exact[near == skip[i + rows][:, None]] = -2
        order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(exact, order, 1)
        r, j = np.nonzero(top >= least)
        out_q.append(i + rows[r])
        out_v.append(near[r, order[r, j]])
        out_s.append(top[r, j])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest_neighbours(df: DataFrame, key: str = "chain_id", vector: str = "vector", k: int = 5, least: float | None = None, dim: int = cl.DIM, sample_rows: int = cl.SAMPLE_ROWS, cell_rows: int = cl.CELL_ROWS, margin: float = MARGIN, ask: int | None = ASK, rerank: int = RERANK, hot: int = cl.HOT_COPIES) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar rows of every row, as far as their cosine is at least `least`, if that is given."""
    rows = cl.vectors(df, key, vector)
    floor = SURE if least is None else least
    total = rows.count()
    drawn = cl.drawn_sample(rows, total, sample_rows, cell_rows, dim)
    cells = cl.fit_cells(drawn, total, cell_rows)
    first = cl.kmeans(drawn, max(1, min(FIRST_WORDS, len(drawn) // 20)), rounds=6)
    rest = drawn[:10_000] - first[cl.nearest(drawn[:10_000], first)]
    model = rows.sparkSession.sparkContext.broadcast((first, Codebooks.fit(rest)))
    apart = cl.set_apart(rows, total, max(hot, k + 1), k + 1)
    spread = cl.routed(apart.rows, cells, margin, ask, dim)
    exact = ask is None

    def meet(table: pa.Table) -> pa.Table:
        first, books = model.value
        g = cl.Group(table, dim)
        pa_q, pa_v, pa_s = [], [], []
        for q, ids, skip in ((g.v, g.ids, np.arange(len(g.ids))), (g.ask_v, g.ask_ids, np.full(len(g.ask_ids), -1))):
            a, b, s = best_exact(q, g.v, k, skip) if exact else search(q, g.v, first, books, k, floor, rerank=rerank, skip=skip)
            near = np.flatnonzero(s >= floor) if least is not None or not exact else np.arange(len(s))
            pa_q += [ids[i] for i in a[near].tolist()]
            pa_v += [g.ids[i] for i in b[near].tolist()]
            pa_s.append(s[near])
        return pa.table({"id": pa.array(pa_q, pa.string()), "neighbour": pa.array(pa_v, pa.string()), "cosine": pa.array(np.concatenate(pa_s), pa.float64())})

    found = spread.groupBy("cell", "block").applyInArrow(meet, "id string, neighbour string, cosine double")
    if least is None and not exact:
        found = staged(found, "near")
        done = found.groupBy("id").agg(F.count_distinct("neighbour").alias("n")).where(F.col("n") >= k).select("id", F.lit(True).alias("done"))
        more = _wide(apart.rows.join(done, "id", "left"), drawn, total, k, dim)
        found = found.unionByName(more).groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    if apart.members is not None:
        found = _with_copies(found, apart)
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _with_copies(found: DataFrame, apart: cl.Apart) -> DataFrame:
    """A neighbour with very many copies stands for its smallest keys; such copies themselves are next to one another."""
    firsts = apart.firsts
    known = F.broadcast(firsts.select(F.col("rep").alias("neighbour"), F.col("id").alias("copy")))
    near = found.join(F.broadcast(firsts.select(F.col("rep").alias("id")).distinct()), "id", "left_anti")
    near = near.join(known, "neighbour", "left").select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "cosine")
    own = apart.members.select("id", "rep").join(F.broadcast(firsts.withColumnRenamed("id", "neighbour")), "rep").where("id != neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    return near.unionByName(own)


def _wide(rows: DataFrame, drawn: np.ndarray, total: int, k: int, dim: int, cell_rows: int = WIDE_ROWS, most: int | None = WIDE_ASK) -> DataFrame:
    """(id, neighbour, cosine): the k best rows in each of the `most` nearest wide cells, for rows that aren't `done`."""
    held = rows.sparkSession.sparkContext.broadcast(cl.fit_cells(drawn, total, cell_rows))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, v = cl.matrix(b.column("vector"), dim)
            if not len(index):
                continue
            ids = b.column("id").take(pa.array(index))
            far = b.column("done").is_null().to_numpy(zero_copy_only=False)[index]
            r, c, n, own = held.value.route(v, cl.hash_ids(ids), 2.0, most)
            keep = own | far[r]
            r, c, n, own = r[keep], c[keep], n[keep], own[keep]
            for i in range(0, len(r), 20_000):
                j = r[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], pa.int32()), pa.array(n[i : i + 20_000], pa.int32()), pa.array(own[i : i + 20_000]), ids.take(pa.array(j)), cl.packed(v[j]), pa.array(far[j])], ["cell", "block", "own", "id", "v", "far"])

    def meet(table: pa.Table) -> pa.Table:
        g = cl.Group(table, dim)
        far = np.flatnonzero(table.column("far").to_numpy()[g.rows_here])
        q = np.concatenate([g.v[far], g.ask_v])
        skip = np.concatenate([far, np.full(len(g.ask_ids), -1)])
        a, b, s = best_exact(q, g.v, k, skip)
        ids = [g.ids[i] for i in far] + g.ask_ids
        return pa.table({"id": pa.array([ids[i] for i in a.tolist()], pa.string()), "neighbour": pa.array([g.ids[i] for i in b.tolist()], pa.string()), "cosine": pa.array(s, pa.float64())})

    spread_rows = rows.select("id", "vector", "done").mapInArrow(spread, cl.ROUTED + ", far boolean")
    return spread_rows.groupBy("cell", "block").applyInArrow(meet, "id string, neighbour string, cosine double")


def best_exact(q: np.ndarray, v: np.ndarray, k: int, skip: np.ndarray, step: int = 256, wide: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asker, resident, cosine) of the k best residents of each asker by exact products; skip[i] is the resident that asker i is itself, or -1.

    Residents come in strips; only what reaches an asker's k-th best of the strips so far is kept.
    """
    outs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(0, len(q) if len(v) else 0, step):
        part, mine = q[i : i + step], skip[i : i + step]
        bar = np.full(len(part), -1.5, np.float32)
        rows, cols, best = [], [], np.full((len(part), k), -2.0, np.float32)
        for j in range(0, len(v), wide):
            s = part @ v[j : j + wide].T
            here = np.flatnonzero((mine >= j) & (mine < j + s.shape[1]))
            s[here, mine[here] - j] = -2
            if j == 0 and s.shape[1] > k:
                bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            r, c = np.nonzero(s >= bar[:, None] - 1e-6)  # equals of the k-th count, so that ties go to the smaller key
            rows.append(r)
            cols.append(c + j)
            if len(r) and j + wide < len(v):
                at = np.arange(len(r)) - np.searchsorted(r, r)
                held = np.full((len(part), k + int(at.max()) + 1), -2.0, np.float32)
                held[:, :k] = best
                held[r, k + at] = s[r, c]
                best = -np.partition(-held, k - 1, axis=1)[:, :k]
                bar = best.min(1)
        r, j = np.concatenate(rows), np.concatenate(cols)
        exact = (part[r].astype(np.float64) * v[j].astype(np.float64)).sum(1)
        keep = mine[r] != j
        r, j, exact = r[keep], j[keep], exact[keep]
        order = np.lexsort((j, -exact, r))
        r, j, exact = r[order], j[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        outs.append((i + r[place < k], j[place < k], exact[place < k]))
    return tuple(np.concatenate(x) for x in zip(*outs))


def neighbour_pairs(neighbours: DataFrame, a: str = "chain_id_a", b: str = "chain_id_b") -> DataFrame:
    """Pairs, smaller key first, in which at least one is among the other's most similar."""
    return neighbours.select(F.least("id", "neighbour").alias(a), F.greatest("id", "neighbour").alias(b)).distinct()


def exact_neighbours(v: np.ndarray, asked: np.ndarray, k: int, least: float = -1.0, step: int = 256) -> Iterator[tuple[int, int, float]]:
    """Brute force for tests and recall: the k best of each asked row."""
    for i in range(0, len(asked), step):
        s = v[asked[i : i + step]].astype(np.float64) @ v.T.astype(np.float64)
        s[np.arange(len(s)), asked[i : i + step]] = -2
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        for r, row in enumerate(order):
            for j in row:
                if s[r, j] >= least:
                    yield int(asked[i + r]), int(j), float(s[r, j])
