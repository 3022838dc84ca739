"""Routing of vectors to cells of bounded size, so that near vectors meet in one task.

An index of centroids is fitted on a bounded sample (`sample_rows`, a documented parameter); every row is then
routed: it lives in the cell of its nearest centroid and asks the cells whose centroids are nearly as near. Cells
that are too large in the sample are split; what can't be split, because the rows are alike, is spread over
blocks, and askers visit all blocks. No row is dropped or capped. `most=None` is the exact way: every row asks every
cell.

A vector that is stored more than HOT_COPIES times travels once, with the number of its ids (`set_apart`); its other
ids are told the result of the one.

A vector counts if it has `dim` finite values that aren't all zero. Rows of one key count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tables import staged

CELL_ROWS = 2000
BLOCK_ROWS = 16_000
SAMPLE_ROWS, MOST_SAMPLE_ROWS = 20_000, 200_000
HOT_COPIES, MOST_HOT = 2000, 1_000_000
SCORES_AT_ONCE = 4_000_000  # so many products of rows and centroids are held at once
DIM = 64


def matrix(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(indices of valid rows, their vectors of unit length as float32)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    index = np.flatnonzero(ok)
    values = column.take(pa.array(index)).flatten()
    if values.null_count:
        values = pc.fill_null(values, float("nan"))
    v = values.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        top = np.abs(v).max(1, initial=0)
        good = np.isfinite(v).all(1) & (top > 0)
        index, v, top = index[good], v[good], top[good]
        v = v / top[:, None]
        v /= np.sqrt((v * v).sum(1))[:, None]
    return index, v.astype(np.float32)


def vectors(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(id, vector, more) with null keys left out; nothing else is read."""
    return df.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{vector}`").alias("vector"), *[F.col(f"`{m}`") for m in more]).where("id is not null and vector is not null")


def hash_share(column: str, share: float):
    """Whether a key's hash falls into the first `share` of all hashes: a sample that no task has to sort for."""
    return F.xxhash64(column) < F.lit(int(-(2**63) + min(1.0, share) * (2**64 - 2048)))


def sample(rows: DataFrame, n: int, total: int, dim: int = DIM) -> np.ndarray:
    """Unit vectors of about n of `total` rows, chosen by key hash, one for each key; all if there are no more."""
    share = 1.0 if total <= n else 1.1 * n / total
    got = rows.where((F.size("vector") == dim) & hash_share("id", share)).select("id", "vector").toArrow()
    ids = np.array(got.column("id").to_pylist(), dtype=object)
    index, v = matrix(got.column("vector"), dim)
    if not len(index):
        return v
    _, first = np.unique(ids[index].astype(str), return_index=True)
    return v[first[np.random.default_rng(1).permutation(len(first))]][: int(n)]


def drawn_sample(rows: DataFrame, total: int, sample_rows: int, cell_rows: int, dim: int) -> np.ndarray:
    """A sample of sample_rows, or of eight rows a cell up to MOST_SAMPLE_ROWS if that is more; never empty."""
    v = sample(rows, max(sample_rows, min(MOST_SAMPLE_ROWS, 8 * (total // cell_rows))), total, dim)
    return v if len(v) else np.full((1, dim), dim**-0.5, np.float32)


@dataclass
class Apart:
    """Rows to be routed, with n ids each, and the copies that were set apart."""

    rows: DataFrame
    members: DataFrame | None = None  # (id, rep, other columns): every id of a hot vector
    firsts: DataFrame | None = None  # (rep, id): the smallest ids of a hot vector


def set_apart(rows: DataFrame, total: int, hot: int = HOT_COPIES, firsts: int = 6) -> Apart:
    """A vector stored more than `hot` times is one row, under its smallest id; there are at most MOST_HOT such vectors.

    Counts go by a hash of the vector and are combined before the shuffle; ids of a hot vector are spread by id.
    """
    counts = rows.groupBy(F.xxhash64("vector").alias("h")).count()
    found = [(r.h,) for r in counts.where(F.col("count") > max(hot, total // MOST_HOT)).select("h").collect()]
    if not found:
        return Apart(rows.withColumn("n", F.lit(1).cast("bigint")))
    spark = rows.sparkSession
    known = F.broadcast(spark.createDataFrame(found, "h long"))
    tagged = rows.withColumn("h", F.xxhash64("vector"))
    other = [c for c in rows.columns if c not in ("id", "vector")]
    members = staged(tagged.join(known, "h").groupBy("h", "id").agg(F.max(F.struct(*other)).alias("o") if other else F.lit(0).alias("o")).select("h", "id", *[f"o.{c}" for c in other]), "copies")
    reps = members.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    vectors_ = tagged.join(known, "h").groupBy("h").agg(F.first("vector").alias("vector"))
    one = reps.join(vectors_, "h").join(members.withColumnRenamed("id", "rep"), ["h", "rep"]).select(F.col("rep").alias("id"), "vector", *other, "n")
    rest = tagged.join(known, "h", "left_anti").select("id", "vector", *other, F.lit(1).cast("bigint").alias("n"))
    place = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    small = members.select("h", "id").withColumn("place", place).where(F.col("place") <= firsts).join(F.broadcast(reps.select("h", "rep")), "h").select("rep", "id")
    return Apart(rest.select(*one.columns).unionByName(one), members.join(F.broadcast(reps.select("h", "rep")), "h").drop("h"), small)


def kmeans(v: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k centroids of unit length (spherical); empty ones are dropped."""
    rng = np.random.default_rng(seed)
    k = min(k, len(v))
    if k <= 1:
        c = v.mean(0, keepdims=True) if len(v) else np.zeros((1, v.shape[1]), np.float32)
        return (c / max(1e-12, np.linalg.norm(c))).astype(np.float32)
    c = v[rng.choice(len(v), k, replace=False)]
    for _ in range(rounds):
        own = nearest(v, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        size = np.linalg.norm(sums, axis=1)
        c = (sums[size > 1e-9] / size[size > 1e-9, None]).astype(np.float32)
    return c


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(16, min(4096, SCORES_AT_ONCE // max(1, len(c))))
    return np.concatenate([(v[i : i + step] @ c.T).argmax(1) for i in range(0, len(v), step)]) if len(v) else np.zeros(0, np.int64)


@dataclass
class Cells:
    """Centroids and the number of blocks of each cell."""

    centroids: np.ndarray
    blocks: np.ndarray

    def route(self, v: np.ndarray, hashes: np.ndarray, margin: float, most: int | None, home: np.ndarray | None = None, also: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(row, cell, block, own): where each row lives (own) and where else it asks: the `most` nearest cells within the margin, or all cells, and the cells of `also` (-1 for none)."""
        k = len(self.centroids)
        margin, most = (np.inf, k) if most is None else (margin, min(most, k))
        step = max(16, min(2048, SCORES_AT_ONCE // k))
        outs = []
        for i in range(0, len(v), step):
            s = v[i : i + step] @ self.centroids.T
            n = len(s)
            near = np.argpartition(s, k - most, axis=1)[:, k - most :] if most < k else np.broadcast_to(np.arange(k), (n, k))
            near_s = np.take_along_axis(s, near, 1)
            own = s.argmax(1) if home is None else home[i : i + step]
            ask = (near_s >= s.max(1)[:, None] - margin) & (near != own[:, None])
            r, j = np.nonzero(ask)
            asked = near[r, j]
            if also is not None:
                more = also[i : i + step]
                r2, j2 = np.nonzero((more >= 0) & (more != own[:, None]))
                pair = np.unique(np.concatenate([r * k + asked, r2 * k + more[r2, j2]]))
                r, asked = pair // k, pair % k
            rows = np.concatenate([np.arange(n), r]) + i
            cells = np.concatenate([own, asked])
            outs.append((rows, cells, np.concatenate([np.ones(n, bool), np.zeros(len(r), bool)])))
        if not outs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        rows, cells, own = (np.concatenate(x) for x in zip(*outs))
        block = np.where(own, hashes[rows] % self.blocks[cells], 0)
        if (self.blocks > 1).any():  # askers, and residents of another block, visit all blocks
            many = np.flatnonzero(self.blocks[cells] > 1)
            times = self.blocks[cells[many]]
            again = np.repeat(many, times)
            b = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, np.int64)
            extra = ~own[again] & (b > 0) | own[again] & (b != block[again])
            rows = np.concatenate([rows, rows[again[extra]]])
            cells = np.concatenate([cells, cells[again[extra]]])
            block = np.concatenate([block, b[extra]])
            own = np.concatenate([own, np.zeros(int(extra.sum()), bool)])
        return rows, cells, block, own


def fit_cells(v: np.ndarray, total: int, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, branch: int = 256) -> Cells:
    """An index for `total` rows from a sample v: about total / cell_rows cells, none above twice its share, found by splitting into at most `branch` parts at a time."""
    if not len(v):
        return Cells(np.ones((1, DIM), np.float32) / 8, np.ones(1, np.int64))
    share = len(v) / max(total, len(v))  # of all rows in the sample
    want = max(8, int(cell_rows * share))
    done, todo = [], [v]
    first = True
    while todo:
        part = todo.pop()
        k = max(1 if first else 2, min(branch, round(len(part) / want), len(part) // 8 or 1))
        c = kmeans(part, k, seed=5 + len(done))
        own = nearest(part, c)
        first = False
        for i in range(len(c)):
            mine = part[own == i]
            alike = len(c) == 1 or len(mine) and float((mine @ c[i]).mean()) > 0.985
            if len(mine) > 2 * want and not alike and len(mine) < len(part):
                todo.append(mine)
            elif len(mine):
                m = mine.mean(0)
                done.append((m / max(1e-12, np.linalg.norm(m)), max(1, int(np.ceil(len(mine) / share / max(block_rows, 2 * cell_rows))))))
    return Cells(np.array([d[0] for d in done], np.float32), np.array([d[1] for d in done], np.int64))


def hash_ids(ids: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh32_intdigest(x) for x in ids.to_pylist()], np.int64)


ROUTED = "cell int, block int, own boolean, id string, v binary"


def routed(rows: DataFrame, cells: Cells, margin: float, most: int | None, dim: int = DIM) -> DataFrame:
    """(cell, block, own, id, v): every row where it lives and where it asks; v is the unit vector as float32."""
    held = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, v = matrix(b.column("vector"), dim)
            if not len(index):
                continue
            ids = b.column("id").take(pa.array(index))
            r, c, k, own = held.value.route(v, hash_ids(ids), margin, most)
            for i in range(0, len(r), 20_000):
                at = pa.array(r[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], pa.int32()), pa.array(k[i : i + 20_000], pa.int32()), pa.array(own[i : i + 20_000]), ids.take(at), packed(v[r[i : i + 20_000]])], ["cell", "block", "own", "id", "v"])

    return rows.select("id", "vector").mapInArrow(run, ROUTED)


def packed(v: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as binary values."""
    v = np.ascontiguousarray(v, np.float32)
    width = v.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer((np.arange(len(v) + 1) * width).astype(np.int32)), pa.py_buffer(v.tobytes())])


def unpacked(column, dim: int = DIM) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([unpacked(c, dim) for c in column.chunks]) if column.num_chunks else np.zeros((0, dim), np.float32)
    offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offset[0] : offset[-1]].view(np.float32).reshape(-1, dim)


class Group:
    """One cell's rows: residents and askers, each key once."""

    def __init__(self, table: pa.Table, dim: int = DIM):
        ids = table.column("id").to_pylist()
        own = np.array(table.column("own").to_pylist(), bool)
        v = unpacked(table.column("v"), dim)
        seen: dict[str, int] = {}
        for i in np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)]):
            seen.setdefault(ids[i], int(i))
        here = [i for i in seen.values() if own[i]]
        here.sort(key=ids.__getitem__)
        ask = [i for i in seen.values() if not own[i]]
        self.ids, self.v = [ids[i] for i in here], v[here]
        self.ask_ids, self.ask_v = [ids[i] for i in ask], v[ask]
        self.rows_here, self.rows_ask = here, ask
