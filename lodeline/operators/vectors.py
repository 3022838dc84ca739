"""Vector tables: validity, centroids, similarity inside groups, exact top-k, nearest centroid.

Dense arithmetic runs in NumPy on Arrow batches; only sums, counts and small candidate lists are shuffled. Vectors
of another length than `dim`, with nulls, or all zero don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64
BLOCK_ROWS = 2048


def to_matrix(column, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(indices of valid rows, their vectors in double precision)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    index = np.flatnonzero(ok)
    values = column.take(pa.array(index)).flatten()
    if values.null_count:
        values = pc.fill_null(values, float("nan"))
    v = values.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    return index[good], v[good]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length; a zero row stays zero."""
    n = np.sqrt((v * v).sum(1))
    return v / np.where(n == 0, 1, n)[:, None]


def valid(df: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows of a key with a vector that counts."""
    return df.where((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0) & F.col("chain_id").isNotNull())


def distinct_chains(df: DataFrame, dim: int = DIM) -> DataFrame:
    """(chain_id, domain, cluster_id, paper_id, vector): one row per chain with a valid vector; the larger label wins."""
    return valid(df, dim).groupBy("chain_id").agg(F.max("domain").alias("domain"), F.max("cluster_id").alias("cluster_id"), F.max("paper_id").alias("paper_id"), F.first("vector").alias("vector"))


def centroids(df: DataFrame, keys: tuple[str, ...] = ("domain", "cluster_id"), normalise: bool = False, dim: int = DIM) -> DataFrame:
    """(keys, n, centroid): element-wise mean of each group. Partial sums are made before the shuffle."""
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    joined = df.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("k"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, v = to_matrix(b.column("vector"), dim)
            if not len(index):
                continue
            v = unit(v) if normalise else v
            groups = b.column("k").take(pa.array(index)).dictionary_encode()
            code = groups.indices.to_numpy()
            sums = np.zeros((len(groups.dictionary), dim))
            np.add.at(sums, code, v)
            yield pa.RecordBatch.from_arrays([groups.dictionary, pa.array(np.bincount(code, minlength=len(sums)), pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))], ["k", "n", "sums"])

    part = joined.mapInArrow(run, "k string, n bigint, sums array<double>").select(F.from_json("k", fields).alias("k"), "n", "sums").select("k.*", "n", "sums")
    counts = part.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim)])
    return counts.select(*keys, "n", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dim)]).alias("centroid"))


def _blocked(df: DataFrame, keys: tuple[str, ...], block_rows: int) -> DataFrame:
    """Rows of each group at every pair of blocks they belong to: no task holds more than two blocks of a group."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    rows = df.join(sizes, list(keys)).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("b"), o).alias("i"), F.greatest(F.col("b"), o).alias("j")))
    return rows.withColumn("at", F.explode(pairs)).withColumn("i", F.col("at.i")).withColumn("j", F.col("at.j")).drop("at", "blocks")


HISTOGRAM = 20_000  # bins of cosines for the median of groups of more than one block


def pair_statistics(df: DataFrame, keys: tuple[str, ...] = ("domain", "cluster_id"), key: str = "chain_id", block_rows: int = BLOCK_ROWS, dim: int = DIM) -> DataFrame:
    """(keys, n_pairs, mean, min, max, median) of the cosines of all pairs of each group.

    Pairs are taken block by block and never emitted. The median is exact for groups of one block, else it is that
    of bins of width 1e-4. Groups of one row have no pairs and null statistics.
    """
    rows = df.select(*keys, F.col(f"`{key}`").alias("id"), "vector")
    spread = _blocked(rows, keys, block_rows)

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        index, v = to_matrix(table.column("vector"), dim)
        v, block = unit(v), np.array(table.column("b").to_pylist())[index]
        n, total, low, high, counts, exact = 0, 0.0, np.inf, -np.inf, np.zeros(HISTOGRAM + 1, np.int64), []
        if i == j:
            for a in range(0, len(v), 512):
                s = v[a : a + 512] @ v.T
                s = s[np.arange(a, a + len(s))[:, None] < np.arange(len(v))[None, :]]
                if len(s):
                    n, total, low, high = n + len(s), total + s.sum(), min(low, s.min()), max(high, s.max())
                    exact.append(s)
        else:
            a, b = v[block == i], v[block == j]
            for k in range(0, len(a), 512):
                s = (a[k : k + 512] @ b.T).ravel()
                if len(s):
                    n, total, low, high = n + len(s), total + s.sum(), min(low, s.min()), max(high, s.max())
                    counts += np.bincount(np.clip(np.round((s + 1) * HISTOGRAM / 2), 0, HISTOGRAM).astype(int), minlength=HISTOGRAM + 1)
        middle = None
        if exact:
            s = np.concatenate(exact)
            middle = float(np.median(s))
            counts += np.bincount(np.clip(np.round((s + 1) * HISTOGRAM / 2), 0, HISTOGRAM).astype(int), minlength=HISTOGRAM + 1)
        used = np.flatnonzero(counts)
        one = {k: pa.array([table.column(k)[0].as_py()], table.schema.field(k).type) for k in keys}
        return pa.table({**one, "n": pa.array([n], pa.int64()), "total": pa.array([float(total)]), "low": pa.array([float(low) if n else None], pa.float64()), "high": pa.array([float(high) if n else None], pa.float64()), "middle": pa.array([middle], pa.float64()), "bins": pa.array([used.tolist()], pa.list_(pa.int32())), "counts": pa.array([counts[used].tolist()], pa.list_(pa.int64()))})

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    parts = spread.groupBy(*keys, "i", "j").applyInArrow(run, f"{fields}, n bigint, total double, low double, high double, middle double, bins array<int>, counts array<bigint>")
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n_pairs"), F.sum("total").alias("total"), F.min("low").alias("min"), F.max("high").alias("max"), F.count("*").alias("parts"), F.first("middle", ignorenulls=True).alias("middle"), F.flatten(F.collect_list(F.arrays_zip("bins", "counts"))).alias("hist"))

    @F.pandas_udf("double")
    def middle_of(hist, n):
        out = []
        for h, total in zip(hist, n):
            counts = np.zeros(HISTOGRAM + 1, np.int64)
            for x in h if h is not None else ():
                counts[x["bins"]] += x["counts"]
            run_ = counts.cumsum()
            at = [int(np.searchsorted(run_, k, side="right")) for k in ((total - 1) // 2, total // 2)]
            out.append((at[0] + at[1]) / HISTOGRAM - 1 if total else None)
        import pandas as pd

        return pd.Series(out, dtype="float64")

    mean = F.when(F.col("n_pairs") > 0, F.col("total") / F.col("n_pairs")).alias("mean")
    single = sums.where("parts = 1").select(*keys, "n_pairs", mean, "min", "max", F.col("middle").alias("median"))
    many = sums.where("parts > 1").select(*keys, "n_pairs", mean, "min", "max", middle_of("hist", "n_pairs").alias("median"))
    return single.unionByName(many)


def top_k(df: DataFrame, query: list[float], k: int, metric: str = "cosine", key: str = "chain_id", where: str | None = None, dim: int = DIM) -> DataFrame:
    """(id, distance, similarity): the k rows nearest to one query vector; ties by id.

    Every partition keeps its own k best before the final sort. cosine: 1 - cos, similarity 1 - d/2; l2: euclidean,
    similarity 1 / (1 + d). The query is aligned to `dim`.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    q = np.array(aligned(query, dim), np.float64)
    rows = df.where(where) if where else df
    rows = rows.select(F.col(f"`{key}`").cast("string").alias("id"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_id, best_d = np.array([], object), np.array([])
        for b in batches:
            index, v = to_matrix(b.column("vector"), dim)
            if not len(index):
                continue
            d = 1 - unit(v) @ unit(q[None])[0] if metric == "cosine" else np.sqrt(((v - q) ** 2).sum(1))
            ids = np.array(b.column("id").take(pa.array(index)).to_pylist(), object)
            ids, d = np.concatenate([best_id, ids]), np.concatenate([best_d, d])
            order = np.lexsort((ids.astype(str), np.round(d, 12)))
            seen, keep = set(), []
            for i in order:
                if ids[i] not in seen:
                    seen.add(ids[i])
                    keep.append(i)
                if len(keep) == k:
                    break
            best_id, best_d = ids[keep], d[keep]
        yield pa.RecordBatch.from_arrays([pa.array(best_id.tolist(), pa.string()), pa.array(best_d, pa.float64())], ["id", "distance"])

    best = rows.mapInArrow(run, "id string, distance double").groupBy("id").agg(F.min("distance").alias("distance"))
    best = best.orderBy("distance", "id").limit(k)
    return best.withColumn("similarity", similarity(F.col("distance"), metric))


def similarity(distance, metric: str = "cosine"):
    """A distance as a score from 0 to 1."""
    s = 1 - distance / 2 if metric in ("cosine", "cos") else 1 / (1 + distance)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def aligned(vector: list[float], dim: int) -> list[float]:
    """Cut or filled with zeros to `dim` values."""
    return [float(x) for x in vector[:dim]] + [0.0] * max(0, dim - len(vector)) if dim > 0 else list(vector)


CENTROID_LIMIT = 200_000


def nearest_centroid(rows: DataFrame, centres: DataFrame, key: str = "chain_id", within: str | None = "domain", dim: int = DIM) -> DataFrame:
    """(key, best columns of centres, similarity): the centroid of greatest cosine for each row, inside `within`.

    Centroids travel in blocks of at most CENTROID_LIMIT rows, one pass for each; ties go to the smaller label.
    `centres` has (within, cluster_id, centroid).
    """
    spark = rows.sparkSession
    total = centres.count()
    blocks = max(1, -(-total // CENTROID_LIMIT))
    found = None
    for n in range(blocks):
        part = centres.where(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)) == n).orderBy("cluster_id").collect()
        by: dict = {}
        for r in part:
            by.setdefault(r[within] if within else None, []).append((r["cluster_id"], r["centroid"]))
        held = spark.sparkContext.broadcast({k: (np.array([x[0] for x in v]), unit(np.array([x[1] for x in v], np.float64))) for k, v in by.items()})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                index, v = to_matrix(b.column("vector"), dim)
                v = unit(v)
                ids = b.column("id").take(pa.array(index)).to_pylist()
                names = b.column("w").take(pa.array(index)).to_pylist()
                out: list[tuple] = []
                groups: dict = {}
                for i, w in enumerate(names):
                    groups.setdefault(w, []).append(i)
                for w, at in groups.items():
                    got = held.value.get(w if within else None)
                    if got is None:
                        continue
                    for i in range(0, len(at), 2048):
                        s = v[at[i : i + 2048]] @ got[1].T
                        for r, c in zip(at[i : i + 2048], s.argmax(1)):
                            out.append((ids[r], w, int(got[0][c]), float(v[r] @ got[1][c])))
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.float64()))], ["id", "w", "cluster_id", "similarity"])

        w = F.col(within).cast("string") if within else F.lit(None).cast("string")
        one = rows.select(F.col(f"`{key}`").cast("string").alias("id"), w.alias("w"), "vector").mapInArrow(run, "id string, w string, cluster_id int, similarity double")
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("id").agg(F.max_by(F.struct("w", "cluster_id", "similarity"), F.struct("similarity", -F.col("cluster_id"))).alias("m")).select("id", "m.*")
    return found.select(F.col("id").alias(key), F.col("w").alias(within or "within"), "cluster_id", "similarity")


def similar_pairs_split(df: DataFrame, least: float = 0.85, keys: tuple[str, ...] = ("domain", "cluster_id"), block_rows: int = 4 * BLOCK_ROWS, dim: int = DIM) -> DataFrame:
    """(pairs, split): all pairs with cosine >= least, and how many of them lie in different groups. Exact, so quadratic.

    Every pair of blocks meets in one task, which holds no more than the two; pairs are counted and never emitted.
    """
    rows = df.select(F.lit(0).alias("all"), F.col("chain_id").alias("id"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("g"), "vector")

    def count(table: pa.Table) -> pa.Table:
        index, v = to_matrix(table.column("vector"), dim)
        v, block = unit(v), np.array(table.column("b").to_pylist())[index]
        _, code = np.unique(np.array(table.column("g").to_pylist(), object)[index].astype(str), return_inverse=True)
        low, high = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        pairs = split = 0
        for k in range(0, len(a), 512):
            x, y = np.nonzero(v[a[k : k + 512]] @ v[b].T >= least)
            x, y = a[x + k], b[y]
            keep = x < y if low == high else np.ones(len(x), bool)
            pairs += int(keep.sum())
            split += int((code[x[keep]] != code[y[keep]]).sum())
        return pa.table({"pairs": pa.array([pairs], pa.int64()), "split": pa.array([split], pa.int64())})

    met = _blocked(rows, ("all",), block_rows).groupBy("i", "j").applyInArrow(count, "pairs bigint, split bigint")
    return met.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("split"), F.lit(0)).alias("split"))


def align(vector: Column, dim: int) -> Column:
    """A vector column cut or filled with zeros to `dim` values; null counts as empty."""
    kind = F.array().cast("array<float>")
    return F.slice(F.concat(F.coalesce(vector, kind), F.array_repeat(F.lit(0).cast("float"), dim)), 1, dim)


def width(df: DataFrame, vector: str = "vector") -> int:
    """The one number of values that all vectors have; none or several are an error."""
    sizes = [r.n for r in df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).distinct().limit(2).collect()]
    if len(sizes) != 1 or sizes[0] <= 0:
        raise ValueError("vectors of one length are needed")
    return sizes[0]
