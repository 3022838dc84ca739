"""Clusters of vectors: constrained linkage, two-stage clustering, quality, selection, metadata, assignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import md_path, xml_path
from ..plans.tables import staged
from . import vectors as vx

EXACT_ROWS = 4096
MOST_MEANS, CELL_ROWS = 3000, 2048  # centres that travel to all tasks; rows of a cell, on average, as long as that many cells are enough


def constrained_linkage(v: np.ndarray, max_size: int = 50, least: float = 0.45, weights: np.ndarray | None = None) -> np.ndarray:
    """Labels 0, 1, ... of complete linkage in which no group outweighs max_size and no pair inside is below `least`.

    The most similar pair of groups merges first, the pair of smallest numbers among equals. The matrix of
    similarities shrinks to the least one of merged rows; each row's best partner is kept, so a merge costs one pass
    over the rows that lost theirs.
    """
    n = len(v)
    if n == 0:
        raise ValueError("no vectors")
    u = vx.unit(np.asarray(v, np.float64)).astype(np.float32)
    s = np.clip(u @ u.T, -1, 1)
    np.fill_diagonal(s, -2)
    weight = np.maximum(np.ones(n, np.int64) if weights is None else np.asarray(weights, np.int64), 1)
    if len(weight) != n:
        raise ValueError("as many weights as vectors are needed")
    for i in np.flatnonzero(weight > max_size - weight.max()):
        s[i, weight[i] + weight > max_size] = -2
    owner, best, top = np.arange(n), s.argmax(1), s.max(1)
    while True:
        i = int(top.argmax())
        if top[i] < least:
            break
        j = int(best[i])
        if weight[i] + weight[j] > max_size:
            s[i, j] = s[j, i] = -2  # groups only grow, so this pair is out for good
            changed = [i, j]
        else:
            i, j = min(i, j), max(i, j)
            low = np.minimum(s[i], s[j])
            s[i], s[:, i] = low, low
            s[j], s[:, j] = -2, -2
            s[i, i] = -2
            weight[i] += weight[j]
            owner[owner == j] = i
            top[j] = -2
            changed = np.flatnonzero(((best == i) | (best == j)) & (top > -2)).tolist() + [i]
        for r in changed:
            best[r] = s[r].argmax()
            top[r] = s[r, best[r]]
    return np.unique(owner, return_inverse=True)[1].astype(np.int32)


def linkage_by_component(v: np.ndarray, max_size: int = 50, least: float = 0.45, step: int = 1024) -> np.ndarray:
    """The labels of constrained_linkage, taken in each component of pairs from `least` on: no merge crosses components."""
    n = len(v)
    u = vx.unit(np.asarray(v, np.float64)).astype(np.float32)
    component, todo, c = np.full(n, -1), [], 0
    for start in range(n):
        if component[start] >= 0:
            continue
        component[start], todo = c, np.array([start])
        while len(todo):
            at, todo = todo[:step], todo[step:]
            free = np.flatnonzero(component < 0)
            new = free[(u[free] @ u[at].T).max(1) >= least - 1e-5] if len(free) else free
            component[new] = c
            todo = np.concatenate([todo, new])
        c += 1
    owner = np.arange(n)
    for rows in np.split(np.argsort(component, kind="stable"), np.cumsum(np.bincount(component))[:-1]) if n else []:
        if len(rows) > 1:
            label = constrained_linkage(v[rows], max_size, least)
            owner[rows] = rows[np.unique(label, return_index=True)[1]][label]
    return np.unique(owner, return_inverse=True)[1].astype(np.int32)


def linkage_within(df: DataFrame, keys: tuple[str, ...], max_size: int = 50, least: float = 0.45, key: str = "chain_id", dim: int = vx.DIM) -> DataFrame:
    """(keys, key, label): constrained linkage inside each whole group; the matrix is that of the largest component of near pairs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        index, v = vx.to_matrix(table.column("vector"), dim)
        return table.take(pa.array(index)).select([*keys, key]).append_column("label", pa.array(linkage_by_component(v, max_size, least), pa.int32()))

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in (*keys, key))
    return df.select(*keys, key, "vector").groupBy(*keys).applyInArrow(run, f"{fields}, label int")


def _kmeans_model(rows: DataFrame, k: int, seed: int, rounds: int):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # one step draws about 2k candidates; for a small k that may be fewer than k
    return KMeans(k=k, seed=seed, maxIter=rounds, initSteps=1 if k >= 100 else 5, featuresCol="features").fit(rows.select(array_to_vector("vector").alias("features")))


def kmeans(rows: DataFrame, k: int, key: str = "chain_id", seed: int = 42, rounds: int = 20) -> DataFrame:
    """(key, label) by k-means over all rows."""
    from pyspark.ml.functions import array_to_vector

    model = _kmeans_model(rows, k, seed, rounds)
    return model.transform(rows.select(key, array_to_vector("vector").alias("features"))).select(key, F.col("prediction").alias("label"))


def small_clusters(rows: DataFrame, micro: int | None = None, key: str = "chain_id", seed: int = 42, rounds: int = 8) -> tuple[DataFrame, list | DataFrame] | None:
    """((key, micro), their centres and sizes): many small clusters by k-means over all rows; none of no rows. They depend on no threshold.

    There are as many as one for 15 rows, however many rows: if they were fewer, they would be larger than the limit that
    linkage keeps, and it would join none. Beyond MOST_MEANS of them, the rows are cut into cells by k-means first and
    each cell into small clusters, and the centres are a table instead of a list.
    """
    rows = staged(rows.select(key, "vector"), "rows")
    n = rows.count()
    if n == 0:
        return None
    want = max(2, min(micro or max(500, n // 15), n))
    if want > MOST_MEANS:
        return _small_by_cell(rows, want / n, n, key, seed, rounds)
    centres = many_means(rows, want, key, seed, rounds)
    small = staged(rows.mapInArrow(_nearest_of(rows, centres, key), f"{key} {rows.schema[key].dataType.simpleString()}, micro int"), "micro")
    at, count, mean = _means(rows, centres)
    return small, [Row(micro=int(i), n=int(m), centroid=c) for i, m, c in zip(at, count, mean)]


def _small_by_cell(rows: DataFrame, share: float, n: int, key: str, seed: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """small_clusters, one for 1 / share rows, made in the tasks: each has the rows of a cell."""
    cells = many_means(rows, max(2, min(MOST_MEANS, n // CELL_ROWS)), key, seed, rounds)
    at, count, _ = _means(rows, cells)
    asked = np.ones(len(cells), np.int64)
    asked[at] = np.ceil(count * share).astype(np.int64)
    first = np.cumsum(asked) - asked
    kind = rows.schema[key].dataType.simpleString()
    vector = rows.schema["vector"].dataType.simpleString()

    def divide(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        c = table.column("micro")[0].as_py()
        _, v = vx.to_matrix(table.column("vector"))  # the rows of a cell are valid
        label, mean, size = divided(v.astype(np.float32), int(asked[c]), np.random.default_rng([seed, c]), rounds)
        # the centre of a small cluster comes with its first row
        _, head = np.unique(label, return_index=True)
        held = np.full(len(v), -1)
        held[head] = np.arange(len(head))
        has = pa.array(held, mask=held < 0)
        return pa.table([table.column(key), pa.array(first[c] + label, pa.int32()), pa.array(size).take(has), pa.array(list(mean), pa.list_(pa.float32())).take(has)], ["key", "micro", "n", "centroid"])

    held = rows.mapInArrow(_nearest_of(rows, cells, key, ("vector",)), f"{key} {kind}, micro int, vector {vector}")
    made = staged(held.groupBy("micro").applyInArrow(divide, "key " + kind + ", micro int, n bigint, centroid array<float>"), "micro")
    return made.select(F.col("key").alias(key), "micro"), made.where("n IS NOT NULL").select("micro", "n", "centroid")


def divided(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8, most: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, means, sizes) of at most k clusters of rows by k-means; for more than `most`, in parts that are clusters themselves."""
    if k > most:
        part, mean, size = divided(v, min(most, -(-k // 128)), rng, rounds, most)
        if len(mean) > 1:
            label, means, sizes, at = np.zeros(len(v), np.int64), [], [], 0
            for i in range(len(mean)):
                rows = np.flatnonzero(part == i)
                own, m, z = divided(v[rows], max(1, k * len(rows) // len(v)), rng, rounds, most)
                label[rows] = at + own
                at += len(m)
                means.append(m)
                sizes.append(z)
            return label, np.concatenate(means), np.concatenate(sizes)
        return part, mean, size
    chosen = _far_rows(v, np.ones(len(v)), k, rng)
    centres = v[chosen]
    for i in range(rounds + 1):
        half = (centres * centres).sum(1) / 2
        at = np.concatenate([(v[j : j + 4096] @ centres.T - half).argmax(1) for j in range(0, len(v), 4096)])
        some, label, size = np.unique(at, return_inverse=True, return_counts=True)
        order = np.argsort(label, kind="stable")
        mean = np.add.reduceat(v[order].astype(np.float64), np.cumsum(size) - size, axis=0) / size[:, None]
        moved = np.sqrt(((centres[some] - mean) ** 2).sum(1)).max()
        if i == rounds or moved <= 1e-4:
            break
        centres = mean.astype(v.dtype)
    return label, mean.astype(np.float32), size


def _nearest_of(rows: DataFrame, centres: np.ndarray, key: str | None, also: tuple[str, ...] = ()):
    """A step over batches: (key, number of the nearest centre, also) of each row, or without a key (centre, rows, their sum) of each partition."""
    x = centres.astype(np.float32)
    held = rows.sparkSession.sparkContext.broadcast((x, (x * x).sum(1) / 2))
    k, dim = centres.shape

    def nearest(v: np.ndarray) -> np.ndarray:
        c, half = held.value
        v = v.astype(np.float32)
        return np.concatenate([(v[i : i + 512] @ c.T - half).argmax(1) for i in range(0, len(v), 512)] or [np.zeros(0, np.int64)])

    def label(batches):
        for b in batches:
            index, v = vx.to_matrix(b.column("vector"), dim)
            kept = [b.column(c).take(pa.array(index)) for c in (key, *also)]
            yield pa.RecordBatch.from_arrays([kept[0], pa.array(nearest(v), pa.int32()), *kept[1:]], [key, "micro", *also])

    def add(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dim))
        for b in batches:
            _, v = vx.to_matrix(b.column("vector"), dim)
            at = nearest(v)
            order = np.argsort(at, kind="stable")
            some, first = np.unique(at[order], return_index=True)
            n += np.bincount(at, minlength=k)
            if len(some):
                total[some] += np.add.reduceat(v[order], first, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["label", "n", "s"])

    return label if key else add


def _means(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, counts, means) of the centres that are the nearest of any row; sums are made where the rows are."""
    parts = rows.select("vector").mapInArrow(_nearest_of(rows, centres, None), "label int, n bigint, s array<double>")
    dim = centres.shape[1]
    got = parts.groupBy("label").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(dim)]).orderBy("label").toArrow()
    n = got.column("n").to_numpy()
    return got.column("label").to_numpy(), n, np.column_stack([got.column(f"s{i}").to_numpy() for i in range(dim)]) / n[:, None]


def _far_rows(v: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """k rows far from each other, drawn by weight and squared distance; fewer if copies of them are all that is left."""
    square = (v * v).sum(1)
    chosen, far = [], weight.astype(float)
    while len(chosen) < k and far.sum() > 0:
        i = int(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), side="right"))
        i = min(i, int(np.flatnonzero(far)[-1]))
        chosen.append(i)
        d = np.maximum(square + square[i] - 2 * v @ v[i], 0)
        d[d < (1e-12 if v.dtype == np.float64 else 1e-6 * square[i])] = 0
        far = np.minimum(far, weight * d) if len(chosen) > 1 else weight * d
    return chosen


def many_means(rows: DataFrame, k: int, key: str = "chain_id", seed: int = 42, rounds: int = 8, least: float = 1e-4) -> np.ndarray:
    """The centres of k-means over all rows for many clusters, by dense products.

    Begins as k-means in parallel does: 2k rows drawn by hash, weighed by the rows nearest to each, of which k are chosen
    far from each other. Ends when no centre moves by more than `least`.
    """
    drawn = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(2 * k).select("vector").toArrow()
    _, drawn = vx.to_matrix(drawn.column("vector"))
    at, weight, _ = _means(rows, drawn)
    drawn, rng = drawn[at], np.random.default_rng(seed)
    chosen = _far_rows(drawn, weight, k, rng)
    centres = drawn[chosen]
    for _ in range(rounds):
        at, _, mean = _means(rows, centres)
        moved = np.sqrt(((centres[at] - mean) ** 2).sum(1)).max()
        centres[at] = mean
        if moved <= least:
            break
    return centres


def merged_clusters(small: tuple[DataFrame, list | DataFrame], max_size: int = 50, least: float = 0.45, key: str = "chain_id") -> DataFrame:
    """(key, label): constrained linkage of the centres of small clusters, weighed by size."""
    return merged_at(small, max_size, [least], key)(least)


def merged_at(small: tuple[DataFrame, list | DataFrame], max_size: int, levels: list[float], key: str = "chain_id"):
    """merged_clusters for each of several rising thresholds, as a function of the threshold; a table of centres is linked once for all."""
    labels, centres = small
    if isinstance(centres, DataFrame):
        held = staged(linked_centres(centres, max_size, levels), "linked")
        return lambda least: labels.join(held.select("micro", F.get("labels", F.lit(levels.index(least))).alias("label")), "micro").select(key, "label")

    def at(least: float) -> DataFrame:
        merged = constrained_linkage(np.array([c.centroid for c in centres]), max_size, least, np.array([c.n for c in centres]))
        ways = labels.sparkSession.createDataFrame([(c.micro, int(m)) for c, m in zip(centres, merged)], "micro int, label int")
        return labels.join(F.broadcast(ways), "micro").select(key, "label")

    return at


def _least_of(s: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of each group of consecutive rows; groups are small."""
    out = s[first]
    for k in range(1, int(size.max())):
        g = np.flatnonzero(size > k)
        out[g] = np.minimum(out[g], s[first[g] + k])
    return out


def linkage_at(v: np.ndarray, max_size: int, levels: list[float], weights: np.ndarray, cells: int = 1 << 23) -> np.ndarray:
    """(levels, rows): for each of the rising thresholds the first row of each row's group by constrained_linkage, without a matrix of all pairs.

    Groups that are each other's best partner merge at once: a merged group is to no third one more similar than its parts
    are, so no other merge comes between. What merges above a threshold doesn't depend on it, so one tree serves all.
    """
    n, least = len(v), levels[0]
    u = vx.unit(np.asarray(v, np.float64)).astype(np.float32)
    into, height = np.arange(n), np.full(n, -2.0, np.float32)
    rows = np.arange(n)  # in the order of their groups
    root, size, weight = np.arange(n), np.ones(n, np.int64), np.maximum(np.asarray(weights, np.int64), 1)
    best, top, stale = np.zeros(n, np.int64), np.full(n, 2.0, np.float32), np.ones(n, bool)
    while len(root) > 1:
        first = np.cumsum(size) - size
        x, plain = u[rows], bool((size == 1).all())
        todo, i = np.flatnonzero(stale), 0
        while i < len(todo):
            some = todo[i : i + max(1, int(np.searchsorted(np.cumsum(size[todo[i:]]), cells // len(rows), side="right")))]
            i += len(some)
            m = np.concatenate([np.arange(first[g], first[g] + size[g]) for g in some])
            s = x @ x[m].T
            if not plain:  # least over the rows of a group, then over those of the other
                s = _least_of(_least_of(s, first, size).T, np.cumsum(size[some]) - size[some], size[some])
            else:
                s = s.T
            s = np.clip(s, -1, 1, order="C")
            np.putmask(s, weight[some][:, None] > max_size - weight, -2)
            s[np.arange(len(some)), some] = -2
            best[some] = s.argmax(1)
            top[some] = s[np.arange(len(some)), best[some]]
        at = np.arange(len(root))
        near = top >= least
        if not near.any():
            break
        pair = near & (best[best] == at) & (at < best)
        if not pair.any():  # equal but for rounding: the most similar pair of all
            i = int(top.argmax())
            lo, hi = np.array([min(i, best[i])]), np.array([max(i, best[i])])
            h = top[[i]]
        else:
            lo, hi = at[pair], best[pair]
            h = np.minimum(top[lo], top[hi])
        merged = np.zeros(len(root), bool)
        merged[lo] = merged[hi] = True
        into[root[hi]], height[root[hi]] = root[lo], h
        weight[lo] += weight[hi]
        # a group without partner is nobody's partner; groups without partner and those that went are left out
        stale = merged | merged[best]
        keep = near.copy()
        keep[lo], keep[hi] = True, False
        to = np.where(keep, np.cumsum(keep) - 1, -1)
        to[hi] = to[lo]
        owner = np.repeat(to, size)
        order = np.argsort(owner, kind="stable")
        order = order[owner[order] >= 0]
        rows, size = rows[order], np.bincount(owner[order], minlength=int(keep.sum()))
        best, top, stale = to[best[keep]], top[keep], stale[keep]
        stale |= best < 0
        root, weight = root[keep], weight[keep]
    out = np.zeros((len(levels), n), np.int64)
    for i, t in enumerate(levels):
        to = np.where(height >= t, into, np.arange(n))
        while (to[to] != to).any():
            to = to[to]
        out[i] = to
    return out


def _own_parts(u: np.ndarray, least: float, step: int = 256) -> np.ndarray:
    """For each unit vector the first one of its component of pairs from `least` on."""
    part = np.arange(len(u))
    for i in range(0, len(u), step):
        for row in u[i : i + step] @ u.T >= least:
            met = part[row]
            if len(met) > 1 and (met != met[0]).any():
                met = np.unique(met)
                part[np.isin(part, met)] = met[0]
    return part


def linked_centres(centres: DataFrame, max_size: int, levels: list[float], block_rows: int | None = None) -> DataFrame:
    """(micro, labels): linkage of all centres at each of the rising thresholds, equal to that of constrained_linkage but for ties; a label is the first of its small clusters.

    No merge crosses components of pairs from the first threshold on. These are found block by block and pair of blocks
    by pair of blocks; then each component is linked in one task, whatever its cells. centres: (micro, n, centroid).
    """
    spark, least = centres.sparkSession, levels[0] - 1e-5
    alone = f"n >= {int(max_size)}"  # such a one joins none
    light = centres.where(f"NOT ({alone})")
    n, end_at = light.agg(F.count("*"), F.coalesce(F.max("micro"), F.lit(0)) + 1).first()
    b = block_rows or max(2048, min(32768, n // 8))
    blocks = max(1, -(-n // b))

    def matrix(table: pa.Table) -> np.ndarray:
        return vx.unit(np.asarray(table.column("centroid").combine_chunks().flatten()).reshape(len(table), -1).astype(np.float64)).astype(np.float32)

    def own(table: pa.Table) -> pa.Table:
        table = table.sort_by("micro")
        micro = table.column("micro").to_numpy()
        return table.append_column("own", pa.array(micro[_own_parts(matrix(table), least)], pa.int32()))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("own", "ascending")])
        block, part = table.column("block").to_numpy(), table.column("own").to_numpy()
        cut = int((block == block[0]).sum())
        u, found = matrix(table), []
        if cut < len(u):
            name, head = np.unique(part[cut:], return_index=True)
            for i in range(0, cut, 256):
                r, c = np.nonzero(np.logical_or.reduceat(u[i : min(i + 256, cut)] @ u[cut:].T >= least, head, axis=1))
                found.append(np.unique(np.column_stack([part[i + r], name[c]]), axis=0))
        found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int32)
        return pa.table([pa.array(found[:, 0], pa.int32()), pa.array(found[:, 1], pa.int32())], ["a", "b"])

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("micro", "ascending")])
        micro, v, w = table.column("micro").to_numpy(), matrix(table), table.column("n").to_numpy()
        _, head = np.unique(table.column("part").to_numpy(), return_index=True)
        got = [micro[a:z][linkage_at(v[a:z], max_size, levels, w[a:z])] if z - a > 1 else np.full((len(levels), 1), micro[a]) for a, z in zip(head, [*head[1:], len(micro)])]
        return pa.table([pa.array(micro, pa.int32()), pa.array(list(np.concatenate(got, axis=1).T.astype(np.int32)), pa.list_(pa.int32()))], ["micro", "labels"])

    placed = light.withColumn("block", F.floor(F.col("micro").cast("bigint") * blocks / end_at).cast("int"))  # cells stay together
    parts = staged(placed.groupBy("block").applyInArrow(own, "micro int, n bigint, centroid array<float>, block int, own int"), "parts")
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda y: y != F.col("block"))
    pairs = parts.select("own", "centroid", "block", F.explode(F.transform(others, lambda y: F.least("block", y) * blocks + F.greatest("block", y))).alias("pair"))
    edges = pairs.groupBy("pair").applyInArrow(meet, "a int, b int").distinct().toArrow()
    up: dict[int, int] = {}

    def end(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist()):
        x, y = end(x), end(y)
        up[max(x, y)] = min(x, y)
    ways = spark.createDataFrame([(x, end(x)) for x in list(up)], "own int, part int")
    told = parts.join(F.broadcast(ways), "own", "left").select("micro", "n", "centroid", F.coalesce("part", "own").alias("part"))
    done = told.withColumn("hand", F.pmod(F.xxhash64("part"), F.lit(max(12, n // 2048)))).groupBy("hand").applyInArrow(link, "micro int, labels array<int>")
    return done.unionByName(centres.where(alone).select("micro", F.array_repeat("micro", len(levels)).alias("labels")))


def two_stage(rows: DataFrame, max_size: int = 50, least: float = 0.45, micro: int | None = None, key: str = "chain_id", seed: int = 42, rounds: int = 8) -> DataFrame:
    """(key, label): many small clusters by k-means over all rows, then constrained linkage of their centres weighed by size.

    Up to MOST_MEANS centres are linked in one matrix, more by components (linked_centres).
    """
    small = small_clusters(rows, micro, key, seed, rounds)
    return rows.select(key, F.lit(0).alias("label")) if small is None else merged_clusters(small, max_size, least, key)


def evolved(cluster, labels_of, least: float, max_size: int, share: float = 0.6, step: float = 0.02):
    """Cluster again with a higher threshold while too many clusters are too large; the threshold never passes 1."""
    while True:
        labels = cluster(least)
        sizes = labels.groupBy(labels_of).count()
        r = sizes.agg(F.count("*").alias("n"), F.count_if(F.col("count") > max_size).alias("large")).first()
        if not r.n or r.large / r.n <= share or least + step > 1:
            return labels, least
        least = round(least + step, 10)


def size_statistics(labels: DataFrame, label: str = "cluster_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row: clusters, noise and the sizes of clusters. Noise has a negative label."""
    per = labels.groupBy(*keys, label).agg(F.count("*").alias("size"))
    good = F.when(F.col(label) >= 0, F.col("size"))
    total = F.sum("size")
    noise = F.coalesce(F.sum(F.when(F.col(label) < 0, F.col("size"))), F.lit(0))
    return per.agg(F.count(good).alias("n_clusters"), noise.alias("n_noise"), F.coalesce(total, F.lit(0)).alias("n_total"), F.round(F.when(total > 0, noise / total), 6).alias("noise_ratio"), F.min(good).alias("size_min"), F.median(good).alias("size_median"), F.max(good).alias("size_max"), F.round(F.avg(good), 6).alias("size_mean"))


def large_share(labels: DataFrame, max_size: int, keys: tuple[str, ...] = ("domain",), label: str = "cluster_id") -> DataFrame:
    """(keys, clusters, large, ratio): how many clusters are larger than max_size."""
    per = labels.where(F.col(label) >= 0).groupBy(*keys, label).agg(F.count("*").alias("size"))
    large = F.count_if(F.col("size") > max_size)
    return per.groupBy(*keys).agg(F.count("*").alias("clusters"), large.alias("large"), F.round(large / F.count("*"), 6).alias("ratio"))


def top_share(sizes: DataFrame, share: float = 0.1, size: str = "size", ties: tuple[str, ...] = ("domain", "cluster_id")) -> DataFrame:
    """The largest share of groups, at least one: int(n * share) by size, ties by key."""
    n = sizes.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share))).alias("__most"))
    # clusters are few against rows; still only the head of the order is ever kept
    ranked = sizes.orderBy(F.desc(size), *ties)
    most = n.first()["__most"]
    return ranked.limit(int(most))


def with_distance(rows: DataFrame, centres: DataFrame, keys: tuple[str, ...] = ("domain", "cluster_id")) -> DataFrame:
    """rows with the euclidean distance to their group's centroid."""

    @F.pandas_udf("double")
    def distance(v, c):
        import pandas as pd

        if not len(v):
            return pd.Series([], dtype="float64")
        a, b = np.stack(v.to_numpy()).astype(np.float64), np.stack(c.to_numpy())
        return pd.Series(np.sqrt(((a - b) ** 2).sum(1)))

    return rows.join(centres.select(*keys, "centroid"), list(keys)).withColumn("distance", distance("vector", "centroid")).drop("centroid")


def nearest_to_centroid(rows: DataFrame, k: int, keys: tuple[str, ...] = ("domain", "cluster_id"), key: str = "chain_id") -> DataFrame:
    """(keys, key, distance, rank): the k rows of each group nearest to its centroid, ties by key."""
    near = with_distance(rows, vx.centroids(rows, keys), keys).withColumn("distance", F.round("distance", 6))
    w = Window.partitionBy(*keys).orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, key, "distance", "rank")


def select_top_clusters(rows: DataFrame, texts: DataFrame, share: float = 0.1, k: int = 10, keys: tuple[str, ...] = ("domain", "cluster_id"), key: str = "chain_id") -> DataFrame:
    """(keys, key, distance, rank, paper_id, chain_text): the most central rows of the largest clusters; missing texts are empty."""
    good = rows.where(F.col(keys[-1]) >= 0)
    top = top_share(good.groupBy(*keys).agg(F.count("*").alias("size")), share, ties=keys)
    mine = good.join(F.broadcast(top.select(*keys)), list(keys), "left_semi")
    near = nearest_to_centroid(mine.select(*keys, key, "vector"), k, keys, key)
    # texts of the chosen alone, one for each key
    told = texts.select(key, "paper_id", "chain_text").join(near.select(key), key, "left_semi").groupBy(key).agg(F.max("paper_id").alias("paper_id"), F.max("chain_text").alias("chain_text"))
    return near.join(told, key, "left").select(*keys, key, "distance", "rank", F.coalesce("paper_id", F.lit("")).alias("paper_id"), F.coalesce("chain_text", F.lit("")).alias("chain_text"))


def cluster_metadata(rows: DataFrame, least: float = 0.6, keys: tuple[str, str] = ("domain", "cluster_id"), key: str = "chain_id", prefix: str = "paper_ocr") -> DataFrame:
    """One row per cluster: ids, counts, papers and their paths in order, centroid, mean and least similarity of pairs (1 for a single row)."""
    good = rows.where(F.col(keys[1]) >= 0)
    papers = F.array_sort(F.collect_set("paper_id"))
    counts = good.groupBy(*keys).agg(F.count("*").alias("num_chains"), papers.alias("paper_ids")).withColumn("num_papers", F.size("paper_ids"))
    pairs = vx.pair_statistics(good.select(*keys, key, "vector"), keys, key).select(*keys, "mean", "min")
    paths = lambda f: F.transform("paper_ids", lambda p: f(prefix, p))
    return counts.join(vx.centroids(good.select(*keys, "vector"), keys).drop("n"), list(keys)).join(pairs, list(keys)).select(
        F.concat_ws("_", F.col(keys[0]), F.col(keys[1]).cast("string")).alias("global_cluster_id"), *keys, "num_chains", "num_papers", paths(xml_path).alias("chain_xml_paths"), "paper_ids", paths(md_path).alias("paper_md_paths"), "centroid",
        F.coalesce("mean", F.lit(1.0)).alias("avg_intra_similarity"), F.coalesce("min", F.lit(1.0)).alias("min_intra_similarity"), F.lit(least).alias("min_pair_sim_threshold"),
    )


def cosine_quality(rows: DataFrame, least: float = 0.85, keys: tuple[str, ...] = ("domain", "cluster_id")) -> DataFrame:
    """One row: medians and means over clusters of the mean and least similarity of pairs, and how many similar pairs are split. Exact, without sampling; null rates where there are no pairs."""
    per = vx.pair_statistics(rows.select(*keys, "chain_id", "vector"), keys).where("n_pairs > 0")
    block = per.agg(F.count("*").alias("clusters_with_pairs"), F.percentile("mean", 0.5).alias("intra_sim_p50"), F.percentile("min", 0.5).alias("min_sim_p50"), F.avg("mean").alias("intra_sim_mean"), F.avg("min").alias("min_sim_mean"))
    rate = F.when(F.col("pairs") > 0, F.col("split") / F.col("pairs"))
    split = vx.similar_pairs_split(rows, least, keys).select(F.col("pairs").alias("high_sim_pairs"), F.col("split").alias("high_sim_split"), rate.alias("high_sim_split_rate"), (1 - rate).alias("high_sim_same_rate"))
    return block.join(split)


def filtered_clusters(meta: DataFrame, domain: str | None = None, ids: list[int] | None = None, min_chains: int | None = None, max_chains: int | None = None, min_similarity: float | None = None) -> DataFrame:
    """Clusters within inclusive bounds, each optional, in the order of their ids."""
    tests: list[Column] = []
    if domain is not None:
        tests.append(F.col("domain") == domain)
    if ids:
        tests.append(F.col("cluster_id").isin(*ids))
    if min_chains is not None:
        tests.append(F.col("num_chains") >= min_chains)
    if max_chains is not None:
        tests.append(F.col("num_chains") <= max_chains)
    if min_similarity is not None:
        tests.append(F.col("avg_intra_similarity") >= min_similarity)
    for t in tests:
        meta = meta.where(t)
    return meta.orderBy("domain", "cluster_id")


def assign_new(rows: DataFrame, meta: DataFrame, key: str = "chain_id") -> DataFrame:
    """(key, domain, cluster_id, similarity, is_new): each new row to the cluster of nearest centroid if that reaches the cluster's own threshold, else to a cluster of its own, numbered on after the domain's last."""
    best = vx.nearest_centroid(rows, meta.select("domain", "cluster_id", "centroid"), key)
    limits = meta.select("domain", "cluster_id", "min_pair_sim_threshold")
    told = rows.select(key, "domain").join(best.drop("domain"), key, "left").join(limits, ["domain", "cluster_id"], "left")
    told = told.withColumn("is_new", F.coalesce(F.col("similarity") < F.col("min_pair_sim_threshold"), F.lit(True)))
    last = meta.groupBy("domain").agg(F.max("cluster_id").alias("last"))
    fresh = told.where("is_new").join(last, "domain", "left").withColumn("cluster_id", (F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("domain").orderBy(key))).cast("int")).drop("last")
    return told.where("not is_new").select(key, "domain", "cluster_id", "similarity", "is_new").unionByName(fresh.select(key, "domain", "cluster_id", "similarity", "is_new"))


def calinski_harabasz(rows: DataFrame, keys: tuple[str, ...] = ("domain", "cluster_id")) -> DataFrame:
    """(clusters, rows, value) from group sums alone: no row meets its centroid."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total = rows.agg(F.sum(square).alias("square"), F.count("*").alias("rows"))
    groups = vx.centroids(rows.select(*keys, "vector"), keys)
    norm = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x)
    parts = groups.select("n", norm.alias("norm"), "centroid")
    size = vx.DIM
    sums = parts.agg(F.count("*").alias("clusters"), F.sum(F.col("n") * F.col("norm")).alias("within_norm"), *[F.sum(F.col("n") * F.get("centroid", F.lit(i))).alias(f"m{i}") for i in range(size)])
    both = sums.join(total)
    grand = sum((F.col(f"m{i}") * F.col(f"m{i}") for i in range(size)), F.lit(0.0)) / F.col("rows")
    between, within = F.col("within_norm") - grand, F.col("square") - F.col("within_norm")
    value = F.when(F.col("clusters") > 1, (between / (F.col("clusters") - 1)) / (within / (F.col("rows") - F.col("clusters"))))
    return both.select("clusters", "rows", value.alias("value"))


def davies_bouldin(rows: DataFrame, keys: tuple[str, ...] = ("domain", "cluster_id"), most: int = 5000) -> DataFrame:
    """(clusters, value): null above `most` clusters, so that the matrix of centroids stays bounded."""
    centres = vx.centroids(rows.select(*keys, "vector"), keys)
    spread = with_distance(rows.select(*keys, "vector"), centres, keys).groupBy(*keys).agg(F.avg("distance").alias("spread"))
    spark = rows.sparkSession
    got = centres.join(spread, list(keys)).select("centroid", "spread").limit(most + 1).collect()
    value = None
    if 2 <= len(got) <= most:
        c, s = np.array([r.centroid for r in got]), np.array([r.spread for r in got])
        d = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * c @ c.T, 0))
        np.fill_diagonal(d, np.inf)
        with np.errstate(divide="ignore"):
            value = float(((s[:, None] + s[None]) / d).max(1).mean())
    return spark.createDataFrame([(len(got) if len(got) <= most else None, value)], "clusters int, value double")


def silhouette(rows: DataFrame, label: str, key: str = "chain_id", sample: int = 10_000) -> DataFrame:
    """(rows, value): euclidean silhouette of a hash sample of bounded size."""
    got = rows.orderBy(F.xxhash64(key), key).limit(sample).select("vector", label).toPandas()
    spark = rows.sparkSession
    x = np.stack(got["vector"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, vx.DIM))
    names, y = np.unique(got[label].astype(str).to_numpy(), return_inverse=True) if len(got) else (np.zeros(0), np.zeros(0, int))
    if len(names) < 2:
        return spark.createDataFrame([(len(got), None)], "rows int, value double")
    n = np.bincount(y)
    held = spark.sparkContext.broadcast((x, y, n))
    step = 500

    def run(batches):
        x, y, n = held.value
        hot = np.eye(len(n))[y]
        for b in batches:
            for at in b.column(0).to_pylist():
                i = slice(at, at + step)
                d = np.sqrt(np.maximum((x[i] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[i] @ x.T, 0)) @ hot
                own = y[i]
                r = np.arange(len(own))
                a = d[r, own] / np.maximum(n[own] - 1, 1)
                m = d / n
                m[r, own] = np.inf
                b_ = m.min(1)
                s = np.where(n[own] > 1, (b_ - a) / np.maximum(np.maximum(a, b_), 1e-300), 0)
                yield pa.RecordBatch.from_arrays([pa.array([len(s)], pa.int64()), pa.array([float(s.sum())])], ["n", "s"])

    parts = spark.range(0, len(x), step).mapInArrow(run, "n bigint, s double")
    return parts.agg(F.sum("n").cast("int").alias("rows"), (F.sum("s") / F.sum("n")).alias("value"))


MOST_ROWS = 65_536  # rows of a block of a group, two of which meet in a task
SPARE = 8  # neighbours kept beyond those asked for in single precision, before distances are taken in double precision
PIECE = 256  # rows of a piece of a component


def density_clusters(df: DataFrame, keys: tuple[str, ...], min_size: int = 5, min_samples: int = 5, key: str = "chain_id", part_rows: int = EXACT_ROWS, dim: int = vx.DIM) -> DataFrame:
    """(keys, key, label): hierarchical density clusters of each whole group; noise is -1.

    Mutual reachability of unit vectors, its spanning tree, and the clusters of greatest stability. A group of over
    part_rows rows is cut into blocks of at most MOST_ROWS, and all pairs of blocks meet twice: for the nearest rows,
    then for the tree. In between, each row is linked to a denser one among its nearest: that edge weighs what the
    cheapest edge of the row does, so it is part of a tree, and what is left to link are the few peaks of density.
    """
    names = list(keys)
    group = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = staged(df.select(*keys, key, "vector").withColumn("__row", F.monotonically_increasing_id()), "density")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    sizes = sizes.select(*keys, "__n", F.least(F.ceil(F.col("__n") / F.lit(part_rows)), F.greatest(F.lit(2), F.ceil(F.col("__n") / F.lit(MOST_ROWS)))).cast("int").alias("__parts"))
    sizes = staged(sizes, "sizes")
    pair = [*names, "low", "high"]

    def paired(table: DataFrame) -> DataFrame:
        """Each row at every pair of blocks that holds its own."""
        at = table.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        return at.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other", "__parts", "__n")

    def near(table: pa.Table) -> pa.Table:
        index, v = vx.to_matrix(table.column("vector"), dim)
        table, v = table.take(pa.array(index)), vx.unit(v)
        part, ids = table.column("part").to_numpy(), table.column("__row").to_numpy()
        low, high = (table.column(c)[0].as_py() if len(v) else 0 for c in ("low", "high"))
        at, to = np.flatnonzero(part == low), np.flatnonzero(part == high)
        r, c, d = nearest_pairs(v, at, None if low == high else to, min_samples)
        ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(v)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (d, ids[c])]
        return table.select([*keys, "__row"]).append_column("d", lists[0]).append_column("i", lists[1])

    blocks = rows.drop(key).join(sizes, names).withColumn("part", F.pmod(F.xxhash64("__row"), F.col("__parts")).cast("int"))
    lists = paired(blocks).groupBy(*pair).applyInArrow(near, f"{group}, __row bigint, d array<double>, i array<bigint>")
    met = F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("d", "i")))), 1, min_samples)
    lists = lists.groupBy(*keys, "__row").agg(met.alias("near")).select(*keys, "__row", F.col("near.d").alias("d"), F.col("near.i").alias("i"))

    def linked(table: pa.Table) -> pa.Table:
        ids, core, up, component, place = peaks(table)
        one = table.select(list(keys)).take(pa.array(np.zeros(len(ids), np.int64)))
        for name, x in (("__row", ids), ("place", place), ("core", core), ("up", up), ("component", component)):
            one = one.append_column(name, pa.array(x))
        return one

    info = staged(lists.groupBy(*keys).applyInArrow(linked, f"{group}, __row bigint, place int, core double, up int, component int"), "peaks")
    # places follow components, so that a block holds most components whole
    placed = info.join(sizes, names).withColumn("part", F.floor(F.col("place").cast("long") * F.col("__parts") / F.col("__n")).cast("int")).drop("up")
    blocks = rows.select("__row", "vector").join(placed, "__row").drop("__row")

    def edges(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        _, v = vx.to_matrix(table.column("vector"), dim)
        v, core, component, place, part = vx.unit(v), *(table.column(c).to_numpy() for c in ("core", "component", "place", "part"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        a, b, w = bridges(v, core, component, np.flatnonzero(part == low), np.flatnonzero(part == high))
        one = table.select(list(keys)).take(pa.array(np.zeros(len(a), np.int64)))
        return one.append_column("a", pa.array(place[a], pa.int32())).append_column("b", pa.array(place[b], pa.int32())).append_column("w", pa.array(w, pa.float64()))

    kind = df.schema[key].dataType.simpleString()
    trees = paired(blocks).groupBy(*pair).applyInArrow(edges, f"{group}, a int, b int, w double")
    # rows travel as the edge to the denser row, or to none
    told = rows.select("__row", key).join(info, "__row").select(*keys, F.col("place").alias("a"), F.col("up").alias("b"), F.col("core").alias("w"), F.col(key).alias("id"))
    both = told.unionByName(trees.withColumn("id", F.lit(None).cast(kind)).withColumn("tree", F.lit(True)), allowMissingColumns=True)

    def label(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_null(table.column("tree")))
        order = own.append_column("at", pa.array(np.arange(own.num_rows))).sort_by("id").column("at").to_numpy()
        number = np.empty(own.num_rows, np.int64)
        number[own.column("a").to_numpy()[order]] = np.arange(own.num_rows)
        a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
        some = b >= 0
        got = tree_labels(own.num_rows, shortest(own.num_rows, number[a[some]], number[b[some]], w[some]), min_size)
        return own.take(pa.array(order)).select([*keys, "id"]).rename_columns([*keys, key]).append_column("label", pa.array(got, pa.int32()))

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in (*keys, key))
    return both.groupBy(*keys).applyInArrow(label, f"{fields}, label int")


def _ranked(r: np.ndarray, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of greatest s, at most `most` of each row, in the order of rows; and the rank of each."""
    order = np.lexsort((-s, r))
    row = r[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < most
    return order[keep], rank[keep]


def nearest_pairs(v: np.ndarray, at: np.ndarray, to: np.ndarray | None, k: int, strip: int = 512, wide: int = 4096, full: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, distance): the k nearest of `to` for each row of `at` and the other way round; inside `at` if `to` is None.

    Products in single precision serve both sides. Only those above a row's k-th best so far are looked at, and
    distances of what is left are taken in double precision.
    """
    x, same = v.astype(np.float32), to is None
    to = at if same else to
    left, right = x[at], x[to]
    low = np.full(len(v), -2, np.float32)
    for own, others in ((at, to), (to, at))[: 1 if same else 2]:
        some = others[:2048]
        n = k + same  # a row may meet itself there
        if len(some) > n:
            for i in range(0, len(own), strip):
                s = x[own[i : i + strip]] @ x[some].T
                low[own[i : i + strip]] = np.partition(s, len(some) - n, axis=1)[:, len(some) - n] - 1e-6
    kept, held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)], []

    def trim() -> None:
        r, c, s = (np.concatenate([kept[n], *[h[n] for h in held]]) for n in range(3))
        held.clear()
        best, rank = _ranked(r, s, k + SPARE)
        kept[:] = r[best], c[best], s[best]
        kth = rank == k - 1
        low[kept[0][kth]] = np.maximum(low[kept[0][kth]], kept[2][kth] - np.float32(1e-6))

    waiting = 0
    for i in range(0, len(at), strip):
        for j in range(i if same else 0, len(to), wide):
            s = left[i : i + strip] @ right[j : j + wide].T
            own, others = low[at[i : i + strip]], low[to[j : j + wide]]
            hit = s > own[:, None]
            hit |= s > others[None]
            found = np.flatnonzero(hit)
            r, c = found // s.shape[1], found % s.shape[1]
            if same:
                after = c + j > r + i
                r, c = r[after], c[after]
            s = s[r, c]
            for mine, a, b in ((s > own[r], at[r + i], to[c + j]), (s > others[c], to[c + j], at[r + i])):
                held.append((a[mine], b[mine], s[mine]))
                waiting += int(mine.sum())
        if waiting > full:
            trim()
            waiting = 0
    trim()
    r, c, _ = kept
    d = np.concatenate([np.sqrt(((v[r[i : i + 65_536]] - v[c[i : i + 65_536]]) ** 2).sum(1)) for i in range(0, len(r), 65_536)] or [np.zeros(0)])
    best, _ = _ranked(r, -d, k)
    return r[best], c[best], d[best]


def peaks(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(rows, core distances, place of the denser row or -1, component, place) of a group with its lists of nearest rows.

    A row is linked to one of its nearest that is denser, by core distance and then by number: no edge of the row is
    shorter than its core distance, and this one is no longer.
    """
    table = table.sort_by("__row")
    ids = table.column("__row").to_numpy()
    n = len(ids)
    d, i = (table.column(c).combine_chunks() for c in ("d", "i"))
    length = pc.list_value_length(d).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, other = d.flatten().to_numpy(), np.searchsorted(ids, i.flatten().to_numpy())
    last = np.cumsum(length) - 1
    core = np.zeros(n)
    core[length > 0] = flat[last[length > 0]]
    row = np.repeat(np.arange(n), length)
    denser = np.flatnonzero((core[other] < core[row]) | ((core[other] == core[row]) & (other < row)))
    row, first = np.unique(row[denser], return_index=True)
    up = np.full(n, -1)
    up[row] = other[denser[first]]
    top = np.where(up < 0, np.arange(n), up)
    while (top[top] != top).any():
        top = top[top]
    order = np.argsort(top, kind="stable")
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    return ids, core, np.where(up < 0, -1, place[up]).astype(np.int32), top.astype(np.int32), place


def bridges(v: np.ndarray, core: np.ndarray, component: np.ndarray, at: np.ndarray, to: np.ndarray, strip: int = 512, wide: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, weight): a spanning forest of the components, of edges of least mutual reachability between rows of `at` and of `to`.

    Rows of a component lie together. Pieces of a component are the nodes; the greatest product of two pieces, cut to
    what the core distances allow, is found in single precision, and the edge between two linked pieces in double.
    """
    x, most = v.astype(np.float32), (1 - core * core / 2).astype(np.float32)

    def pieces(rows: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(np.diff(component[rows], prepend=-1) != 0)
        size = np.diff(begin, append=len(rows))
        n = -(-size // PIECE)
        return np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * PIECE

    one, two = pieces(at), pieces(to)
    if not len(one) or not len(two):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ends, stops = np.append(one[1:], len(at)), np.append(two[1:], len(to))
    s = np.empty((len(one), len(two)), np.float32)
    right, limit = x[to], most[to]
    k = 0
    while k < len(one):
        m = max(k + 1, int(np.searchsorted(ends, one[k] + strip, side="right")))
        own = at[one[k] : ends[m - 1]]
        best = np.empty((m - k, len(to)), np.float32)
        for j in range(0, len(to), wide):
            p = x[own] @ right[j : j + wide].T
            np.minimum(p, most[own][:, None], out=p)
            for q in range(k, m):
                best[q - k, j : j + wide] = p[one[q] - one[k] : ends[q] - one[k]].max(0)
        np.minimum(best, limit[None], out=best)
        s[k:m] = np.maximum.reduceat(best, two, axis=1)
        k = m
    names, label = np.unique(np.concatenate([component[at[one]], component[to[two]]]), return_inverse=True)
    root, chosen = np.arange(len(names)), []
    side = [[s, np.zeros(len(one), np.int64), np.full(len(one), 9, np.float32)], [s.T, np.zeros(len(two), np.int64), np.full(len(two), 9, np.float32)]]
    while True:
        a, b = label[: len(one)], label[len(one) :]
        for (m, link, value), mine, others in zip(side, (a, b), (b, a)):
            # only what led to another component until now, and no longer does, is looked up again
            stale = np.flatnonzero(((others[link] == mine) | (value > 2)) & (value > -5))
            for i in range(0, len(stale), strip):
                z = stale[i : i + strip]
                free = np.where(others[None] == mine[z][:, None], np.float32(-9), m[z])
                link[z] = free.argmax(1)
                value[z] = free[np.arange(len(z)), link[z]]
        p = np.concatenate([np.arange(len(one)), side[1][1]])
        q = np.concatenate([side[0][1], np.arange(len(two))])
        value = np.concatenate([side[0][2], side[1][2]])
        order = np.lexsort((-value, label))
        order = order[value[order] > -5]
        order = order[np.unique(label[order], return_index=True)[1]]
        if not len(order):
            break
        for e in order[np.argsort(-value[order], kind="stable")].tolist():
            y, z = int(a[p[e]]), int(b[q[e]])
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            while root[z] != z:
                root[z] = root[root[z]]
                z = root[z]
            if y != z:
                root[max(y, z)] = min(y, z)
                chosen.append((p[e], q[e]))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]
    found = []
    for p, q in chosen:
        i, j = at[one[p] : ends[p]], to[two[q] : stops[q]]
        w = np.maximum(np.maximum(core[i][:, None], core[j][None]), np.sqrt(np.maximum(2 - 2 * v[i] @ v[j].T, 0)))
        y, z = np.unravel_index(w.argmin(), w.shape)
        y, z = i[y], j[z]
        found.append((y, z, max(core[y], core[z], np.sqrt(((v[y] - v[z]) ** 2).sum()))))
    y, z, w = (np.array(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return y, z, w


def shortest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[tuple[float, int, int]]:
    """The edges of a spanning tree of n rows among the given ones, from the shortest on."""
    order = np.lexsort((b, a, w))
    root, tree = list(range(n)), []
    for d, x, y in zip(w[order].tolist(), a[order].tolist(), b[order].tolist()):
        i, j = x, y
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if i != j:
            root[j] = i
            tree.append((d, x, y))
    return tree


def density_labels(v: np.ndarray, min_size: int, min_samples: int) -> np.ndarray:
    n = len(v)
    if n < min_size:
        return np.full(n, -1, np.int32)
    core = np.sort(np.sqrt(np.maximum(2 - 2 * v @ v.T, 0)), 1)[:, min(min_samples, n - 1)]
    return tree_labels(n, spanning_tree(v, core), min_size)


def spanning_tree(v: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """The edges of the spanning tree of mutual reachability, from the shortest on."""
    n = len(v)
    if n < 2:
        return []
    d = np.sqrt(np.maximum(2 - 2 * v @ v.T, 0))
    d = np.maximum(np.maximum(core[:, None], core[None]), d)
    # spanning tree from row 0 on
    inside, reach, via, tree = np.zeros(n, bool), d[0].copy(), np.zeros(n, int), []
    inside[0] = True
    for _ in range(n - 1):
        reach_out = np.where(inside, np.inf, reach)
        j = int(reach_out.argmin())
        tree.append((float(reach_out[j]), int(via[j]), j))
        inside[j] = True
        closer = d[j] < reach
        reach[closer], via[closer] = d[j][closer], j
    tree.sort()
    return tree


def tree_labels(n: int, tree: list[tuple[float, int, int]], min_size: int) -> np.ndarray:
    """The clusters of greatest stability of a spanning tree.

    Edges of equal weight (to 1e-9) merge at once: which of several equal trees is given makes no difference.
    """
    if n < min_size:
        return np.full(n, -1, np.int32)
    # merge from the shortest edge on; a join of two large sides begins a new cluster over both
    root, size, small = list(range(n)), [1] * n, {i: [i] for i in range(n)}  # small: the rows of sides that carry no cluster yet
    node, entered = {}, np.full(n, -1)  # the cluster that a side carries, the first one of a row
    total, kids, least, above = [], [], [], []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def merge(sides: list[int], lam: float) -> None:
        big = [i for i in sides if i in node]
        rows = [x for i in sides if i not in node for x in small.pop(i)]
        whole = sum(size[i] for i in sides)
        head = max(sides, key=lambda i: size[i])
        if len(big) > 1 or not big and whole >= min_size:
            for i in big:
                total[node[i]] -= lam * size[i]  # what stayed in it until this edge
                above[node[i]] = len(total)
            kids.append([node.pop(i) for i in big])
            least.append(min(least[i] for i in kids[-1]) if big else n)
            total.append(lam * whole)
            above.append(-1)
            node[head] = len(total) - 1
        elif big:
            node[head] = node.pop(big[0])
            total[node[head]] += lam * len(rows)
        else:
            small[head] = rows
        if head in node and rows:
            entered[rows] = node[head]
            least[node[head]] = min(least[node[head]], min(rows))
        for i in sides:
            root[i] = head
        size[head] = whole

    at = 0
    while at < len(tree):
        to = at + 1
        while to < len(tree) and tree[to][0] - tree[at][0] <= 1e-9:
            to += 1
        ends = [(top(a), top(b)) for _, a, b in tree[at:to]]
        if to == at + 1:
            together = [list(ends[0])]
        else:
            own = {x: x for e in ends for x in e}
            for a, b in ends:
                while own[a] != a:
                    a = own[a]
                while own[b] != b:
                    b = own[b]
                own[b] = a
            sets: dict[int, list[int]] = {}
            for x in own:
                r = x
                while own[r] != r:
                    r = own[r]
                sets.setdefault(r, []).append(x)
            together = list(sets.values())
        for sides in together:
            merge(sides, 1 / max(tree[at][0], 1e-12))
        at = to
    value, chosen = [], np.zeros(len(total), bool)
    for i, k in enumerate(kids):
        below = sum(value[j] for j in k)
        whole = i == len(kids) - 1 and k  # all rows as one cluster is no answer
        chosen[i] = not (k and (below > total[i] or whole))
        value.append(max(total[i], 0.0) if chosen[i] else below)
    # a chosen cluster covers those below it
    cover = np.full(len(total), -1)
    for i in range(len(total) - 1, -1, -1):
        cover[i] = cover[above[i]] if above[i] >= 0 and cover[above[i]] >= 0 else i if chosen[i] else -1
    number = {i: m for m, i in enumerate(sorted(set(cover[cover >= 0].tolist()), key=lambda i: least[i]))}
    code = np.array([number.get(i, -1) for i in cover.tolist()] + [-1], np.int32)
    return code[entered]


def principal_plane(rows: DataFrame, key: str = "chain_id", parts: int = 2, dim: int = vx.DIM) -> DataFrame:
    """(key, p1, p2, ...): coordinates on the first principal axes; the covariance is summed where the rows are."""

    def moments(batches):
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            _, v = vx.to_matrix(b.column(0), dim)
            n, s, q = n + len(v), s + v.sum(0), q + v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1), pa.int32()), pa.array([np.append(s, n).tolist(), *[np.append(r, 0).tolist() for r in q]], pa.list_(pa.float64()))], ["i", "x"])

    sums = rows.select("vector").mapInArrow(moments, "i int, x array<double>").groupBy("i").agg(*[F.sum(F.get("x", F.lit(j))).alias(f"c{j}") for j in range(dim + 1)]).orderBy("i").collect()
    m = np.array([[r[f"c{j}"] for j in range(dim + 1)] for r in sums])
    n = max(m[0, dim], 1)
    mean = m[0, :dim] / n
    _, axes = np.linalg.eigh(m[1:, :dim] / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :parts]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(parts)])
    held = rows.sparkSession.sparkContext.broadcast((mean, axes))

    def project(batches):
        for b in batches:
            index, v = vx.to_matrix(b.column("vector"), dim)
            z = (v - held.value[0]) @ held.value[1]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(index)), *[pa.array(z[:, i]) for i in range(parts)]], ["id", *[f"p{i + 1}" for i in range(parts)]])

    return rows.select(F.col(key).cast("string").alias("id"), "vector").mapInArrow(project, "id string, " + ", ".join(f"p{i + 1} double" for i in range(parts))).withColumnRenamed("id", key)
