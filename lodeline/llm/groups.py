"""Groups of mutually similar vectors: a Gaussian mixture, then exact links inside and between its components.

Method: features are standardised and reduced by principal components; a mixture of Gaussians with regularised
diagonal covariances starts from a bounded sample and is fitted by expectation-maximisation. Components begin too
many and those that the information criterion (half a parameter set's cost in effective rows) doesn't bear are
removed. Two further rounds of expectation-maximisation run over all rows, spread over the cluster. A component
with too many rows is parted into sub-components in the same space.

Every row lives in its most likely component and asks those whose means are nearly as near. Exact cosines then link
rows; all rows meet a second time in cells of another index; linked pieces are joined by connected components. The
members of highest density represent a group. There are at most MOST_COMPONENTS components; what grows with the table
are the cells inside them.

Defined results: null, short, zero or non-finite vectors are in no group; repeated rows of one key count once; a row
without links is in no group; ties of density go to the smaller key; an empty table gives no rows.
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
from . import cells as cl
from .components import connected_components

LINK = 0.78
REDUCED = 32
MOST_COMPONENTS = 1024
MARGIN, ASK, SAME, SECOND_ASK = 0.25, 12, 5, 6


@dataclass
class Mixture:
    """A mixture in the reduced space, with what leads there from unit vectors."""

    mean: np.ndarray  # of the features
    scale: np.ndarray
    axes: np.ndarray  # (features, reduced)
    weight: np.ndarray  # (components,)
    centre: np.ndarray  # (components, reduced)
    spread: np.ndarray  # variances, as the centres

    def reduce(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.mean) / self.scale) @ self.axes

    def log_density(self, z: np.ndarray) -> np.ndarray:
        """log(weight * density) of every row and component."""
        inv = 1.0 / self.spread
        const = np.log(np.maximum(self.weight, 1e-300)) - 0.5 * (np.log(self.spread).sum(1) + (self.centre**2 * inv).sum(1) + z.shape[1] * np.log(2 * np.pi))
        return const + z @ (self.centre * inv).T - 0.5 * (z * z) @ inv.T

    def step(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expectation: sums of responsibilities, of rows and of their squares, and the log-likelihood."""
        n, s1, s2, total = np.zeros(len(self.weight)), np.zeros(self.centre.shape), np.zeros(self.centre.shape), 0.0
        step = max(16, cl.SCORES_AT_ONCE // 4 // len(self.weight))
        for i in range(0, len(z), step):
            part = z[i : i + step]
            log = self.log_density(part)
            top = log.max(1, keepdims=True)
            r = np.exp(log - top)
            norm = r.sum(1, keepdims=True)
            r /= norm
            n += r.sum(0)
            s1 += r.T @ part
            s2 += r.T @ (part * part)
            total += float((np.log(norm) + top).sum())
        return n, s1, s2, total

    def maximised(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray, floor: np.ndarray, cost: float) -> Mixture:
        """Maximisation, with the covariance drawn towards the floor; components not worth their cost are removed."""
        keep = n > cost
        if not keep.any():
            keep = n >= n.max()
        n, s1, s2 = n[keep], s1[keep], s2[keep]
        centre = s1 / n[:, None]
        spread = np.maximum(s2 / n[:, None] - centre**2, 0)
        spread = (spread * n[:, None] + floor * 8) / (n[:, None] + 8)
        left = np.maximum(n - cost, 1e-9)
        return Mixture(self.mean, self.scale, self.axes, left / left.sum(), centre, np.maximum(spread, floor * 0.2))


def information(likelihood: float, components: int, dims: int, rows: int) -> float:
    """The Bayesian information criterion; less is better."""
    return -2 * likelihood + components * (2 * dims + 1) * np.log(max(rows, 2))


def fit_mixture(v: np.ndarray, start: int, reduced: int = REDUCED, rounds: int = 8, seed: int = 11) -> Mixture:
    """A mixture from a sample: of the removals along the way, the number of components with the best criterion stays."""
    mean, scale = v.mean(0), np.maximum(v.std(0), 1e-6)
    x = (v - mean) / scale
    values, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(x.shape[1]))
    axes = axes[:, ::-1][:, :reduced]
    z = x @ axes
    k = max(1, min(start, len(v) // 8))
    centres = cl.kmeans(v, k, rounds=6, seed=seed)
    own = cl.nearest(v, centres)
    n, s1, s2 = np.bincount(own, minlength=len(centres)).astype(float), np.zeros((len(centres), z.shape[1])), np.zeros((len(centres), z.shape[1]))
    np.add.at(s1, own, z)
    np.add.at(s2, own, z * z)
    floor = np.maximum(z.var(0), 1e-9) * 0.05
    mixture = Mixture(mean, scale, axes, np.ones(1), z.mean(0, keepdims=True), z.var(0, keepdims=True) + floor)
    mixture = mixture.maximised(n, s1, s2, floor, 0.5)
    best, least = mixture, np.inf
    cost = (2 * z.shape[1] + 1) / 4
    for _ in range(rounds):
        n, s1, s2, likelihood = mixture.step(z)
        score = information(likelihood, len(mixture.weight), z.shape[1], len(z))
        if score < least:
            best, least = mixture, score
        mixture = mixture.maximised(n, s1, s2, floor, cost)
    return best


def refine(rows: DataFrame, mixture: Mixture, rounds: int = 2, dim: int = cl.DIM) -> Mixture:
    """Rounds of expectation-maximisation over all rows. Only sums of components come to the driver."""
    spark = rows.sparkSession
    floor = np.maximum((mixture.weight[:, None] * (mixture.spread + mixture.centre**2)).sum(0), 1e-9) * 0.05
    width = mixture.centre.shape[1]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(mixture)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = held.value
            n, s1, s2 = np.zeros(len(m.weight)), np.zeros(m.centre.shape), np.zeros(m.centre.shape)
            for b in batches:
                _, v = cl.matrix(b.column(0), dim)
                if len(v):
                    a, b1, b2, _ = m.step(m.reduce(v))
                    n, s1, s2 = n + a, s1 + b1, s2 + b2
            every = np.concatenate([n[:, None], s1, s2], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(list(every), pa.list_(pa.float64()))], ["c", "sums"])

        parts = rows.select("vector").mapInArrow(run, "c int, sums array<double>")
        sums = parts.select("c", F.posexplode("sums").alias("i", "s")).groupBy("c", "i").agg(F.sum("s").alias("s"))
        full = np.zeros((len(mixture.weight), 1 + 2 * width))
        for r in sums.toLocalIterator():
            full[r.c, r.i] = r.s
        held.unpersist()
        if full[:, 0].sum() <= 0:
            return mixture
        mixture = mixture.maximised(full[:, 0], full[:, 1 : 1 + width], full[:, 1 + width :], floor, 0.5)
    return mixture


def part_components(mixture: Mixture, v: np.ndarray, total: int, cell_rows: int) -> tuple[cl.Cells, np.ndarray]:
    """Cells inside components: (cells, component of each cell). A component within the bound is one cell."""
    own = component_of(mixture, v)
    want = max(8, int(cell_rows * len(v) / max(total, len(v))))
    centroids, blocks, of = [], [], []
    for c in range(len(mixture.weight)):
        mine = v[own == c]
        if not len(mine):  # seen by no sampled row: its mean stands for it
            x = mixture.centre[c] @ mixture.axes.T * mixture.scale + mixture.mean
            cells = cl.Cells((x / max(1e-9, np.linalg.norm(x)))[None].astype(np.float32), np.ones(1, np.int64))
        elif len(mine) <= 2 * want:
            m = mine.mean(0)
            cells = cl.Cells((m / max(1e-9, np.linalg.norm(m)))[None].astype(np.float32), np.ones(1, np.int64))
        else:
            cells = cl.fit_cells(mine, max(1, round(total * len(mine) / len(v))), cell_rows)
        centroids.append(cells.centroids)
        blocks.append(cells.blocks)
        of.append(np.full(len(cells.centroids), c))
    return cl.Cells(np.concatenate(centroids), np.concatenate(blocks)), np.concatenate(of)


def component_of(mixture: Mixture, v: np.ndarray) -> np.ndarray:
    step = max(16, cl.SCORES_AT_ONCE // 4 // len(mixture.weight))
    return np.concatenate([mixture.log_density(mixture.reduce(v[i : i + step])).argmax(1) for i in range(0, len(v), step)]) if len(v) else np.zeros(0, np.int64)


def live(mixture: Mixture, cells: cl.Cells, of: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cell, component, log-density, further cells) of rows: the most likely component and its nearest cells."""
    wide = min(SAME, len(cells.centroids))
    home, comp, dens, more = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.zeros(len(v)), np.full((len(v), wide), -1)
    step = max(16, cl.SCORES_AT_ONCE // 4 // len(mixture.weight))
    for i in range(0, len(v), step):
        log = mixture.log_density(mixture.reduce(v[i : i + step]))
        comp[i : i + step] = log.argmax(1)
        top = log.max(1)
        dens[i : i + step] = top + np.log(np.exp(log - top[:, None]).sum(1))
    order = np.argsort(comp, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1) if len(v) else []:
        here = np.flatnonzero(of == comp[mine[0]])  # the cells of one component alone
        for k in range(0, len(mine), 4096):
            part = mine[k : k + 4096]
            s = v[part] @ cells.centroids[here].T
            near = np.argsort(-s, axis=1, kind="stable")[:, :wide]
            home[part] = here[near[:, 0]]
            more[part, : near.shape[1]] = here[near]
    return home, comp, dens, more


def linked(v: np.ndarray, least: float) -> np.ndarray:
    """The component number of each row in the graph of cosines >= least, exactly; blocks of rows at a time."""
    n = len(v)
    label = np.full(n, -1, np.int64)
    wide = n > 6000
    adjacent = None if wide else v @ v.T >= least
    row = (lambda i: v @ v[i] >= least) if wide else (lambda i: adjacent[i])
    next_label = 0
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i] = next_label
        fresh = np.flatnonzero(row(i) & (label < 0))
        while len(fresh):
            label[fresh] = next_label
            left = np.flatnonzero(label < 0)
            if not len(left):
                break
            # which of the others any of the fresh rows reaches
            hit = np.zeros(len(left), bool)
            for k in range(0, len(fresh), 2048):
                part = fresh[k : k + 2048]
                hit |= ((v[part] @ v[left].T) >= least).any(0) if wide else adjacent[np.ix_(part, left)].any(0)
            fresh = left[hit]
        next_label += 1
    return label


def links_of(g: cl.Group, least: float) -> tuple[np.ndarray, dict[int, str], list[tuple[int, str]]]:
    """(piece of each resident, first key of each piece, (asker, first key of a piece it is linked to))."""
    label = linked(g.v, least)
    root: dict[int, str] = {}
    for i, n in zip(g.ids, label.tolist()):  # residents come in the order of their keys
        root.setdefault(n, i)
    asked = []
    for i in range(0, len(g.ask_v) if len(g.v) else 0, 512):
        q, j = np.nonzero(g.ask_v[i : i + 512] @ g.v.T >= least)
        asked += [(i + int(x) // len(root), root[int(x) % len(root)]) for x in np.unique(q * len(root) + label[j])]
    return label, root, asked


def second_look(rows: DataFrame, least: float, cell_rows: int, sample_rows: int, dim: int) -> DataFrame:
    """(id, root): links among rows of different pieces, met again in cells of their own, for what the first cells kept apart."""
    spark = rows.sparkSession
    total = rows.count()
    drawn = rows.where(cl.hash_share("id", 1.0 if total <= sample_rows else sample_rows / total)).select("v").toArrow().column("v")
    cells = cl.fit_cells(cl.unpacked(drawn, dim), total, cell_rows)
    held = spark.sparkContext.broadcast(cells)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column("id"), cl.unpacked(b.column("v"), dim)
            r, c, k, own = held.value.route(v, cl.hash_ids(ids), MARGIN, SECOND_ASK)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(k, pa.int32()), pa.array(own), ids.take(pa.array(r)), cl.packed(v[r])], ["cell", "block", "own", "id", "v"])

    def meet(table: pa.Table) -> pa.Table:
        g = cl.Group(table, dim)
        label, root, asked = links_of(g, least)
        pairs = [(i, root[n]) for i, n in zip(g.ids, label.tolist()) if i != root[n]] + [(g.ask_ids[a], r) for a, r in asked]
        return pa.table({"id": pa.array([p[0] for p in pairs], pa.string()), "root": pa.array([p[1] for p in pairs], pa.string())})

    return rows.mapInArrow(spread, cl.ROUTED).groupBy("cell", "block").applyInArrow(meet, "id string, root string")


def similarity_groups(df: DataFrame, key: str = "chain_id", vector: str = "vector", least: float = LINK, domain: str | None = "domain", dim: int = cl.DIM, sample_rows: int = cl.SAMPLE_ROWS, cell_rows: int = cl.CELL_ROWS, margin: float = MARGIN, ask: int | None = ASK, hot: int = cl.HOT_COPIES) -> DataFrame:
    """(id, group, density, component[, domain]): every row that is linked to another; group is its smallest key.

    `ask` is how many further cells within `margin` of the nearest a row asks at most; None asks all cells and is exact.
    """
    rows = cl.vectors(df, key, vector, *([domain] if domain else []))
    rows = rows.withColumnRenamed(domain, "domain") if domain else rows.withColumn("domain", F.lit(None).cast("string"))
    total = rows.count()
    spark = rows.sparkSession
    drawn = cl.drawn_sample(rows, total, sample_rows, cell_rows, dim)
    mixture = refine(rows, fit_mixture(drawn, start=max(4, min(MOST_COMPONENTS, len(drawn) // 32))), dim=dim)
    cells, of = part_components(mixture, drawn, total, cell_rows)
    held = spark.sparkContext.broadcast((mixture, cells, of))
    apart = cl.set_apart(rows, total, hot)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, index, owner = held.value
        for b in batches:
            at, v = cl.matrix(b.column("vector"), dim)
            if not len(at):
                continue
            ids, names, copies = (b.column(c).take(pa.array(at)) for c in ("id", "domain", "n"))
            home, comp, dens, more = live(m, index, owner, v)
            r, c, k, own = index.route(v, cl.hash_ids(ids), margin, ask, home, more)
            for i in range(0, len(r), 20_000):
                j = r[i : i + 20_000]
                take = pa.array(j)
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], pa.int32()), pa.array(k[i : i + 20_000], pa.int32()), pa.array(own[i : i + 20_000]), ids.take(take), cl.packed(v[j]), pa.array(dens[j], pa.float64()), pa.array(comp[j], pa.int32()), names.take(take), copies.take(take)], ["cell", "block", "own", "id", "v", "density", "component", "domain", "n"])

    routed = apart.rows.mapInArrow(spread, cl.ROUTED + ", density double, component int, domain string, n bigint")

    def meet(table: pa.Table) -> pa.Table:
        g = cl.Group(table, dim)
        label, root, asked = links_of(g, least)
        size = np.bincount(label, minlength=1)[label] if len(label) else np.zeros(0, np.int64)
        at = pa.array([g.rows_ask[a] for a, _ in asked] + g.rows_here, pa.int64())
        ids = [g.ask_ids[a] for a, _ in asked] + g.ids
        roots = [r for _, r in asked] + [root[n] for n in label.tolist()]
        own = pa.array(np.arange(len(ids)) >= len(asked))
        v = pc.if_else(own, table.column("v").combine_chunks().take(at), pa.scalar(None, pa.binary()))
        alone = pa.array(np.concatenate([np.zeros(len(asked), bool), size < 2]))
        alone = pc.and_(alone, pc.equal(table.column("n").combine_chunks().take(at), 1))
        return pa.table({"id": pa.array(ids, pa.string()), "root": pa.array(roots, pa.string()), "own": own, "alone": alone, "v": v, **{c: table.column(c).take(at) for c in ("density", "component", "domain")}})

    met = staged(routed.groupBy("cell", "block").applyInArrow(meet, "id string, root string, own boolean, alone boolean, v binary, density double, component int, domain string"), "linked")
    # a row that asks elsewhere ties its own piece to the pieces it meets there
    homes = met.where("own").select("id", F.col("root").alias("home"))
    ties = met.where("not own").join(homes, "id").select(F.col("home").alias("a"), F.col("root").alias("b"))
    again = second_look(met.where("own").select("id", "v"), least, cell_rows, sample_rows, dim)
    again = again.join(homes, "id").join(homes.select(F.col("id").alias("root"), F.col("home").alias("b")), "root").select(F.col("home").alias("a"), "b")
    ties = ties.unionByName(again).where("a != b").distinct()
    joined = connected_components(ties)
    members = met.where("own").join(joined, met.root == joined.node, "left").select("id", F.coalesce(joined.root, met.root).alias("piece"), (F.col("alone") & joined.root.isNull()).alias("single"), "density", "component", "domain").where("not single").drop("single")
    if apart.members is not None:
        of_rep = members.select(F.col("id").alias("rep"), "piece", "density", "component")
        copies = apart.members.where("id != rep").join(of_rep, "rep").select("id", "piece", "density", "component", "domain")
        members = members.unionByName(copies)
    # pieces are named after their smallest key, but not each piece of a group is
    first = members.groupBy("piece").agg(F.min("id").alias("group"))
    return members.join(first, "piece").drop("piece")


def group_members(groups: DataFrame) -> DataFrame:
    """(first_chain_id, chain_id): one row for each member but the first."""
    return groups.where("id != group").select(F.col("group").alias("first_chain_id"), F.col("id").alias("chain_id"))


def group_profiles(groups: DataFrame, typical: int = 3) -> DataFrame:
    """(first_chain_id, domain, size, components, typical): each group by its size and its members of highest density."""
    best = Window.partitionBy("group").orderBy(F.desc("density"), "id")
    top = groups.withColumn("place", F.row_number().over(best)).where(F.col("place") <= typical)
    top = top.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("t"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"), F.count_distinct("component").alias("components"), F.max(F.when(F.col("domain") != "", F.col("domain"))).alias("domain"))
    return sizes.join(top, "group").select(F.col("group").alias("first_chain_id"), "domain", "size", "components", F.expr("transform(t, x -> x.id)").alias("typical"))
