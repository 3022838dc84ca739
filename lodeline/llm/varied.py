"""A varied subset: concave coverage of features by descending thresholds.

Method: the features of a row are its crowd (named by the smallest near-alike key, over all cells and blocks;
names that name one another are one), its prototype (the nearest of many centroids of the collection to the row that names the crowd, weighted by
the row's own cosine) and its recorded cluster, a hint of little weight. The subset maximises the sum over features of
the square root of the selected mass, so that every further row of a crowd or a prototype gains less. Rounds of
descending thresholds add the rows whose marginal gain reaches the threshold; rounds run in all prototypes at once,
because features lie inside prototypes, and the subset of a domain is cut in the round in which its size is reached.

A row's crowd feature also tells its mass, the number of rows that are near-alike to it: `near`. Counts are exact for
the rows that meet; a row meets the rows of its own cell and of the cells whose centroids are nearly as near, or of all
cells (`ask=None`).

A prototype of a domain has one mass, however many rows it holds: rows that agree in crowd, hint and weight (to two
decimals) are counted, and the thresholds run over these counts. Defined results: null, short, zero or non-finite
vectors are not chosen; repeated rows of one key count once; ties go by a hash of the key; a domain of fewer rows than
its size gives all; null sizes count nothing; an empty table gives no rows. A row of null domain is in no subset.
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
from .components import connected_components

ALIKE = 0.95
PROTOTYPES = 1024
SALT_ROWS = 4096
HASH_BINS = 4096
FALL = 0.85
HINT = 0.25
MARGIN, ASK = 0.17, 10


def features(df: DataFrame, key: str = "chain_id", vector: str = "vector", domain: str = "domain", cluster: str = "cluster_id", alike: float = ALIKE, dim: int = cl.DIM, sample_rows: int = cl.SAMPLE_ROWS, cell_rows: int = cl.CELL_ROWS, margin: float = MARGIN, ask: int | None = ASK, hot: int = cl.HOT_COPIES) -> DataFrame:
    """(id, domain, prototype, weight, crowd, hint, near): the features of every row; near counts the other rows with cosine >= alike."""
    rows = cl.vectors(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{domain}`").alias("domain"), F.col(f"`{cluster}`").cast("int").alias("hint")), "id", "vector", "domain", "hint")
    total = rows.count()
    drawn = cl.drawn_sample(rows, total, sample_rows, cell_rows, dim)
    cells = cl.fit_cells(drawn, total, cell_rows)
    prototypes = cl.kmeans(drawn, max(1, min(PROTOTYPES, len(drawn) // 20)), rounds=6)
    held = rows.sparkSession.sparkContext.broadcast((cells, prototypes))
    apart = cl.set_apart(rows, total, hot)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _ = held.value
        for b in batches:
            at, v = cl.matrix(b.column("vector"), dim)
            if not len(at):
                continue
            take = pa.array(at)
            ids, names, hints, copies = (b.column(c).take(take) for c in ("id", "domain", "hint", "n"))
            r, c, k, own = index.route(v, cl.hash_ids(ids), margin, ask)
            for i in range(0, len(r), 20_000):
                j = r[i : i + 20_000]
                t = pa.array(j)
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], pa.int32()), pa.array(k[i : i + 20_000], pa.int32()), pa.array(own[i : i + 20_000]), ids.take(t), cl.packed(v[j]), names.take(t), hints.take(t), copies.take(t)], ["cell", "block", "own", "id", "v", "domain", "hint", "n"])

    routed = apart.rows.mapInArrow(spread, cl.ROUTED + ", domain string, hint int, n bigint")

    def meet(table: pa.Table) -> pa.Table:
        _, protos = held.value
        g = cl.Group(table, dim)
        here = len(g.ids)
        take = pa.array(g.rows_here, pa.int64())
        copies = table.column("n").take(take).to_numpy()
        near, leader = count_near(g.v, g.v, alike, copies)
        asked, met_first = count_near(g.ask_v, g.v, alike, copies)
        hit = np.flatnonzero(asked)
        # a crowd has the prototype of the row that names it
        proto = cl.nearest(g.v, protos)

        def weight(v: np.ndarray, first: np.ndarray) -> pa.Array:
            return pa.array(np.maximum((v * protos[proto[first]]).sum(1), 0), pa.float32())

        own = pa.table({"id": pa.array(g.ids, pa.string()), "near": pa.array(near - 1, pa.int64()), "own": pa.array(np.ones(here, bool)), "prototype": pa.array(proto[leader], pa.int32()), "weight": weight(g.v, leader), "crowd": pa.array([g.ids[i] for i in leader], pa.string()), "domain": table.column("domain").take(take), "hint": table.column("hint").take(take)})
        met_first = met_first[hit]
        k = len(hit)
        other = pa.table({"id": pa.array([g.ask_ids[i] for i in hit], pa.string()), "near": pa.array(asked[hit], pa.int64()), "own": pa.array(np.zeros(k, bool)), "prototype": pa.array(proto[met_first], pa.int32()), "weight": weight(g.ask_v[hit], met_first), "crowd": pa.array([g.ids[i] for i in met_first], pa.string()), "domain": pa.nulls(k, pa.string()), "hint": pa.nulls(k, pa.int32())})
        return pa.concat_tables([own, other])

    met = routed.groupBy("cell", "block").applyInArrow(meet, "id string, near bigint, own boolean, prototype int, weight float, crowd string, domain string, hint int")
    home = F.max(F.when(F.col("own"), F.struct("domain", "hint"))).alias("f")
    crowd = F.min(F.struct("crowd", "prototype", "weight")).alias("c")
    told = met.groupBy("id").agg(F.sum("near").alias("near"), home, crowd).select("id", "f.domain", "c.prototype", "c.weight", "c.crowd", "f.hint", "near")
    if apart.members is None:
        return told
    told = staged(told, "features")
    of_rep = told.select(F.col("id").alias("rep"), "prototype", "weight", "crowd", "near")
    return told.unionByName(apart.members.where("id != rep").join(of_rep, "rep").select(*told.columns))


def one_name(rows: DataFrame) -> DataFrame:
    """rows with the crowds that name one another under the smallest key; a row asks a bounded number of cells, so the row that names a crowd may itself have met a smaller key."""
    named = rows.where("crowd != id").select("id", "crowd")
    links = named.join(named.select(F.col("crowd").alias("id")).distinct(), "id", "left_semi")
    roots = connected_components(links.select(F.col("id").alias("a"), F.col("crowd").alias("b"))).where("node != root")
    places = rows.select(F.col("id").alias("root"), F.col("prototype").alias("root_prototype"))
    roots = roots.join(places, "root").select(F.col("node").alias("crowd"), "root", "root_prototype")
    told = rows.join(roots, "crowd", "left")
    return told.withColumn("crowd", F.coalesce("root", "crowd")).withColumn("prototype", F.coalesce("root_prototype", "prototype")).select(rows.columns)


def count_near(q: np.ndarray, v: np.ndarray, alike: float, copies: np.ndarray | None = None, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(residents with cosine >= alike, each as often as it has copies, and the first of them) for every asker; doubtful cosines are taken again in double precision."""
    count, first = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    if not len(v):
        return count, first
    single = copies is None or (copies == 1).all()
    for i in range(0, len(q), step):
        s = q[i : i + step] @ v.T
        a, b = np.nonzero(np.abs(s - alike) < 2e-6)
        if len(a):
            s[a, b] = np.where((q[i + a].astype(np.float64) * v[b].astype(np.float64)).sum(1) >= alike, 1.0, 0.0)
        hit = s >= alike
        count[i : i + step] = hit.sum(1) if single else hit @ copies
        first[i : i + step] = hit.argmax(1)
    return count, first


def thresholds(ids: list[str], weight: np.ndarray, crowd: list[str], hint: np.ndarray, fall: float = FALL) -> tuple[np.ndarray, np.ndarray]:
    """(round, gain) in which each row of one prototype is added: descending thresholds over its marginal gain."""
    n = len(ids)
    rounds, gains = np.zeros(n, np.int64), np.zeros(n)
    for i, _, r, gain in counted_thresholds(ids, weight, crowd, hint, np.ones(n, np.int64), n, fall):
        rounds[i], gains[i] = r, gain
    return rounds, gains


def counted_thresholds(ids: list[str], weight: np.ndarray, crowd: list[str], hint: np.ndarray, count: np.ndarray, most: int, fall: float = FALL) -> list[tuple[int, int, int, float]]:
    """(kind, place, round, gain) of each added row of one prototype, given kinds of `count` equal rows and their smallest ids.

    No round follows the one in which `most` rows are reached.
    """
    n = len(ids)
    out: list[tuple[int, int, int, float]] = []
    taken = np.zeros(n, np.int64)
    mass, crowds, hints = 0.0, {}, {}
    bound = np.full(n, 3.0)
    left, tau, r = sorted(range(n), key=ids.__getitem__), 2.0 + HINT, 0
    while left and len(out) < most:
        rest = []
        for i in left:
            if bound[i] < tau:
                rest.append(i)
                continue
            w, k = weight[i], hint[i]
            while taken[i] < count[i]:
                c, h = crowds.get(crowd[i], 0), hints.get(k, 0) if k >= 0 else 0
                gain = (mass + w) ** 0.5 - mass**0.5 + (c + 1) ** 0.5 - c**0.5 + (HINT * ((h + 1) ** 0.5 - h**0.5) if k >= 0 else 0.0)
                if gain < tau:
                    bound[i] = gain  # gains only fall
                    rest.append(i)
                    break
                taken[i] += 1
                out.append((i, int(taken[i]), r, gain))
                mass += w
                crowds[crowd[i]] = c + 1
                if k >= 0:
                    hints[k] = h + 1
        left, tau, r = rest, tau * fall, r + 1
    return out


def select_varied(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(domain, chain_id, gain): the subset of each domain; sizes has (domain, size)."""
    rows = rows.where("domain is not null").join(F.broadcast(sizes.where("size > 0").select("domain")), "domain", "left_semi")
    kind = ["domain", "prototype", "crowd", "hint", "weight"]
    rows = rows.select("domain", "prototype", "crowd", F.coalesce("hint", F.lit(-1)).alias("hint"), F.round("weight", 2).alias("weight"), "id")
    kinds = rows.groupBy(*kind).agg(F.count("*").alias("n"), F.min("id").alias("first"))

    def add(table: pa.Table) -> pa.Table:
        got = counted_thresholds(table.column("first").to_pylist(), np.array(table.column("weight").to_pylist(), np.float64), table.column("crowd").to_pylist(), np.array(table.column("hint").to_pylist()), np.array(table.column("n").to_pylist()), table.column("size")[0].as_py())
        i, place, r, gain = zip(*got) if got else ((), (), (), ())
        return table.select([*kind, "first"]).take(pa.array(i, pa.int64())).append_column("place", pa.array(place, pa.int64())).append_column("round", pa.array(r, pa.int32())).append_column("gain", pa.array(gain, pa.float64()))

    fields = "domain string, prototype int, crowd string, hint int, weight float, first string, place bigint, round int, gain double"
    added = staged(kinds.join(F.broadcast(sizes), "domain").groupBy("domain", "prototype").applyInArrow(add, fields), "added")
    per_round = added.groupBy("domain", "round").agg(F.count("*").alias("n")).join(F.broadcast(sizes), "domain")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("domain").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # rounds are few; a domain's last round is cut by gain, equal gains in the order of a hash
    room = per_round.withColumn("room", F.col("size") - before).where("room > 0").select("domain", "round", "room", (F.col("n") > F.col("room")).alias("cut"))
    open_ = added.join(F.broadcast(room), ["domain", "round"])
    whole = open_.where("not cut")
    last = _first_of(open_.where("cut").drop("cut"))
    keep = [*kind, "place", "gain"]
    chosen = whole.select(*keep).unionByName(last.select(*keep))
    # the smallest keys of a kind, first within shares of it, so that no task sorts a large kind
    most = chosen.groupBy(*kind).agg(F.max("place").alias("most"))
    asked = rows.join(most.join(kinds.select(*kind, "n"), kind), kind)
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(SALT_ROWS)))
    asked = asked.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy(*kind, "salt").orderBy("id"))).where(F.col("place") <= F.col("most"))
    asked = asked.withColumn("place", F.row_number().over(Window.partitionBy(*kind).orderBy("id")))
    return asked.select(*kind, "id", "place").join(chosen, [*kind, "place"]).select("domain", F.col("id").alias("chain_id"), "gain")


def _first_of(rows: DataFrame) -> DataFrame:
    """The first `room` rows of each domain by gain, then hash: counted in bins of gain and hash, so that only the bin in which the cut falls is sorted."""
    rows = rows.withColumn("low", -F.round("gain", 6)).withColumn("turn", F.xxhash64("first", "place")).withColumn("bin", F.floor((F.col("turn") / F.lit(2.0**64) + 0.5) * HASH_BINS).cast("int"))
    bins = rows.groupBy("domain", "room", "low", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("domain").orderBy("low", "bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("left", F.col("room") - F.coalesce(F.sum("n").over(order), F.lit(0))).where("left > 0").select("domain", "low", "bin", "left", (F.col("n") > F.col("left")).alias("part"))
    placed = rows.join(bins, ["domain", "low", "bin"])
    cut = placed.where("part").withColumn("at", F.row_number().over(Window.partitionBy("domain").orderBy("turn", "first", "place"))).where(F.col("at") <= F.col("left"))
    return placed.where("not part").select(*rows.columns).unionByName(cut.select(*rows.columns))


def covered(df: DataFrame, stats: DataFrame, **how) -> DataFrame:
    """(chain_id, domain, crowd, near, gain, chosen): every row of df with the mass of its crowd and, if it is in the varied subset, the gain with which it came in."""
    rows = staged(one_name(staged(features(df, **how), "features")), "named")
    chosen = select_varied(rows, domain_sizes(stats)).select(F.col("chain_id").alias("id"), "gain")
    return rows.join(chosen, "id", "left").select(F.col("id").alias("chain_id"), "domain", "crowd", "near", "gain", F.col("gain").isNotNull().alias("chosen"))


def domain_sizes(stats: DataFrame) -> DataFrame:
    """(domain, size): the sum of recorded counts of each domain."""
    return stats.where("domain is not null").groupBy("domain").agg(F.coalesce(F.sum("selected_count"), F.lit(0)).cast("bigint").alias("size"))
