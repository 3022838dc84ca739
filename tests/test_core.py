import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.functions import text as tx
from lodeline.operators import analytics as an
from lodeline.operators import clustering as cu
from lodeline.operators import providers as pv
from lodeline.operators import retrieval as rt
from lodeline.operators import vectors as vx
from lodeline.operators import xml as xm
from lodeline.plans import catalog
from lodeline.sources import store as st
from lodeline.streaming import incremental as inc

GOOD = """<reasoning_chains><conclusion_reasoning conclusion_id="1" conclusion_title="T"><conclusion_text>C</conclusion_text><reasoning>
<step id="1">First</step><step id="2">See <ref type="citation">[1]</ref> tail</step><step id="3">A &lt; B <ref type="figure">F</ref></step></reasoning></conclusion_reasoning>
<conclusion_reasoning conclusion_id="2" conclusion_title="E"><reasoning/></conclusion_reasoning></reasoning_chains>"""


def points(n, centres, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(f"c{i:05d}", "d", i % centres, f"p{i % 7}", (c[i % centres] + 0.2 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chain_id string, domain string, cluster_id int, paper_id string, vector array<float>")


def test_parse_keeps_mixed_text_and_survives_damage(spark):
    df = spark.createDataFrame([("a", None, GOOD), ("b", "J", "<x><unclosed>"), ("c", "J", ""), ("d", "J", None)], "paper_id string, journal string, reasoning_xml string")
    rows = xm.parse_chains(df).collect()
    assert len(rows) == 1 and rows[0].journal == "Unknown"
    s = rows[0].steps
    assert [x.text for x in s] == ["First", "See [1] tail", "A < B F"]
    assert [x.has_citations for x in s] == [False, True, False] and [x.has_figures for x in s] == [False, False, True]
    r = xm.chain_rows(xm.parse_chains(df)).first()
    assert r.chain_id == "a_1" and r.chain_text.startswith("Step 1: First\nStep 2") and r.num_steps == 3 and r.has_citations
    stats = xm.load_statistics(xm.parse_chains(df), df).first()
    assert (stats.papers, stats.with_chains, stats.skipped, stats.steps) == (4, 1, 3, 3)
    assert xm.parse_chains(df.limit(0)).count() == 0


def test_enrichment(spark):
    tool = ("t", 'N & "M"', "D", "k")
    df = spark.createDataFrame([("a", GOOD), ("b", "<bad"), ("c", None), ("d", "<r><conclusion_reasoning conclusion_id='1'><reasoning><step id='2' x='/>'/></reasoning></conclusion_reasoning></r>")], "paper_id string, reasoning_xml string")
    found = spark.createDataFrame([("a", "1", [tool], [("2", "t"), ("1", "?")]), ("a", "9", [], []), ("d", "1", [tool], [("2", "t"), ("2", "t")])], "paper_id string, " + xm.TOOLS)
    out = {r.paper_id: r for r in xm.enrich(df, found).collect()}
    a = out["a"].enriched
    assert a.startswith("<?xml") and a.count('<ref type="tool"') == 1 and 'category="k"' in a and a.count('type="citation"') == 1 and a.count("<tools>") == 1
    assert xm.chains_of(a.split("\n", 1)[1])[0]["steps"][1]["text"].endswith('tailN & "M"') and not out["b"].valid and not out["c"].valid
    assert out["d"].enriched.count("<ref ") == 2 and xm._root(out["d"].enriched.split("\n", 1)[1]) is not None
    done = xm.enrich(df, found)
    text = {(r.paper_id, r.conclusion_id): r.text for r in xm.refined_texts(done, "enriched").collect()}
    assert '[Tools: N & "M"]' in text["a", "1"] and '- **N & "M"**: D' in text["a", "1"] and "- Step 2: See " in text["a", "1"] and text["a", "2"] == "### Reasoning Steps:\n\n---\n\n"
    old = spark.createDataFrame([("p", "<r><conclusion_reasoning conclusion_id='7' conclusion_title='A'><conclusion title='B'>Says so</conclusion></conclusion_reasoning></r>")], "paper_id string, reasoning_xml string")
    asked = spark.createDataFrame([("p", "7"), ("p", "8"), ("q", "1")], "paper_id string, conclusion_id string")
    assert {(r.paper_id, r.conclusion_id): r.text for r in xm.conclusion_by_id(old, asked).collect()} == {("p", "7"): "## Conclusion: B\nSays so\n\n---\n\n", ("p", "8"): None, ("q", "1"): None}
    blocks = {r.conclusion_id: r for r in xm.conclusion_blocks(df.where("paper_id = 'a'")).collect()}
    assert blocks["1"].title == "T" and blocks["1"].reasoning_xml.startswith("<reasoning>")
    whole = xm.chains_text(xm.parse_chains(df.withColumn("journal", F.lit("J"))), ["journal"]).first()
    assert whole.n == 2 and whole.text.startswith("# T\nConclusion: C\n\n## Reasoning Steps:\n- First\n- See [1] tail\n")


def test_linkage_invariants():
    v = np.array([p[4] for p in points(60, 3)])
    lab = cu.constrained_linkage(v, 30, 0.5)
    assert sorted(set(lab)) == list(range(lab.max() + 1)) and lab.max() == 2
    small = cu.constrained_linkage(v, 5, 0.3)
    assert np.bincount(small).max() <= 5
    u = vx.unit(v)
    for g in range(small.max() + 1):
        assert (u[small == g] @ u[small == g].T).min() >= 0.3 - 1e-6
    assert (cu.constrained_linkage(v, 5, 0.3) == small).all()
    assert cu.constrained_linkage(v[:1]).tolist() == [0]
    assert cu.constrained_linkage(v[:4], 2, 0.0, np.array([2, 2, 2, 2])).tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        cu.constrained_linkage(v[:0])


def test_pairs_against_brute_force(spark):
    rows = points(90, 3) + [("z0", "d", 0, "p", [0.0] * 64), ("n0", "d", 0, "p", None), ("s0", "d", 0, "p", [1.0]), ("one", "d", 77, "p", [1.0] * 64)]
    df = vx.distinct_chains(frame(spark, rows + rows[:5]))
    assert df.count() == 91
    for block in (2048, 8):
        got = {r.cluster_id: r for r in vx.pair_statistics(df, block_rows=block).collect()}
        v = vx.unit(np.array([r[4] for r in rows[:90] if r[2] == 1]))
        s = (v @ v.T)[np.triu_indices(30, 1)]
        assert got[1].n_pairs == 435 and np.isclose(got[1].mean, s.mean()) and np.isclose(got[1].min, s.min()) and np.isclose(got[1].max, s.max())
        assert abs(got[1].median - np.median(s)) < 2e-4
        assert got[77].n_pairs == 0 and got[77].mean is None
    c = {r.cluster_id: r.centroid for r in vx.centroids(df).collect()}
    assert np.allclose(c[2], np.mean([r[4] for r in rows[:90] if r[2] == 2], 0), atol=1e-6)
    pair = vx.similar_pairs_split(df, 0.5, block_rows=20).first()
    u, lab = vx.unit(np.array([r[4] for r in rows[:90]] + [[1.0] * 64])), np.array([r[2] for r in rows[:90]] + [77])
    i, j = np.triu_indices(91, 1)
    hit = (u @ u.T)[i, j] >= 0.5
    assert (pair.pairs, pair.split) == (int(hit.sum()), int((lab[i] != lab[j])[hit].sum()))


def test_topk_and_assignment(spark):
    df = frame(spark, points(60, 3))
    top = vx.top_k(df, points(60, 3)[0][4], 5).collect()
    assert top[0].id == "c00000" and abs(top[0].distance) < 1e-6 and [r.distance for r in top] == sorted(r.distance for r in top)
    assert vx.top_k(df.limit(0), [1.0] * 64, 5).count() == 0
    with pytest.raises(ValueError):
        vx.top_k(df, [1.0], 5, "dot")
    meta = vx.centroids(df).withColumn("min_pair_sim_threshold", F.lit(0.6))
    new = frame(spark, [("n1", "d", -1, "p", points(3, 3)[1][4]), ("n2", "d", -1, "p", [-x for x in points(3, 3)[0][4]]), ("n3", "other", -1, "p", [1.0] * 64)])
    got = {r.chain_id: (r.cluster_id, r.is_new) for r in cu.assign_new(new, meta).collect()}
    assert got["n1"] == (1, False) and got["n2"][1] and got["n3"] == (0, True)


def test_selection_and_sizes(spark):
    df = frame(spark, points(60, 3) + [("x", "d", -1, "p", [1.0] * 64)])
    top = cu.select_top_clusters(df, spark.createDataFrame([("c00000", "p", None)], "chain_id string, paper_id string, chain_text string"), 0.34, 4).collect()
    assert len(top) == 4 and {r.cluster_id for r in top} == {0} and all(r.chain_text == "" for r in top)
    s = cu.size_statistics(df).first()
    assert (s.n_clusters, s.n_noise, s.n_total, s.size_min, s.size_median) == (3, 1, 61, 20, 20)


def test_density_and_two_stage(spark):
    v = vx.unit(np.array([p[4] for p in points(90, 3)]))
    lab = cu.density_labels(v, 5, 5)
    assert {tuple(sorted(set(lab[i::3].tolist()) - {-1})) for i in range(3)} == {(0,), (1,), (2,)}
    assert (cu.density_labels(v[:3], 5, 5) == -1).all()
    df = frame(spark, points(90, 3))
    two = cu.two_stage(df.select("chain_id", "vector"), 200, 0.5, micro=6)
    pure = two.join(df, "chain_id").groupBy("label").agg(F.count_distinct("cluster_id").alias("k")).agg(F.max("k")).first()[0]
    assert pure == 1 and two.count() == 90


def test_linkage_of_whole_groups(spark):
    rows = points(120, 3)
    v = np.array([p[4] for p in sorted(rows)])
    assert (cu.linkage_by_component(v, 50, 0.6) == cu.constrained_linkage(v, 50, 0.6)).all()
    # 4,200 rows of a group are 2,100 pairs of copies: every pair is one cluster
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2100, 64)).tolist()
    df = spark.createDataFrame([("d", f"c{i:05d}", x[i // 2]) for i in range(4200)], "domain string, chain_id string, vector array<float>")
    got = cu.linkage_within(df, ("domain",), 50, 0.95).groupBy("label").count().collect()
    assert len(got) == 2100 and {r["count"] for r in got} == {2}


def test_density_in_blocks_equals_the_whole(spark):
    rows = sorted(points(90, 3))
    want = cu.density_labels(vx.unit(np.array([p[4] for p in rows])), 5, 5)
    got = cu.density_clusters(frame(spark, rows).select(F.lit("d").alias("domain"), "chain_id", "vector"), ("domain",), part_rows=12).collect()
    assert len(got) == 90 and [r.label for r in sorted(got, key=lambda r: r.chain_id)] == want.tolist()


def test_small_clusters_are_made_once_for_all_thresholds(spark, tmp_path, monkeypatch):
    # three clusters of 100 copies each stay too large at every threshold
    v = np.random.default_rng(4).normal(size=(3, 64)).tolist()
    frame(spark, [(f"c{i:03d}", "d", 0, "p", v[i % 3]) for i in range(300)]).write.parquet(f"{tmp_path}/chain_embedding.parquet")
    made = []
    for name in ("_kmeans_model", "many_means"):
        monkeypatch.setattr(cu, name, lambda *a, f=getattr(cu, name, None), **k: made.append(1) or f(*a, **k), raising=False)
    got = catalog.QUERIES["evolved_clustering"](spark, str(tmp_path)).collect()
    assert len(made) == 1 and len(got) == 300 and {r.threshold for r in got} == {1.0}
    assert {tuple(sorted({r.label for r in got if int(r.chain_id[1:]) % 3 == i})) for i in range(3)} == {(0,), (1,), (2,)}


def test_means_by_dense_products(spark):
    rows = points(300, 3)
    df = frame(spark, rows).select("chain_id", "vector").repartition(3)
    centres = cu.many_means(df, 3)
    at, n, mean = cu._means(df, centres)
    v, own = np.array([p[4] for p in rows]), np.arange(300) % 3
    want = np.array([v[own == i].mean(0) for i in range(3)])
    assert n.tolist() == [100] * 3 and np.allclose(np.sort(mean, 0), np.sort(want, 0), atol=1e-5) and np.allclose(mean, centres, atol=1e-4)
    # pairs that are too heavy from the start leave the others as they were
    x = np.array([p[4] for p in rows[:40]])
    weight = np.where(np.arange(40) % 5 == 0, 9, 1)
    lab = cu.constrained_linkage(x, 10, 0.5, weight)
    assert max(weight[lab == i].sum() for i in set(lab.tolist())) <= 10
    assert cu.small_clusters(df.where("false")) is None


def test_linkage_without_a_matrix_equals_the_one_with_it(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(25, 64))[rng.integers(0, 25, 500)] + 1.2 * rng.normal(size=(500, 64)) * rng.random((500, 1))
    weight, levels = rng.integers(1, 75, 500), [0.5, 0.7, 0.8, 0.9, 1.0]
    want = [cu.constrained_linkage(v, 60, t, weight) for t in levels]
    for cells in (1 << 23, 2000):
        assert [np.unique(x, return_inverse=True)[1].tolist() for x in cu.linkage_at(v, 60, levels, weight, cells)] == [x.tolist() for x in want]
    # by blocks and components; centres of 60 and more join none
    centres = spark.createDataFrame([(3 * i, int(w), x) for i, (w, x) in enumerate(zip(weight, v.tolist()))], "micro int, n bigint, centroid array<float>")
    for block_rows in (70, 5000):
        got = sorted(cu.linked_centres(centres, 60, levels, block_rows).collect(), key=lambda r: r.micro)
        assert [r.micro for r in got] == list(range(0, 1500, 3))
        for i, x in enumerate(want):
            assert np.unique([r.labels[i] for r in got], return_inverse=True)[1].tolist() == x.tolist()
    assert len({tuple(x.tolist()) for x in want}) > 2
    # equal centres: none is left over
    same = cu.linkage_at(np.ones((7, 64)), 3, [0.7], np.ones(7))[0]
    assert sorted(np.unique(same, return_counts=True)[1].tolist()) == [1, 3, 3]


def test_small_clusters_grow_in_number_with_the_rows(spark, tmp_path):
    # 48,000 rows, 600 of them copies, the others around 300 points; 3,000 small clusters were all there could be
    i = F.sequence(F.lit(0), F.lit(63))
    spread = F.when(F.col("id") < 600, 0.0).otherwise(0.5)
    of = lambda *x: F.pmod(F.xxhash64(*x), F.lit(2001)) / 1000 - 1
    vector = F.transform(i, lambda k: (of(F.when(F.col("id") < 600, -1).otherwise(F.col("id") % 300), k) + spread * of("id", F.lit("own"), k)).cast("float"))
    df = spark.range(48000).select(F.format_string("c%05d", "id").alias("chain_id"), F.lit("d").alias("domain"), F.lit(0).alias("cluster_id"), F.lit("p").alias("paper_id"), vector.alias("vector"))
    df.write.parquet(f"{tmp_path}/chain_embedding.parquet")
    rows = catalog.chains(spark, str(tmp_path)).select("chain_id", "vector")
    labels, centres = cu.small_clusters(rows)
    got = {r.micro: r for r in (centres if isinstance(centres, list) else centres.collect())}
    assert 3000 < len(got) < 3500 and sum(r.n for r in got.values()) == 48000
    held = labels.groupBy("micro").agg(F.count("*").alias("n"), F.count_distinct("chain_id").alias("k"), F.count_if(F.col("chain_id") < "c00600").alias("copies")).collect()
    assert all(r.n == r.k == got[r.micro].n for r in held) and len(held) == len(got)
    assert sorted(r.copies for r in held)[-2:] == [0, 600]
    mean = labels.where("micro = 7").join(rows, "chain_id").toPandas().vector
    assert np.allclose(np.stack(mean).mean(0), got[7].centroid, atol=1e-5)
    # linkage joins small clusters up to the limit, and the query has these labels
    out = catalog.QUERIES["evolved_clustering"](spark, str(tmp_path)).collect()
    size = Counter(r.label for r in out)
    assert len(out) == len({r.chain_id for r in out}) == 48000 and {r.threshold for r in out} == {0.7}
    assert len(size) < 0.8 * len(got) and sum(n > 60 for n in size.values()) <= sum(r.n > 60 for r in got.values())


def test_rows_divided_in_parts(spark):
    v = np.repeat(np.random.default_rng(2).normal(size=(40, 64)), 5, axis=0).astype(np.float32)
    for most in (8, 512):
        label, mean, size = cu.divided(v, 40, np.random.default_rng(1), most=most)
        assert sorted(set(label.tolist())) == list(range(len(mean))) and size.tolist() == np.bincount(label).tolist() and size.sum() == 200
        assert all(len(set(label[i : i + 5].tolist())) == 1 for i in range(0, 200, 5))
        assert all(np.allclose(v[label == i].mean(0), m, atol=1e-5) for i, m in enumerate(mean))
    label, mean, size = cu.divided(np.ones((9, 64), np.float32), 4, np.random.default_rng(1))
    assert label.tolist() == [0] * 9 and size.tolist() == [9]


def noisy(n: int, seed: int) -> np.ndarray:
    """Unit vectors, two thirds of them in twelve clusters."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 64))
    some = rng.random(n) < 2 / 3
    return vx.unit(np.where(some[:, None], rng.normal(size=(12, 64))[rng.integers(0, 12, n)] + 0.4 * v, v)).astype(np.float32).astype(np.float64)


def test_density_of_noise_in_any_blocks(spark):
    v = noisy(600, 5)
    want = cu.density_labels(vx.unit(v), 5, 5)
    schema = "domain string, chain_id string, vector array<float>"
    # equal edges are many here; a group of one row, one of three copies and one without a valid vector come along
    rows = [("d", f"c{i:04d}", x) for i, x in enumerate(v.tolist())] + [("one", "o", v[0].tolist())] + [("copies", f"k{i}", v[1].tolist()) for i in range(3)] + [("none", "n", [float("nan")] * 64)]
    for part_rows in (30, 1000):
        got = {r.chain_id: r.label for r in cu.density_clusters(spark.createDataFrame(rows, schema), ("domain",), part_rows=part_rows).collect()}
        assert [got[f"c{i:04d}"] for i in range(600)] == want.tolist()
        assert [got[x] for x in ("o", "k0", "k1", "k2")] == [-1] * 4 and len(got) == 604


def test_equal_edges_merge_at_once():
    # row 10 is as near to the one cluster as to the other
    sides = [(0.1 + i / 100, s + i, s + i + 1) for s in (0, 5) for i in range(4)]
    trees = [sorted(sides) + x for x in ([(0.5, 10, 0), (0.5, 10, 5)], [(0.5, 10, 9), (0.5, 10, 2)], [(0.5, 4, 5), (0.5, 10, 0)])]
    assert {tuple(cu.tree_labels(11, t, 5).tolist()) for t in trees} == {(0,) * 5 + (1,) * 5 + (-1,)}


def test_nearest_rows_and_bridges_by_brute_force():
    v = np.concatenate([noisy(700, 6), noisy(700, 6)[:20]])  # with copies
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    at, to = np.arange(0, 300), np.arange(300, 720)
    r, c, got = cu.nearest_pairs(v, at, to, 5, strip=64, wide=128, full=500)
    assert np.allclose(got[r < 300].reshape(300, 5), np.sort(d[:300, 300:], 1)[:, :5]) and np.allclose(got[r >= 300].reshape(420, 5), np.sort(d[300:, :300], 1)[:, :5])
    r, c, got = cu.nearest_pairs(v, np.arange(720), None, 5, strip=64, wide=128, full=500)
    assert np.allclose(got.reshape(720, 5), np.sort(d, 1)[:, :5]) and np.allclose(got, d[r, c])
    core, component = np.sort(d, 1)[:, 4], np.arange(720) // 3
    a, b, w = cu.bridges(v, core, component, at, to, strip=64, wide=128)
    m = np.maximum(np.maximum(core[:300, None], core[None, 300:]), d[:300, 300:])
    between = m.reshape(100, 3, 140, 3).min((1, 3))
    want = cu.shortest(240, *(x.ravel() for x in np.meshgrid(np.arange(100), np.arange(100, 240), indexing="ij")), between.ravel())
    assert len(w) == 239 and np.allclose(np.sort(w), [x[0] for x in want], atol=1e-6)


def test_fusion_and_routes(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", -0.2)], "chain_id string, score double")
    b = spark.createDataFrame([("y", 3.0), ("z", 1.0)], "chain_id string, score double")
    got = {r.chain_id: r for r in rt.fused({"vector": a, "lexical": b}, {"vector": 0.65, "lexical": 0.25}, 10).collect()}
    assert got["x"].vector == 1 and got["y"].vector == 0 and got["y"].lexical == 1 and got["y"].route_hits == "lexical,vector"
    flat = spark.createDataFrame([("x", 2.0)], "chain_id string, score double")
    assert rt.fused({"vector": flat}, {"vector": 1.0}, 5).first().vector == 1.0
    rows = frame(spark, points(20, 2)).withColumn("conclusion_title", F.lit("Spin wave")).withColumn("chain_text", F.lit(None).cast("string")).withColumn("journal", F.lit("J"))

    def broken(_):
        raise OSError("no service")

    out = rt.ChainSearch(rows, broken).search(rt.ChainSearchRequest("spin", 3))
    assert out.degraded and out.failed_routes == ["vector"] and len(out.items) == 3
    for bad in (rt.ChainSearchRequest(" "), rt.ChainSearchRequest("x", 0)):
        with pytest.raises(ValueError):
            rt.ChainSearch(rows, broken).search(bad)
    with pytest.raises(RuntimeError):
        rt.ChainSearch(rows, broken).search(rt.ChainSearchRequest("spin", 3, strict=True))


def test_first_route_wins_or_all_fuse(spark):
    k = spark.createDataFrame([("w1", 1.0), ("w2", 0.5)], "workflow_id string, score double")
    m = spark.createDataFrame([("w1", 1.0), ("w3", 1.0)], "workflow_id string, score double")
    reg = spark.createDataFrame([("w1", "a"), ("w2", "a")], "workflow_id string, domain string")
    first = {r.workflow_id: r for r in rt.workflow_search({"keyword": k, "method": m}, reg).collect()}
    assert set(first) == {"w1", "w2"} and first["w1"].method == 0
    assert {r.workflow_id: r for r in rt.workflow_search({"keyword": k, "method": m}, reg, merge="max").collect()}["w1"].method == 1
    assert rt.workflow_search({"keyword": k}, reg, domain="b").count() == 0


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.chain_tokens(F.lit("Spin spin wave-1 a"), 8).alias("t"), tx.workflow_tokens(F.lit("The spin of Spin 12 x")).alias("w"), tx.repaired_json(F.lit('x ```json\n{"a": 1}\n``` y')).alias("j"), tx.repaired_json(F.lit("none")).alias("n"),
        tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("e"), tx.percent(F.lit(1), F.lit(0)).alias("p"), tx.number(F.lit(None)).alias("d"), tx.suffix_after(F.lit("p_1"), F.lit("p")).alias("s"), tx.truncated(F.lit("abcdefghij"), 8, "...").alias("c"),
        tx.without_tags(F.lit("<a>x</a>\n y")).alias("g"), tx.filled("q={{q}} {{z}}", {"q": F.lit("v"), "z": F.lit(None)}).alias("f"), tx.workflow_name(F.array(), F.array(F.lit("m"))).alias("o"),
    ).first()
    assert row.t == ["spin", "wave-1"] and row.w == ["spin", "spin", "12"] and json.loads(row.j) == {"a": 1} and row.n is None
    assert (row.e, row.p, row.d, row.s, row.c, row.g, row.f, row.o) == (1.0, "—", "—", "1", "abcde...", "x y", "q=v ", "m")


def test_analytics(spark):
    c = spark.createDataFrame([("a", "b", "A"), ("b", "c", "B"), ("a", "c", None)], "file_a string, file_b string, better string")
    assert [(r.file, r.score, r.ties) for r in an.tournament(c).orderBy("rank").collect()] == [("a", 1, 1), ("c", 1, 1), ("b", -2, 0)]
    items = spark.createDataFrame([(f"i{i}",) for i in range(10)], "k string")
    pairs = an.sampled_pairs(items, "k", 15).collect()
    assert len({(r.a, r.b) for r in pairs}) == 15 and all(r.a < r.b for r in pairs)
    assert an.sampled_pairs(items.limit(4), "k", 99).distinct().count() == 6
    rounds = spark.createDataFrame([("x", i, r) for i, r in enumerate([0.1, 0.5, 0.5, 0.4, 0.5])], "run string, turn int, rate double")
    assert an.gains_stopped(rounds, "run", "turn", "rate").first().stop_turn == 4
    near = spark.createDataFrame([("c", "a", None), ("c", "b", 2.0), ("c", "d", 1.0)], "g string, k string, distance double")
    assert [r.k for r in an.nearest_sample(near, 2, "g", "distance", "k").collect()] == ["d", "b"]


def test_table_versions(spark, tmp_path):
    t = st.KeyedTable(spark, f"file://{tmp_path}/t", "cluster_centers", "cluster_id")
    row = lambda i, s: (i, "d", [1.0], s)
    new = lambda *r: spark.createDataFrame(list(r), st.SCHEMAS["cluster_centers"])
    assert t.count() == 0
    t.append(new(row(1, 5), row(2, 6)))
    t.upsert(new(row(2, 7), row(3, 8)))
    t.update(spark.createDataFrame([(1, 50), (9, 1)], "cluster_id int, size int"))
    t.delete(spark.createDataFrame([(3,)], "cluster_id int"))
    assert {(r.cluster_id, r.size) for r in t.read().collect()} == {(1, 50), (2, 7)}
    t.replace(new(row(4, 1)), "domain = 'd'")
    assert t.count() == 1 and t.count("size > 1") == 0
    assert [r.found for r in t.get([4, 8]).collect()] == [True, False]
    _, before = t.manifest()
    t.upsert(new(row(77, 1)))
    _, after = t.manifest()
    assert sum(before.get(b) != d for b, d in after.items()) == 1  # one key touches one bucket
    t.compact()
    t.delete(spark.createDataFrame([(77,)], "cluster_id int"))
    turn, held = t.manifest()
    with pytest.raises(RuntimeError):
        t._commit(turn, held)
    with pytest.raises(ValueError):
        st.schema("nothing")
    with pytest.raises(ValueError):
        st.check_columns(spark.range(1), "cluster_centers")
    new(row(4, 9), row(5, 9)).write.json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(st.SCHEMAS["cluster_centers"]).json(f"file://{tmp_path}/in")
    for _ in range(2):
        inc.upsert_stream(stream, t, "size", f"file://{tmp_path}/ck").awaitTermination()
    assert {(r.cluster_id, r.size) for r in t.read().collect()} == {(4, 9), (5, 9)}


def test_config_and_lists(tmp_path):
    p = tmp_path / "j.yaml"
    p.write_text("a:\n  journals: [x, y]\nb:\n  journals: []\n")
    assert st.journal_config(str(p), "a") == ["x", "y"]
    for bad in ("b", "c"):
        with pytest.raises(ValueError):
            st.journal_config(str(p), bad)
    st.save_id_list(str(tmp_path / "l.json"), "a", ["x"], ["1", "2"], {"x": 2}, "now")
    assert st.load_id_list(str(tmp_path / "l.json")) == ["1", "2"]


def test_providers(spark):
    assert pv.in_order([{"index": 2, "embedding": [2]}, {"index": 0, "embedding": [0]}, {"index": 1, "embedding": [1]}]) == [[0], [1], [2]]
    e = pv.HashEmbedder(16)
    df = spark.createDataFrame([("a", "spin wave"), ("b", None)], "k string, t string")
    got = {r.k: r for r in pv.embed(df, "t", e, "k").collect()}
    assert np.allclose(got["a"].vector, e(["spin wave"])[0]) and sum(got["b"].vector) == 0
    out = {r.k: r for r in pv.complete(df, "t", lambda p: p.upper(), "k").collect()}
    assert out["a"].answer == "SPIN WAVE" and out["b"].answer is None
    assert pv.parsed_answer('```json\n{"a": 1}\n```') == {"a": 1} and pv.parsed_answer("no", default={}) == {}
    assert pv.verdict('{"better": "a"}') == "A" and pv.verdict("?") == "TIE"
    assert pv.valid_code("def execute_workflow(): pass") and not pv.valid_code("def f(:") and not pv.valid_code(None)
    rule = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^t[0-9]+$"}, "n": {"type": "number", "minimum": 0}}}
    assert pv.contract_errors({"id": "t1", "n": 1}, rule) == [] and len(pv.contract_errors({"id": "x", "n": -1}, rule)) == 2


def test_catalogue_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from lodeline.plans import catalog

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in glob.glob(d + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name in ("cluster_sizes", "intra_cluster_similarity", "select_top_clusters", "multi_recall_fused", "workflow_rerank", "latest_wins", "incremental_assignment", "size_cdf", "keyed_changes"):
        got, want = catalog.QUERIES[name](spark, d).toPandas(), con.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        show = lambda x: sorted(x[cols].map(lambda v: f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)).agg("|".join, axis=1))  # noqa: B023, E731
        assert show(got) == show(want), name
