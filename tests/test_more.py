import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions import papers as pp
from lodeline.operators import analytics as an
from lodeline.operators import clustering as cu
from lodeline.operators import pipeline as pl
from lodeline.operators import vectors as vx
from lodeline.sources import artifacts as ar
from lodeline.sources import store as st

from .test_core import GOOD, points


def chain_table(spark, rows):
    full = [(k, p, "J", dom, k, "T", "x", "m", "text", v, c, 3, True, False) for k, dom, c, p, v in rows]
    return spark.createDataFrame(full, st.SCHEMAS["chain_embeddings"])


def test_cluster_and_save_then_increments(spark, tmp_path):
    chains, meta = pl.open_tables(spark, f"file://{tmp_path}/s")
    rows = points(60, 3)
    chains.append(chain_table(spark, rows + [("other", "e", 7, "p", [1.0] * 64)]))
    for _ in range(2):  # a second run leaves nothing of the first
        got = pl.cluster_and_save(chains, meta, "d", 30, 0.5).first()
        assert (got.n_clusters, got.total_chains, got.min_pair_sim) == (3, 60, 0.5) and chains.count() == 61 and meta.count() == 3
    assert chains.read().where("domain = 'e'").first().cluster_id == 7
    labels = {r.chain_id: r.cluster_id for r in chains.read().where("domain = 'd'").collect()}
    assert all(len({labels[r[0]] for r in rows if r[2] == c}) == 1 for c in range(3))
    m = meta.read().orderBy("local_cluster_id").collect()
    assert [r.num_chains for r in m] == [20, 20, 20] and m[0].paper_ids == sorted(m[0].paper_ids) and len(m[0].chain_xml_paths) == m[0].num_papers and m[0].created_at is not None
    fresh = chain_table(spark, [("n1", "d", -1, "px", points(3, 3)[1][4]), ("n2", "d", -1, "py", [-x for x in points(3, 3)[0][4]]), ("bad", "d", -1, "p", [0.0] * 64)])
    told = {r.chain_id: r for r in pl.incremental_run(chains, meta, fresh, "d").collect()}
    assert set(told) == {"n1", "n2"} and told["n1"].cluster_id == labels["c00001"] and not told["n1"].is_new and told["n2"].is_new
    after = {r.local_cluster_id: r.num_chains for r in meta.read().collect()}
    assert after[labels["c00001"]] == 21 and after[told["n2"].cluster_id] == 1 and len(after) == 4 and chains.count() == 63


def test_algorithms_by_configuration(spark, tmp_path):
    for bad in ({"algorithm": "kmeans"}, {"algorithm": "x"}, {}):
        with pytest.raises(ValueError):
            pl.algorithm(bad)
    with pytest.raises(RuntimeError):
        pl.algorithm({"algorithm": "kmeans", "n_clusters": 3, "device": "gpu"})
    rows = spark.createDataFrame(points(60, 3), "chain_id string, domain string, cluster_id int, paper_id string, vector array<float>")
    for config in ({"algorithm": "kmeans", "n_clusters": 3}, {"algorithm": "hdbscan", "hdbscan": {"min_cluster_size": 5}}, {"algorithm": "agglomerative", "device": "auto", "agglomerative": {"max_size": 30, "min_pair_sim": 0.5}}):
        out = pl.run(rows, config, "d")
        m = out["metrics"].first()
        assert m.n_clusters == 3 and m.silhouette > 0.3 and m.cosine_quality.high_sim_split in (0, None) and out["centers"].count() == 3
    pl.write_result(out, f"file://{tmp_path}/r")
    pl.write_result({"labels": out["labels"], "metrics": out["metrics"], "centers": None}, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r/labels").count() == 60
    assert pl.best_k(rows, 2, 4)[0] == 3
    assert pl.selection_config(None) == (0.1, 10) and pl.selection_config({"selection": {"top_percent": 0.5}}) == (0.5, 10)
    with pytest.raises(ValueError):
        vx.width(rows.select(F.expr("case when chain_id = 'c00001' then array(1f) else vector end").alias("vector")))
    assert vx.width(rows) == 64
    assert cu.cosine_quality(rows.limit(0)).first().clusters_with_pairs == 0


def test_chains_by_configuration(spark, tmp_path):
    papers = spark.createDataFrame([("a", "X", GOOD), ("a", "X", GOOD), ("b", "Y", GOOD), ("c", "X", "<broken"), (None, "X", GOOD)], "paper_id string, journal string, reasoning_xml string")
    config = {"mode": "journal", "journals": ["X", "X"], "cache": f"file://{tmp_path}/c"}
    for source in (papers, papers.limit(0)):  # the second time from the cache
        assert [(r.paper_id, len(r.steps)) for r in ar.load_chains(spark, config, source).collect()] == [("a", 3)]
    assert ar.load_chains(spark, {"mode": "random_sample", "n": 99}, papers).count() == 2
    for bad in ({"mode": "journal"}, {"mode": "?"}):
        with pytest.raises(ValueError):
            ar.load_chains(spark, bad, papers)


def test_files_of_artifacts(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [{"chain_id": "c1", "cluster_id": 2, "distance": None}, {"chain_id": "c2", "cluster_id": "2", "distance": 0.5}, {"chain_id": "c3", "cluster_id": True}, {"chain_id": "c4", "cluster_id": "x"}, {"cluster_id": 3}, {"chain_text": "t", "cluster_id": 1, "distance": 2.0}]
    (tmp_path / "sel.json").write_text(json.dumps(rows))
    assert [(r.cluster_id, r.place, r.chain_id) for r in ar.selected_chains(spark, f"{root}/sel.json").collect()] == [(1, 1, None), (2, 1, "c2"), (2, 2, "c1")]
    (tmp_path / "other.json").write_text(json.dumps([{"a": 1}]))
    assert ar.selected_chains(spark, f"{root}/other.json") is None and ar.selected_chains(spark, f"{root}/none.json") is None
    assert ar.workflow_entries(spark, root).count() == 0
    (tmp_path / "workflows.json").write_text(json.dumps([{"a": 1}, 5, {"b": 2}]))
    assert {r.entry_id for r in ar.workflow_entries(spark, root).collect()} == {"workflows.json#0", "workflows.json#2"}
    (tmp_path / "workflows").mkdir()
    (tmp_path / "workflows" / "cluster_4.json").write_text('{"w": 1}')
    assert [(r.entry_id, json.loads(r.workflow)) for r in ar.workflow_entries(spark, root).collect()] == [("workflows/cluster_4.json", {"w": 1})]
    with pytest.raises(FileNotFoundError):
        ar.similarity_artifacts(spark, root)
    (tmp_path / "vector_metrics.json").write_text("{}")
    with pytest.raises(ValueError):
        ar.similarity_artifacts(spark, root)
    (tmp_path / "vector_metrics.json").write_text(json.dumps([{"cluster_id": 1, "pairwise_cosine": {"n_pairs": 3, "mean": 0.5}}]))
    metrics, judgments, summary = ar.similarity_artifacts(spark, root)
    assert metrics.first().pairwise_cosine.n_pairs == 3 and judgments.count() == 0 and summary == {}
    (tmp_path / "llm_judgments.jsonl").write_text('{"cluster_id": 1, "confidence": "low"}\n\n')
    (tmp_path / "summary.json").write_text('{"n": 4}')
    _, judgments, summary = ar.similarity_artifacts(spark, root)
    assert judgments.first().confidence == "low" and summary == {"n": 4}
    assert [r.paper_id for r in ar.resolved_ids(spark, [" b ", "", "a", "b"], None, 2).collect()] == ["b", "a"]
    listing = spark.createDataFrame([("z",), ("y",)], "paper_id string")
    assert [r.paper_id for r in ar.resolved_ids(spark, None, listing, 1).collect()] == ["y"]
    assert ar.similarity_settings({"chain_similarity": {"max_workers": 0}, "data": {"selected_chains_path": "p"}}) == {"enabled": True, "selected_chains_path": "p", "table_name": "chain_embeddings", "max_workers": 1, "max_chars_per_chain": 8000}


def test_whole_files(spark, tmp_path):
    for where, name, text in (("xml", "p%2F1_reasoning_chain.xml", GOOD), ("xml", "q_reasoning_chain.xml", GOOD), ("md", "p%2F1.md", "text"), ("md", "q.md", " "), ("md", "skip.bin", "x")):
        (tmp_path / where).mkdir(exist_ok=True)
        (tmp_path / where / name).write_text(text)
    root = f"file://{tmp_path}"
    journals = spark.createDataFrame([("p/1", "J")], "paper_id string, journal string")
    assert [(r.paper_id, r.journal) for r in st.read_papers(spark, f"{root}/xml", f"{root}/md", journals).collect()] == [("p/1", "J")]
    assert st.read_papers(spark, f"{root}/xml", f"{root}/md").first().journal == "Unknown"
    assert {r.source_id for r in st.read_texts(spark, f"{root}/md").collect()} == {"p%2F1", "q"}
    assert len(st.listed_ids(spark, f"{root}/xml", "_reasoning_chain.xml", 1).collect()) == 1
    for k in ("cluster_1", "cluster_2", "other"):
        (tmp_path / "w" / k).mkdir(parents=True)
        (tmp_path / "w" / k / "a.json").write_text("{}")
    (tmp_path / "w" / "cluster_2" / "b.json").write_text("{}")
    assert [r.directory for r in st.workflow_directories(spark, f"{root}/w", ["a.json", "b.json"]).collect()] == ["cluster_2"]


def test_citations(spark):
    texts = ["# Accepted Manuscript\n\n# Spin waves in films\n\nA. Jones$^{1}$, B. Smith*\n\nWater Research 37 (2003) 4295\n", "WATER RESEARCH 46 (2012) I233\n## no title", "Received 3 May 1998, accepted 2 June 1999\n# T\nshort", "© 1901 X", "", None]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(pp.citation(F.col("t")).alias("c")).collect()]
    assert (got[0].journal, got[0].year, got[0].title, got[0].authors, got[0].first_author) == ("Water Research", 2003, "Spin waves in films", "A. Jones, B. Smith", "Jones") or got[0].first_author == "A."
    assert (got[1].journal, got[1].year, got[1].title) == ("Water Research", 2012, None)
    assert (got[2].year, got[2].title, got[2].authors) == (1999, "T", None) and got[3].year is None and got[4].title is None and got[5].title is None


def test_samples(spark):
    kind = T.StructType.fromDDL(pp.SAMPLE)
    blank = dict.fromkeys(kind.fieldNames())
    long_ = "A long English statement of the research problem that is to be solved here"
    rows = [
        blank | {"sample_id": "1", "domain": "d", "cluster_id": "3", "research_problem_full_zh": pp.FULL_PREFIX + long_, "research_question_zh": "why", "key_terms": [" a ", "", "b"], "related_chains": [("p_1", "", None), ("p_1", "", None), ("", "", ""), ("q_x_2", "q_x", "2")]},
        blank | {"ids": ("2", "d", "4"), "research_question_zh": " 为什么 ", "research_question_en": "", "labels": [("r_1", "r", "1")], "key_terms": None},
    ]
    docs = spark.createDataFrame([("r", f"<x><problem>{long_} <b>so</b> long</problem></x>")], "paper_id string, reasoning_xml string")
    got = {r.ids.sample_id: r for r in pp.migrated_samples(spark.createDataFrame([tuple(r[n] for n in kind.fieldNames()) for r in rows], kind), docs).collect()}
    assert got["1"].research_question_en == long_ and got["1"].research_question_zh.startswith("围绕「" + pp.FOCUS) and "「a、b」" in got["1"].research_question_zh
    assert [tuple(x) for x in got["1"].labels] == [("p_1", "p", "1"), ("q_x_2", "q_x", "2")] and tuple(got["1"].counts) == (2, 2)
    assert got["2"].research_question_zh == "为什么" and got["2"].research_question_en == long_ + " so long" and tuple(got["2"].counts) == (1, 0)
    xml = '<conclusion_reasoning conclusion_id="a.1"><conclusion id="a.1">A conclusion that is longer than forty characters</conclusion></conclusion_reasoning>'
    row = spark.range(1).select(pp.stated_conclusion(F.lit(xml), F.lit("a.1")).alias("a"), pp.stated_conclusion(F.lit(xml), F.lit("ab1")).alias("b"), pp.dot_source(F.lit("x\n```dot\ngraph\n```")).alias("c"), pp.dot_source(F.lit(" y\n")).alias("d")).first()
    assert row.a.startswith("A conclusion") and row.b is None and (row.c, row.d) == ("graph", "y")


def test_grouped_analytics(spark):
    tools = spark.createDataFrame([("T1",), ("t",), (" ",), (None,)], "tool_name string")
    steps = spark.createDataFrame([(1, "use T1 here"), (2, None), (3, "")], "s int, text string")
    assert sorted((r.s, r.tool_name) for r in an.text_matches(steps, tools, ["s"], "text").collect()) == [(1, "T1"), (1, "t")]
    assert an.text_matches(steps, tools.limit(0), ["s"], "text").count() == 0
    assert an.finder(["ab", "b"])("xab") == {"ab", "b"} and an.finder([])("x") == set()
    stages = spark.createDataFrame([("a", ["x"]), ("b", ["none"]), ("c", None)], "stage string, words array<string>")
    papers = spark.createDataFrame([(f"p{i}", "x y" if i else "y") for i in range(4)], "paper string, text string")
    got = {}
    for r in an.stage_keyword_papers(stages, papers, "stage", "words", "paper", "text").collect():
        got.setdefault(r.stage, []).append((r["rank"], r.paper, r.hits))
    assert sorted(got["a"]) == [(1, "p1", 1), (2, "p2", 1), (3, "p3", 1)] and sorted(got["b"]) == [(1, "p3", 0), (2, "p0", 0), (3, "p1", 0)] and sorted(got["c"]) == [(1, "p2", 0), (2, "p3", 0), (3, "p0", 0)]
    assert an.stage_keyword_papers(stages, papers.limit(0), "stage", "words", "paper", "text").count() == 0
    assert an.top_keywords(spark.createDataFrame([("m", ["t", "m"]), ("m", ["t", "u", "v", "w"]), (None, None)], "m string, t array<string>"), "m", F.col("t")).orderBy("place").collect()[0].keyword == "m"


def test_late_rows_of_a_stream(spark, tmp_path):
    """A watermark drops what comes too late; the table of the last rows is the same whatever the batches."""
    from lodeline.streaming import incremental as inc

    kind = "ts timestamp, event_type string, value double"
    days = [[("2024-01-01", 1.0), ("2024-01-02", 1.0)], [("2024-01-20", 1.0)], [("2024-01-01", 5.0), ("2024-01-21", 1.0)]]
    for day in days:
        spark.createDataFrame(day, "t string, value double").select(F.to_timestamp("t").alias("ts"), F.lit("k").alias("event_type"), "value").coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(kind).json(f"file://{tmp_path}/in")
        inc.windowed_counts(stream).writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {str(r.start)[:10]: (r.n, r.total) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got["2024-01-01"] == (1, 1.0) and got["2024-01-02"] == (1, 1.0)


def test_new_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from lodeline.plans import catalog, more

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in glob.glob(d + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    slow = {"cosine_quality", "task_manifest", "cluster_paths", "clustering_quality", "cluster_and_save", "selection_summary", "selected_papers", "judged_metrics"}
    for name in [n for n in more.NAMES if n in catalog.SQL and n not in slow]:
        got, want = catalog.QUERIES[name](spark, d).toPandas(), con.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert len(got) == len(want), name
        cols = sorted(got.columns)
        one = lambda v: "-" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
        show = lambda x: sorted("|".join(map(one, r)) for r in x[cols].astype(object).itertuples(index=False))  # noqa: B023, E731
        assert show(got) == show(want), name
