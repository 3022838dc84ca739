import json

from pyspark.sql import functions as F

from lodeline.operators import providers as pv
from lodeline.operators import workflows as wf


def test_packages_and_manifest(spark, tmp_path):
    chains = spark.createDataFrame([("p_1", "p", 1, "J", "1", "T", "text", 3, True, False, "d"), ("q_1", "q", 1, None, "1", None, None, None, None, None, "d"), ("r_1", "r", -1, "J", "1", "T", "x", 1, True, True, "d")], ", ".join(f"{c} {'int' if c in ('cluster_id', 'num_steps') else 'boolean' if c.startswith('has') else 'string'}" for c in (*wf.PACKAGE, "domain")))
    docs = spark.createDataFrame([("p", "<x/>", "md"), ("p", "<x/>", "md"), ("q", None, None)], "paper_id string, reasoning_xml string, paper_md string")
    got = wf.write_packages(chains, docs, f"file://{tmp_path}/w").collect()
    assert [(r.cluster_id, r.chains, r.papers, r.documents) for r in got] == [(1, 2, 2, 1)]
    assert spark.read.json(f"file://{tmp_path}/w/chains").count() == 2
    meta = spark.createDataFrame([(1, "d_1", "d", 2, 2, 0.5)], "cluster_id int, global_cluster_id string, domain string, num_chains int, num_papers int, avg_intra_similarity float")
    task = wf.manifest(meta, "/w").first()
    assert task.status == "pending" and task.directory.endswith("domain=d/cluster_id=1") and not any(task.outputs.values())


def test_descriptions_index_and_search(spark):
    papers = [{"title": "T", "algorithm_layer": {"method_family": "spin fit"}, "tools": ["Lattice", 3], "implementation_layer": {"input_qc": "y"}, "quantitative_results": ["1"]}, {"tools": ["Lattice"]}, "junk"]
    rows = [("w1", "a", json.dumps({"stages": [{"name": "grow films"}, {"stage": "measure"}]}), json.dumps(papers), json.dumps([1, 2])), ("w2", "b", "{}", "", None), ("w3", "b", "broken", "", None)]
    d = wf.descriptions(spark.createDataFrame(rows, "workflow_id string, domain string, structure string, extractions string, chains string")).cache()
    got = {r.workflow_id: r for r in d.collect()}
    assert set(got) == {"w1", "w2"} and got["w2"].workflow_name == "未命名工作流" and got["w2"].problem_description == "未知研究问题"
    w = got["w1"]
    assert w.methods == ["Lattice", "spin fit"] and w.frequencies == [1.0, 0.5] and w.workflow_name == "grow films → measure" and w.num_papers == 2 and w.num_chains == 2
    assert w.input_types == ["experimental_data"] and w.output_types == ["measurement_data"] and "grow" in w.keywords
    s = {r.workflow_id: r for r in wf.signatures(d).collect()}
    assert len(s["w1"].method_vector) == 10 and s["w1"].stage_count == 2
    e = pv.HashEmbedder(32)
    index = wf.index_tables(d, e)
    hits = wf.search(index, "measure films", e, 5, merge="max").collect()
    assert hits[0].workflow_id == "w1" and hits[0].keyword == 1.0
    assert wf.search(index, "measure films", e, 5, domain="b").collect()[0].workflow_id == "w2"
    d.unpersist()


def test_pipelines_over_a_completer(spark):
    chains = spark.createDataFrame([(f"c{i}", i % 2, f"text {i}", [float(i + 1), 1.0] + [0.0] * 62) for i in range(6)], "chain_id string, cluster_id int, chain_text string, vector array<float>")
    good = wf.extract_workflows(chains, "{{block}}", lambda p: json.dumps({"title": p[:5], "steps": []}), each=40)
    assert {(r.cluster_id, r.status) for r in good.collect()} == {(0, "completed"), (1, "completed")}
    bad = wf.extract_workflows(chains, "{{block}}", lambda p: "no json")
    assert {r.status for r in bad.collect()} == {"failed"} and wf.success(bad).first().success_rate == 0
    assert wf.missing_outputs(chains.select("cluster_id").distinct(), good, "cluster_id").count() == 0
    verdicts = wf.judge_clusters(chains, "{{block}}", lambda p: '{"decision": "accept"}' if "text 0" in p else "?")
    assert {(r.cluster_id, r.decision) for r in verdicts.collect()} == {(0, "ACCEPT"), (1, "ERROR")}
    ranked = wf.compare_pairs(chains, "chain_id", "chain_text", 99, "{{a}} or {{b}}", lambda p: json.dumps({"better": "A"})).orderBy("rank").collect()
    assert [r.file for r in ranked] == [f"c{i}" for i in range(6)] and ranked[0].wins == 5
    code = wf.generated(spark.createDataFrame([("a", "ok"), ("b", "bad")], "k string, p string"), "k", "p", lambda p: "```python\ndef execute_workflow():\n    pass\n```" if p == "ok" else "x =")
    assert {(r.k, r.status) for r in code.collect()} == {("a", "completed"), ("b", "failed")}
    ev = wf.similarity_evaluation(chains, chains, "{{block}}", lambda p: '{"overall_chain_similarity": "high", "confidence": "low"}').collect()
    assert len(ev) == 2 and all(r.n_pairs == 3 and r.overall == "high" for r in ev)
    assert wf.numbered_texts(chains, "cluster_id", 2, 4).where(F.col("n") == 3).count() == 2
