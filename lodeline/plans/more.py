"""Further queries of the core and their SQL: sources, sinks, filters, reports, text and workflow functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import papers as pp
from ..functions import text as tx
from ..operators import analytics as an
from ..operators import clustering as cu
from ..operators import pipeline as pl
from ..operators import providers as pv
from ..operators import retrieval as rt
from ..operators import vectors as vx
from ..operators import workflows as wf
from ..operators import xml as xm
from ..sources import artifacts as ar
from ..sources import store as st
from . import catalog as ca
from .catalog import CENTRES, CHAINS, GROUPED, KEYS, PAIRS, TEXTS, WORKFLOWS, query
from .tables import stage_dir, staged, table

BEFORE = set(ca.QUERIES)


def folder(spark, label: str) -> str:
    return f"{stage_dir(spark)}/{label}-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query("SELECT domain, cluster_id, size, selected_count FROM selection_stats")
def jsonl_round_trip(spark, d):
    """Rows written as JSON lines and read with their schema."""
    rows = table(spark, d, "selection_stats")
    path = folder(spark, "jsonl")
    st.write_jsonl(rows, path)
    return st.read_jsonl(spark, path, rows.schema).select("domain", "cluster_id", "size", "selected_count")


@query("SELECT paper_id FROM (SELECT DISTINCT paper_id FROM papers WHERE paper_id IS NOT NULL) ORDER BY md5(paper_id || ':42'), paper_id LIMIT 50")
def paper_sample(spark, d):
    """A random sample of papers, the feature's own limit."""
    return st.hash_sample(table(spark, d, "papers").select("paper_id").where("paper_id is not null").distinct(), "paper_id", 50, 42)


IN_DOMAIN = "(SELECT journal FROM domain_journals WHERE domain = 'bioinformatics')"


def _journals(spark, d):
    return table(spark, d, "domain_journals").where("domain = 'bioinformatics'")


@query(f"SELECT DISTINCT paper_id, journal FROM papers WHERE paper_id IS NOT NULL AND journal IN {IN_DOMAIN}")
def journal_filtered_ids(spark, d):
    return st.journal_ids(table(spark, d, "papers"), _journals(spark, d)).select("paper_id", "journal")


@query(f"SELECT journal, count(DISTINCT paper_id) AS papers FROM papers WHERE journal IN {IN_DOMAIN} GROUP BY journal")
def journal_filtered_counts(spark, d):
    return journal_filtered_ids(spark, d).groupBy("journal").agg(F.count("*").alias("papers"))


@query(f"SELECT paper_id, max(journal) AS journal, md5(max(reasoning_xml)) AS xml_md5 FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id HAVING max(journal) IN {IN_DOMAIN}")
def dispatched_papers(spark, d):
    """The papers that a configuration by journals asks for."""
    journals = [r.journal for r in _journals(spark, d).select("journal").collect()]  # a fixed list of configuration
    return ar.chosen_papers(spark, {"mode": "journal", "journals": journals}, table(spark, d, "papers")).select("paper_id", "journal", F.md5("reasoning_xml").alias("xml_md5"))


@query("SELECT * EXCLUDE (vector) FROM chain_embedding WHERE domain = 'superconductivity' AND cluster_id = 2")
def cluster_chain_rows(spark, d):
    return st.cluster_chains(table(spark, d, "chain_embedding"), "superconductivity", 2)


@query("SELECT len(vector)::INTEGER AS width, count(*) AS n FROM chain_embedding WHERE vector IS NOT NULL GROUP BY ALL")
def vector_widths(spark, d):
    return table(spark, d, "chain_embedding").where("vector is not null").groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))


@query("SELECT chain_id, num_steps FROM chain_embedding WHERE domain = 'math''s' OR num_steps > 7")
def registered_table(spark, d):
    """SQL over a registered table, with its values as parameters and never as text."""
    table(spark, d, "chain_embedding").createOrReplaceTempView("registered_chains")
    return spark.sql("SELECT chain_id, num_steps FROM registered_chains WHERE domain = :domain OR num_steps > :least", args={"domain": "math's", "least": 7})


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey != 2 AND c_nationkey != 4
UNION ALL SELECT -c_custkey, c_acctbal, 'REPLACED' FROM customer WHERE c_nationkey = 4""")
def keyed_table_changes(spark, d):
    """Append, update, upsert, delete and replacement on a table of versions."""
    customers = table(spark, d, "customer")
    rows = customers.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    t = st.KeyedTable(spark, folder(spark, "customers"), "c_custkey bigint, c_acctbal double, c_mktsegment string, c_nationkey int", "c_custkey", 8)
    t.append(rows.where("c_nationkey < 10"))
    t.append(rows.where("c_nationkey >= 10"))
    t.update(rows.where("c_nationkey = 1").select("c_custkey", F.lit(0.0).alias("c_acctbal")))
    t.upsert(rows.where("c_nationkey = 3").withColumn("c_mktsegment", F.lit("NEW")))
    t.delete(rows.where("c_nationkey = 2").select("c_custkey"))
    t.replace(rows.where("c_nationkey = 4").withColumn("c_custkey", -F.col("c_custkey")).withColumn("c_mktsegment", F.lit("REPLACED")), "c_nationkey = 4")
    return t.read().select("c_custkey", "c_acctbal", "c_mktsegment")


SELECTION = f"""WITH {CENTRES}, {TEXTS}, s AS (SELECT domain, cluster_id, count(*) AS size FROM g GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (ORDER BY size DESC, domain, cluster_id) AS n, count(*) OVER () AS k FROM s), b AS (SELECT domain, cluster_id FROM o WHERE n <= greatest(1, floor(k * 0.1))),
 r AS (SELECT domain, cluster_id, chain_id, round(list_distance(v, centre), 6) AS distance FROM g JOIN b USING (domain, cluster_id) JOIN k USING (domain, cluster_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY domain, cluster_id ORDER BY distance, chain_id)::INTEGER AS rank FROM r), sel AS (SELECT n.*, paper_id FROM n JOIN t USING (chain_id) WHERE rank <= 10)"""


def _selection(spark, d):
    share, k = pl.selection_config({"selection": {"top_percent": 0.1}})
    chosen = staged(cu.select_top_clusters(ca.grouped(spark, d), table(spark, d, "chain_embedding"), share, k), "selection")
    return pl.selection_parts(chosen, ca.cluster_sizes(spark, d))


@query(SELECTION + " SELECT (SELECT count(*) FROM s) AS n_clusters_total, (SELECT count(*) FROM (SELECT DISTINCT domain, cluster_id FROM sel)) AS n_clusters_selected, (SELECT count(*) FROM sel) AS n_chains_selected")
def selection_summary(spark, d):
    return _selection(spark, d)["summary"]


@query(SELECTION + " SELECT domain, cluster_id, any_value(size) AS size, count(*) AS selected_count FROM sel JOIN s USING (domain, cluster_id) GROUP BY ALL")
def selection_by_cluster(spark, d):
    """What the sink of a selection holds, read again."""
    path = folder(spark, "selection")
    pl.write_selection(_selection(spark, d), path)
    return spark.read.schema("domain string, cluster_id int, size bigint, selected_count bigint").json(f"{path}/stats")


@query(SELECTION + " SELECT DISTINCT paper_id FROM sel WHERE paper_id != ''")
def selected_papers(spark, d):
    return _selection(spark, d)["papers"]


@query("""WITH c AS (SELECT * FROM chain_embedding WHERE cluster_id >= 0 AND chain_id IS NOT NULL), k AS (SELECT domain, cluster_id, count(*) AS chains, count(DISTINCT paper_id) AS papers FROM c GROUP BY ALL),
 h AS (SELECT domain, cluster_id, count(DISTINCT paper_id) AS documents FROM c WHERE paper_id IN (SELECT paper_id FROM papers WHERE reasoning_xml IS NOT NULL OR paper_md IS NOT NULL) GROUP BY ALL)
SELECT domain, cluster_id, chains, papers, coalesce(documents, 0) AS documents FROM k LEFT JOIN h USING (domain, cluster_id)""")
def work_packages(spark, d):
    """Chains and documents written cluster by cluster."""
    return wf.write_packages(table(spark, d, "chain_embedding"), table(spark, d, "papers"), folder(spark, "packages"))


@query(f"""WITH {PAIRS}, s AS (SELECT domain, cluster_id, count(*) AS num_chains, count(DISTINCT paper_id)::INTEGER AS num_papers FROM g GROUP BY ALL), q AS (SELECT domain, cluster_id, avg(s) AS a FROM p GROUP BY ALL)
SELECT cluster_id, domain || '_' || cluster_id AS global_cluster_id, '/w/chains/domain=' || domain || '/cluster_id=' || cluster_id AS directory, num_chains, num_papers, round(coalesce(a, 1), 6) AS avg_intra_similarity, 'pending' AS status, 5 AS open FROM s LEFT JOIN q USING (domain, cluster_id)""")
def task_manifest(spark, d):
    m = wf.manifest(cu.cluster_metadata(ca.grouped(spark, d)), "/w")
    return m.select("cluster_id", "global_cluster_id", "directory", "num_chains", "num_papers", F.round("avg_intra_similarity", 6).alias("avg_intra_similarity"), "status", F.size(F.map_filter("outputs", lambda k, v: ~v)).alias("open"))


@query("""WITH m AS (SELECT DISTINCT paper_id, metadata_version, title FROM paper_metadata WHERE title IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY paper_id, metadata_version) - 1 AS i FROM m)
SELECT paper_id, metadata_version, CASE WHEN i = 0 THEN title ELSE title || '_' || i END AS unique_name FROM r""")
def unique_workflow_names(spark, d):
    m = table(spark, d, "paper_metadata").select("paper_id", "metadata_version", "title").where("title is not null").distinct()
    return st.numbered_names(m, "title", ["paper_id", "metadata_version"]).select("paper_id", "metadata_version", "unique_name")


@query("SELECT count(*) AS workflows, sum(num_steps)::BIGINT AS steps, round(avg(num_steps), 6) AS avg_steps FROM chain_embedding")
def saver_stats(spark, d):
    return table(spark, d, "chain_embedding").agg(F.count("*").alias("workflows"), F.coalesce(F.sum("num_steps"), F.lit(0)).alias("steps"), F.round(F.coalesce(F.avg("num_steps"), F.lit(0.0)), 6).alias("avg_steps"))


@query("SELECT count(*) AS total, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'completed') / count(*) AS success_rate FROM (SELECT CASE WHEN error_message IS NOT NULL THEN 'failed' WHEN step3_completed THEN 'completed' ELSE 'pending' END AS s FROM progress_tracker)")
def success_rate(spark, d):
    status = F.when(F.col("error_message").isNotNull(), "failed").when(F.col("step3_completed"), "completed").otherwise("pending")
    return wf.success(table(spark, d, "progress_tracker").select(status.alias("status")))


@query("""WITH p AS (SELECT DISTINCT domain, cluster_id, paper_id FROM chain_embedding WHERE cluster_id IS NOT NULL AND paper_id IS NOT NULL), h AS (SELECT DISTINCT paper_id AS there FROM papers WHERE paper_md IS NOT NULL OR reasoning_xml IS NOT NULL)
SELECT domain, cluster_id, count(*) AS papers, count(there) AS fetched, count(*) - count(there) AS missing FROM p LEFT JOIN h ON there = paper_id GROUP BY ALL""")
def cluster_fetch_report(spark, d):
    return ar.papers_by_cluster(table(spark, d, "chain_embedding"), table(spark, d, "papers"))


@query("SELECT DISTINCT paper_id FROM progress_tracker WHERE paper_id NOT IN (SELECT paper_id FROM progress_tracker WHERE step3_completed)")
def still_to_do(spark, d):
    rows = table(spark, d, "progress_tracker")
    done = rows.select("paper_id", F.when(F.col("step3_completed"), "completed").alias("status"))
    return wf.missing_outputs(rows.select("paper_id").distinct(), done, "paper_id")


@query("SELECT DISTINCT paper_id, 'out/' || replace(paper_id, '/', '%2F') || '_reasoning_chain_refine.xml' AS path FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM paper_metadata)")
def missing_refined_outputs(spark, d):
    listing = table(spark, d, "paper_metadata").select(ar.output_name("out/", F.col("paper_id")).alias("path")).distinct()
    left = ar.without_output(table(spark, d, "papers").select("paper_id").distinct(), listing, "out/")
    return left.select("paper_id", ar.output_name("out/", F.col("paper_id")).alias("path"))


@query("SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents")
def sync_totals(spark, d):
    return an.file_totals(table(spark, d, "documents"), "n_chars")


@query(f"""WITH {GROUPED}, s AS (SELECT domain, count(DISTINCT cluster_id) AS n_clusters, count(*) AS total_chains FROM g GROUP BY domain) SELECT domain, n_clusters, 'recorded' AS algorithm, total_chains FROM s""")
def cluster_summary(spark, d):
    return ca.grouped(spark, d).groupBy("domain").agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count("*").alias("total_chains")).withColumn("algorithm", F.lit("recorded"))


# --- filters and joins ----------------------------------------------------------------------------------------------


@query("SELECT paper_id, metadata_version, max((metadata_version = 'v1')::INTEGER) = 1 AS unreadable, CASE WHEN metadata_version = 'v1' THEN NULL ELSE 1 END::INTEGER AS papers FROM paper_metadata WHERE metadata_version IS NOT NULL GROUP BY ALL")
def extraction_errors(spark, d):
    """Extraction files read as YAML; broken ones are told apart."""
    rows = table(spark, d, "paper_metadata").where("metadata_version is not null").groupBy("paper_id", "metadata_version").agg(F.max("title").alias("t"))
    text = F.when(F.col("metadata_version") == "v1", F.lit("- [title: 'x")).otherwise(F.concat(F.lit("- title: "), F.to_json(F.struct(F.coalesce("t", F.lit("")).alias("t"))), F.lit("\n  tools: [A, 3]\n")))
    read = wf.with_papers(rows.select("paper_id", "metadata_version", text.alias("extractions")))
    return read.select("paper_id", "metadata_version", F.col("parse_error").isNotNull().alias("unreadable"), F.when(F.col("parse_error").isNull(), F.size("papers")).alias("papers"))


GRADED = "CASE WHEN num_steps > 5 THEN 'A' WHEN num_steps > 3 THEN 'B' ELSE 'C' END"


@query(f"SELECT count(*) AS total, count(*) FILTER (g = 'A' AND has_citations) AS a_main, count(*) FILTER (g = 'B') AS b_variant, count(*) FILTER (g = 'C') AS c_edge FROM (SELECT {GRADED} AS g, has_citations FROM chain_embedding)")
def grade_statistics(spark, d):
    rows = table(spark, d, "chain_embedding").select(F.expr(GRADED).alias("grade"), F.when(F.col("has_citations"), "主线").otherwise("旁支").alias("subtype"))
    return an.grade_statistics(rows)


@query(f"SELECT chain_id FROM chain_embedding WHERE {GRADED} = 'A' AND has_citations")
def main_line_chains(spark, d):
    rows = table(spark, d, "chain_embedding").select("chain_id", F.expr(GRADED).alias("grade"), F.when(F.col("has_citations"), "主线").alias("subtype"))
    return rows.where(an.is_main_line()).select("chain_id")


@query("""WITH m AS (SELECT paper_id, list_sort(list_distinct(list_filter([computational_setup.dft_code, computational_setup.xc_functional, computational_setup.pseudopotential, 'solver', '数值 X1'], lambda x: x IS NOT NULL AND regexp_matches(x, '[A-Z0-9]') AND NOT regexp_matches(x, '数值|求解器|积分器|未报告|未提及')))) AS t FROM paper_metadata)
SELECT DISTINCT paper_id, array_to_string(t[1:20], '|') AS tools FROM m""")
def named_tools(spark, d):
    tools = F.array_compact(F.array("computational_setup.dft_code", "computational_setup.xc_functional", "computational_setup.pseudopotential", F.lit("solver"), F.lit("数值 X1")))
    return table(spark, d, "paper_metadata").select("paper_id", F.array_join(an.named_tools(tools), "|").alias("tools")).distinct()


@query("SELECT cluster_id IS NOT NULL AND (chain_text IS NOT NULL OR chain_id IS NOT NULL) AS is_record, count(*) AS n FROM chain_embedding GROUP BY ALL")
def record_check(spark, d):
    rows = table(spark, d, "chain_embedding")
    return rows.groupBy(an.is_record(rows.columns).alias("is_record")).agg(F.count("*").alias("n"))


@query(f"""WITH {WORKFLOWS}, q AS (SELECT unnest(['vortex', 'lattice', 'lattice', 'linewidth']) AS term),
 a AS (SELECT workflow_id, count(*) / 4.0 AS s FROM i JOIN q USING (term) GROUP BY workflow_id ORDER BY s DESC, workflow_id LIMIT 20), n AS (SELECT workflow_id, {ca._scaled('s')} AS k FROM a)
SELECT workflow_id, round(k, 6)::DOUBLE AS keyword, round(0.2 * k + 0.05, 6)::DOUBLE AS score FROM n JOIN w USING (workflow_id) WHERE xc = 'meta-GGA' ORDER BY round(0.2 * k + 0.05, 12) DESC, workflow_id LIMIT 5""")
def workflow_search_in_domain(spark, d):
    """The domain is asked for after ranking and before the limit."""
    w = ca.workflows(spark, d)
    route = rt.match_route(rt.postings(w, tx.workflow_tokens(F.col("title")), "workflow_id"), ["vortex", "lattice", "lattice", "linewidth"], 20, "workflow_id")
    out = rt.workflow_search({"keyword": route}, w.select("workflow_id", F.col("xc").alias("domain")), 5, "meta-GGA")
    return out.select("workflow_id", F.round("keyword", 6).alias("keyword"), F.round("score", 6).alias("score"))


@query("SELECT chain_id, cluster_id AS old, CASE WHEN num_steps > 4 THEN num_steps + 1000 ELSE cluster_id END::INTEGER AS label FROM chain_embedding")
def chain_labels(spark, d):
    """New labels where there are some."""
    rows = table(spark, d, "chain_embedding").select("chain_id", "cluster_id", "num_steps")
    labels = rows.where("num_steps > 4").select("chain_id", (F.col("num_steps") + 1000).alias("new")).distinct()
    return rows.join(labels, "chain_id", "left").select("chain_id", F.col("cluster_id").alias("old"), F.coalesce("new", "cluster_id").alias("label"))


@query("SELECT chain_id, paper_id, conclusion_id FROM chain_embedding WHERE (paper_id, conclusion_id) IN (SELECT paper_id, conclusion_id FROM chain_embedding WHERE num_steps > 6)")
def step_chains(spark, d):
    """Chains found by the names of their steps."""
    rows = table(spark, d, "chain_embedding").select("chain_id", "paper_id", "conclusion_id", "num_steps")
    steps = rows.where("num_steps > 6").select(F.concat_ws("::", "paper_id", "conclusion_id", F.lit("7")).alias("step_id")).unionByName(spark.createDataFrame([("no::step",)], "step_id string"))
    return an.steps_to_chains(steps, rows).select("chain_id", "paper_id", "conclusion_id")


@query(f"""WITH {PAIRS}, m AS (SELECT domain || '_' || cluster_id AS cluster_id, count(*) AS n_pairs, avg(s) AS mean, min(s) AS lo, max(s) AS hi FROM p GROUP BY domain, cluster_id),
 j AS (SELECT domain || '_' || cluster_id AS cluster_id, arg_max(selected_count::VARCHAR, size) AS overall FROM selection_stats GROUP BY domain, cluster_id)
SELECT m.cluster_id, n_pairs, format('{{:.4f}}', mean) AS mean, format('{{:.4f}}', lo) AS min, format('{{:.4f}}', hi) AS max, coalesce(overall, '—') AS overall, '—' AS confidence FROM m LEFT JOIN j USING (cluster_id)""")
def judged_metrics(spark, d):
    """Metrics beside the last judgment of each cluster."""
    name = F.concat_ws("_", *KEYS)
    m = vx.pair_statistics(ca.grouped(spark, d)).where("n_pairs > 0").withColumn("cluster_id", name)
    j = table(spark, d, "selection_stats").select(name.alias("cluster_id"), F.col("size").alias("judged_at"), F.col("selected_count").cast("string").alias("overall"), F.lit(None).cast("string").alias("confidence"))
    return an.similarity_report(m, j).select("cluster_id", "n_pairs", "mean", "min", "max", "overall", "confidence")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name")
def all_pairs(spark, d):
    """All pairs of workflows, here of nations, drawn by number."""
    return an.sampled_pairs(table(spark, d, "nation"), "n_name", 10_000)


STAGES = [("s1", ["vortex", "lattice"]), ("s2", ["crystal", "spin", "layer"]), ("s3", ["nothing-of-the-kind"])]


@query(f"""WITH p AS (SELECT paper_id AS paper, max(title) AS title FROM paper_metadata WHERE paper_id IS NOT NULL GROUP BY paper_id), n AS (SELECT count(*) AS n FROM p), o AS (SELECT paper, row_number() OVER (ORDER BY paper) - 1 AS i FROM p),
 h AS ({" UNION ALL ".join(f"SELECT '{s}' AS stage, paper, " + " + ".join(f"coalesce(contains(lower(title), '{w}')::INTEGER, 0)" for w in ws) + " AS hits FROM p" for s, ws in STAGES)}),
 b AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY hits DESC, paper)::INTEGER AS rank FROM h WHERE hits > 0)
SELECT stage, paper, hits, rank FROM b WHERE rank <= 5
 UNION ALL SELECT stage, paper, 0, (i - (3 * k % n) + n) % n + 1 FROM o, n, (VALUES {", ".join(f"('{s}', {k})" for k, (s, _) in enumerate(STAGES))}) AS v(stage, k) WHERE stage NOT IN (SELECT stage FROM b) AND (i - (3 * k % n) + n) % n < 3""")
def stage_papers(spark, d):
    """Papers for each stage by its keywords; a stage without any takes turns."""
    stages = spark.createDataFrame(STAGES, "stage string, words array<string>")
    papers = table(spark, d, "paper_metadata").where("paper_id is not null").groupBy("paper_id").agg(F.coalesce(F.max("title"), F.lit("")).alias("title"))
    return an.stage_keyword_papers(stages, papers, "stage", "words", "paper_id", "title")


@query(f"SELECT workflow_id, count(*) OVER (PARTITION BY code) >= 30 AND code IS NOT NULL AND xc IS NOT NULL AS extractable FROM (WITH {WORKFLOWS} SELECT * FROM w)")
def extractable_workflows(spark, d):
    """Enough support and every criterion fulfilled."""
    w = ca.workflows(spark, d)
    n = w.groupBy(F.col("code").alias("c")).agg(F.count("*").alias("support"))
    rows = w.join(n, F.col("code").eqNullSafe(F.col("c"))).select("workflow_id", "support", F.col("code").isNotNull().alias("a"), F.col("xc").isNotNull().alias("b"))
    return an.extractable(rows, "support", ["a", "b"], 30).select("workflow_id", "extractable")


@query(f"""WITH {GROUPED}, b AS (SELECT domain, cluster_id FROM g GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT paper_id) >= 5), r AS (SELECT g.*, row_number() OVER (PARTITION BY domain, cluster_id, paper_id ORDER BY chain_id DESC) AS i FROM g JOIN b USING (domain, cluster_id))
SELECT domain, cluster_id, paper_id, chain_id FROM r WHERE i = 1""")
def core_chains(spark, d):
    """The best chain of each paper in clusters of enough chains and papers."""
    return an.core_chains(ca.grouped(spark, d).select(*KEYS, "paper_id", "chain_id"), list(KEYS), "paper_id", "chain_id", [F.desc("chain_id")])


@query("""WITH r AS (SELECT event_type AS run, date_trunc('day', ts) AS turn, max(value) AS rate FROM events GROUP BY ALL),
 w AS (SELECT *, max(rate) OVER (PARTITION BY run ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS best, max(rate) OVER (PARTITION BY run ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM r)
SELECT run, min(turn) AS stop_turn FROM w WHERE rate >= 1000000 OR (best IS NOT NULL AND recent <= best) GROUP BY run""")
def stopped_rounds(spark, d):
    """The first day that brought no gain for three days."""
    days = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.date_trunc("day", "ts").alias("turn")).agg(F.max("value").alias("rate"))
    return an.gains_stopped(days, "run", "turn", "rate", 1_000_000.0)


# --- grouped analytics ----------------------------------------------------------------------------------------------


@query(f"""WITH {GROUPED}, s AS (SELECT domain, cluster_id, count(*) AS num_chains, list_sort(list(DISTINCT paper_id)) AS p FROM g GROUP BY ALL)
SELECT domain || '_' || cluster_id AS global_cluster_id, num_chains, len(p)::INTEGER AS num_papers, md5(array_to_string(p, ',')) AS papers_md5, md5(array_to_string(list_transform(p, lambda x: 'paper_ocr/xml/' || x || '_reasoning_chain.xml'), ',')) AS xml_md5, md5(array_to_string(list_transform(p, lambda x: 'paper_ocr/md/' || x || '.md'), ',')) AS md_md5 FROM s""")
def cluster_paths(spark, d):
    """The metadata row's lists of papers and paths."""
    m = cu.cluster_metadata(ca.grouped(spark, d))
    return m.select("global_cluster_id", "num_chains", "num_papers", *[F.md5(F.array_join(c, ",")).alias(n) for c, n in (("paper_ids", "papers_md5"), ("chain_xml_paths", "xml_md5"), ("paper_md_paths", "md_md5"))])


@query(f"""WITH {PAIRS}, r AS (SELECT avg(s) AS m, min(s) AS lo FROM p GROUP BY domain, cluster_id), h AS (SELECT a.domain != b.domain OR a.cluster_id != b.cluster_id AS split FROM g a JOIN g b ON a.chain_id < b.chain_id WHERE list_cosine_similarity(a.v, b.v) >= 0.85)
SELECT count(*) AS clusters_with_pairs, round(median(m), 6) AS intra_sim_p50, round(median(lo), 6) AS min_sim_p50, round(avg(m), 6) AS intra_sim_mean, round(avg(lo), 6) AS min_sim_mean, (SELECT count(*) FROM h) AS high_sim_pairs, (SELECT count(*) FILTER (split) FROM h) AS high_sim_split, (SELECT round(count(*) FILTER (split) / count(*), 6) FROM h) AS high_sim_split_rate, (SELECT round(1 - count(*) FILTER (split) / count(*), 6) FROM h) AS high_sim_same_rate FROM r""")
def cosine_quality(spark, d):
    q = cu.cosine_quality(ca.grouped(spark, d))
    return q.select(*[F.round(c, 6).alias(c) if "sim_p" in c and "pairs" not in c or c.endswith(("mean", "rate")) else F.col(c) for c in q.columns])


@query("SELECT material, array_to_string(list_sort(list(DISTINCT paper_id)), ',') AS sources FROM paper_metadata WHERE material IS NOT NULL AND paper_id IS NOT NULL GROUP BY material")
def merged_sources(spark, d):
    rows = table(spark, d, "paper_metadata").where("material is not null").select("material", F.array("paper_id").alias("ids"))
    return an.merged_ids(rows, "material", "ids").select("material", F.array_join("ids", ",").alias("sources"))


@query("""WITH m AS (SELECT 0 AS kind, computational_setup.dft_code AS k FROM paper_metadata UNION ALL SELECT 1, unnest([computational_setup.xc_functional, computational_setup.pseudopotential, computational_setup.k_points]) FROM paper_metadata),
 c AS (SELECT kind, k, count(*) AS n FROM m WHERE k IS NOT NULL AND k != '' GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, k) AS i FROM c), o AS (SELECT k, min(kind * 100 + i) AS o FROM t WHERE i <= 5 GROUP BY k), r AS (SELECT k AS keyword, row_number() OVER (ORDER BY o)::INTEGER AS place FROM o)
SELECT place, keyword FROM r WHERE place <= 10""")
def keyword_list(spark, d):
    return an.top_keywords(table(spark, d, "paper_metadata"), "computational_setup.dft_code", F.array("computational_setup.xc_functional", "computational_setup.pseudopotential", "computational_setup.k_points", "computational_setup.q_points"))


@query("SELECT domain, cluster_id, selected_count, place FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY selected_count ASC NULLS LAST, cluster_id)::INTEGER AS place FROM selection_stats) WHERE place <= 4")
def nulls_last_sample(spark, d):
    return an.nearest_sample(table(spark, d, "selection_stats").select("domain", "cluster_id", "selected_count"), 4, "domain", "selected_count", "cluster_id")


@query("""WITH r AS (SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)
SELECT 0 AS line_no, '| n_nationkey | n_name |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT i + 1, line FROM r WHERE i <= 10 UNION ALL SELECT 12, '… ' || (SELECT count(*) - 10 FROM nation) || ' more'""")
def truncated_report(spark, d):
    """A report's table, cut with a note of what is hidden: the cut is the feature."""
    text = an.ablation_report(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 10)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, line string")


@query(f"WITH {CHAINS}, k AS (SELECT cluster_id < 0 AS noise, count(*) AS n FROM c GROUP BY ALL), z AS (SELECT * FROM c WHERE cluster_id >= 0 AND domain != '') SELECT (SELECT count(*) FROM (SELECT DISTINCT domain, cluster_id FROM z)) AS n_clusters, (SELECT count(*) FROM z) AS n_total, false AS davies_bouldin_skipped")
def clustering_quality(spark, d):
    """All metrics of a clustering in one row; those with SQL of their own are left out here."""
    return pl.evaluate(ca.grouped(spark, d)).select("n_clusters", "n_total", "davies_bouldin_skipped")


@query()
def generic_cluster_run(spark, d):
    """Labels of a clustering by configuration, after its result was written."""
    out = pl.run(ca.chains(spark, d), {"algorithm": "kmeans", "n_clusters": 12, "cosine_quality": False})
    pl.write_result(out, folder(spark, "result"))
    return out["labels"]


@query(f"WITH {CHAINS} SELECT count(*) AS total_chains, 'mathematics' AS domain, 'agglomerative' AS algorithm FROM c WHERE domain = 'mathematics'")
def cluster_and_save(spark, d):
    """A domain clustered and written back with its metadata: the operator works on one domain."""
    rows, meta = pl.open_tables(spark, folder(spark, "stored"))
    rows.append(table(spark, d, "chain_embedding").where("domain = 'mathematics'"))
    return pl.cluster_and_save(rows, meta, "mathematics", 50, 0.45).select("total_chains", "domain", "algorithm")


# --- scalar functions -----------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN user_id % 5 IN (0, 1) THEN NULL ELSE value END AS safe FROM events")
def json_safe_values(spark, d):
    odd = F.when(F.col("user_id") % 5 == 0, float("nan")).when(F.col("user_id") % 5 == 1, float("inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", tx.json_safe(odd).alias("safe"))


HEADINGS = ("## Method", "## Material", "## Experimental", "## 方法", "### Method")


@query(f"SELECT DISTINCT paper_id, md5(substr(paper_md, coalesce({', '.join(f"nullif(strpos(lower(paper_md), '{h.lower()}'), 0)" for h in HEADINGS)}, (length(paper_md) // 3) + 1)::INTEGER, 3000)) AS slice FROM papers")
def methods_slice(spark, d):
    return table(spark, d, "papers").select("paper_id", F.md5(tx.methods_section(F.col("paper_md"), HEADINGS)).alias("slice")).distinct()


@query(r"SELECT chain_id, left(regexp_replace(conclusion_title, '[^\w\x{4e00}-\x{9fff}.-]+', '_', 'g'), 180) AS stem FROM chain_embedding")
def safe_stems(spark, d):
    return table(spark, d, "chain_embedding").select("chain_id", tx.safe_stem(F.col("conclusion_title")).alias("stem"))


@query("SELECT chain_id, 'Q: ' || coalesce(conclusion_title, '') || ' / ' || coalesce(domain, '') || ' {{other}}' AS prompt FROM chain_embedding")
def prompts(spark, d):
    return table(spark, d, "chain_embedding").select("chain_id", tx.filled("Q: {{title}} / {{domain}} {{other}}", {"title": F.col("conclusion_title"), "domain": F.col("domain")}).alias("prompt"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '—' ELSE format('{:.4f}', o_totalprice) END AS shown, format('{:.1f}%', o_totalprice * 100.0 / 500000) AS share FROM orders")
def formatted_numbers(spark, d):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", tx.number(price).alias("shown"), tx.percent(F.col("o_totalprice"), F.lit(500000)).alias("share"))


@query("SELECT event_id, CASE WHEN length(props) > 12 THEN left(props, 9) || '...' ELSE props END AS cut FROM events")
def truncated_json(spark, d):
    return table(spark, d, "events").select("event_id", tx.truncated(F.col("props"), 12, "...").alias("cut"))


@query(f"""WITH {TEXTS}, c AS (SELECT domain, chain_id, chain_text, row_number() OVER (PARTITION BY domain ORDER BY chain_id) AS i, count(*) OVER (PARTITION BY domain) AS n FROM t WHERE domain IS NOT NULL)
SELECT domain, any_value(n) AS n, md5(string_agg('[' || i || '] ' || CASE WHEN length(chain_text) > 80 THEN left(chain_text, 79) || '…' ELSE coalesce(chain_text, '') END, chr(10) || chr(10) ORDER BY i)) AS block FROM c WHERE i <= 5 GROUP BY domain""")
def numbered_blocks(spark, d):
    """The first texts of each group, cut and numbered: the cut is the feature."""
    return wf.numbered_texts(ca.texts(spark, d).where("domain is not null"), "domain", 5, 80).select("domain", "n", F.md5("block").alias("block"))


CJK, LATIN = (f"(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '{p}', '', 'g'))::DOUBLE / length(text) ELSE 0 END)" for p in (r"[^\x{4e00}-\x{9fff}]", "[^A-Za-z]"))


@query(f"SELECT doc_id, text IS NOT NULL AND length(text) >= 35 AND {CJK} <= 0.12 AND (length(text) >= 40 AND {LATIN} >= 0.38 AND {CJK} < 0.12 OR length(text) >= 50 AND {LATIN} >= 0.22) AS good FROM documents")
def english_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(tx.good_enough_english(F.col("text")), F.lit(False)).alias("good"))


@query(r"""SELECT DISTINCT paper_id, metadata_version, '\bibitem{' || left(paper_id, 8) || '}' || chr(10) || coalesce(material, '') || '.' || chr(10) || coalesce(title, '') || '.' || chr(10) || CASE WHEN coalesce(computational_setup.dft_code, '') != '' THEN '\textit{' || computational_setup.dft_code || '}' ELSE '' END || CASE WHEN coalesce(metadata_version, '') != '' THEN ', ' || metadata_version ELSE '' END || '.' || chr(10) AS entry FROM paper_metadata""")
def bibliography(spark, d):
    """Entries of which a part may be absent."""
    entry = pp.bibliography_line(F.left("paper_id", F.lit(8)), F.col("material"), F.col("title"), F.col("computational_setup.dft_code"), F.col("metadata_version"), F.lit(None).cast("string"))
    return table(spark, d, "paper_metadata").select("paper_id", "metadata_version", entry.alias("entry")).distinct()


@query("SELECT event_id, props AS dot FROM events")
def dot_sources(spark, d):
    """The graph out of an answer, fenced or not."""
    answer = F.when(F.col("event_type") == "click", F.concat(F.lit("Here:\n```dot\n"), "props", F.lit("\n```\n"))).otherwise(F.concat(F.lit("  "), "props", F.lit("\n")))
    return table(spark, d, "events").select("event_id", pp.dot_source(answer).alias("dot"))


@query("SELECT chain_id, '/data/' || CASE WHEN lower(trim(domain)) = 'superconductivity' THEN 'Superconductivity' ELSE trim(domain) END || '/workflows/cluster_' || cluster_id || '/xml/' || paper_id || '_' || conclusion_id || '.xml' AS first, 2 AS n FROM chain_embedding")
def candidate_paths(spark, d):
    paths = pp.candidate_paths("/data", F.col("domain"), F.col("cluster_id"), F.col("paper_id"), F.col("conclusion_id"))
    return table(spark, d, "chain_embedding").select("chain_id", paths[0].alias("first"), F.size(paths).alias("n"))


@query("SELECT domain, cluster_id, CASE WHEN cluster_id % 3 = 0 THEN NULL ELSE cluster_id END AS found, CASE WHEN cluster_id % 3 = 1 THEN NULL ELSE cluster_id END AS normal FROM selection_stats")
def cluster_names(spark, d):
    """Cluster ids out of file names and of raw values."""
    c = F.col("cluster_id")
    name = F.concat(F.when(c % 3 == 0, F.lit("x/group_")).otherwise(F.lit("x/cluster_")), c.cast("string"), F.lit(".json"))
    raw = F.when(c % 3 == 1, F.lit("true")).otherwise(c.cast("string"))
    return table(spark, d, "selection_stats").select("domain", "cluster_id", ar.cluster_of_file(name).alias("found"), ar.normal_cluster(raw).alias("normal"))


@query("SELECT chain_id, CASE WHEN has_figures THEN 'https://out/' || xml_path ELSE 'else/' || xml_path END AS address FROM chain_embedding")
def endpoints(spark, d):
    inner = F.concat(F.when(F.col("has_figures"), F.lit("https://in/")).otherwise(F.lit("else/")), "xml_path")
    return table(spark, d, "chain_embedding").select("chain_id", ar.endpoint(inner, "https://out/", "https://in/").alias("address"))


@query(r"SELECT doc_id, regexp_replace(left(text, 100), '^\s+|\s+$', '', 'g') AS bare FROM documents WHERE text IS NOT NULL")
def prefix_stripped(spark, d):
    """Statements without the fixed words before them."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", pp.without_prefix(F.concat(F.lit(pp.FULL_PREFIX), F.left("text", F.lit(100)))).alias("bare"))


@query("SELECT chain_id, paper_id, conclusion_id FROM chain_embedding")
def chain_id_parts(spark, d):
    """Ids parted at their first underscore."""
    part = pp.split_chain(F.col("chain_id"), F.lit(""), F.lit(None).cast("string"))
    return table(spark, d, "chain_embedding").select("chain_id", part["paper_id"].alias("paper_id"), part["conclusion_id"].alias("conclusion_id"))


@query(f"""SELECT workflow_id, coalesce(nullif(array_to_string(list_filter([code, xc], lambda x: x IS NOT NULL), ' → '), ''), '未命名工作流') AS name,
 CASE WHEN title IS NOT NULL AND coalesce(code, xc) IS NOT NULL THEN '如何通过 ' || array_to_string(list_filter([code, xc], lambda x: x IS NOT NULL), ' → ') || ' 解决相关问题' WHEN title IS NOT NULL THEN '关于 ' || left(title, 50) || ' 的研究方法' WHEN coalesce(code, xc) IS NOT NULL THEN '如何完成 ' || array_to_string(list_filter([code, xc], lambda x: x IS NOT NULL), ' → ') ELSE '未知研究问题' END AS problem FROM (WITH {WORKFLOWS} SELECT * FROM w)""")
def workflow_names(spark, d):
    """Names and questions that stages and titles suggest."""
    stages = F.array_compact(F.array("code", "xc"))
    return ca.workflows(spark, d).select("workflow_id", tx.workflow_name(stages, F.array().cast("array<string>")).alias("name"), wf.problem_description(stages, F.col("title")).alias("problem"))


@query("""WITH m AS (SELECT paper_id, max(title) AS title, list(computational_setup.dft_code) FILTER (computational_setup.dft_code IS NOT NULL) AS tools FROM paper_metadata WHERE paper_id IS NOT NULL GROUP BY paper_id), e AS (SELECT paper_id, unnest(tools) AS name FROM m), c AS (SELECT paper_id, name, count(*) AS n FROM e GROUP BY ALL),
 t AS (SELECT paper_id, string_agg(name, '|' ORDER BY n DESC, name) AS methods FROM c GROUP BY paper_id)
SELECT paper_id AS workflow_id, coalesce(methods, '') AS methods, 1 AS num_papers, 2 AS num_chains, 'a → b' AS workflow_name FROM m LEFT JOIN t USING (paper_id)""")
def workflow_descriptions(spark, d):
    """Descriptions out of files of structure, extractions and chains."""
    m = table(spark, d, "paper_metadata").where("paper_id is not null").groupBy("paper_id").agg(F.coalesce(F.max("title"), F.lit("")).alias("title"), F.collect_list("computational_setup.dft_code").alias("tools"))
    files = m.select(F.col("paper_id").alias("workflow_id"), F.lit("d").alias("domain"), F.lit('{"stages": [{"name": "a"}, {"stage": "b"}]}').alias("structure"), F.concat(F.lit("["), F.to_json(F.struct("title", "tools")), F.lit("]")).alias("extractions"), F.lit('{"chains": [1, 2]}').alias("chains"))
    return wf.descriptions(files).select("workflow_id", F.array_join("methods", "|").alias("methods"), "num_papers", "num_chains", "workflow_name")


@query()
def citation_heads(spark, d):
    """What the first lines of each paper tell about it."""
    return table(spark, d, "papers").where("paper_md is not null").select("paper_id", pp.citation(F.col("paper_md")).alias("c")).select("paper_id", "c.*").distinct()


@query("SELECT DISTINCT paper_id, CASE WHEN length(trim(p)) >= 60 THEN trim(p) END AS problem FROM (SELECT paper_id, regexp_replace(regexp_replace(regexp_extract(reasoning_xml, '(?is)<problem\\b[^>]*>(.*?)</problem>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') AS p FROM papers)")
def stated_problems(spark, d):
    return table(spark, d, "papers").select("paper_id", pp.stated_problem(F.col("reasoning_xml")).alias("problem")).distinct()


@query()
def well_formed_documents(spark, d):
    """How many documents parse."""
    return table(spark, d, "papers").where("reasoning_xml is not null").groupBy(xm.well_formed(F.col("reasoning_xml")).alias("well_formed")).agg(F.count("*").alias("n"))


@query()
def chains_as_markdown(spark, d):
    """The chains of each paper as one text."""
    papers = table(spark, d, "papers").select("paper_id", "journal", "reasoning_xml").distinct()
    rows = xm.parse_chains(papers).select("paper_id", "conclusion_id", "conclusion_title", "conclusion_text", "steps")
    return xm.chains_text(rows.withColumn("paper", F.col("paper_id")), ["paper"]).select("paper", "n", F.md5("text").alias("text_md5"))


@query()
def conclusion_blocks(spark, d):
    return xm.conclusion_blocks(table(spark, d, "papers")).select("paper_id", "conclusion_id", "title", F.md5("reasoning_xml").alias("xml_md5")).distinct()


@query("SELECT DISTINCT chain_id FROM chain_embedding WHERE chain_id IS NOT NULL")
def refined_bodies(spark, d):
    """Each chain's text from its refined document, else from the table."""
    refined = xm.refined_texts(ca._enriched(spark, d), "enriched")
    return xm.refined_bodies(ca.texts(spark, d).where("chain_id is not null"), refined).where("body is not null").select("chain_id")


@query()
def migrated_samples(spark, d):
    """Samples of the old layout made of chains, in the new one."""
    rows = ca.texts(spark, d).where("paper_id is not null")
    chain = F.struct("chain_id", F.lit("").alias("paper_id"), F.lit("").alias("conclusion_id"))
    old = rows.groupBy("paper_id").agg(F.max("conclusion_title").alias("t"), F.max("domain").alias("domain"), F.sort_array(F.collect_list(chain)).alias("related_chains"))
    made = {"sample_id": F.col("paper_id"), "research_question_zh": F.col("t"), "research_focus_zh": F.col("domain"), "key_terms": F.array("domain"), "domain": F.col("domain"), "related_chains": F.col("related_chains")}
    full = old.select(*[(made[n] if n in made else F.lit(None)).cast(k).alias(n) for n, k in _sample_columns()])
    out = pp.migrated_samples(full)
    return out.select(F.col("ids.sample_id").alias("sample_id"), "research_question_zh", "research_question_en", F.size("labels").alias("labels"), F.col("counts.key_terms").alias("key_terms"))


def _sample_columns():
    from pyspark.sql import types as T

    return [(f.name, f.dataType) for f in T.StructType.fromDDL(pp.SAMPLE)]


@query()
def workflow_index_search(spark, d):
    """Descriptions indexed and searched over four routes."""
    m = table(spark, d, "paper_metadata").where("paper_id is not null and title is not null").groupBy("paper_id").agg(F.max("title").alias("title"), F.collect_set("computational_setup.dft_code").alias("tools"))
    files = m.select(F.col("paper_id").alias("workflow_id"), F.lit("d").alias("domain"), F.to_json(F.struct(F.array(F.struct(F.col("title").alias("name"))).alias("stages"))).alias("structure"), F.concat(F.lit("["), F.to_json(F.struct("title", "tools")), F.lit("]")).alias("extractions"), F.lit("[]").alias("chains"))
    e = pv.HashEmbedder(32)
    index = wf.index_tables(staged(wf.descriptions(files), "described"), e)
    return wf.search(index, "vortex lattice in layered crystals", e, 10, methods=[("VASP", "VASP")], merge="max").select("workflow_id", *[F.round(c, 6).alias(c) for c in ("semantic", "keyword", "method", "score")])


NAMES = [n for n in ca.QUERIES if n not in BEFORE]
