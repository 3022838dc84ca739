"""Work packages of clusters, workflow descriptions and their index, and pipelines over a completion provider."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import analytics as an
from . import providers as pv
from . import retrieval as rt
from . import vectors as vx

# The columns of a work package and the files that a worker is to write.
PACKAGE = ("chain_id", "paper_id", "cluster_id", "journal", "conclusion_id", "conclusion_title", "chain_text", "num_steps", "has_citations", "has_figures")
OUTPUTS = ("workflow_structure.json", "paper_extractions.yaml", "workflow_3layer.md", "review.pdf", "decision_tree.pdf")
WORKFLOW_KEYS = ("title", "steps")


def write_packages(chains: DataFrame, documents: DataFrame, path: str) -> DataFrame:
    """Writes chains and their papers' documents, one directory per domain and cluster, and returns what was found.

    (domain, cluster_id, chains, papers, documents): a paper without a document is counted and no error.
    """
    rows = chains.where("cluster_id >= 0 and chain_id is not null")
    rows.select("domain", *PACKAGE).write.partitionBy("domain", "cluster_id").mode("errorifexists").json(f"{path}/chains")
    papers = rows.select("domain", "cluster_id", "paper_id").distinct()
    held = papers.join(documents.select("paper_id", "reasoning_xml", "paper_md").where("reasoning_xml is not null or paper_md is not null").dropDuplicates(["paper_id"]), "paper_id")
    held.write.partitionBy("domain", "cluster_id").mode("errorifexists").parquet(f"{path}/documents")
    counts = rows.groupBy("domain", "cluster_id").agg(F.count("*").alias("chains"), F.count_distinct("paper_id").alias("papers"))
    return counts.join(held.groupBy("domain", "cluster_id").agg(F.count("*").alias("documents")), ["domain", "cluster_id"], "left").na.fill(0, ["documents"])


def manifest(meta: DataFrame, path: str) -> DataFrame:
    """One pending task per cluster, with its directory and the checklist of outputs."""
    return meta.select(
        "cluster_id", "global_cluster_id", "domain", F.concat(F.lit(f"{path}/chains/domain="), "domain", F.lit("/cluster_id="), F.col("cluster_id").cast("string")).alias("directory"), "num_chains", "num_papers",
        F.col("avg_intra_similarity").cast("double").alias("avg_intra_similarity"), F.lit("pending").alias("status"), F.create_map(*[x for o in OUTPUTS for x in (F.lit(o), F.lit(False))]).alias("outputs"),
    )


PAPERS = {"title": pa.string(), "family": pa.string(), "tools": pa.list_(pa.string()), "checked": pa.bool_(), "measured": pa.bool_()}
EXTRACTED = "array<struct<title string, family string, tools array<string>, checked boolean, measured boolean>>"


def extracted_papers(text: str | None) -> list[dict] | None:
    """The papers of an extraction file in one shape, whether it lists them or names them; None if it is no YAML."""
    import yaml

    try:
        got = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return None
    if isinstance(got, dict):
        got = got["papers"] if isinstance(got.get("papers"), list) else [*got.values()]
    part = lambda p, name: p[name] if isinstance(p.get(name), dict) else {}
    texts = lambda p, name: [x for x in p[name] if isinstance(x, str)] if isinstance(p.get(name), list) else []
    return [
        {"title": None if p.get("title") is None else str(p["title"]), "family": str(part(p, "algorithm_layer").get("method_family") or "") or None, "tools": texts(p, "tools"), "checked": bool(part(p, "implementation_layer").get("input_qc")), "measured": bool(texts(p, "quantitative_results"))}
        for p in (got if isinstance(got, list) else [])
        if isinstance(p, dict)
    ]


def with_papers(files: DataFrame, text: str = "extractions") -> DataFrame:
    """files with `papers` (EXTRACTED) and `parse_error` in place of the text."""
    keep = [c for c in files.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extracted_papers(t) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(got, pa.list_(pa.struct(list(PAPERS.items())))), pa.array([None if g is not None else "not readable" for g in got], pa.string())], [*keep, "papers", "parse_error"])

    fields = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, papers {EXTRACTED}, parse_error string")


# The words of inferred descriptions.
NO_PROBLEM, ARROW = "未知研究问题", " → "


def mentions(papers: DataFrame, key: str = "workflow_id") -> DataFrame:
    """(key, name): every method family and tool of the papers, as often as it is named."""
    named = F.flatten(F.transform("papers", lambda p: F.concat(F.array_compact(F.array(p["family"])), F.coalesce(p["tools"], F.array().cast("array<string>")))))
    return papers.select(key, F.explode(named).alias("name"))


def top_mentions(papers: DataFrame, most: int = 10, key: str = "workflow_id") -> DataFrame:
    """(key, methods, counts): the names mentioned most often, ties by name."""
    counts = mentions(papers, key).groupBy(key, "name").agg(F.count("*").alias("n"))
    first = counts.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "name"))).where(F.col("i") <= most)
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "name", "n"))).alias("m"))
    return lists.select(key, F.transform("m", lambda x: x["name"]).alias("methods"), F.transform("m", lambda x: x["n"]).alias("counts"))


def problem_description(stages: Column, title: Column) -> Column:
    """The question that stages and the first paper's title suggest."""
    two = F.concat(F.lit("如何通过 "), F.array_join(F.slice(stages, 1, 2), ARROW), F.lit(" 解决相关问题"))
    return F.when(title.isNotNull(), F.when(F.size(stages) > 0, two).otherwise(F.concat(F.lit("关于 "), F.left(title, F.lit(50)), F.lit(" 的研究方法")))).when(F.size(stages) > 0, F.concat(F.lit("如何完成 "), F.array_join(stages, ARROW))).otherwise(F.lit(NO_PROBLEM))


def workflow_keywords(methods: Column, stages: Column, most: int = 20) -> Column:
    """Methods and the words of stage names, in order, at most `most`."""
    words = F.flatten(F.transform(stages, lambda s: F.regexp_extract_all(s, F.lit("[一-鿿]+|[a-zA-Z]+"), F.lit(0))))
    return F.slice(F.array_sort(F.array_distinct(F.concat(methods, words))), 1, most)


def descriptions(files: DataFrame) -> DataFrame:
    """Workflow descriptions from (workflow_id, domain, structure, extractions, chains): JSON or YAML as text; unreadable ones are left out.

    The columns: ids, name and question, stages, methods with their share of papers, kinds of input and output, keywords, counts.
    """
    none = F.array().cast("array<string>")
    texts = files.select("workflow_id", "domain", "structure", "extractions", "chains").where(F.try_parse_json("structure").isNotNull())
    rows = with_papers(texts).where("parse_error is null")
    named = F.transform(F.from_json("structure", "stages array<struct<name string, stage string>>")["stages"], lambda s: F.coalesce(F.nullif(s["name"], F.lit("")), F.nullif(s["stage"], F.lit(""))))
    rows = rows.withColumn("main_stages", F.coalesce(F.array_compact(named), none))
    rows = rows.join(top_mentions(rows), "workflow_id", "left").withColumn("methods", F.coalesce("methods", none))
    count = F.size("papers")
    held = F.coalesce(F.json_array_length("chains"), F.json_array_length(F.get_json_object("chains", "$.chains")), F.lit(0))
    tag = lambda flag, name: F.when(F.exists("papers", lambda p: p[flag]), F.array(F.lit(name))).otherwise(none)
    return rows.select(
        "workflow_id", "domain", tx.workflow_name(F.col("main_stages"), F.col("methods")).alias("workflow_name"), problem_description(F.col("main_stages"), F.get("papers", F.lit(0))["title"]).alias("problem_description"), "main_stages", "methods",
        F.coalesce(F.transform("counts", lambda n: n / count), F.array().cast("array<double>")).alias("frequencies"), tag("checked", "experimental_data").alias("input_types"), tag("measured", "measurement_data").alias("output_types"),
        workflow_keywords(F.col("methods"), F.col("main_stages")).alias("keywords"), count.alias("num_papers"), held.alias("num_chains"),
    )


def signatures(described: DataFrame) -> DataFrame:
    return described.select("workflow_id", tx.similarity_signature(F.col("frequencies"), F.col("main_stages")).alias("s")).select("workflow_id", "s.*")


def index_tables(described: DataFrame, embedder: pv.Embedder) -> dict[str, DataFrame]:
    """The postings of three routes, the vectors of problem descriptions and the registry."""
    return {
        "keyword": rt.postings(described, F.col("keywords"), "workflow_id"),
        "io_type": rt.postings(described, F.concat("input_types", "output_types"), "workflow_id"),
        "method": rt.postings(described, F.col("methods"), "workflow_id"),
        "vectors": pv.embed(described, "problem_description", embedder, "workflow_id").select("workflow_id", "vector"),
        "registry": described.select("workflow_id", "domain", "workflow_name"),
    }


def search(index: dict[str, DataFrame], query: str, embedder: pv.Embedder, k: int = 5, domain: str | None = None, types: list[tuple[str, str]] = (), methods: list[tuple[str, str]] = (), recall: int = 20, merge: str = "first") -> DataFrame:
    """Four routes over an index, ranked. `types` and `methods` are rules (pattern, name) applied to the query."""
    spark = index["registry"].sparkSession
    asked = spark.range(1).select(tx.workflow_tokens(F.lit(query)).alias("w"), *[(tx.tags(F.lit(query), list(r)) if r else F.array().cast("array<string>")).alias(n) for n, r in (("t", types), ("m", methods))]).first()
    near = vx.top_k(index["vectors"], list(embedder([query])[0]), recall, key="workflow_id", dim=embedder.dim)
    routes = {
        "semantic": near.select(F.col("id").alias("workflow_id"), F.col("similarity").alias("score")),
        "keyword": rt.match_route(index["keyword"], asked.w, recall, "workflow_id"),
        "io_type": rt.match_route(index["io_type"], asked.t, recall, "workflow_id"),
        "method": rt.match_route(index["method"], asked.m, recall, "workflow_id"),
    }
    return rt.workflow_search(routes, index["registry"], k, domain, merge=merge)


def numbered_texts(chains: DataFrame, group: str, most: int, each: int, marker: str = "…") -> DataFrame:
    """(group, block, n): the first `most` texts of each group, cut and numbered, as one block; longer groups are counted whole."""
    w = Window.partitionBy(group).orderBy("chain_id")
    counts = chains.groupBy(group).agg(F.count("*").alias("n"))
    head = chains.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= most)
    line = F.concat(F.lit("["), F.col("__i").cast("string"), F.lit("] "), tx.truncated(F.coalesce("chain_text", F.lit("")), each, marker))
    blocks = head.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("block"))
    return counts.join(blocks, group)


def asked(groups: DataFrame, template: str, completer: pv.Completer, key: str, required: Sequence[str] = (), times: int = 2) -> DataFrame:
    """(key, answer, fields, status): a prompt per row, its JSON answer checked for required keys; a failure keeps its row."""
    prompts = groups.withColumn("__prompt", tx.filled(template, {c: F.col(c) for c in groups.columns}))

    def call(prompt: str) -> str:
        answer = completer(prompt)
        if required and pv.parsed_answer(answer, required) is None:
            raise ValueError(f"the answer lacks one of {', '.join(required)}")
        return answer

    answers = pv.complete(prompts, "__prompt", call, key, times)

    @F.pandas_udf("string")
    def fields(values):
        return values.map(lambda a: json.dumps(got, ensure_ascii=False, sort_keys=True) if a is not None and (got := pv.parsed_answer(a)) is not None else None)

    return answers.select(key, "answer", fields("answer").alias("fields"), F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error")


def extract_workflows(chains: DataFrame, template: str, completer: pv.Completer, most: int = 50, each: int = 1000) -> DataFrame:
    """One workflow per cluster; an answer without title or steps is asked for once more."""
    return asked(numbered_texts(chains, "cluster_id", most, each), template, completer, "cluster_id", WORKFLOW_KEYS)


def judge_clusters(chains: DataFrame, template: str, completer: pv.Completer, most: int = 5, each: int = 800) -> DataFrame:
    """(cluster_id, decision): ACCEPT, REJECT or ERROR."""
    got = asked(numbered_texts(chains, "cluster_id", most, each), template, completer, "cluster_id", ("decision",), 1)
    decision = F.upper(F.get_json_object("fields", "$.decision"))
    return got.select("cluster_id", F.when(decision.isin("ACCEPT", "REJECT"), decision).otherwise("ERROR").alias("decision"))


def compare_pairs(items: DataFrame, key: str, text: str, pairs: int, template: str, completer: pv.Completer, seed: int = 42) -> DataFrame:
    """A tournament over sampled pairs; an answer that names no side is a tie."""
    drawn = an.sampled_pairs(items, key, pairs, seed)
    side = lambda c: items.select(F.col(key).alias(c), F.col(text).alias(f"text_{c}"))
    both = drawn.join(side("a"), "a").join(side("b"), "b").withColumn("pair", F.concat_ws("|", "a", "b"))
    answers = pv.complete(both.withColumn("__p", tx.filled(template, {"a": F.col("text_a"), "b": F.col("text_b")})), "__p", completer, "pair")

    @F.pandas_udf("string")
    def told(values):
        return values.map(pv.verdict)

    verdicts = answers.select("pair", told(F.coalesce("answer", F.lit(""))).alias("better"))
    return an.tournament(both.select("pair", "a", "b").join(verdicts, "pair"), "a", "b")


def generated(items: DataFrame, key: str, prompt: str, completer: pv.Completer, valid: Callable[[str], bool] = pv.valid_code, times: int = 2) -> DataFrame:
    """(key, code, status): code that passes `valid`, fences taken off, within the attempts; else failed."""

    def call(p: str) -> str:
        code = completer(p)
        body = code.split("```")[1].split("\n", 1)[-1] if code.count("```") >= 2 else code
        if not valid(body):
            raise ValueError("not valid")
        return body

    got = pv.complete(items, prompt, call, key, times)
    return got.select(key, F.col("answer").alias("code"), F.when(F.col("answer").isNull(), "failed").otherwise("completed").alias("status"))


def success(statuses: DataFrame) -> DataFrame:
    """(total, completed, failed, success_rate)."""
    done = F.count_if(F.col("status") == "completed")
    return statuses.agg(F.count("*").alias("total"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.when(F.count("*") > 0, done / F.count("*")).otherwise(F.lit(0.0)).alias("success_rate"))


def similarity_evaluation(chains: DataFrame, selected: DataFrame, template: str, completer: pv.Completer) -> DataFrame:
    """Pair statistics of the selected chains of clusters with two or more, beside a completion's judgment."""
    mine = chains.join(selected.select("chain_id").distinct(), "chain_id", "left_semi")
    stats = vx.pair_statistics(mine.select("cluster_id", "chain_id", "vector"), ("cluster_id",)).where("n_pairs > 0")
    judged = asked(numbered_texts(mine, "cluster_id", 8, 900).where("n >= 2"), template, completer, "cluster_id", (), 1)
    return stats.join(judged.select("cluster_id", F.get_json_object("fields", "$.overall_chain_similarity").alias("overall"), F.get_json_object("fields", "$.confidence").alias("confidence"), "error"), "cluster_id", "left")


def missing_outputs(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: keys without a completed result."""
    return expected.join(done.where("status = 'completed'").select(key).distinct(), key, "left_anti")
