"""Sources made of several files: chains by configuration, selected chains, workflow sets, evaluation results, file names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import xml as xm
from . import store as st

SELECTED = "chain_id string, paper_id string, cluster_id string, chain_text string, distance double"
VECTOR_METRICS = "cluster_id int, n_chains_in_selection int, n_chains_with_vector int, missing_vector_chain_ids array<string>, pairwise_cosine struct<n_pairs int, max double, min double, mean double, median double>"
JUDGMENTS = "cluster_id int, research_question_alignment string, reasoning_path_similarity string, overall_chain_similarity string, confidence string, rationale_zh string, error string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_chains(spark: SparkSession, config: Mapping, papers: DataFrame) -> DataFrame:
    """Chains by config['mode']: 'journal' takes config['journals'], 'random_sample' takes config['n'] papers by hash of config['seed'].

    config['cache'] names a path: parsed chains that lie there are read, else they are parsed and put there. An
    unknown mode, or no journals, is an error.
    """
    cache = config.get("cache")
    if cache and exists(spark, cache):
        return spark.read.schema(st.SCHEMAS["chains"]).json(cache)
    chains = xm.parse_chains(chosen_papers(spark, config, papers))
    if cache:
        st.write_jsonl(chains, cache)
        return spark.read.schema(st.SCHEMAS["chains"]).json(cache)
    return chains


def chosen_papers(spark: SparkSession, config: Mapping, papers: DataFrame) -> DataFrame:
    """(paper_id, journal, reasoning_xml): the papers that a configuration asks for, each once."""
    rows = papers.select("paper_id", "journal", "reasoning_xml").where("paper_id is not null").groupBy("paper_id").agg(F.max("journal").alias("journal"), F.max("reasoning_xml").alias("reasoning_xml"))
    mode = config.get("mode")
    if mode == "journal":
        if not config.get("journals"):
            raise ValueError("no journals are named")
        return rows.join(F.broadcast(spark.createDataFrame([(j,) for j in config["journals"]], "journal string").distinct()), "journal", "left_semi").select("paper_id", "journal", "reasoning_xml")
    if mode == "random_sample":
        ids = st.hash_sample(rows.select("paper_id"), "paper_id", int(config["n"]), int(config.get("seed", 0)))
        return rows.join(ids, "paper_id", "left_semi")
    raise ValueError(f"unknown mode {mode}")


def normal_cluster(raw: Column) -> Column:
    """A cluster id as a whole number; truth values and other texts are null."""
    text = raw.cast("string")
    return F.when(~F.lower(text).isin("true", "false"), text.try_cast("int"))


def selected_chains(spark: SparkSession, path: str) -> DataFrame | None:
    """(cluster_id, place, chain_id, paper_id, chain_text, distance) of a file of selected chains, by distance with unknown ones last; None if the file is no such list."""
    try:
        rows = spark.read.option("multiLine", True).json(path)
    except Exception:
        return None
    if "cluster_id" not in rows.columns or not {"chain_text", "chain_id"} & set(rows.columns):
        return None
    full = spark.read.schema(SELECTED).option("multiLine", True).json(path)
    good = full.where(an.is_record(full.columns)).withColumn("cluster_id", normal_cluster(F.col("cluster_id"))).where("cluster_id is not null")
    near = an.nearest_sample(good, 2**31 - 1, "cluster_id", "distance", "chain_id")
    return near.select("cluster_id", "place", "chain_id", "paper_id", "chain_text", "distance")


def workflow_entries(spark: SparkSession, root: str) -> DataFrame:
    """(entry_id, workflow): the files under workflows/, in one JSON each; without them the items of workflows.json by place; else none."""
    if exists(spark, f"{root}/workflows"):
        files = st.read_texts(spark, f"{root}/workflows", (".json",))
        if not files.isEmpty():
            return files.select(F.concat(F.lit("workflows/"), F.element_at(F.split("path", "/"), -1)).alias("entry_id"), F.col("text").alias("workflow"))
    if exists(spark, f"{root}/workflows.json"):
        whole = spark.read.text(f"{root}/workflows.json", wholetext=True)
        items = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("i", "workflow"))
        return items.where(F.startswith(F.trim("workflow"), F.lit("{"))).select(F.concat(F.lit("workflows.json#"), F.col("i").cast("string")).alias("entry_id"), "workflow")
    return spark.createDataFrame([], "entry_id string, workflow string")


def similarity_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(vector metrics, judgments, summary) of an evaluation; metrics must be there and be a list, the others may be missing."""
    if not exists(spark, f"{path}/vector_metrics.json"):
        raise FileNotFoundError(f"{path}/vector_metrics.json")
    head = spark.read.text(f"{path}/vector_metrics.json", wholetext=True).first()
    if head is None or not head.value.lstrip().startswith("["):
        raise ValueError("vector_metrics.json must be a list")
    metrics = spark.read.schema(VECTOR_METRICS).option("multiLine", True).json(f"{path}/vector_metrics.json")
    judged = f"{path}/llm_judgments.jsonl"
    judgments = spark.read.schema(JUDGMENTS).json(judged) if exists(spark, judged) else spark.createDataFrame([], JUDGMENTS)
    summary = spark.read.option("multiLine", True).json(f"{path}/summary.json").first() if exists(spark, f"{path}/summary.json") else None
    return metrics, judgments, summary.asDict(True) if summary else {}


def output_name(prefix: str, paper: Column) -> Column:
    """Where a paper's refined document is put."""
    return F.concat(F.lit(prefix), F.replace(paper, F.lit("/"), F.lit("%2F")), F.lit("_reasoning_chain_refine.xml"))


def without_output(papers: DataFrame, listing: DataFrame, prefix: str) -> DataFrame:
    """Papers whose output is not in a listing (path)."""
    return papers.join(listing.select(F.col("path").alias("__out")), output_name(prefix, F.col("paper_id")) == F.col("__out"), "left_anti")


def resolved_ids(spark: SparkSession, named: list[str] | None, listing: DataFrame, limit: int | None = None) -> DataFrame:
    """(paper_id): the named ids, trimmed and without blanks, in their order, else those of the listing."""
    if named:
        ids = [x for x in dict.fromkeys(n.strip() for n in named) if x]
        return spark.createDataFrame([(x,) for x in (ids[:limit] if limit else ids)], "paper_id string")
    rows = listing.select("paper_id").distinct().orderBy("paper_id")
    return rows.limit(limit) if limit else rows


def cluster_of_file(path: Column) -> Column:
    """The number in a name like cluster_7.json, null for other names."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)cluster_(\d+)\.json$", 1), F.lit("")).cast("int")


def endpoint(address: Column, public: str, internal: str) -> Column:
    """An address with its public beginning in place of the internal one."""
    return F.when(F.startswith(address, F.lit(internal)), F.concat(F.lit(public), F.substring(address, F.lit(len(internal) + 1), F.length(address)))).otherwise(address)


# Settings of the similarity evaluation and their defaults.
SIMILARITY_DEFAULTS = {"enabled": True, "selected_chains_path": "data/step1_output/selected_chains.json", "table_name": "chain_embeddings", "max_workers": 8, "max_chars_per_chain": 8000}


def similarity_settings(config: Mapping) -> dict:
    """Settings of the evaluation: its own section first, then the general data section, then the defaults."""
    own, data = config.get("chain_similarity") or {}, config.get("data") or {}
    found = {k: own.get(k) if own.get(k) is not None else data.get(k) for k in SIMILARITY_DEFAULTS}
    told = {k: SIMILARITY_DEFAULTS[k] if v is None or v == "" else type(SIMILARITY_DEFAULTS[k])(v) for k, v in found.items()}
    return told | {"max_workers": max(1, told["max_workers"])}


def papers_by_cluster(chains: DataFrame, documents: DataFrame) -> DataFrame:
    """(domain, cluster_id, papers, fetched, missing): the different papers of each cluster, and for how many there is a document."""
    pairs = chains.where("cluster_id is not null and paper_id is not null").select("domain", "cluster_id", "paper_id").distinct()
    there = documents.where("paper_md is not null or reasoning_xml is not null").select("paper_id", F.lit(True).alias("there")).distinct()
    held = pairs.join(there, "paper_id", "left")
    return held.groupBy("domain", "cluster_id").agg(F.count("*").alias("papers"), F.count("there").alias("fetched"), F.count_if(F.col("there").isNull()).alias("missing"))
