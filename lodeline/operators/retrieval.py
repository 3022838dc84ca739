"""Retrieval over several routes with fused scores, for chains and for workflows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import vectors as vx

# Weights of the routes.
CHAIN_WEIGHTS = {"vector": 0.65, "lexical": 0.25, "rule": 0.10}
WORKFLOW_WEIGHTS = {"semantic": 0.4, "keyword": 0.2, "io_type": 0.2, "method": 0.1, "quality": 0.1}
FLAT = 1e-9
LEXICAL_FIELDS, RULE_FIELDS = ["conclusion_title", "chain_text", "journal"], ["conclusion_title", "journal"]


def min_max(col: Column) -> Column:
    """Over all rows: from 0 to 1; where all are equal, 1 for positive values and 0 for others."""
    w = Window.partitionBy()
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(F.abs(high - low) < FLAT, F.when(col > 0, 1.0).otherwise(0.0)).otherwise((col - low) / (high - low))


def contains_score(terms: list[str], fields: list[str]) -> Column:
    """In how many of the fields each term occurs, whatever the case, summed."""
    parts = [F.coalesce(F.contains(F.lower(F.col(f)), F.lit(t.lower())).cast("int"), F.lit(0)) for t in terms for f in fields]
    return sum(parts, F.lit(0))


def query_terms(spark: SparkSession, query: str, n: int, lower: bool) -> list[str]:
    return spark.range(1).select(tx.chain_tokens(F.lit(query), n, lower).alias("t")).first().t


def lexical_route(rows: DataFrame, query: str, k: int, fields: list[str], n_terms: int = 8, lower: bool = True, key: str = "chain_id") -> DataFrame:
    """(key, score): the k rows in which most query terms occur; none for a query without terms. A key counts once, by its best row."""
    terms = query_terms(rows.sparkSession, query, n_terms, lower)
    score = contains_score(terms, fields)
    hits = rows.select(key, score.cast("double").alias("score")).where(F.col("score") > 0).where(F.col(key).isNotNull())
    return hits.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def fused(routes: dict[str, DataFrame], weights: dict[str, float], k: int, key: str = "chain_id") -> DataFrame:
    """(key, one score per route, final_score, route_hits): union of the routes, absent scores 0, min-max over the union, weighted."""
    parts = [df.select(F.col(key), F.lit(name).alias("route"), "score") for name, df in routes.items()]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    merged = all_.groupBy(key).agg(*[F.greatest(F.coalesce(F.max(F.when(F.col("route") == n, F.col("score"))), F.lit(0.0)), F.when(F.count_if(F.col("route") != n) > 0, 0.0).otherwise(F.lit(float("-inf")))).alias(n) for n in routes], F.array_join(F.array_sort(F.collect_set("route")), ",").alias("route_hits"))
    scaled = merged.select(key, *[min_max(F.col(n)).alias(n) for n in routes], "route_hits")
    final = sum((F.col(n) * weights.get(n, 0.0) for n in routes), F.lit(0.0))
    return scaled.withColumn("final_score", final).orderBy(F.desc("final_score"), key).limit(k)


def chain_search(rows: DataFrame, query: str, embedding: list[float], ann_k: int = 1000, lexical_k: int = 800, rule_k: int = 200, k: int = 100, weights: dict[str, float] | None = None, domain: str | None = None) -> DataFrame:
    """Three routes over one table of chains, fused. `domain` is an opt-in filter before recall."""
    rows = rows.where(F.col("domain") == domain) if domain else rows
    ann = vx.top_k(rows, embedding, ann_k).select(F.col("id").alias("chain_id"), (1 - F.col("distance")).alias("score"))
    lexical = lexical_route(rows, query, lexical_k, LEXICAL_FIELDS)
    rule = lexical_route(rows, query, rule_k, RULE_FIELDS, n_terms=6, lower=False)
    return fused({"vector": ann, "lexical": lexical, "rule": rule}, weights or CHAIN_WEIGHTS, k)


@dataclass
class ChainSearchRequest:
    query: str
    top_k: int = 10
    domain: str | None = None
    strict: bool = False


@dataclass
class ChainSearchResponse:
    items: list[dict]
    degraded: bool
    failed_routes: list[str] = field(default_factory=list)


class ChainSearch:
    """Search with the failure of a route isolated: what remains is fused and the response says so."""

    def __init__(self, rows: DataFrame, embed, weights: dict[str, float] | None = None):
        self.rows, self.embed, self.weights = rows, embed, weights or CHAIN_WEIGHTS

    def search(self, request: ChainSearchRequest) -> ChainSearchResponse:
        if not request.query.strip() or request.top_k <= 0:
            raise ValueError("a query and a positive top_k are needed")
        rows = self.rows.where(F.col("domain") == request.domain) if request.domain else self.rows
        spark = rows.sparkSession
        plans = {
            "vector": lambda: vx.top_k(rows, list(self.embed([request.query])[0]), 1000).select(F.col("id").alias("chain_id"), (1 - F.col("distance")).alias("score")),
            "lexical": lambda: lexical_route(rows, request.query, 800, LEXICAL_FIELDS),
            "rule": lambda: lexical_route(rows, request.query, 200, RULE_FIELDS, n_terms=6, lower=False),
        }
        good, failed = {}, []
        for name, plan in plans.items():
            try:  # at most a thousand rows each; taken here so that a failing run is noticed too
                good[name] = spark.createDataFrame([tuple(r) for r in plan().collect()], "chain_id string, score double")
            except Exception:
                failed.append(name)
        if not good or failed and request.strict:
            raise RuntimeError(f"routes failed: {', '.join(failed)}")
        items = [r.asDict() for r in fused(good, self.weights, request.top_k).collect()]
        return ChainSearchResponse(items, bool(failed) or not items, failed)


def postings(docs: DataFrame, terms: Column, key: str) -> DataFrame:
    """(term, key): one row per occurrence in the term lists; a term listed twice is there twice."""
    return docs.select(F.explode(terms).alias("term"), F.col(key)).where("term is not null")


def match_route(index: DataFrame, terms: list[str], k: int, key: str) -> DataFrame:
    """(key, score): hits over the number of query terms; repeated terms count again."""
    if not terms:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    asked = index.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    hits = index.join(F.broadcast(asked), "term").groupBy(key).agg((F.count("*") / F.lit(float(len(terms)))).alias("score"))
    return hits.orderBy(F.desc("score"), key).limit(k)


def workflow_search(routes: dict[str, DataFrame], registry: DataFrame, k: int = 5, domain: str | None = None, weights: dict[str, float] | None = None, merge: str = "first", key: str = "workflow_id") -> DataFrame:
    """(key, route scores, score): ranked workflows of the registry.

    merge='first' keeps a workflow only from the first route that found it; merge='max' fuses all routes. The
    domain filter comes after ranking and before the limit. A registry without quality counts 0.5.
    """
    weights = weights or WORKFLOW_WEIGHTS
    names = list(routes)
    parts = [df.select(key, F.lit(i).alias("turn"), F.lit(n).alias("route"), "score") for i, (n, df) in enumerate(routes.items())]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    if merge == "first":
        all_ = all_.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("turn"))).where("__n = 1")
    merged = all_.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("route") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in names])
    scaled = merged.select(key, *[min_max(F.col(n)).alias(n) for n in names])
    quality = F.coalesce(F.col("quality"), F.lit(0.5)) if "quality" in registry.columns else F.lit(0.5)
    known = scaled.join(registry, key)
    score = sum((F.col(n) * weights.get(n, 0.0) for n in names), quality * weights.get("quality", 0.1))
    ranked = known.withColumn("score", score)
    if domain is not None:
        ranked = ranked.where(F.col("domain") == domain)
    return ranked.select(key, *names, "score").orderBy(F.desc("score"), key).limit(k)
