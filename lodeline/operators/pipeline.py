"""Clustering from configuration to stored result: algorithms by name, search for k, quality, cluster-and-save, incremental runs, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import staged
from ..sources.store import KeyedTable
from . import clustering as cu
from . import vectors as vx

DEVICES = ("cpu", "auto")


def algorithm(config: dict) -> Callable[[DataFrame], DataFrame]:
    """rows (chain_id, vector) to (chain_id, label), by config['algorithm']: kmeans, hdbscan or agglomerative.

    A missing n_clusters, an unknown name and a device that isn't there are errors; device 'auto' is the cpu.
    """
    name, seed = config.get("algorithm"), int(config.get("random_seed", 42))
    if str(config.get("device", "cpu")).lower().strip() not in DEVICES:
        raise RuntimeError("no such device here; use cpu or auto")
    if name == "kmeans":
        if config.get("n_clusters") is None:
            raise ValueError("kmeans needs n_clusters")
        return lambda rows: cu.kmeans(rows, int(config["n_clusters"]), seed=seed, rounds=int(config.get("max_iter", 20)))
    if name == "hdbscan":
        own = config.get("hdbscan") or {}
        size = int(own.get("min_cluster_size", 5))
        return lambda rows: cu.density_clusters(rows.select(F.lit(0).alias("all"), "chain_id", "vector"), ("all",), size, int(own.get("min_samples") or size)).drop("all")
    if name == "agglomerative":
        own = config.get("agglomerative") or {}
        size, least = int(own.get("max_size", 50)), float(own.get("min_pair_sim", 0.45))

        def linkage(rows: DataFrame) -> DataFrame:
            if rows.count() <= int(own.get("max_n_exact", cu.EXACT_ROWS)):
                return cu.linkage_within(rows.select(F.lit(0).alias("all"), "chain_id", "vector"), ("all",), size, least).drop("all")
            return cu.two_stage(rows, size, least, own.get("micro_k"), seed=seed)

        return linkage
    raise ValueError(f"unknown clustering algorithm {name}")


def best_k(rows: DataFrame, low: int = 5, high: int = 50, seed: int = 42) -> tuple[int, float]:
    """(k, silhouette) of the k-means with the greatest silhouette, the smaller k among equals."""
    best = (low, -1.0)
    for k in range(low, high + 1):
        labels = cu.kmeans(rows, k, seed=seed).withColumnRenamed("label", "g")
        value = cu.silhouette(rows.join(labels, "chain_id").select("chain_id", "vector", "g"), "g").first().value
        if value is not None and value > best[1]:
            best = (k, value)
    return best


def evaluate(rows: DataFrame, keys: tuple[str, ...] = ("domain", "cluster_id")) -> DataFrame:
    """One row of quality: counts and sizes of clusters, silhouette of a sample, Calinski-Harabasz and Davies-Bouldin. Noise has a negative last key and counts in the sizes alone."""
    sizes = cu.size_statistics(rows, keys[-1], keys[:-1])
    good = staged(rows.where(F.col(keys[-1]) >= 0).select("chain_id", "vector", *keys, F.concat_ws("_", *keys).alias("g")), "valid")
    width = cu.silhouette(good.select("chain_id", "vector", "g"), "g").select(F.col("rows").alias("silhouette_sample_size"), F.col("value").alias("silhouette"))
    between = cu.calinski_harabasz(good, keys).select(F.col("value").alias("calinski_harabasz"))
    index = cu.davies_bouldin(good, keys).select(F.col("value").alias("davies_bouldin"), F.col("clusters").isNull().alias("davies_bouldin_skipped"))
    return sizes.join(width).join(between).join(index)


def run(rows: DataFrame, config: dict, domain: str | None = None) -> dict[str, DataFrame]:
    """Labels, centres, and one row of metrics with the cosine block, of a clustering by configuration."""
    rows = rows.where(F.col("domain") == domain) if domain else rows
    rows = rows.select("chain_id", "vector")
    labels = staged(algorithm(config)(rows), "labels")
    labelled = staged(rows.join(labels, "chain_id").select("chain_id", "vector", F.lit(domain or "").alias("domain"), F.col("label").alias("cluster_id")), "labelled")
    good = labelled.where("cluster_id >= 0")
    metrics = evaluate(labelled)
    if config.get("cosine_quality", True):
        block = cu.cosine_quality(good, float(config.get("cosine_split_threshold", 0.85)))
        metrics = metrics.join(block.select(F.struct(*block.columns).alias("cosine_quality")))
    return {"labels": labels, "centers": vx.centroids(good, ("cluster_id",)), "metrics": metrics}


def write_result(result: dict[str, DataFrame], path: str) -> None:
    """Labels, metrics and, if there are any, centres, each in a directory of its own; written again, they are replaced."""
    result["labels"].write.mode("overwrite").json(f"{path}/labels")
    result["metrics"].write.mode("overwrite").json(f"{path}/metrics")
    if result.get("centers") is not None:
        result["centers"].write.mode("overwrite").parquet(f"{path}/centers")


def selection_parts(selected: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ("domain", "cluster_id")) -> dict[str, DataFrame]:
    """What is kept of a selection: its chains, how many of each cluster, the different papers, and a summary of one row."""
    stats = sizes.select(*keys, "size").join(selected.groupBy(*keys).agg(F.count("*").alias("selected_count")), list(keys))
    total = sizes.agg(F.count("*").alias("n_clusters_total"))
    summary = total.join(stats.agg(F.count("*").alias("n_clusters_selected"), F.coalesce(F.sum("selected_count"), F.lit(0)).alias("n_chains_selected")))
    return {"chains": selected, "stats": stats, "papers": selected.select("paper_id").where("paper_id != ''").distinct(), "summary": summary}


def write_selection(parts: dict[str, DataFrame], path: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def selection_config(config: dict | None) -> tuple[float, int]:
    """(share of clusters, chains of each), with their defaults."""
    own = (config or {}).get("selection") or {}
    return float(own.get("top_percent", 0.1)), int(own.get("max_per_cluster", 10))


def cluster_and_save(chains: KeyedTable, meta: KeyedTable, domain: str, max_size: int = 50, least: float = 0.45, micro: int | None = None, share: float = 0.6) -> DataFrame:
    """Clusters a domain's chains, with a higher threshold while too many clusters are too large, writes their labels and metadata, and returns the summary.

    (domain, n_clusters, algorithm, min_pair_sim, total_chains): labels and metadata of the domain are replaced each in
    one step, so a second run leaves no rows of the first.
    """
    spark = chains.spark
    rows = staged(vx.distinct_chains(chains.read().where(F.col("domain") == domain)), "chains")
    labels, reached = cu.evolved(lambda t: staged(algorithm({"algorithm": "agglomerative", "agglomerative": {"max_size": max_size, "min_pair_sim": t, "micro_k": micro}})(rows.select("chain_id", "vector")), "labels"), "label", least, max_size, share)
    labelled = staged(rows.drop("cluster_id").join(labels.withColumnRenamed("label", "cluster_id"), "chain_id"), "labelled")
    relabel(chains, labelled.select("chain_id", "cluster_id"), domain)
    store_metadata(meta, cu.cluster_metadata(labelled, reached), domain)
    return labelled.agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count("*").alias("total_chains")).select(F.lit(domain).alias("domain"), "n_clusters", F.lit("agglomerative").alias("algorithm"), F.lit(reached).alias("min_pair_sim"), "total_chains")


def relabel(chains: KeyedTable, labels: DataFrame, domain: str) -> None:
    """The domain's rows with new cluster ids; rows without one keep theirs."""
    old = chains.read().where(F.col("domain") == domain)
    new = staged(old.withColumnRenamed("cluster_id", "__old").join(labels.select("chain_id", "cluster_id"), "chain_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "__old")).select(*old.columns), "relabelled")
    chains.replace(new, f"domain = '{sql_text(domain)}'")


def sql_text(value: str) -> str:
    """A text as it stands inside quotes in SQL."""
    return value.replace("\\", "\\\\").replace("'", "\\'")


def store_metadata(meta: KeyedTable, rows: DataFrame, domain: str, ids: DataFrame | None = None) -> None:
    """Metadata rows of a domain, or of some of its clusters, in place of the old ones."""
    now = F.current_timestamp().cast("timestamp_ntz")
    full = rows.withColumn("local_cluster_id", F.col("cluster_id")).withColumn("created_at", now).withColumn("last_updated", now)
    full = staged(full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in meta.kind]), "metadata")
    if ids is None:
        meta.replace(full, f"domain = '{sql_text(domain)}'")
    else:
        meta.upsert(full)


def incremental_run(chains: KeyedTable, meta: KeyedTable, fresh: DataFrame, domain: str) -> DataFrame:
    """Puts new chains (the columns of the table) to their nearest clusters or to clusters of their own, and renews the metadata of the clusters concerned.

    (chain_id, domain, cluster_id, similarity, is_new). Each cluster keeps its own threshold; a new one has the least
    of the domain, or 0.6 where there is none.
    """
    known = meta.read().where(F.col("domain") == domain).withColumnRenamed("local_cluster_id", "cluster_id")
    valid = vx.distinct_chains(fresh.where(F.col("domain") == domain))
    told = staged(cu.assign_new(valid.select("chain_id", "domain", "vector"), known), "assigned")
    chains.upsert(staged(fresh.drop("cluster_id").join(told.select("chain_id", "cluster_id"), "chain_id").dropDuplicates(["chain_id"]), "fresh"))
    touched = told.select("cluster_id").distinct()
    mine = staged(vx.distinct_chains(chains.read().where(F.col("domain") == domain)).join(touched, "cluster_id", "left_semi"), "touched")
    least = known.agg(F.min("min_pair_sim_threshold").alias("t")).first().t
    rows = cu.cluster_metadata(mine, 0.6 if least is None else float(least)).drop("min_pair_sim_threshold")
    own = known.select("cluster_id", F.col("min_pair_sim_threshold").alias("own"))
    rows = rows.join(own, "cluster_id", "left").withColumn("min_pair_sim_threshold", F.coalesce("own", F.lit(0.6 if least is None else float(least)))).drop("own")
    store_metadata(meta, rows, domain, touched)
    return told


def open_tables(spark: SparkSession, path: str) -> tuple[KeyedTable, KeyedTable]:
    """The table of chains and that of cluster metadata under one path."""
    return KeyedTable(spark, f"{path}/chains", "chain_embeddings", "chain_id"), KeyedTable(spark, f"{path}/clusters", "cluster_metadata", "global_cluster_id")
