"""The queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import analytics as an
from ..operators import clustering as cu
from ..operators import providers as pv
from ..operators import retrieval as rt
from ..operators import units
from ..operators import vectors as vx
from ..operators import xml as xm
from ..sources import store as st
from ..streaming import incremental as inc
from .tables import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "select_top_clusters"
KEYS = ("domain", "cluster_id")

# The chains with a valid vector, once each, as every vector query takes them.
CHAINS = """c AS (SELECT chain_id, max(domain) AS domain, max(cluster_id) AS cluster_id, max(paper_id) AS paper_id, any_value(vector)::DOUBLE[] AS v
 FROM chain_embedding WHERE len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0 AND chain_id IS NOT NULL GROUP BY chain_id)"""
GROUPED = CHAINS + """, g AS (SELECT * FROM c WHERE cluster_id >= 0 AND domain != '')"""
CENTRES = GROUPED + """, e AS (SELECT domain, cluster_id, unnest(v) AS x, unnest(range(64)) AS i FROM g),
 m AS (SELECT domain, cluster_id, i, avg(x) AS x FROM e GROUP BY ALL),
 k AS (SELECT domain, cluster_id, list(x ORDER BY i) AS centre FROM m GROUP BY ALL)"""
PAIRS = GROUPED + """, p AS (SELECT a.domain, a.cluster_id, list_cosine_similarity(a.v, b.v) AS s FROM g a JOIN g b ON a.domain = b.domain AND a.cluster_id = b.cluster_id AND a.chain_id < b.chain_id)"""
TEXTS = """t AS (SELECT chain_id, max(conclusion_title) AS conclusion_title, max(chain_text) AS chain_text, max(paper_id) AS paper_id, max(domain) AS domain, max(journal) AS journal FROM chain_embedding GROUP BY chain_id)"""


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def chains(spark: SparkSession, d: str) -> DataFrame:
    return vx.distinct_chains(table(spark, d, "chain_embedding"))


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return chains(spark, d).where("cluster_id >= 0 and domain != ''")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chain_embedding").groupBy("chain_id").agg(*[F.max(c).alias(c) for c in ("conclusion_title", "chain_text", "paper_id", "domain", "journal")])


# --- quantities -----------------------------------------------------------------------------------------------------


@query()
def p4_values(spark, d):
    """Every stated energy in eV."""
    return units.in_common_units(table(spark, d, "paper_metadata"))


@query()
def p4_found(spark, d):
    return units.in_other_units(p4_values(spark, d)).select("paper_id", "metadata_version", "field", "unit", "lg100").distinct()


# --- clusters -------------------------------------------------------------------------------------------------------


@query(f"WITH {GROUPED} SELECT domain, cluster_id, count(*) AS size FROM g GROUP BY ALL")
def cluster_sizes(spark, d):
    return grouped(spark, d).groupBy(*KEYS).agg(F.count("*").alias("size"))


@query(f"""WITH {CHAINS}, s AS (SELECT domain, cluster_id, count(*) AS size FROM c GROUP BY ALL)
SELECT count(*) FILTER (cluster_id >= 0) AS n_clusters, coalesce(sum(size) FILTER (cluster_id < 0), 0)::BIGINT AS n_noise, sum(size)::BIGINT AS n_total,
 round(coalesce(sum(size) FILTER (cluster_id < 0), 0)::DOUBLE / sum(size), 6) AS noise_ratio, min(size) FILTER (cluster_id >= 0) AS size_min,
 median(size) FILTER (cluster_id >= 0) AS size_median, max(size) FILTER (cluster_id >= 0) AS size_max, round(avg(size) FILTER (cluster_id >= 0), 6) AS size_mean FROM s""")
def cluster_size_stats(spark, d):
    return cu.size_statistics(chains(spark, d), keys=("domain",))


@query(f"WITH {CENTRES} SELECT domain, cluster_id, i::INTEGER AS i, round(x, 6) AS x FROM m")
def cluster_centroid(spark, d):
    return vx.centroids(grouped(spark, d)).select(*KEYS, F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {PAIRS} SELECT domain, cluster_id, round(avg(s), 6) AS avg_similarity, round(min(s), 6) AS min_similarity FROM p GROUP BY ALL")
def intra_cluster_similarity(spark, d):
    return vx.pair_statistics(grouped(spark, d)).where("n_pairs > 0").select(*KEYS, F.round("mean", 6).alias("avg_similarity"), F.round("min", 6).alias("min_similarity"))


@query(f"WITH {PAIRS} SELECT domain, cluster_id, count(*) AS n_pairs, round(max(s), 6) AS max, round(min(s), 6) AS min, round(avg(s), 6) AS mean, round(median(s), 4) AS median FROM p GROUP BY ALL")
def pairwise_summary(spark, d):
    rows = vx.pair_statistics(grouped(spark, d)).where("n_pairs > 0")
    return rows.select(*KEYS, "n_pairs", *[F.round(c, 6).alias(c) for c in ("max", "min", "mean")], F.round("median", 4).alias("median"))


@query(f"""WITH {PAIRS}, r AS (SELECT domain, cluster_id, max(s) AS hi, min(s) AS lo, avg(s) AS m, median(s) AS md FROM p GROUP BY ALL)
SELECT count(*) AS clusters, round(avg(m), 6) AS mean_of_means, round(avg(md), 4) AS mean_of_medians, round(min(lo), 6) AS least, round(max(hi), 6) AS greatest FROM r""")
def across_cluster_summary(spark, d):
    s = vx.pair_statistics(grouped(spark, d)).where("n_pairs > 0")
    return s.agg(F.count("*").alias("clusters"), F.round(F.avg("mean"), 6).alias("mean_of_means"), F.round(F.avg("median"), 4).alias("mean_of_medians"), F.round(F.min("min"), 6).alias("least"), F.round(F.max("max"), 6).alias("greatest"))


@query(f"""WITH {PAIRS}, s AS (SELECT domain, cluster_id, count(*) AS num_chains, count(DISTINCT paper_id) AS num_papers FROM g GROUP BY ALL),
 q AS (SELECT domain, cluster_id, avg(s) AS a, min(s) AS b FROM p GROUP BY ALL)
SELECT domain || '_' || cluster_id AS global_cluster_id, domain, cluster_id, num_chains, num_papers, round(coalesce(a, 1), 6) AS avg_intra_similarity, round(coalesce(b, 1), 6) AS min_intra_similarity
FROM s LEFT JOIN q USING (domain, cluster_id)""")
def cluster_metadata(spark, d):
    m = cu.cluster_metadata(grouped(spark, d))
    return m.select("global_cluster_id", *KEYS, "num_chains", "num_papers", F.round("avg_intra_similarity", 6).alias("avg_intra_similarity"), F.round("min_intra_similarity", 6).alias("min_intra_similarity"))


@query(f"""WITH {PAIRS}, s AS (SELECT domain, cluster_id, count(*) AS num_chains FROM g GROUP BY ALL), q AS (SELECT domain, cluster_id, avg(s) AS a FROM p GROUP BY ALL)
SELECT cluster_id, num_chains FROM s LEFT JOIN q USING (domain, cluster_id) WHERE domain = 'bioinformatics' AND num_chains BETWEEN 5 AND 2000 AND coalesce(a, 1) >= 0.3""")
def cluster_filter(spark, d):
    return cu.filtered_clusters(cu.cluster_metadata(grouped(spark, d)), "bioinformatics", None, 5, 2000, 0.3).select("cluster_id", "num_chains")


@query(f"""WITH {GROUPED}, s AS (SELECT domain, cluster_id, count(*) AS size FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, domain, cluster_id) AS n, count(*) OVER () AS k FROM s)
SELECT domain, cluster_id, size FROM r WHERE n <= greatest(1, floor(k * 0.1))""")
def top_percent_clusters(spark, d):
    return cu.top_share(cluster_sizes(spark, d), 0.1)


@query(f"""WITH {CENTRES}, r AS (SELECT domain, cluster_id, chain_id, round(list_distance(v, centre), 6) AS distance FROM g JOIN k USING (domain, cluster_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY domain, cluster_id ORDER BY distance, chain_id)::INTEGER AS rank FROM r) SELECT * FROM n WHERE rank <= 3""")
def nearest_k_per_cluster(spark, d):
    return cu.nearest_to_centroid(grouped(spark, d).select(*KEYS, "chain_id", "vector"), 3)


@query(f"""WITH {CENTRES}, {TEXTS}, s AS (SELECT domain, cluster_id, count(*) AS size FROM g GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (ORDER BY size DESC, domain, cluster_id) AS n, count(*) OVER () AS k FROM s), b AS (SELECT domain, cluster_id FROM o WHERE n <= greatest(1, floor(k * 0.1))),
 r AS (SELECT domain, cluster_id, chain_id, round(list_distance(v, centre), 6) AS distance FROM g JOIN b USING (domain, cluster_id) JOIN k USING (domain, cluster_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY domain, cluster_id ORDER BY distance, chain_id)::INTEGER AS rank FROM r)
SELECT n.domain, n.cluster_id, n.chain_id, distance, rank, coalesce(t.paper_id, '') AS paper_id, coalesce(chain_text, '') AS chain_text FROM n LEFT JOIN t USING (chain_id) WHERE rank <= 10""")
def select_top_clusters(spark, d):
    return cu.select_top_clusters(grouped(spark, d), table(spark, d, "chain_embedding"))


@query(f"""WITH {GROUPED}, s AS (SELECT domain, cluster_id, count(*) AS size FROM g GROUP BY ALL)
SELECT domain, count(*) AS clusters, count(*) FILTER (size > 50) AS large, round(count(*) FILTER (size > 50)::DOUBLE / count(*), 6) AS ratio FROM s GROUP BY ALL""")
def large_cluster_ratio(spark, d):
    return cu.large_share(grouped(spark, d), 50)


@query(f"""WITH {GROUPED}, s AS (SELECT domain, cluster_id, count(*) AS size FROM g GROUP BY ALL), u AS (SELECT size, count(*) AS groups, sum(size) AS rows FROM s GROUP BY size)
SELECT size, groups, round((sum(rows) OVER (ORDER BY size))::DOUBLE / (sum(rows) OVER ()), 6) AS cumulative FROM u""")
def size_cdf(spark, d):
    return an.size_distribution(cluster_sizes(spark, d))


@query(f"""WITH {CHAINS}, q AS (SELECT v AS qv FROM c ORDER BY chain_id LIMIT 1)
SELECT chain_id AS id, round(1 - list_cosine_similarity(v, qv), 6) AS distance, round(1 - (1 - list_cosine_similarity(v, qv)) / 2, 6) AS similarity FROM c, q ORDER BY round(1 - list_cosine_similarity(v, qv), 12), chain_id LIMIT 20""")
def vector_topk_cosine(spark, d):
    return _rounded(vx.top_k(table(spark, d, "chain_embedding"), _first_vector(spark, d), 20))


@query(f"""WITH {CHAINS}, q AS (SELECT v AS qv FROM c ORDER BY chain_id LIMIT 1)
SELECT chain_id AS id, round(list_distance(v, qv), 6) AS distance, round(1 / (1 + list_distance(v, qv)), 6) AS similarity FROM c, q ORDER BY round(list_distance(v, qv), 12), chain_id LIMIT 20""")
def vector_topk_l2(spark, d):
    return _rounded(vx.top_k(table(spark, d, "chain_embedding"), _first_vector(spark, d), 20, "l2"))


def _rounded(df):
    return df.select("id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


def _first_vector(spark, d) -> list[float]:
    # of all rows: only the first comes together, and repeated rows of a chain have one vector
    got = vx.valid(table(spark, d, "chain_embedding")).select("chain_id", "vector").orderBy("chain_id").select("vector").first()
    return list(got.vector) if got else [0.0] * vx.DIM


@query(f"""WITH {CENTRES}, n AS (SELECT chain_id, domain, v FROM c WHERE cluster_id < 0 AND domain != ''),
 s AS (SELECT chain_id, domain, k.cluster_id, list_cosine_similarity(v, centre) AS similarity FROM n JOIN k USING (domain)),
 r AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY similarity DESC, cluster_id) AS n FROM s) SELECT chain_id, domain, cluster_id, round(similarity, 6) AS similarity FROM r WHERE n = 1""")
def nearest_centroid_assign(spark, d):
    rows = chains(spark, d).where("cluster_id < 0 and domain != ''")
    return vx.nearest_centroid(rows, vx.centroids(grouped(spark, d))).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {CENTRES}, w AS (SELECT chain_id, domain, v FROM c WHERE cluster_id < 0 AND domain != ''),
 s AS (SELECT chain_id, domain, k.cluster_id, list_cosine_similarity(v, centre) AS similarity FROM w LEFT JOIN k USING (domain)),
 r AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY similarity DESC, cluster_id) AS n FROM s), o AS (SELECT * FROM r WHERE n = 1), l AS (SELECT domain, max(cluster_id) AS last FROM k GROUP BY domain),
 y AS (SELECT o.*, last, coalesce(similarity < 0.6, true) AS is_new FROM o LEFT JOIN l USING (domain))
SELECT chain_id, domain, CASE WHEN is_new THEN (coalesce(last, -1) + row_number() OVER (PARTITION BY domain, is_new ORDER BY chain_id))::INTEGER ELSE cluster_id END AS cluster_id, is_new FROM y""")
def incremental_assignment(spark, d):
    meta = vx.centroids(grouped(spark, d)).withColumn("min_pair_sim_threshold", F.lit(0.6))
    return cu.assign_new(chains(spark, d).where("cluster_id < 0 and domain != ''"), meta).select("chain_id", *KEYS, "is_new")


@query(f"""WITH {GROUPED}, p AS (SELECT a.domain != b.domain OR a.cluster_id != b.cluster_id AS split FROM g a JOIN g b ON a.chain_id < b.chain_id WHERE list_cosine_similarity(a.v, b.v) >= 0.85)
SELECT count(*) AS pairs, count(*) FILTER (split) AS split, round(count(*) FILTER (split)::DOUBLE / count(*), 6) AS split_rate FROM p""")
def high_sim_split_rate(spark, d):
    p = vx.similar_pairs_split(grouped(spark, d), 0.85)
    return p.select("pairs", "split", F.round(F.when(F.col("pairs") > 0, F.col("split") / F.col("pairs")), 6).alias("split_rate"))


@query(f"""WITH {CENTRES}, z AS (SELECT i, avg(x) AS z FROM e GROUP BY i), n AS (SELECT domain, cluster_id, count(*) AS n FROM g GROUP BY ALL),
 b AS (SELECT sum(n * (m.x - z) ^ 2) AS b FROM m JOIN z USING (i) JOIN n USING (domain, cluster_id)), w AS (SELECT sum((e.x - m.x) ^ 2) AS w FROM e JOIN m USING (domain, cluster_id, i))
SELECT (SELECT count(*) FROM n) AS clusters, (SELECT sum(n)::BIGINT FROM n) AS rows, round((b / ((SELECT count(*) FROM n) - 1)) / (w / ((SELECT sum(n) FROM n) - (SELECT count(*) FROM n))), 4) AS value FROM b, w""")
def calinski_harabasz(spark, d):
    return cu.calinski_harabasz(grouped(spark, d)).withColumn("value", F.round("value", 4))


@query(f"""WITH {CENTRES}, s AS (SELECT domain, cluster_id, any_value(centre) AS centre, avg(list_distance(v, centre)) AS s FROM g JOIN k USING (domain, cluster_id) GROUP BY ALL),
 r AS (SELECT max((a.s + b.s) / list_distance(a.centre, b.centre)) AS r FROM s a JOIN s b ON (a.domain, a.cluster_id) != (b.domain, b.cluster_id) GROUP BY a.domain, a.cluster_id)
SELECT count(*)::INTEGER AS clusters, round(avg(r), 5) AS value FROM r""")
def davies_bouldin(spark, d):
    return cu.davies_bouldin(grouped(spark, d)).withColumn("value", F.round("value", 5))


@query(f"""WITH {GROUPED}, k AS (SELECT *, domain || '_' || cluster_id AS g FROM g), d AS (SELECT a.chain_id, a.g AS own, b.g AS other, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM k a JOIN k b ON true GROUP BY ALL),
 m AS (SELECT chain_id, max(n) FILTER (own = other) AS size, max(t) FILTER (own = other) AS t, min(t / n) FILTER (own != other) AS b FROM d GROUP BY chain_id),
 r AS (SELECT CASE WHEN size > 1 THEN (b - t / (size - 1)) / greatest(b, t / (size - 1)) ELSE 0 END AS s FROM m)
SELECT count(*)::INTEGER AS rows, round(avg(s), 6) AS value FROM r""")
def silhouette(spark, d):
    """Euclidean silhouette of recorded clusters over a bounded hash sample; at the smaller scales over all rows."""
    rows = grouped(spark, d).withColumn("g", F.concat_ws("_", *KEYS)).select("chain_id", "vector", "g")
    return cu.silhouette(rows, "g").withColumn("value", F.round("value", 6))


@query()
def constrained_clustering(spark, d):
    """Constrained complete linkage inside recorded clusters."""
    return cu.linkage_within(grouped(spark, d).select(*KEYS, "chain_id", "vector"), KEYS, 50, 0.9)


@query()
def two_stage_clustering(spark, d):
    """Small clusters by k-means, then linkage of their centres, over all chains."""
    return cu.two_stage(chains(spark, d).select("chain_id", "vector"), 400, 0.7)


@query()
def evolved_clustering(spark, d):
    """The threshold raised while too many clusters are too large."""
    rows = chains(spark, d).select("chain_id", "vector")
    small = cu.small_clusters(rows)  # the same at every threshold
    levels = [round(0.7 + 0.02 * i, 10) for i in range(16)]
    labels, least = cu.evolved(cu.merged_at(small, 60, levels), "label", 0.7, 60) if small else (rows.select("chain_id", F.lit(0).alias("label")), 0.7)
    return labels.withColumn("threshold", F.lit(least))


@query()
def kmeans_labels(spark, d):
    return cu.kmeans(chains(spark, d).select("chain_id", "vector"), 16)


@query()
def density_labels(spark, d):
    """Hierarchical density clusters of each domain."""
    return cu.density_clusters(chains(spark, d).where("domain != ''").select("domain", "chain_id", "vector"), ("domain",), part_rows=2048)


@query()
def principal_plane(spark, d):
    """Coordinates on two principal axes."""
    return cu.principal_plane(chains(spark, d)).select("chain_id", F.round("p1", 4).alias("p1"), F.round("p2", 4).alias("p2"))


@query(f"""WITH {GROUPED}, r AS (SELECT domain, cluster_id, chain_id, row_number() OVER (PARTITION BY domain, cluster_id ORDER BY md5(chain_id || ':42'), chain_id)::INTEGER AS place FROM g) SELECT * FROM r WHERE place <= 5""")
def budget_sample(spark, d):
    return an.budget_sample(grouped(spark, d).select(*KEYS, "chain_id"), 5, list(KEYS), "chain_id")


@query("SELECT chain_id, coalesce(len(vector), 0)::INTEGER AS dim, md5(array_to_string(list_transform(list_concat(coalesce(vector, []::FLOAT[]), list_transform(range(72), lambda x: 0::FLOAT))[1:72], lambda x: (x * 1000::FLOAT)::INTEGER), ',')) AS aligned FROM chain_embedding")
def vector_align(spark, d):
    """Every vector, missing and short ones too, filled to 72 values."""
    v = F.transform(vx.align(F.col("vector"), 72), lambda x: F.rint(x * F.lit(1000).cast("float")).cast("int").cast("string"))
    return table(spark, d, "chain_embedding").select("chain_id", F.coalesce(F.when(F.col("vector").isNotNull(), F.size("vector")), F.lit(0)).alias("dim"), F.md5(F.array_join(v, ",")).alias("aligned"))


# --- retrieval ------------------------------------------------------------------------------------------------------

QUERY = "Revisiting the transport measurement of layered cuprate crystal"
FIELDS, RULE_FIELDS = rt.LEXICAL_FIELDS, rt.RULE_FIELDS


def _contains(terms: list[str], fields: list[str]) -> str:
    return " + ".join(f"coalesce(contains(lower({f}), '{t.lower()}')::INTEGER, 0)" for t in terms for f in fields)


LEXICAL = _contains(["revisiting", "the", "transport", "measurement", "of", "layered", "cuprate", "crystal"], FIELDS)
RULE = _contains(["Revisiting", "the", "transport", "measurement", "of", "layered"], RULE_FIELDS)


@query(f"WITH {TEXTS} SELECT chain_id, ({LEXICAL})::DOUBLE AS score FROM t WHERE ({LEXICAL}) > 0 ORDER BY score DESC, chain_id LIMIT 80")
def lexical_recall(spark, d):
    return rt.lexical_route(table(spark, d, "chain_embedding"), QUERY, 80, FIELDS)


@query(f"WITH {TEXTS} SELECT chain_id, ({RULE})::DOUBLE AS score FROM t WHERE ({RULE}) > 0 ORDER BY score DESC, chain_id LIMIT 20")
def rule_recall(spark, d):
    return rt.lexical_route(table(spark, d, "chain_embedding"), QUERY, 20, RULE_FIELDS, 6, False)


def _scaled(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-9 THEN (CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END) ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


@query(f"""WITH {CHAINS}, {TEXTS}, q AS (SELECT v AS qv FROM c ORDER BY chain_id LIMIT 1),
 x AS (SELECT chain_id, 'vector' AS route, list_cosine_similarity(v, qv) AS score FROM c, q ORDER BY round(1 - list_cosine_similarity(v, qv), 12), chain_id LIMIT 100),
 y AS (SELECT chain_id, 'lexical' AS route, ({LEXICAL})::DOUBLE AS score FROM t WHERE ({LEXICAL}) > 0 ORDER BY score DESC, chain_id LIMIT 80),
 z AS (SELECT chain_id, 'rule' AS route, ({RULE})::DOUBLE AS score FROM t WHERE ({RULE}) > 0 ORDER BY score DESC, chain_id LIMIT 20),
 u AS (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z),
 m AS (SELECT chain_id, coalesce(max(score) FILTER (route = 'vector'), 0) AS a, coalesce(max(score) FILTER (route = 'lexical'), 0) AS b, coalesce(max(score) FILTER (route = 'rule'), 0) AS c, string_agg(DISTINCT route, ',' ORDER BY route) AS route_hits FROM u GROUP BY chain_id),
 n AS (SELECT chain_id, {_scaled('a')} AS a, {_scaled('b')} AS b, {_scaled('c')} AS c, route_hits FROM m)
SELECT chain_id, round(a, 6) AS vector, round(b, 6) AS lexical, round(c, 6) AS rule, route_hits, round(0.65 * a + 0.25 * b + 0.10 * c, 6) AS final_score FROM n ORDER BY 0.65 * a + 0.25 * b + 0.10 * c DESC, chain_id LIMIT 50""")
def multi_recall_fused(spark, d):
    ann = vx.top_k(table(spark, d, "chain_embedding"), _first_vector(spark, d), 100).select(F.col("id").alias("chain_id"), (1 - F.col("distance")).alias("score"))
    out = rt.fused({"vector": ann, "lexical": lexical_recall(spark, d), "rule": rule_recall(spark, d)}, rt.CHAIN_WEIGHTS, 50)
    return out.select("chain_id", *[F.round(c, 6).alias(c) for c in ("vector", "lexical", "rule")], "route_hits", F.round("final_score", 6).alias("final_score"))


WORDS = r"[\x{4e00}-\x{9fff}]+|[a-zA-Z]+|[0-9]+"
STOPS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
WORKFLOWS = f"""w AS (SELECT paper_id || ':' || metadata_version AS workflow_id, any_value(material) AS material, max(title) AS title, max(computational_setup.dft_code) AS code, max(computational_setup.xc_functional) AS xc FROM paper_metadata GROUP BY ALL),
 i AS (SELECT workflow_id, unnest(list_filter(regexp_extract_all(lower(title), '{WORDS}'), lambda x: length(x) >= 2 AND x NOT IN ({STOPS}))) AS term FROM w)"""


def workflows(spark, d):
    """Paper versions stand for workflows: title, code and functional for problem, tool and method."""
    m = table(spark, d, "paper_metadata")
    return m.groupBy(F.concat_ws(":", "paper_id", "metadata_version").alias("workflow_id")).agg(F.max("title").alias("title"), F.max("computational_setup.dft_code").alias("code"), F.max("computational_setup.xc_functional").alias("xc"))


@query(f"WITH {WORKFLOWS} SELECT term, count(*) AS n, count(DISTINCT workflow_id) AS workflows FROM i GROUP BY term")
def keyword_postings(spark, d):
    p = rt.postings(workflows(spark, d), tx.workflow_tokens(F.col("title")), "workflow_id")
    return p.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("workflow_id").alias("workflows"))


@query(f"""WITH {WORKFLOWS}, q AS (SELECT unnest(['vortex', 'lattice', 'lattice', 'linewidth']) AS term)
SELECT workflow_id, round(count(*) / 4.0, 6)::DOUBLE AS score FROM i JOIN q USING (term) GROUP BY workflow_id ORDER BY score DESC, workflow_id LIMIT 20""")
def keyword_route(spark, d):
    index = rt.postings(workflows(spark, d), tx.workflow_tokens(F.col("title")), "workflow_id")
    return rt.match_route(index, ["vortex", "lattice", "lattice", "linewidth"], 20, "workflow_id").withColumn("score", F.round("score", 6))


@query(f"""WITH {WORKFLOWS}, q AS (SELECT unnest(['vortex', 'lattice', 'lattice', 'linewidth']) AS term),
 a AS (SELECT workflow_id, count(*) / 4.0 AS s FROM i JOIN q USING (term) GROUP BY workflow_id ORDER BY s DESC, workflow_id LIMIT 20),
 b AS (SELECT workflow_id, 1.0 AS s FROM w WHERE xc = 'GGA' ORDER BY workflow_id LIMIT 20),
 u AS (SELECT workflow_id, 0 AS turn, s FROM a UNION ALL SELECT workflow_id, 1, s FROM b), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY turn) = 1),
 m AS (SELECT workflow_id, coalesce(max(s) FILTER (turn = 0), 0) AS k, coalesce(max(s) FILTER (turn = 1), 0) AS e FROM f GROUP BY workflow_id), n AS (SELECT workflow_id, {_scaled('k')} AS k, {_scaled('e')} AS e FROM m)
SELECT workflow_id, round(k, 6)::DOUBLE AS keyword, round(e, 6)::DOUBLE AS method, round(0.2 * k + 0.1 * e + 0.05, 6)::DOUBLE AS score FROM n ORDER BY round(0.2 * k + 0.1 * e + 0.05, 12) DESC, workflow_id LIMIT 10""")
def workflow_rerank(spark, d):
    w = workflows(spark, d)
    methods = rt.postings(w, F.array("xc"), "workflow_id")
    routes = {"keyword": rt.match_route(rt.postings(w, tx.workflow_tokens(F.col("title")), "workflow_id"), ["vortex", "lattice", "lattice", "linewidth"], 20, "workflow_id"), "method": rt.match_route(methods, ["GGA"], 20, "workflow_id")}
    out = rt.workflow_search(routes, w.select("workflow_id"), 10)
    return out.select("workflow_id", *[F.round(c, 6).alias(c) for c in ("keyword", "method", "score")])


RULES = [("spin|magnet", "magnetic"), ("lattice|crystal|layer", "structure"), ("transport|conduct", "transport")]


@query("""SELECT chain_id, array_to_string(list_filter([CASE WHEN regexp_matches(chain_text, '(?i)spin|magnet') THEN 'magnetic' END, CASE WHEN regexp_matches(chain_text, '(?i)lattice|crystal|layer') THEN 'structure' END, CASE WHEN regexp_matches(chain_text, '(?i)transport|conduct') THEN 'transport' END], lambda x: x IS NOT NULL), ',') AS tags
FROM (SELECT chain_id, max(chain_text) AS chain_text FROM chain_embedding GROUP BY chain_id)""")
def pattern_tags(spark, d):
    return texts(spark, d).select("chain_id", F.array_join(tx.tags(F.col("chain_text"), RULES), ",").alias("tags"))


@query(f"SELECT doc_id, round({_scaled('n_chars')}, 6)::DOUBLE AS scaled FROM documents")
def minmax_normalise(spark, d):
    # scalar minimum and maximum instead of a window over all rows
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    ends = docs.agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    flat = F.when(F.col("n_chars") > 0, 1.0).otherwise(0.0)
    return docs.join(F.broadcast(ends)).select("doc_id", F.round(F.when(F.col("high") - F.col("low") < 1e-9, flat).otherwise((F.col("n_chars") - F.col("low")) / (F.col("high") - F.col("low"))), 6).alias("scaled"))


# --- documents, papers, progress ------------------------------------------------------------------------------------


@query("""SELECT journal, count(*) AS papers FROM (SELECT DISTINCT paper_id, coalesce(journal, 'Unknown') AS journal FROM papers) GROUP BY journal""")
def journal_counts(spark, d):
    return table(spark, d, "papers").select("paper_id", F.coalesce("journal", F.lit("Unknown")).alias("journal")).distinct().groupBy("journal").agg(F.count("*").alias("papers"))


@query("""SELECT DISTINCT paper_id, p.journal, coalesce(j.label, 'Unknown') AS label FROM papers p LEFT JOIN domain_journals j ON j.journal = p.journal""")
def journal_labels(spark, d):
    journals = table(spark, d, "domain_journals").select("journal", "label")
    return table(spark, d, "papers").select("paper_id", "journal").distinct().join(F.broadcast(journals), "journal", "left").select("paper_id", "journal", F.coalesce("label", F.lit("Unknown")).alias("label"))


@query("SELECT DISTINCT paper_id FROM progress_tracker WHERE paper_id NOT IN (SELECT paper_id FROM paper_metadata WHERE paper_id IS NOT NULL)")
def incremental_new_ids(spark, d):
    return table(spark, d, "progress_tracker").select("paper_id").distinct().join(table(spark, d, "paper_metadata").select("paper_id").distinct(), "paper_id", "left_anti")


@query("SELECT paper_id, step1_completed, num_steps, last_updated FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY last_updated DESC NULLS LAST, num_steps DESC NULLS LAST, num_conclusions DESC NULLS LAST, step1_completed DESC NULLS LAST) AS n FROM progress_tracker) WHERE n = 1")
def latest_wins(spark, d):
    order = [F.desc_nulls_last(c) for c in ("last_updated", "num_steps", "num_conclusions", "step1_completed")]
    return st.latest(table(spark, d, "progress_tracker"), ["paper_id"], order).select("paper_id", "step1_completed", "num_steps", "last_updated")


@query("""SELECT CASE WHEN error_message IS NOT NULL THEN 'failed' WHEN step3_completed THEN 'done' WHEN step1_completed THEN 'running' ELSE 'pending' END AS status, count(*) AS n, sum(num_steps)::BIGINT AS steps FROM progress_tracker GROUP BY ALL""")
def status_summary(spark, d):
    status = F.when(F.col("error_message").isNotNull(), "failed").when(F.col("step3_completed"), "done").when(F.col("step1_completed"), "running").otherwise("pending")
    return table(spark, d, "progress_tracker").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("num_steps").alias("steps"))


@query("""WITH ids AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id DESC) - 1)::INTEGER AS position FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 5)), a AS (SELECT * FROM ids UNION ALL SELECT -1, 5)
SELECT position, a.doc_id, d.doc_id IS NOT NULL AS found, source, n_chars FROM a LEFT JOIN documents d USING (doc_id)""")
def id_lookup_ordered(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    ids = [r.doc_id for r in docs.select("doc_id").orderBy(F.desc("doc_id")).limit(5).collect()]
    return st.ordered_lookup(docs, [*ids, -1], "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def offset_page(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").offset(100).limit(50)


@query("SELECT chain_id, paper_id, cluster_id, num_steps FROM chain_embedding WHERE domain = 'mathematics' AND num_steps > 4")
def predicate_scan(spark, d):
    return table(spark, d, "chain_embedding").where((F.col("domain") == "mathematics") & (F.col("num_steps") > 4)).select("chain_id", "paper_id", "cluster_id", "num_steps")


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority != '5-LOW'
UNION ALL SELECT -o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderpriority = '2-HIGH'""")
def keyed_changes(spark, d):
    """Update, delete and upsert by key over one table."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    base = orders.drop("o_orderpriority")
    kept = base.join(orders.where("o_orderpriority = '5-LOW'").select("o_orderkey"), "o_orderkey", "left_anti")
    new = st.updated(kept, orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus")), "o_orderkey")
    return st.upserted(new, orders.where("o_orderpriority = '2-HIGH'").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", "o_orderstatus"), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' ELSE 'changed' END AS change FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH'""")
def snapshot_diff(spark, d):
    orders = table(spark, d, "orders")
    after = orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate")
    return st.snapshot_changes(orders.where("o_orderpriority != '1-URGENT'"), after, "o_orderkey", ["o_totalprice", "o_orderdate"])


@query("""SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))::DOUBLE / length(text) ELSE 0 END, 6) AS cjk, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / length(text) ELSE 0 END, 6) AS latin,
 length(text) >= 40 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / length(text) >= 0.38 AND length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))::DOUBLE / length(text) < 0.12 AS english FROM documents""")
def language_ratios(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.round(tx.cjk_ratio(t), 6).alias("cjk"), F.round(tx.latin_ratio(t), 6).alias("latin"), tx.looks_english(t).alias("english"))


@query(r"""SELECT DISTINCT paper_id, md5(trim(regexp_replace(regexp_replace(reasoning_xml, '<[^>]+>', ' ', 'g'), '[ \t\n\r\x{0B}\f]+', ' ', 'g'))) AS plain FROM papers""")
def strip_markup(spark, d):
    return table(spark, d, "papers").select("paper_id", F.md5(tx.without_tags(F.col("reasoning_xml"))).alias("plain")).distinct()


@query("""SELECT chain_id, 'paper_ocr/xml/' || paper_id || '_reasoning_chain.xml' AS xml_path, 'paper_ocr/md/' || paper_id || '.md' AS md_path, replace(chain_id, '/', '%2F') AS safe, substr(chain_id, length(paper_id) + 2) AS suffix FROM chain_embedding""")
def path_templates(spark, d):
    rows = table(spark, d, "chain_embedding")
    return rows.select("chain_id", tx.xml_path("paper_ocr", F.col("paper_id")).alias("xml_path"), tx.md_path("paper_ocr", F.col("paper_id")).alias("md_path"), tx.path_safe(F.col("chain_id")).alias("safe"), tx.suffix_after(F.col("chain_id"), F.col("paper_id")).alias("suffix"))


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_type = 'click' THEN left(props, 3) ELSE props END AS JSON) IS NOT NULL AS valid FROM events""")
def json_repair(spark, d):
    broken = F.when(F.col("event_type") == "click", F.left("props", F.lit(3))).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return table(spark, d, "events").select("event_id", tx.repaired_json(broken).isNotNull().alias("valid"))


@query(f"""WITH v AS (SELECT paper_id, metadata_version, list_distinct(regexp_extract_all(lower(max(title)), '{WORDS}')) AS t FROM paper_metadata GROUP BY ALL),
 p AS (SELECT a.paper_id, len(list_intersect(a.t, b.t)) AS i, len(list_distinct(list_concat(a.t, b.t))) AS u FROM v a JOIN v b ON a.paper_id = b.paper_id AND a.metadata_version = 'v1' AND b.metadata_version = 'v2')
SELECT paper_id, round(CASE WHEN u = 0 THEN 1 ELSE i::DOUBLE / u END, 6) AS jaccard FROM p""")
def jaccard_similarity(spark, d):
    t = table(spark, d, "paper_metadata").groupBy("paper_id", "metadata_version").agg(F.array_distinct(F.regexp_extract_all(F.lower(F.max("title")), F.lit(tx.WORKFLOW_TOKEN), F.lit(0))).alias("t"))
    two = t.where("metadata_version in ('v1', 'v2')").groupBy("paper_id").agg(F.max(F.when(F.col("metadata_version") == "v1", F.col("t"))).alias("a"), F.max(F.when(F.col("metadata_version") == "v2", F.col("t"))).alias("b"))
    return two.where("a is not null and b is not null").select("paper_id", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("""WITH s AS (SELECT paper_id, string_agg(coalesce(code, ''), '>' ORDER BY metadata_version) AS signature FROM (SELECT paper_id, metadata_version, max(computational_setup.dft_code) AS code FROM paper_metadata GROUP BY ALL) GROUP BY paper_id)
SELECT signature, count(*) AS n, min(paper_id) AS first_unit FROM s GROUP BY signature""")
def signature_groups(spark, d):
    m = table(spark, d, "paper_metadata").groupBy("paper_id", "metadata_version").agg(F.max("computational_setup.dft_code").alias("code"))
    return an.signature_groups(m, "paper_id", ["metadata_version"], "code")


@query(f"""WITH {WORKFLOWS} SELECT workflow_id, substr(sha256(coalesce(array_to_string(list_filter([code, xc], lambda x: x IS NOT NULL), '_'), '')), 1, 16) AS stage_hash, len(list_filter([code, xc], lambda x: x IS NOT NULL))::INTEGER AS stages FROM w""")
def similarity_signature(spark, d):
    s = tx.similarity_signature(F.array().cast("array<double>"), F.array_compact(F.array("code", "xc")))
    return workflows(spark, d).select("workflow_id", s["stage_sequence_hash"].alias("stage_hash"), s["stage_count"].alias("stages"))


@query("""WITH m AS (SELECT paper_id, computational_setup.dft_code AS method FROM paper_metadata UNION ALL SELECT paper_id, computational_setup.xc_functional FROM paper_metadata), n AS (SELECT count(DISTINCT paper_id) AS k FROM m)
SELECT method, count(*) AS mentions, round(count(*)::DOUBLE / any_value(k), 6) AS frequency FROM m, n WHERE method IS NOT NULL AND method != '' GROUP BY method ORDER BY mentions DESC, method LIMIT 10""")
def method_frequency(spark, d):
    m = table(spark, d, "paper_metadata").select("paper_id", F.explode(F.array("computational_setup.dft_code", "computational_setup.xc_functional")).alias("m"))
    return an.method_frequency(m, "m", "paper_id")


@query("""WITH n AS (SELECT count(DISTINCT paper_id) AS k FROM documents) SELECT section AS stage, count(DISTINCT paper_id) AS covered, round(count(DISTINCT paper_id) * 100.0 / any_value(k), 1)::DOUBLE AS share FROM documents, n WHERE section IS NOT NULL GROUP BY section""")
def stage_coverage(spark, d):
    return an.coverage(table(spark, d, "documents"), F.col("section"), "paper_id")


@query("""SELECT CASE WHEN l_extendedprice IS NULL OR p_retailprice IS NULL THEN 'missing' WHEN p_retailprice = 0 THEN 'fail' WHEN abs(l_extendedprice / l_quantity - p_retailprice) / p_retailprice <= 0.3 THEN 'pass' ELSE 'fail' END AS status, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def tolerance_checks(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return an.tolerance_checks(rows, F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice"))


COMPARED = """k AS (SELECT a.l_suppkey AS x, b.l_suppkey AS y, CASE WHEN a.l_quantity > b.l_quantity THEN 'A' WHEN a.l_quantity < b.l_quantity THEN 'B' ELSE 'tie' END AS better FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
 s AS (SELECT x AS file, better = 'A' AS won, better = 'B' AS lost FROM k UNION ALL SELECT y, better = 'B', better = 'A' FROM k)"""


@query(f"""WITH {COMPARED}, t AS (SELECT file, count(*) FILTER (won) AS wins, count(*) FILTER (lost) AS losses, count(*) FILTER (NOT won AND NOT lost) AS ties, count(*) FILTER (won) - count(*) FILTER (lost) AS score FROM s GROUP BY file)
SELECT *, row_number() OVER (ORDER BY score DESC, wins DESC, file)::INTEGER AS rank FROM t""")
def tournament_ranking(spark, d):
    """Suppliers of consecutive lines of an order compared by quantity."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("x"), F.col("l_quantity").alias("qx"))
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("x").alias("y"), F.col("qx").alias("qy"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).withColumn("better", F.when(F.col("qx") > F.col("qy"), "A").when(F.col("qx") < F.col("qy"), "B").otherwise("tie"))
    return an.tournament(pairs, "x", "y")


@query(f"""WITH {GROUPED}, a AS (SELECT domain, cluster_id, count(*) AS size FROM g GROUP BY ALL), b AS (SELECT domain, cluster_id, max(size) AS size FROM selection_stats GROUP BY ALL)
SELECT count(*) FILTER (a.domain IS NOT NULL AND b.domain IS NOT NULL) AS aligned, count(*) FILTER (b.domain IS NULL) AS only_baseline, count(*) FILTER (a.domain IS NULL) AS only_variant, count(*) FILTER (a.size > b.size) AS baseline_wins, count(*) FILTER (b.size > a.size) AS variant_wins, count(*) FILTER (a.size = b.size) AS ties FROM a FULL JOIN b USING (domain, cluster_id)""")
def ablation_alignment(spark, d):
    recorded = table(spark, d, "selection_stats").groupBy(*KEYS).agg(F.max("size").alias("size"))
    return an.alignment(cluster_sizes(spark, d), recorded, list(KEYS), "size")


@query("""WITH c AS (SELECT coalesce(lower(trim(source)), '(空)') AS value, count(*) AS n FROM documents GROUP BY ALL) SELECT value, n, format('{:.1f}%', n * 100.0 / sum(n) OVER ()) AS percent FROM c""")
def judgment_counts(spark, d):
    return an.distribution(table(spark, d, "documents"), F.col("source"))


@query("""SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(spark, d):
    return inc.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH r AS (SELECT domain, cluster_id, size, row_number() OVER (PARTITION BY domain ORDER BY size DESC, cluster_id)::INTEGER AS place FROM selection_stats) SELECT * FROM r WHERE place <= 5""")
def largest_recorded_clusters(spark, d):
    rows = table(spark, d, "selection_stats").select("domain", "cluster_id", "size")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("size"), "cluster_id"))).where("place <= 5")


# --- documents in XML -----------------------------------------------------------------------------------------------


@query()
def xml_parse_chains(spark, d):
    """The chains of all papers as rows of the vector table, without vectors."""
    rows = xm.chain_rows(xm.parse_chains(table(spark, d, "papers").select("paper_id", "journal", "reasoning_xml").distinct()))
    return rows.select("chain_id", "paper_id", "journal", "conclusion_id", "num_steps", "has_citations", "has_figures", F.md5("chain_text").alias("text_md5"))


# Papers whose document is whole and holds a step, as far as counts of marks can tell.
WHOLE = """(SELECT paper_id FROM papers WHERE trim(reasoning_xml) LIKE '<reasoning_chains>%</reasoning_chains>' AND contains(reasoning_xml, '<step')
 AND (length(reasoning_xml) - length(replace(reasoning_xml, '<step', ''))) / 5 = (length(reasoning_xml) - length(replace(reasoning_xml, '</step>', ''))) / 7)"""


@query(f"""SELECT chain_id, left(max(chain_text), 1000) AS chain_text, max(num_steps) AS num_steps, bool_or(has_citations) AS has_citations, bool_or(has_figures) AS has_figures FROM chain_embedding WHERE paper_id IN {WHOLE} GROUP BY chain_id""")
def chain_text_assembly(spark, d):
    """Texts, counts and flags assembled from the XML, which the stored chains must equal, none more and none less; texts as far as all are stored, since some were cut at 1,000 characters."""
    papers = table(spark, d, "papers").select("paper_id", "journal", "reasoning_xml").where("reasoning_xml is not null")
    return xm.chain_rows(xm.parse_chains(papers)).groupBy("chain_id").agg(F.left(F.max("chain_text"), F.lit(1000)).alias("chain_text"), F.max("num_steps").alias("num_steps"), F.bool_or("has_citations").alias("has_citations"), F.bool_or("has_figures").alias("has_figures"))


@query(f"""WITH p AS (SELECT count(DISTINCT paper_id) AS papers FROM papers), c AS (SELECT DISTINCT paper_id, chain_id, num_steps FROM chain_embedding WHERE paper_id IN {WHOLE}),
 s AS (SELECT count(DISTINCT paper_id) AS with_chains, count(*) AS chains, sum(num_steps)::BIGINT AS steps FROM c)
SELECT papers, with_chains, papers - with_chains AS skipped, chains, steps, steps::DOUBLE / chains AS avg_steps FROM p, s""")
def load_stats(spark, d):
    papers = table(spark, d, "papers").select("paper_id", "journal", "reasoning_xml").distinct()
    return xm.load_statistics(xm.parse_chains(papers), papers)


def _tools(spark):
    names = ["spin rotation", "Wannier interpolation", "isotope substitution", "column leaching", "profile search"]
    return spark.createDataFrame([(f"t{i}", n, f"method {n}", "analysis") for i, n in enumerate(names)], "tool_id string, tool_name string, tool_description string, tool_category string")


def _steps(spark, d):
    papers = table(spark, d, "papers").select("paper_id", "journal", "reasoning_xml").distinct()
    return xm.parse_chains(papers).select("paper_id", "conclusion_id", F.explode("steps").alias("s")).select("paper_id", "conclusion_id", "s.step_id", "s.text")


@query()
def tool_text_match(spark, d):
    """Tools named in the steps, whatever the case."""
    return an.text_matches(_steps(spark, d), _tools(spark), ["paper_id", "conclusion_id", "step_id"], "text")


@query()
def tool_link_join(spark, d):
    """Every step with the tools linked to it."""
    steps = _steps(spark, d)
    found = an.text_matches(steps, _tools(spark), ["paper_id", "conclusion_id", "step_id"], "text")
    links = found.join(F.broadcast(_tools(spark).select("tool_id", "tool_name")), "tool_name").select("paper_id", "conclusion_id", "step_id", "tool_id")
    return an.linked_tools(steps, links, F.broadcast(_tools(spark)), ["paper_id", "conclusion_id"]).withColumn("tools", F.array_join("tools", ","))


def _enriched(spark, d):
    found = an.text_matches(_steps(spark, d), _tools(spark), ["paper_id", "conclusion_id", "step_id"], "text").join(F.broadcast(_tools(spark)), "tool_name")
    extractions = found.groupBy("paper_id", "conclusion_id").agg(F.array_sort(F.collect_set(F.struct("tool_id", "tool_name", "tool_description", "tool_category"))).alias("tools"), F.array_sort(F.collect_set(F.struct("step_id", "tool_id"))).alias("links"))
    papers = table(spark, d, "papers").groupBy("paper_id").agg(F.max("reasoning_xml").alias("reasoning_xml"))
    return xm.enrich(papers, extractions)


@query()
def xml_enrich(spark, d):
    """Documents with their tools."""
    return _enriched(spark, d).select("paper_id", "valid", F.md5("enriched").alias("xml_md5"), F.regexp_count("enriched", F.lit('<ref type="tool"')).alias("tool_refs"))


@query()
def refined_texts(spark, d):
    """Refined conclusions as text."""
    return xm.refined_texts(_enriched(spark, d), "enriched").select("paper_id", "conclusion_id", F.md5("text").alias("text_md5"))


@query(f"SELECT DISTINCT chain_id, num_steps FROM chain_embedding WHERE paper_id IN {WHOLE} AND chain_id NOT IN (SELECT chain_id FROM chain_embedding WHERE domain = 'mathematics')")
def embedded_increment(spark, d):
    """Chains that the table doesn't hold for a domain yet, embedded offline to unit length."""
    papers = table(spark, d, "papers").select("paper_id", "journal", "reasoning_xml").distinct()
    rows = pv.vectorised_increment(xm.chain_rows(xm.parse_chains(papers)), table(spark, d, "chain_embedding"), pv.HashEmbedder(), "mathematics")
    return rows.where(F.abs(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) - 1) < 1e-3).select("chain_id", "num_steps")
