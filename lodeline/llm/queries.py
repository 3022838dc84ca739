"""The pN_ queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import staged, table
from . import groups as gr
from . import leaks as lk
from . import mixing as mx
from . import neighbours as nb
from . import pieces as pc
from . import scans as sc
from . import skeleton as sk
from . import varied as vr


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    """Damaged lines with what was read and what it should be."""
    return sc.damaged_lines(table(spark, d, "papers"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_lines(spark, d).select("paper_id", "line_no", "kind").distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every paper's text as continuous paragraphs; sound papers unchanged."""
    papers = table(spark, d, "papers")
    fixed = sc.repaired(papers, staged(sc.damaged_lines(papers), "damage")).distinct()
    return fixed.select("paper_id", F.md5("repaired").alias("text_md5"), F.length("repaired").alias("n_chars"))


# Field, table, key, limit and overlap of problem 2.
OVERSIZED = (("paper_md", "papers", "paper_id", 6000, 300), ("chain_text", "chain_embedding", "chain_id", 1000, 100))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [pc.oversized(table(spark, d, t), key, field, limit, overlap).select(F.lit(field).alias("field"), "item_id", "cut") for field, t, key, limit, overlap in OVERSIZED]
    return parts[0].unionByName(parts[1]).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces with their places; the bodies as digests, to keep the result narrow."""
    parts = [pc.pieces(table(spark, d, t), key, field, limit, overlap).select(F.lit(field).alias("field"), "item_id", "piece_no", "start", "end", "forced", F.md5("piece").alias("piece_md5")) for field, t, key, limit, overlap in OVERSIZED]
    return parts[0].unionByName(parts[1]).distinct()


def _covered(spark: SparkSession, d: str) -> DataFrame:
    return vr.covered(table(spark, d, "chain_embedding"), table(spark, d, "selection_stats"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the coverage run whose crowd holds at least 20 others: those that the subset must not be filled from."""
    return _covered(spark, d).where("near >= 20").select("chain_id")


def p3_selected(spark: SparkSession, d: str) -> DataFrame:
    """The varied subset of each domain."""
    return _covered(spark, d).where("chosen").select("domain", "chain_id", "gain")


def p3_crowds(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each large crowd there are and how many were chosen."""
    rows = _covered(spark, d).groupBy("domain", "crowd").agg(F.count("*").alias("size"), F.count_if("chosen").alias("chosen"))
    return rows.where("size >= 20")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return gr.group_members(gr.similarity_groups(table(spark, d, "chain_embedding")))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group by size and most typical members."""
    groups = gr.similarity_groups(table(spark, d, "chain_embedding"))
    return gr.group_profiles(groups).withColumn("typical", F.array_join("typical", ","))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar chains of each chain, however far they are."""
    return nb.nearest_neighbours(table(spark, d, "chain_embedding")).withColumn("cosine", F.round("cosine", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nb.neighbour_pairs(nb.nearest_neighbours(table(spark, d, "chain_embedding"), least=0.8))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Longest verbatim match of each affected document and item."""
    return lk.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without affected documents."""
    docs = table(spark, d, "documents")
    return lk.without_leaks(docs, p7_leaks(spark, d)).select("doc_id", "source", "n_chars")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return staged(mx.sized_documents(table(spark, d, "documents"), table(spark, d, "mix_targets")), "sized")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the schedule holds less than their goal."""
    return p8_shares(spark, d).where("short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source in the schedule."""
    sized = _sized(spark, d)
    plan = mx.source_plan(sized, table(spark, d, "mix_targets"))
    return mx.reached_shares(plan, mx.mixed(sized, plan))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The schedule: documents in the order of their slots."""
    sized = _sized(spark, d)
    return mx.mixed(sized, mx.source_plan(sized, table(spark, d, "mix_targets"))).orderBy("slot", "start")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sk.look_alike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with the class of its look."""
    return sk.look_classes(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its one form."""
    return sk.with_skeleton(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5("skeleton").alias("form_md5"), F.length("skeleton").alias("form_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_lines, p1_repaired, p2_found, p2_pieces, p3_found, p3_selected, p3_crowds, p5_found, p5_groups, p6_found, p6_neighbours, p7_found, p7_leaks, p7_clean, p8_found, p8_shares, p8_mix, p9_found, p9_classes, p9_forms)}
# The chains with a valid vector, once each.
CHAINS = """c AS (SELECT chain_id, any_value(vector)::DOUBLE[] AS v FROM chain_embedding WHERE len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0 AND chain_id IS NOT NULL GROUP BY chain_id)"""
SQL: dict[str, str] = {
    "p3_found": f"WITH {CHAINS} SELECT a.chain_id FROM c a JOIN c b ON a.chain_id != b.chain_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95 GROUP BY a.chain_id HAVING count(*) >= 20",
    "p5_found": f"""WITH RECURSIVE {CHAINS}, l AS (SELECT a.chain_id AS a, b.chain_id AS b FROM c a JOIN c b ON a.chain_id != b.chain_id WHERE list_cosine_similarity(a.v, b.v) >= 0.78),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT min(b) AS first_chain_id, a AS chain_id FROM r GROUP BY a HAVING min(b) < a""",
    "p6_found": f"""WITH {CHAINS}, s AS (SELECT a.chain_id AS a, b.chain_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM c a JOIN c b ON a.chain_id != b.chain_id WHERE list_cosine_similarity(a.v, b.v) >= 0.8),
 n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s)
SELECT DISTINCT least(a, b) AS chain_id_a, greatest(a, b) AS chain_id_b FROM n WHERE n <= 5""",
    "p2_found": r"""
SELECT DISTINCT field, item_id,
       CASE WHEN list_max(list_transform(regexp_split_to_array(t, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x{0B}。！？；，]'), lambda x: length(x))) > lim THEN 'forced' ELSE 'natural' END AS cut
FROM (SELECT 'paper_md' AS field, paper_id AS item_id, paper_md AS t, 6000 AS lim FROM papers
      UNION ALL SELECT 'chain_text', chain_id, chain_text, 1000 FROM chain_embedding) u
WHERE item_id IS NOT NULL AND length(t) > lim
""",
}
