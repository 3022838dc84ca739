"""What a paper's first lines tell about it, citations, and evaluation samples in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

# Marks of citation lines, titles that are none, and the years that are believed.
LINES, TITLE_LINES = 30, 40
VOLUME, YEAR_SIGN, NUMBERED_YEAR = r"^([A-Z][\w\s&]+?)\s+\d+\s*\((\d{4})\)", r"[©]\s*(\d{4})", r"\b((?:19|20)\d{2})\b"
NO_TITLES = ("accepted manuscript", "graphical abstract", "highlights", "contents")
NOT_AUTHORS = ("PII:", "DOI:", "Reference:", "To appear in:", "Received Date:", "Accepted Date:")
YEARS = (1950, 2030)


def citation(text: Column) -> Column:
    """struct(journal, year, title, authors, first_author) from the head of a paper; what isn't there, or a year beyond belief, is null.

    The journal and year come from the first line of the form "Journal 12 (2003)", else the year from a copyright
    sign, else from a line of dates or a doi. The title is the first heading of level one that is a title; the authors
    are the first line after it that lists at least two names.
    """
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    head = F.filter(F.slice(lines, 1, LINES), lambda s: (s != "") & ~s.rlike("^[#!]"))
    volume = F.try_element_at(F.filter(head, lambda s: s.rlike(VOLUME)), F.lit(1))
    journal = F.nullif(F.trim(F.regexp_extract(volume, VOLUME, 1)), F.lit(""))
    journal = F.when(journal.rlike("^[A-Z\\s&]+$"), F.initcap(journal)).otherwise(journal)
    signed = F.try_element_at(F.filter(head, lambda s: s.rlike(YEAR_SIGN)), F.lit(1))
    dated = F.try_element_at(F.filter(head, lambda s: F.lower(s).rlike("received|accepted|doi") & s.rlike(NUMBERED_YEAR)), F.lit(1))
    year = F.coalesce(*[F.nullif(y, F.lit("")) for y in (F.regexp_extract(volume, VOLUME, 2), F.regexp_extract(signed, YEAR_SIGN, 1), F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.coalesce(dated, F.lit("")), F.lit(NUMBERED_YEAR), F.lit(1))), -1))]).try_cast("int")
    is_title = lambda s: F.startswith(s, F.lit("# ")) & ~F.lower(F.trim(F.substr(s, F.lit(3)))).isin(*NO_TITLES) & ~F.startswith(F.trim(F.substr(s, F.lit(3))), F.lit("!"))
    title_line = F.try_element_at(F.filter(F.slice(lines, 1, TITLE_LINES), is_title), F.lit(1))
    title = F.nullif(F.trim(F.substr(title_line, F.lit(3))), F.lit(""))
    at = F.array_position(lines, title_line)
    after = F.slice(lines, F.greatest(F.coalesce(at, F.lit(1)), F.lit(1)).cast("int") + 1, 14)
    is_authors = lambda s: (F.length(s) >= 10) & ~s.rlike("^[#!]") & ~F.contains(s, F.lit(":")) & s.rlike("[A-Z]") & F.contains(s, F.lit(","))
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\$[^$]*\$", ""), "[*†‡§¶¹²³⁴⁵⁶⁷⁸⁹⁰ˡ]", ""), r"\s+", " "))
    named = F.filter(F.transform(F.filter(after, is_authors), clean), lambda s: F.size(F.filter(F.split(s, ","), lambda p: F.trim(p) != "")) >= 2)
    authors = F.when(title.isNotNull(), F.try_element_at(named, F.lit(1)))
    surname = F.try_element_at(F.filter(F.split(F.trim(F.split(authors, ",")[0]), " "), lambda w: w.rlike("^[A-Z].")), F.lit(-1))
    return F.struct(journal.alias("journal"), F.when(year.between(*YEARS), year).alias("year"), title.alias("title"), authors.alias("authors"), surname.alias("first_author"))


def bibliography_line(key: Column, authors: Column, title: Column, journal: Column, year: Column, doi: Column) -> Column:
    """One entry; absent parts are left out."""
    part = lambda c, before, after="": F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(before), c.cast("string"), F.lit(after))).otherwise(F.lit(""))
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("\\bibitem{"), key, F.lit("}\n"), text(authors), F.lit(".\n"), text(title), F.lit(".\n"), part(journal, "\\textit{", "}"), part(year, ", "), part(doi, ". doi:"), F.lit(".\n"))


def dot_source(answer: Column) -> Column:
    """The graph in a fenced block, else the whole answer."""
    inside = F.regexp_extract(answer, r"(?s)```(?:dot)?\s*\n(.*?)```", 1)
    return bare(F.when(inside != "", inside).otherwise(answer))


# The wording of samples.
FULL_PREFIX, FOCUS, TAIL = "研究问题完整表述：", "该簇核心主题", "相关证据与结论"
QUESTION = ("围绕「", "」，结合簇内思维链，需要在「", "」等方向上澄清机理、定量关系、验证边界与主要争议点。")
PROBLEM_CHARS, CONCLUSION_CHARS = 60, 40
SAMPLE = "sample_id string, domain string, cluster_id string, research_question_zh string, research_question_en string, research_problem_full_zh string, research_focus_zh string, key_terms array<string>, labels array<struct<chain_id string, paper_id string, conclusion_id string>>, related_chains array<struct<chain_id string, paper_id string, conclusion_id string>>, ids struct<sample_id string, domain string, cluster_id string>"


def bare(col: Column) -> Column:
    """Without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"^\s+|\s+$", "")


def without_prefix(col: Column, prefix: str = FULL_PREFIX) -> Column:
    return F.when(F.startswith(bare(col), F.lit(prefix)), bare(F.substr(bare(col), F.lit(len(prefix) + 1)))).otherwise(bare(col))


def stated_problem(xml: Column) -> Column:
    """The problem that a document states, if it is long enough."""
    found = tx.without_tags(F.regexp_extract(xml, r"(?is)<problem\b[^>]*>(.*?)</problem>", 1))
    return F.when(F.length(found) >= PROBLEM_CHARS, found)


def stated_conclusion(xml: Column, conclusion: Column) -> Column:
    """The conclusion of an id that a document states, if it is long enough."""
    quoted = F.regexp_replace(conclusion, r"([\\.^$|()\[\]{}*+?-])", r"\\$1")
    pattern = F.concat(F.lit(r"(?s)<conclusion_reasoning\b[^>]*\bconclusion_id=\""), quoted, F.lit(r"\"[^>]*>.*?<conclusion\b[^>]*\bid=\""), quoted, F.lit(r"\"[^>]*>(.*?)</conclusion>"))
    found = tx.without_tags(F.call_function("regexp_extract", xml, pattern, F.lit(1)))
    return F.when((F.trim(conclusion) != "") & (F.length(found) >= CONCLUSION_CHARS), found)


def english_statement(problem: Column, question: Column, current: Column, from_xml: Column) -> Column:
    """The first that will do: the old full statement, the old question, the current one, what the document says, then longer old texts whatever their language."""
    full, old, now = without_prefix(problem), bare(question), bare(current)
    return F.coalesce(
        F.when(tx.looks_english(full), full), F.when(tx.looks_english(old), old), F.when(tx.looks_english(now), now), F.nullif(from_xml, F.lit("")),
        F.when(F.length(full) >= 40, full), F.when(F.length(old) >= 40, old), F.when(tx.latin_ratio(now) >= 0.45, now), F.lit(""),
    )


def chinese_question(question: Column, focus: Column, terms: Column) -> Column:
    """The question if it is Chinese enough, else one made of the focus and at most six terms."""
    kept = F.slice(F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), bare), lambda t: t != ""), 1, 6)
    tail = F.when(F.size(kept) > 0, F.array_join(kept, "、")).otherwise(F.lit(TAIL))
    made = F.concat(F.lit(QUESTION[0]), F.trim(F.coalesce(F.nullif(focus, F.lit("")), F.lit(FOCUS))), F.lit(QUESTION[1]), tail, F.lit(QUESTION[2]))
    return F.when(tx.cjk_ratio(bare(question)) >= 0.18, bare(question)).otherwise(made)


def split_chain(chain: Column, paper: Column, conclusion: Column) -> Column:
    """struct(chain_id, paper_id, conclusion_id): without a paper the id is parted at its first underscore."""
    id_, pid, cid = bare(chain), bare(paper), bare(conclusion)
    part = (pid == "") & F.contains(id_, F.lit("_"))
    rest = F.substring_index(id_, "_", 1)
    tail = F.substr(id_, F.length(rest) + 2)
    return F.struct(id_.alias("chain_id"), F.when(part, rest).otherwise(pid).alias("paper_id"), F.when(part & (tail != ""), tail).otherwise(cid).alias("conclusion_id"))


def first_labels(chains: Column) -> Column:
    """Labels of related chains, the first of each id."""
    kept = F.filter(F.transform(chains, lambda c: split_chain(c["chain_id"], c["paper_id"], c["conclusion_id"])), lambda c: c["chain_id"] != "")
    return F.aggregate(kept, F.slice(kept, 1, 0), lambda a, c: F.when(F.exists(a, lambda x: x["chain_id"] == c["chain_id"]), a).otherwise(F.concat(a, F.array(c))))


def candidate_paths(root: str, domain: Column, cluster: Column, paper: Column, conclusion: Column) -> Column:
    """Where a chain's document may lie, best first."""
    folder = F.when(F.lower(bare(domain)) == "superconductivity", F.lit("Superconductivity")).otherwise(bare(domain))
    end = F.concat(F.lit("/cluster_"), cluster.cast("string"), F.lit("/xml/"), paper, F.lit("_"), conclusion, F.lit(".xml"))
    return F.array(*[F.concat(F.lit(f"{root}/"), folder, F.lit(f"/{d}"), end) for d in ("workflows", "workflows_top50")])


def migrated_samples(samples: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(ids, research_question_zh, research_question_en, key_terms, labels, counts) of samples in either of two layouts (SAMPLE).

    A sample with related_chains is of the old layout; documents (paper_id, reasoning_xml) answer for statements that
    are in no sample.
    """
    none = F.array().cast("array<string>")
    terms = F.filter(F.transform(F.coalesce("key_terms", none), bare), lambda t: t != "")
    old = F.col("related_chains").isNotNull() | F.col("ids").isNull()
    labels = F.when(old, first_labels(F.coalesce("related_chains", F.slice("labels", 1, 0)))).otherwise(F.col("labels"))
    rows = samples.withColumn("__old", old).withColumn("__labels", F.coalesce(labels, F.slice(F.coalesce("labels", "related_chains"), 1, 0))).withColumn("__first", F.get("__labels", F.lit(0)))
    if documents is not None:
        docs = documents.groupBy("paper_id").agg(F.max("reasoning_xml").alias("__xml"))
        rows = rows.join(docs, F.col("__first.paper_id") == docs.paper_id, "left").drop(docs.paper_id)
    else:
        rows = rows.withColumn("__xml", F.lit(None).cast("string"))
    problem, conclusion = stated_problem(F.col("__xml")), stated_conclusion(F.col("__xml"), F.col("__first.conclusion_id"))
    told = F.coalesce(F.when(tx.good_enough_english(problem), problem), F.when(tx.good_enough_english(conclusion), conclusion), problem, conclusion)
    legacy = lambda c: F.when(F.col("__old"), F.col(c))
    english = english_statement(legacy("research_problem_full_zh"), legacy("research_question_zh"), F.col("research_question_en"), told)
    chinese = F.when(F.col("__old"), chinese_question(F.col("research_question_zh"), F.col("research_focus_zh"), F.col("key_terms"))).otherwise(bare(F.col("research_question_zh")))
    ids = F.when(F.col("__old"), F.struct("sample_id", "domain", "cluster_id")).otherwise(F.col("ids"))
    return rows.select(ids.alias("ids"), chinese.alias("research_question_zh"), english.alias("research_question_en"), terms.alias("key_terms"), F.col("__labels").alias("labels"), F.struct(F.size("__labels").alias("labels"), F.size(terms).alias("key_terms")).alias("counts"))
