"""Tournaments, ablations, reports, coverage and other grouped analytics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import number, percent


def tournament(comparisons: DataFrame, a: str = "file_a", b: str = "file_b", better: str = "better") -> DataFrame:
    """(file, wins, losses, ties, score, rank): score is wins less losses; an unknown verdict is a tie."""
    verdict = F.upper(F.coalesce(F.col(better), F.lit("tie")))
    sides = comparisons.select(F.explode(F.array(F.struct(F.col(a).alias("file"), (verdict == "A").alias("won"), (verdict == "B").alias("lost")), F.struct(F.col(b).alias("file"), (verdict == "B").alias("won"), (verdict == "A").alias("lost")))).alias("s")).select("s.*")
    sums = sides.groupBy("file").agg(F.count_if("won").alias("wins"), F.count_if("lost").alias("losses"), F.count_if(~F.col("won") & ~F.col("lost")).alias("ties"))
    scored = sums.withColumn("score", F.col("wins") - F.col("losses"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("wins"), "file")))


def sampled_pairs(items: DataFrame, key: str, pairs: int, seed: int = 42) -> DataFrame:
    """(a, b): `pairs` different unordered pairs drawn by position, or all if there are no more.

    Positions come from an index over the items, and a drawn pair is found by two lookups; pairs are never all made.
    """
    indexed = items.select(F.col(key).alias("k")).distinct().withColumn("i", (F.row_number().over(Window.orderBy("k")) - 1).cast("bigint"))
    n = indexed.count()
    total = n * (n - 1) // 2
    want = min(pairs, total)
    spark = items.sparkSession
    if want == total:
        numbers = spark.range(total).withColumnRenamed("id", "p")
    else:
        numbers = spark.range(want * 3 + 16).select((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1)))).alias("p"), "id").groupBy("p").agg(F.min("id").alias("o")).orderBy("o").limit(want).select("p")
    # the p-th pair (i < j): j is the largest with j(j-1)/2 <= p
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("bigint")
    drawn = numbers.select("p", j.alias("j")).withColumn("j", F.col("j") + F.when(F.col("j") * (F.col("j") + 1) / 2 <= F.col("p"), 1).when(F.col("j") * (F.col("j") - 1) / 2 > F.col("p"), -1).otherwise(0)).withColumn("i", (F.col("p") - F.col("j") * (F.col("j") - 1) / 2).cast("bigint"))
    return drawn.join(indexed.select(F.col("k").alias("a"), "i"), "i").join(indexed.select(F.col("k").alias("b"), F.col("i").alias("j")), "j").select("a", "b")


def alignment(baseline: DataFrame, variant: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: keys on both sides or one, and on which side the value is greater."""
    both = baseline.select(*keys, F.col(value).alias("x"), F.lit(True).alias("in_a")).join(variant.select(*keys, F.col(value).alias("y"), F.lit(True).alias("in_b")), keys, "full_outer")
    a, b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(F.count_if(a & b).alias("aligned"), F.count_if(a & ~b).alias("only_baseline"), F.count_if(b & ~a).alias("only_variant"), F.count_if(a & b & (F.col("x") > F.col("y"))).alias("baseline_wins"), F.count_if(a & b & (F.col("y") > F.col("x"))).alias("variant_wins"), F.count_if(a & b & (F.col("x") == F.col("y"))).alias("ties"))


def distribution(df: DataFrame, column: Column, empty: str = "(空)") -> DataFrame:
    """(value, n, percent): counts of values without case and outer blanks; nulls have a name of their own."""
    value = F.coalesce(F.lower(F.trim(column)), F.lit(empty))
    counts = df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def method_frequency(mentions: DataFrame, method: str, paper: str, most: int = 10) -> DataFrame:
    """(method, mentions, frequency): the most mentioned methods; the base is all papers, repeated mentions count."""
    papers = mentions.agg(F.count_distinct(paper).alias("papers"))
    counts = mentions.where(F.col(method).isNotNull() & (F.col(method) != "")).groupBy(F.col(method).alias("method")).agg(F.count("*").alias("mentions"))
    return counts.join(papers).select("method", "mentions", F.round(F.col("mentions") / F.col("papers"), 6).alias("frequency")).orderBy(F.desc("mentions"), "method").limit(most)


def coverage(rows: DataFrame, stage: Column, unit: str) -> DataFrame:
    """(stage, covered, share): units in which a stage occurs, of all units, to one place."""
    total = rows.agg(F.count_distinct(unit).alias("total"))
    got = rows.select(stage.alias("stage"), unit).where("stage is not null").groupBy("stage").agg(F.count_distinct(unit).alias("covered"))
    return got.join(total).select("stage", "covered", F.round(F.col("covered") * 100.0 / F.col("total"), 1).alias("share"))


def tolerance_checks(df: DataFrame, actual: Column, expected: Column, tolerance: float = 0.3) -> DataFrame:
    """(status, n): pass or fail by relative error, missing where either is null; an expected zero passes only on zero."""
    error = F.abs(actual - expected) / F.abs(expected)
    status = F.when(actual.isNull() | expected.isNull(), "missing").when(expected == 0, F.when(actual == 0, "pass").otherwise("fail")).when(error <= tolerance, "pass").otherwise("fail")
    return df.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def size_distribution(sizes: DataFrame, size: str = "size") -> DataFrame:
    """(size, groups, cumulative): share of rows in groups up to each size. Equal sizes are summed first, so the window is short."""
    per = sizes.groupBy(size).agg(F.count("*").alias("groups"), F.sum(size).alias("rows"))
    upto = F.sum("rows").over(Window.orderBy(size).rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("cumulative", F.round(upto / F.sum("rows").over(Window.partitionBy()), 6)).select(size, "groups", "cumulative")


def budget_sample(rows: DataFrame, per_group: int, keys: list[str], key: str, seed: str = "42") -> DataFrame:
    """At most per_group rows of each group in the order of a digest of key and seed, the same on any engine."""
    if per_group < 1:
        raise ValueError("per_group must be at least 1")
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.col(key), F.lit(seed))), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group)


def nearest_sample(rows: DataFrame, per_group: int, group: str, distance: str, key: str) -> DataFrame:
    """At most per_group rows of each group by distance, unknown distances last."""
    if per_group < 1:
        raise ValueError("per_group must be at least 1")
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last(distance), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group).orderBy(group, "place")


def signature_groups(steps: DataFrame, unit: str, order: list[str], tool: str) -> DataFrame:
    """(signature, units, n): units whose sequences of tools are the same, order included."""
    seq = steps.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(tool), F.lit("")).alias("t")))).alias("s")).select(unit, F.array_join(F.transform("s", lambda x: x["t"]), ">").alias("signature"))
    return seq.groupBy("signature").agg(F.count("*").alias("n"), F.min(unit).alias("first_unit"))


MOST_TOOLS = 100_000


def text_matches(steps: DataFrame, tools: DataFrame, step_keys: list[str], text: str, name: str = "tool_name") -> DataFrame:
    """(step keys, name): tools whose name occurs in a step's text, whatever the case, found in one pass over each text. Tools are a short list, checked to be."""
    names = [r[0] for r in tools.select(name).where(F.col(name).isNotNull() & (F.trim(name) != "")).distinct().limit(MOST_TOOLS + 1).collect()]
    if len(names) > MOST_TOOLS:
        raise ValueError(f"more than {MOST_TOOLS} tools")
    by_low: dict[str, list[str]] = {}
    for n in sorted(names):
        by_low.setdefault(n.lower(), []).append(n)
    held = steps.sparkSession.sparkContext.broadcast(by_low)

    @F.pandas_udf("array<string>")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder(held.value)
        for texts in parts:
            yield texts.map(lambda t: sorted(n for low in find((t or "").lower()) for n in held.value[low]))

    return steps.select(*step_keys, F.explode(hits(F.col(text))).alias(name))


def finder(names):
    """A function from a text to the set of names in it: by an automaton where there is one, else one by one."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {n for n in names if n in text}
    machine = ahocorasick.Automaton()
    for n in names:
        machine.add_word(n, n)
    if not len(machine):
        return lambda text: set()
    machine.make_automaton()
    return lambda text: {n for _, n in machine.iter(text)}


def linked_tools(steps: DataFrame, links: DataFrame, tools: DataFrame, keys: list[str], step: str = "step_id") -> DataFrame:
    """(keys, step, tools): names of the tools linked to each step; links to unknown tools are left out."""
    named = links.join(tools, "tool_id").groupBy(*keys, step).agg(F.array_sort(F.collect_set("tool_name")).alias("tools"))
    return steps.select(*keys, step).join(named, [*keys, step], "left").select(*keys, step, F.coalesce("tools", F.array().cast("array<string>")).alias("tools"))


def stage_keyword_papers(stages: DataFrame, papers: DataFrame, stage: str, words: str, paper: str, text: str, most: int = 5, instead: int = 3) -> DataFrame:
    """(stage, paper, hits, rank): for each stage the papers in which most of its keywords occur.

    A stage without any hit takes turns: of the papers in order, `instead` from the place instead * its own number on,
    beginning again at the end, with 0 hits. Stages are few and checked to be.
    """
    rows = stages.select(stage, words).orderBy(stage).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 stages")
    scores = F.array(*[F.struct(F.lit(r[stage]).alias("stage"), sum((F.contains(F.lower(F.col(text)), F.lit(w.lower())).cast("int") for w in r[words] or []), F.lit(0)).alias("hits")) for r in rows])
    hit = papers.select(F.col(paper).alias("paper"), F.explode(scores).alias("s")).select("s.stage", "paper", "s.hits").where("hits > 0")
    best = hit.withColumn("rank", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("hits"), "paper"))).where(F.col("rank") <= most)
    n = papers.select(paper).distinct().count()
    turns = [(r[stage], place + 1, (instead * i + place) % n) for i, r in enumerate(rows) for place in range(min(instead, n))] if n else []
    spark = papers.sparkSession
    numbered = spark.createDataFrame([(i, x[0]) for i, x in enumerate(papers.select(paper).distinct().orderBy(paper).limit(instead * len(rows)).collect())], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("paper", papers.schema[paper].dataType)]))
    taken = spark.createDataFrame(turns, "stage string, rank int, i int").join(F.broadcast(numbered), "i").join(best.select("stage").distinct(), "stage", "left_anti")
    return best.unionByName(taken.select("stage", "paper", F.lit(0).alias("hits"), "rank"))


def merged_ids(rows: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, ids): the different ids of all rows of a key, in order."""
    return rows.select(key, F.explode(ids).alias("x")).where("x is not null").groupBy(key).agg(F.array_sort(F.collect_set("x")).alias(ids))


def grade_statistics(rows: DataFrame, grade: str = "grade", subtype: str = "subtype", main: str = "主线") -> DataFrame:
    """(total, a_main, b_variant, c_edge)."""
    g = F.col(grade)
    return rows.agg(F.count("*").alias("total"), F.count_if(is_main_line(grade, subtype, main)).alias("a_main"), F.count_if(g == "B").alias("b_variant"), F.count_if(g == "C").alias("c_edge"))


def is_main_line(grade: str = "grade", subtype: str = "subtype", main: str = "主线") -> Column:
    return (F.col(grade) == "A") & (F.col(subtype) == main)


def is_record(columns: list[str]) -> Column:
    """Whether a row is a selected chain: it has a cluster, and a text or an id."""
    held = [F.col(c).isNotNull() for c in ("chain_text", "chain_id") if c in columns]
    return F.col("cluster_id").isNotNull() & (held[0] if len(held) == 1 else held[0] | held[1]) if held and "cluster_id" in columns else F.lit(False)


def named_tools(tools: Column, generic: tuple[str, ...] = ("数值", "求解器", "积分器", "未报告", "未提及"), most: int = 20) -> Column:
    """Of a list the tools with a proper name - a capital or a digit and no generic word - in order."""
    proper = lambda t: t.rlike("[A-Z0-9]") & ~t.rlike("|".join(generic))
    return F.slice(F.array_sort(F.array_distinct(F.filter(tools, proper))), 1, most)


def top_keywords(rows: DataFrame, method: str, tools: str, each: int = 5, per_row: int = 3, most: int = 10) -> DataFrame:
    """(place, keyword): the most frequent methods, then the most frequent of the first tools of each row, each once."""
    parts = [rows.select(F.lit(0).alias("kind"), F.col(method).alias("k")), rows.select(F.lit(1).alias("kind"), F.explode(F.slice(tools, 1, per_row)).alias("k"))]
    counts = parts[0].unionByName(parts[1]).where("k is not null and k != ''").groupBy("kind", "k").agg(F.count("*").alias("n"))
    top = counts.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "k"))).where(F.col("i") <= each)
    once = top.groupBy("k").agg(F.min(F.struct("kind", "i")).alias("o"))
    return once.withColumn("place", F.row_number().over(Window.orderBy("o"))).where(F.col("place") <= most).select("place", F.col("k").alias("keyword"))


def extractable(clusters: DataFrame, support: str, criteria: list[str], least: int = 10) -> DataFrame:
    """clusters with `extractable`: enough chains and every criterion fulfilled; an unknown one isn't."""
    good = F.col(support) >= least
    for c in criteria:
        good = good & F.coalesce(F.col(c), F.lit(False))
    return clusters.withColumn("extractable", F.coalesce(good, F.lit(False)))


def core_chains(chains: DataFrame, group: list[str], paper: str, key: str, order: list, least_chains: int = 10, least_papers: int = 5) -> DataFrame:
    """(group, paper, key): the best chain of each paper, in groups of enough chains and papers."""
    big = chains.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(paper).alias("p")).where((F.col("n") >= least_chains) & (F.col("p") >= least_papers)).select(*group)
    best = chains.join(big, group, "left_semi").withColumn("i", F.row_number().over(Window.partitionBy(*group, paper).orderBy(*order, key)))
    return best.where("i = 1").select(*group, paper, key)


def steps_to_chains(steps: DataFrame, chains: DataFrame, step: str = "step_id") -> DataFrame:
    """The chains that steps named paper::conclusion::step belong to; other names are left out."""
    parts = F.split(step, "::")
    wanted = steps.where(F.size(parts) >= 3).select(parts[0].alias("paper_id"), parts[1].alias("conclusion_id")).distinct()
    return chains.join(wanted, ["paper_id", "conclusion_id"], "left_semi")


def file_totals(files: DataFrame, size: str) -> DataFrame:
    """(files, bytes)."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def ablation_report(rows: DataFrame, key: str, most: int = 100) -> str:
    """A table of the first rows in Markdown, and how many are not shown."""
    shown = rows.orderBy(key).limit(most).collect()
    hidden = rows.count() - len(shown)
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join("—" if r[n] is None else str(r[n]) for n in names) + " |" for r in shown]]
    return "\n".join(lines + ([f"… {hidden} more"] if hidden > 0 else []))


def similarity_report(metrics: DataFrame, judgments: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Vector metrics beside judgments, the last judgment of a cluster counting, numbers to four places."""
    last = judgments.withColumn("__n", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("judged_at"), F.desc("overall")))).where("__n = 1").select(cluster, "overall", "confidence")
    return metrics.join(last, cluster, "left").select(cluster, "n_pairs", *[number(F.col(c)).alias(c) for c in ("mean", "median", "min", "max")], F.coalesce("overall", F.lit("—")).alias("overall"), F.coalesce("confidence", F.lit("—")).alias("confidence"))


def gains_stopped(rounds: DataFrame, run: str, turn: str, rate: str, enough: float = 0.9, patience: int = 3) -> DataFrame:
    """(run, stop_turn): the first round that reaches `enough`, or after which `patience` rounds brought no gain."""
    w = Window.partitionBy(run).orderBy(turn)
    best = F.max(rate).over(w.rowsBetween(Window.unboundedPreceding, -patience))
    recent = F.max(rate).over(w.rowsBetween(-patience + 1, 0))
    stop = (F.col(rate) >= enough) | (best.isNotNull() & (recent <= best))
    return rounds.withColumn("__s", stop).where("__s").groupBy(run).agg(F.min(turn).alias("stop_turn"))
