"""Text functions as Spark columns: tokenisers, ratios, markup, templates, JSON repair, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of query keywords, and token patterns.
STOPWORDS = ("的", "了", "和", "是", "在", "有", "与", "及", "等", "中", "对", "为", "以", "从", "到", "用", "by", "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "from")
CHAIN_TOKEN = r"[一-鿿A-Za-z0-9\-\+]{2,}"
WORKFLOW_TOKEN = r"[一-鿿]+|[a-zA-Z]+|[0-9]+"


def chain_tokens(col: Column, n: int, lower: bool = True) -> Column:
    """The first n different tokens of a chain query."""
    text = F.lower(col) if lower else col
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(CHAIN_TOKEN), F.lit(0))), 1, n)


def workflow_tokens(col: Column, least: int = 2, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Keywords of a workflow query; repeated ones stay."""
    words = F.regexp_extract_all(F.lower(col), F.lit(WORKFLOW_TOKEN), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stopwords))


def share(col: Column, pattern: str) -> Column:
    """Matches of a one-character pattern over the length; 0 for an empty text."""
    return F.when(F.length(col) > 0, F.regexp_count(col, F.lit(pattern)) / F.length(col)).otherwise(F.lit(0.0))


def cjk_ratio(col: Column) -> Column:
    return share(col, "[一-鿿]")


def latin_ratio(col: Column) -> Column:
    return share(col, "[A-Za-z]")


def looks_english(col: Column) -> Column:
    return (F.length(col) >= 40) & (latin_ratio(col) >= 0.38) & (cjk_ratio(col) < 0.12)


def good_enough_english(col: Column) -> Column:
    wide = (F.length(col) >= 50) & (latin_ratio(col) >= 0.22)
    return col.isNotNull() & (F.length(col) >= 35) & (cjk_ratio(col) <= 0.12) & (looks_english(col) | wide)


def without_tags(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col, "<[^>]+>", " "), r"\s+", " "))


def without_fences(col: Column) -> Column:
    """The inside of a fenced block, else the text."""
    inside = F.regexp_extract(col, r"(?s)```[A-Za-z]*\s*\n(.*?)```", 1)
    return F.trim(F.when(inside != "", inside).otherwise(col))


def repaired_json(col: Column) -> Column:
    """A JSON object out of a completion: fences stripped, then the outermost braces; null where nothing parses."""
    bare = without_fences(col)
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    pick = F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(F.nullif(braces, F.lit(""))).isNotNull(), braces)
    return pick


def path_safe(col: Column) -> Column:
    return F.replace(col, F.lit("/"), F.lit("%2F"))


def safe_stem(col: Column, most: int = 180) -> Column:
    return F.substring(F.regexp_replace(col, r"[^\w一-鿿.-]+", "_"), 1, most)


def xml_path(prefix: str, paper: Column) -> Column:
    return F.concat(F.lit(f"{prefix}/xml/"), paper, F.lit("_reasoning_chain.xml"))


def md_path(prefix: str, paper: Column) -> Column:
    return F.concat(F.lit(f"{prefix}/md/"), paper, F.lit(".md"))


def truncated(col: Column, most: int, marker: str = "") -> Column:
    """At most `most` characters; with a marker, what is cut makes room for it."""
    if not marker:
        return F.left(col, F.lit(most))
    return F.when(F.length(col) > most, F.concat(F.left(col, F.lit(most - len(marker))), F.lit(marker))).otherwise(col)


def percent(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.format_string("%.1f%%", num * 100.0 / den)).otherwise(F.lit("—"))


def number(col: Column, places: int = 4) -> Column:
    d = col.cast("double")
    return F.when(d.isNotNull(), F.format_string(f"%.{places}f", d)).otherwise(F.lit("—"))


def json_safe(col: Column) -> Column:
    """NaN and infinities as null."""
    d = col.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def suffix_after(text: Column, prefix: Column) -> Column:
    """What follows `prefix_`, null where the text doesn't begin with it."""
    head = F.concat(prefix, F.lit("_"))
    return F.when(F.startswith(text, head), F.substring(text, F.length(head) + 1, F.length(text)))


def tags(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The sorted names of the rules (pattern, name) that match, whatever the case."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for p, n in rules]))))


def methods_section(col: Column, headings: tuple[str, ...], size: int = 3000) -> Column:
    """`size` characters from the first heading found, else from a third of the text."""
    low = F.lower(col)
    at = F.coalesce(*[F.nullif(F.instr(low, h.lower()), F.lit(0)) for h in headings], (F.length(col) / 3).cast("int") + 1)
    return F.substring(col, at, F.lit(size))


def workflow_name(stages: Column, methods: Column) -> Column:
    return F.when(F.size(stages) > 0, F.array_join(F.slice(stages, 1, 3), " → ")).when(F.size(methods) > 0, F.array_join(F.slice(methods, 1, 3), " + ")).otherwise(F.lit("未命名工作流"))


def similarity_signature(frequencies: Column, stages: Column) -> Column:
    """Method frequencies padded to ten, the number of stages, and a digest of their sequence."""
    zeros = F.array_repeat(F.lit(0.0), 10)
    return F.struct(F.slice(F.concat(frequencies, zeros), 1, 10).alias("method_vector"), F.size(stages).alias("stage_count"), F.substring(F.sha2(F.array_join(stages, "_"), 256), 1, 16).alias("stage_sequence_hash"))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets; two empty sets are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {{name}} places filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
