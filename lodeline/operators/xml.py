"""Reasoning documents in XML: parsing into chains, enrichment with tools, plain text.

Markup with mixed content is read with the standard library inside Arrow batches, into rows of a declared schema; texts
and fragments of markup are then put together by Spark. What can't be parsed gives no chains and is reported apart,
never as a failure.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import md_path, xml_path

STEP = pa.struct([("step_id", pa.string()), ("text", pa.string()), ("raw_text", pa.string()), ("has_citations", pa.bool_()), ("has_figures", pa.bool_())])
CHAINS = "paper_id string, journal string, conclusion_id string, conclusion_title string, conclusion_text string, steps array<struct<step_id string, text string, raw_text string, has_citations boolean, has_figures boolean>>, raw_xml string"


def _root(xml: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(xml) if xml and xml.strip() else None
    except ET.ParseError:
        return None


def _has_ref(step: ET.Element, kind: str) -> bool:
    return any(r.get("type") == kind for r in step.iter("ref"))


def _alone(e: ET.Element) -> str:
    tail, e.tail = e.tail, None
    out = ET.tostring(e, encoding="unicode")
    e.tail = tail
    return out


def chains_of(xml: str | None) -> list[dict]:
    """The chains of one document; a chain without steps is left out. A title of a child stands before the attribute."""
    root = _root(xml)
    out = []
    for block in [] if root is None else root.iter("conclusion_reasoning"):
        steps = [{"step_id": s.get("id", "unknown"), "text": "".join(s.itertext()).strip(), "raw_text": _alone(s), "has_citations": _has_ref(s, "citation"), "has_figures": _has_ref(s, "figure")} for s in block.iter("step")]
        if steps:
            child, text = block.find("conclusion"), block.find("conclusion_text")
            title = (child.get("title") if child is not None else None) or block.get("conclusion_title", "")
            out.append({"conclusion_id": block.get("conclusion_id", "unknown"), "conclusion_title": title, "conclusion_text": text.text if text is not None else "", "steps": steps, "raw_xml": _alone(block)})
    return out


def parse_chains(papers: DataFrame, xml: str = "reasoning_xml") -> DataFrame:
    """One row per chain of every document; unparsable documents give none. A null journal becomes Unknown."""
    rows = papers.select(F.col("paper_id").cast("string"), F.coalesce("journal", F.lit("Unknown")).alias("journal"), F.col(xml).alias("xml")).where("xml is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conclusion_id", "conclusion_title", "conclusion_text", "steps", "raw_xml"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(STEP), pa.string()]
        for b in batches:
            at, got = [], []
            for i, x in enumerate(b.column("xml").to_pylist()):
                for c in chains_of(x):
                    at.append(i)
                    got.append(c)
            index = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("paper_id").take(index), b.column("journal").take(index), *[pa.array([c[n] for c in got], k) for n, k in zip(names, kinds)]], ["paper_id", "journal", *names])

    return rows.mapInArrow(run, CHAINS)


def well_formed(col):
    """Whether a document parses."""

    @F.pandas_udf("boolean")
    def check(values):
        return values.map(lambda x: _root(x) is not None)

    return check(col)


def chain_rows(chains: DataFrame, prefix: str = "paper_ocr", stored: int = 2000) -> DataFrame:
    """Chains as rows of the vector table, without vector: id, assembled text, paths, counts and flags."""
    text = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("Step "), s["step_id"], F.lit(": "), s["text"])), "\n")
    return chains.select(
        F.concat_ws("_", "paper_id", "conclusion_id").alias("chain_id"), "paper_id", "journal", "conclusion_id", "conclusion_title",
        xml_path(prefix, F.col("paper_id")).alias("xml_path"), md_path(prefix, F.col("paper_id")).alias("md_path"),
        F.left(text, F.lit(stored)).alias("chain_text"), text.alias("full_text"), F.lit(-1).alias("cluster_id"), F.size("steps").alias("num_steps"),
        F.exists("steps", lambda s: s["has_citations"]).alias("has_citations"), F.exists("steps", lambda s: s["has_figures"]).alias("has_figures"),
    )


def load_statistics(chains: DataFrame, papers: DataFrame) -> DataFrame:
    """(papers, with_chains, skipped, chains, steps, avg_steps) of a load."""
    n = papers.agg(F.count_distinct("paper_id").alias("papers"))
    got = chains.agg(F.count_distinct("paper_id").alias("with_chains"), F.count("*").alias("chains"), F.coalesce(F.sum(F.size("steps")), F.lit(0)).alias("steps"))
    return n.join(got).select("papers", "with_chains", (F.col("papers") - F.col("with_chains")).alias("skipped"), "chains", "steps", F.when(F.col("chains") > 0, F.col("steps") / F.col("chains")).alias("avg_steps"))


# The pieces of an enriched document and of a refined conclusion's text.
DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>\n'
HEAD, STEPS, TOOLS_USED, RULE = "## Conclusion: ", "### Reasoning Steps:\n", "\n### Tools Used:\n", "\n---\n\n"
TOOLS = "conclusion_id string, tools array<struct<tool_id string, tool_name string, tool_description string, tool_category string>>, links array<struct<step_id string, tool_id string>>"
_DECLARED = re.compile(r"^\s*<\?xml[^>]*\?>")
_EMPTY_TAG = re.compile(rb"""<[^\s/>]+(?:[^"'>]|"[^"]*"|'[^']*')*?/>""")


def escaped(text: Column) -> Column:
    """Text as it stands in XML; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _attribute(name: str, value: Column) -> Column:
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f' {name}="'), escaped(F.trim(value)), F.lit('"'))).otherwise(F.lit(""))


def fragments(extractions: DataFrame) -> DataFrame:
    """(paper_id, conclusion_id, step_id, xml): what a document gains, for each linked step and, with null step_id, for each conclusion.

    A link counts if its tool is among the conclusion's own.
    """
    tool = F.struct("tools.tool_id", "tools.tool_name", "tools.tool_description", "tools.tool_category", "place")
    listed = extractions.select("paper_id", "conclusion_id", F.posexplode("tools").alias("place", "tools")).select("paper_id", "conclusion_id", tool.alias("t")).select("paper_id", "conclusion_id", "t.*")
    known = listed.groupBy("paper_id", "conclusion_id", "tool_id").agg(F.max_by(F.struct("tool_name", "tool_category"), "place").alias("t"))
    links = extractions.select("paper_id", "conclusion_id", F.posexplode("links").alias("turn", "l")).select("paper_id", "conclusion_id", "turn", "l.step_id", "l.tool_id").where("step_id != ''")
    ref = F.concat(F.lit('<ref type="tool"'), _attribute("tool_id", F.col("tool_id")), _attribute("category", F.col("t.tool_category")), F.lit(">"), escaped(F.col("t.tool_name")), F.lit("</ref>"))
    joined = lambda place: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("i"), F.col("x")))), lambda r: r["x"]), "")
    refs = links.join(known, ["paper_id", "conclusion_id", "tool_id"]).withColumn("x", ref).groupBy("paper_id", "conclusion_id", "step_id").agg(joined("turn").alias("xml"))
    entry = F.concat(
        F.lit("\n<tool"), _attribute("tool_id", F.col("tool_id")), F.concat(F.lit(' index="'), (F.col("place") + 1).cast("string"), F.lit('"')), _attribute("category", F.col("tool_category")),
        F.lit("><tool_name>"), escaped(F.col("tool_name")), F.lit("</tool_name><tool_description>"), escaped(F.col("tool_description")), F.lit("</tool_description></tool>"),
    )
    lists = listed.withColumn("x", entry).groupBy("paper_id", "conclusion_id").agg(joined("place").alias("x")).select("paper_id", "conclusion_id", F.lit(None).cast("string").alias("step_id"), F.concat(F.lit("\n<tools>"), "x", F.lit("\n</tools>\n")).alias("xml"))
    return refs.unionByName(lists)


def spliced(xml: str, gains: dict[tuple[str, str | None], str]) -> str | None:
    """The document with fragments put before the ends of steps and conclusions, all else as it was; None if it doesn't parse."""
    body = _DECLARED.sub("", xml, count=1).strip().encode("utf-8", "replace")
    parser, open_, places = expat.ParserCreate("utf-8"), [], []

    def begin(name: str, attributes: dict) -> None:
        open_.append((name, attributes))

    def end(name: str) -> None:
        _, own = open_.pop()
        key = None
        if name == "conclusion_reasoning":
            key = own.get("conclusion_id", ""), None
        elif name == "step" and [n for n, _ in open_[-2:]] == ["conclusion_reasoning", "reasoning"]:
            key = open_[-2][1].get("conclusion_id", ""), own.get("id", "")
        if key in gains:
            places.append((parser.CurrentByteIndex, name, gains[key]))

    parser.StartElementHandler, parser.EndElementHandler = begin, end
    try:
        parser.Parse(body, True)
    except expat.ExpatError:
        return None
    parts, last = [], 0
    for at, name, gain in places:
        tag = None if body.startswith(b"</", at) else _EMPTY_TAG.match(body, at)
        parts.append(body[last:at] if tag is None else body[last : tag.end() - 2] + b">")
        parts.append(gain.encode() if tag is None else gain.encode() + f"</{name}>".encode())
        last = at if tag is None else tag.end()
    return DECLARATION + b"".join([*parts, body[last:]]).decode() + "\n"


def enrich(papers: DataFrame, extractions: DataFrame, xml: str = "reasoning_xml") -> DataFrame:
    """(paper_id, enriched, valid): documents with the tools of `extractions` (paper_id and the columns of TOOLS)."""
    gains = fragments(extractions).groupBy("paper_id").agg(F.collect_list(F.struct("conclusion_id", "step_id", "xml")).alias("found"))
    rows = papers.select("paper_id", F.col(xml).alias("xml")).join(gains, "paper_id", "left").select("paper_id", "xml", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if not (x or "").strip() else spliced(x, {(f["conclusion_id"], f["step_id"]): f["xml"] for f in found or ()}) for x, found in zip(b.column("xml").to_pylist(), b.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("paper_id"), pa.array(out, pa.string()), pa.array([o is not None for o in out])], ["paper_id", "enriched", "valid"])

    return rows.mapInArrow(run, "paper_id string, enriched string, valid boolean")


REFINED_STEP = pa.struct([("step_id", pa.string()), ("lead", pa.string()), ("tools", pa.list_(pa.string()))])
REFINED_TOOL = pa.struct([("name", pa.string()), ("description", pa.string())])
REFINED = {"conclusion_id": pa.string(), "title": pa.string(), "lead": pa.string(), "steps": pa.list_(REFINED_STEP), "tools": pa.list_(REFINED_TOOL), "reasoning_xml": pa.string()}


def _refined(block: ET.Element) -> dict:
    """One conclusion's parts; of a step only what stands before its first child. Absent parts are None."""
    first: dict[str, ET.Element] = {}
    for e in block:
        first.setdefault(e.tag, e)
    told, reasoning, tools = (first.get(t) for t in ("conclusion", "reasoning", "tools"))
    row = {"conclusion_id": block.get("conclusion_id", ""), "title": block.get("conclusion_title", ""), "lead": None, "steps": None, "tools": None, "reasoning_xml": None}
    if told is not None:
        row |= {"title": told.get("title") or row["title"], "lead": told.text}
    if reasoning is not None:
        named = lambda step: [r.text for r in step if r.tag == "ref" and r.get("type") == "tool" and r.text]
        row |= {"steps": [{"step_id": e.get("id", ""), "lead": e.text, "tools": named(e)} for e in reasoning if e.tag == "step"], "reasoning_xml": _alone(reasoning)}
    if tools is not None:
        row["tools"] = [{"name": e.findtext("tool_name"), "description": e.findtext("tool_description")} for e in tools if e.tag == "tool"]
    return row


def refined_parts(papers: DataFrame, xml: str = "reasoning_xml") -> DataFrame:
    """(paper_id and the columns of REFINED): the conclusions of refined documents as rows; what doesn't parse gives none."""
    rows = papers.select("paper_id", F.col(xml).alias("xml")).where("xml is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, _refined(e)) for i, x in enumerate(b.column("xml").to_pylist()) if (root := _root(x)) is not None for e in root.iter("conclusion_reasoning")]
            at = pa.array([i for i, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("paper_id").take(at), *[pa.array([r[n] for _, r in found], k) for n, k in REFINED.items()]], ["paper_id", *REFINED])

    return rows.mapInArrow(run, "paper_id string, conclusion_id string, title string, lead string, steps array<struct<step_id string, lead string, tools array<string>>>, tools array<struct<name string, description string>>, reasoning_xml string")


def refined_text() -> Column:
    """The text of one conclusion, out of the columns of refined_parts."""
    empty = F.lit("")
    head = F.when(F.col("lead") != "", F.concat(F.lit(HEAD), "title", F.lit("\n"), "lead", F.lit("\n")))
    step = lambda s: F.concat(F.lit("- Step "), s["step_id"], F.lit(": "), F.coalesce(s["lead"], empty), F.when(F.size(s["tools"]) > 0, F.concat(F.lit(" [Tools: "), F.array_join(s["tools"], ", "), F.lit("]"))).otherwise(empty), F.lit("\n"))
    tool = lambda t: F.concat(F.lit("- **"), t["name"], F.lit("**: "), F.coalesce(t["description"], empty), F.lit("\n"))
    steps = F.concat(F.lit(STEPS), F.array_join(F.transform("steps", step), ""))
    tools = F.concat(F.lit(TOOLS_USED), F.array_join(F.transform(F.filter("tools", lambda t: t["name"] != ""), tool), ""))
    return F.concat(*[F.coalesce(part, empty) for part in (head, steps, tools)], F.lit(RULE))


def refined_texts(papers: DataFrame, xml: str = "reasoning_xml") -> DataFrame:
    """(paper_id, conclusion_id, text): every conclusion of refined documents as text."""
    return refined_parts(papers, xml).select("paper_id", "conclusion_id", refined_text().alias("text"))


def conclusion_by_id(papers: DataFrame, wanted: DataFrame, xml: str = "reasoning_xml") -> DataFrame:
    """(paper_id, conclusion_id, text): the asked conclusions (paper_id, conclusion_id); null text where the document lacks it."""
    asked = wanted.select("paper_id", "conclusion_id").distinct()
    mine = papers.join(asked.select("paper_id").distinct(), "paper_id", "left_semi")
    found = refined_texts(mine, xml).groupBy("paper_id", "conclusion_id").agg(F.first("text").alias("text"))
    return asked.join(found, ["paper_id", "conclusion_id"], "left")


def conclusion_blocks(papers: DataFrame, xml: str = "reasoning_xml") -> DataFrame:
    """(paper_id, conclusion_id, title, reasoning_xml): what a tool extraction is asked about."""
    return refined_parts(papers, xml).select("paper_id", "conclusion_id", "title", "reasoning_xml")


def chains_text(chains: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, text): the chains of each group as one Markdown text, in the order of their ids."""
    lines = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("- "), s["text"])), "\n")
    one = F.concat(F.lit("# "), F.coalesce("conclusion_title", F.lit("")), F.lit("\nConclusion: "), F.coalesce("conclusion_text", F.lit("")), F.lit("\n\n## Reasoning Steps:\n"), lines, F.lit("\n\n---\n"))
    rows = chains.select(*group, F.struct("paper_id", "conclusion_id", one.alias("t")).alias("s"))
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n").alias("text"))


def refined_bodies(chains: DataFrame, refined: DataFrame) -> DataFrame:
    """(chain_id, body, origin): a chain's own conclusion, else the whole refined paper, else its stored text."""
    whole = refined.groupBy("paper_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conclusion_id", "text"))), lambda x: x["text"]), "").alias("whole"))
    suffix = F.when(F.startswith(F.col("chain_id"), F.concat("paper_id", F.lit("_"))), F.expr("substring(chain_id, length(paper_id) + 2)"))
    own = refined.groupBy("paper_id", "conclusion_id").agg(F.first("text").alias("own"))
    rows = chains.select("chain_id", "paper_id", "chain_text", suffix.alias("conclusion_id")).join(own, ["paper_id", "conclusion_id"], "left").join(whole, "paper_id", "left")
    return rows.select("chain_id", F.coalesce("own", "whole", "chain_text").alias("body"), F.when(F.col("own").isNotNull(), "conclusion").when(F.col("whole").isNotNull(), "paper").otherwise("chain").alias("origin"))
