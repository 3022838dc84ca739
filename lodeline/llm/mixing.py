"""Sources mixed to target weights: Pfair scheduling of blocks of documents.

Every source's documents are counted in tokens of a public tokenizer, put into hash order and cut into blocks. In the
fluid mix, all sources that still have blocks advance in proportion to their weights; when a source has given all that
it may, the shares of the others are renewed. Block j of a source is released when the fluid mix begins it and is due
when the fluid mix ends it; at every slot the released block of the earliest deadline is taken. All deadlines can be
met (the fluid mix shows it), so at any slot every source has given less than one block more or less than its share.
A document belongs to the slot in which it begins: counted in tokens, a source may be off by a block and its longest
document. A source whose tokens do not suffice is repeated in whole passes up to its cap; the shares reached are
reported.

A block holds BLOCK_TOKENS tokens, or a part in SLOTS of the mix if that is more, so the schedule of blocks is a table
of at most about SLOTS rows, whatever the size of the corpus. Running sums are taken in two steps (sums of hash
buckets, then inside a bucket of about BUCKET_DOCS documents), so that a source with a third of all rows is not one
task.

Defined results: documents with null id, null or unknown source or null text are left out; an empty text has no tokens
and takes no room; a target without documents reports zero; a null share counts as 0 and a null cap as 1; repeated
rows of one id count once.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENIZER_DIR = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before merges, which belongs to the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_DOCS = 50_000
BLOCK_TOKENS = 4096
SLOTS = 500_000
_COUNTERS: dict[str, TokenCounter] = {}


class TokenCounter:
    """Counts tokens. A text may be cut before each blank that begins a word without changing its tokens, so counts of short pieces are kept."""

    def __init__(self, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        pieces = text.split(" ")
        total, known = 0, self.known
        if len(known) > 400_000:
            known.clear()
        for i, p in enumerate(pieces):
            if p == "" or p[0].isspace():  # blanks in a row belong together
                return len(self.encode(text))
            n = known.get(p) if i else None
            if n is None:
                n = len(self.encode(" " + p if i else p))
                if i and len(p) < 32:
                    known[p] = n
            total += n
        return total


def counter(ranks: str) -> TokenCounter:
    if ranks not in _COUNTERS:
        _COUNTERS[ranks] = TokenCounter(ranks)
    return _COUNTERS[ranks]


def token_counts(df: DataFrame, keep: list[str], text: str = "text", ranks: str | None = None) -> DataFrame:
    """The columns `keep` with the number of tokens of `text`; null for a null text."""
    ranks = ranks or os.path.join(TOKENIZER_DIR, RANKS)
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks)
        for b in batches:
            n = [None if t is None else count(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "tokens"])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.mapInArrow(run, ", ".join([*fields, "tokens bigint"]))


def source_key(col: Column) -> Column:
    """One spelling for sources that differ only in case, blanks or separators."""
    return F.regexp_replace(F.lower(col), r"[\p{Z}\s_\-‐‑–./]+", "")


def sized_documents(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, source as in the targets, tokens) of the documents of known source. The targets are a short list and are checked to be."""
    names = [r.source for r in targets.select("source").where("source is not null").distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 sources")
    own = docs.sparkSession.createDataFrame([(n,) for n in names], "source string").withColumn("__k", source_key(F.col("source")))
    known = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), source_key(F.col("source")).alias("__k")).where("doc_id is not null and text is not null")
    known = known.join(F.broadcast(own), "__k").drop("__k")
    counted = token_counts(known, ["doc_id", "source"], "text", ranks)
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("s")).select("doc_id", "s.source", "s.tokens")


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, goal, taken): what each source is to give.

    goal is target_share times the tokens of all documents of known source; a source gives at most max_repeats
    times its tokens.
    """
    sums = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    wanted = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    plan = wanted.join(F.broadcast(sums), "source", "left").na.fill(0, ["docs", "tokens"])
    plan = plan.withColumn("goal", F.col("target_share") * F.sum("tokens").over(Window.partitionBy()))  # over the short list of sources
    return plan.withColumn("taken", F.least(F.col("goal"), (F.col("max_repeats") * F.col("tokens")).cast("double")))


def windows(weights: np.ndarray, blocks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(release, deadline) of every block of each source: the slots between which the fluid mix gives it.

    The fluid mix at level x has taken min(x * weight, blocks) of each source; the slots up to there are their sum.
    """
    ends = np.where(weights > 0, blocks / np.maximum(weights, 1e-300), 0.0)
    levels = np.unique(np.concatenate([[0.0], ends]))
    slots = np.array([np.minimum(x * weights, blocks).sum() for x in levels])
    out = []
    for w, n in zip(weights, blocks):
        at = np.interp(np.arange(n + 1) / w, levels, slots) if n else np.zeros(1)
        slack = 1e-9 * np.maximum(1.0, at)  # what floating point may be off
        out.append((np.floor(at + slack)[:-1].astype(np.int64), np.ceil(at - slack)[1:].astype(np.int64)))
    return out


def pfair(weights: np.ndarray, blocks: np.ndarray) -> list[np.ndarray]:
    """The slot of every block of each source: among the released blocks the earliest deadline first, ties to the first source."""
    frames = windows(weights, blocks)
    slot_of = [np.zeros(n, np.int64) for n in blocks]
    nexts = [0] * len(blocks)
    waiting = [(int(r[0]), i) for i, (r, _) in enumerate(frames) if len(r)]
    heapq.heapify(waiting)
    frames = [(r.tolist(), d.tolist()) for r, d in frames]
    ready: list[tuple[int, int]] = []
    for t in range(int(blocks.sum())):
        while waiting and (waiting[0][0] <= t or not ready):
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (frames[i][1][nexts[i]], i))
        _, i = heapq.heappop(ready)
        slot_of[i][nexts[i]] = t
        nexts[i] += 1
        if nexts[i] < len(frames[i][0]):
            heapq.heappush(waiting, (frames[i][0][nexts[i]], i))
    return slot_of


def mixed(sized: DataFrame, plan: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7, slots: int = SLOTS, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(slot, source, start, pass, doc_id, tokens): the mix; in the order of slot and start it is the schedule."""
    use = plan.where("taken > 0").select("source", F.col("tokens").alias("all_tokens"), "taken", "target_share", F.ceil(F.col("docs") / F.lit(bucket_docs)).alias("buckets"))
    rows = use.orderBy("source").collect()  # as short as the list of sources
    taken = np.array([r.taken for r in rows])
    size = max(block_tokens, int(np.ceil(taken.sum() / slots))) if len(rows) else block_tokens
    slot_of = pfair(np.array([r.target_share for r in rows]), np.maximum(1, np.ceil(taken / size)).astype(np.int64)) if len(rows) else []
    held = sized.sparkSession.sparkContext.broadcast({r.source: x for r, x in zip(rows, slot_of)})
    docs = sized.where("tokens > 0").join(F.broadcast(use), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.col("buckets")))
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"]).drop("in_bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("here", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, ["source", "bucket"])
    placed = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("all_tokens")).cast("int") - 1)))
    placed = placed.withColumn("start", F.col("pass") * F.col("all_tokens") + F.col("before") + F.col("here")).where("start < taken")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("source").dictionary_encode()
            block, code = b.column("start").to_numpy() // size, names.indices.to_numpy()
            slot = np.zeros(len(block), np.int64)
            for k, name in enumerate(names.dictionary.to_pylist()):
                mine = code == k
                slot[mine] = held.value[name][block[mine]]
            yield pa.RecordBatch.from_arrays([pa.array(slot), *b.columns], ["slot", *b.schema.names])

    keep = placed.select("source", F.col("start").cast("bigint").alias("start"), "pass", "doc_id", "tokens")
    return keep.mapInArrow(put, "slot bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema))


def reached_shares(plan: DataFrame, mix: DataFrame) -> DataFrame:
    """(source, target_share, docs_used, tokens_used, actual_share, short): what the mix really holds of each source, and whether that is less than its goal."""
    used = mix.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum("tokens").alias("tokens_used"))
    rows = plan.select("source", "target_share", "goal").join(F.broadcast(used), "source", "left").na.fill(0, ["docs_used", "tokens_used"])
    total = F.sum("tokens_used").over(Window.partitionBy())
    return rows.withColumn("actual_share", F.when(total > 0, F.col("tokens_used") / total)).withColumn("short", F.col("tokens_used") < F.col("goal")).drop("goal")
