"""Sources and sinks: schemas, readers of the document formats, and a keyed table of versions in plain parquet.

Parquet knows no update, delete or merge, and overwriting what is being read loses data. A KeyedTable therefore keeps
its rows in buckets of keys: a change writes new directories for the touched buckets alone, and a manifest that names
the directories in force comes last. A writer that dies leaves the old manifest in force; of two writers of one turn the
second fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The columns of the tables.
SCHEMAS = {
    "chain_embeddings": "chain_id string, paper_id string, journal string, domain string, conclusion_id string, conclusion_title string, xml_path string, md_path string, chain_text string, vector array<float>, cluster_id int, num_steps int, has_citations boolean, has_figures boolean",
    "cluster_metadata": "global_cluster_id string, domain string, local_cluster_id int, num_chains int, num_papers int, chain_xml_paths array<string>, paper_ids array<string>, paper_md_paths array<string>, centroid array<float>, avg_intra_similarity float, min_intra_similarity float, min_pair_sim_threshold float, created_at timestamp_ntz, last_updated timestamp_ntz",
    "cluster_centers": "cluster_id int, domain string, center array<float>, size int",
    "progress_tracker": "paper_id string, step1_completed boolean, step2_completed boolean, step3_completed boolean, num_conclusions int, num_steps int, num_tools_matched int, created_at timestamp_ntz, last_updated timestamp_ntz, error_message string",
    "tool_matches": "match_id string, chain_id string, step_id string, tool_id string, tool_name string, match_method string, confidence float",
    "workflow_embeddings": "workflow_id string, workflow_name string, domain string, problem_description string, vector array<float>, keywords array<string>, input_types array<string>, output_types array<string>, methods array<string>, key_methods string, stage_count int, num_papers int, num_chains int, created_at timestamp_ntz",
    "chains": "paper_id string, journal string, conclusion_id string, conclusion_title string, conclusion_text string, steps array<struct<step_id string, text string, raw_text string, has_citations boolean, has_figures boolean>>, raw_xml string",
}
KEY_NAMES = ("chain_id", "workflow_id", "step_id")


def schema(name: str) -> T.StructType:
    """The declared schema of a table; an unknown name is an error."""
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name}; known are {', '.join(sorted(SCHEMAS))}")
    return T.StructType.fromDDL(SCHEMAS[name])


def check_columns(df: DataFrame, name: str) -> list[str]:
    """Missing columns are an error; the names of further ones are returned."""
    want = {f.name for f in schema(name)}
    if missing := sorted(want - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return sorted(set(df.columns) - want)


def primary_key(columns: Sequence[str]) -> str:
    """The first of the conventional keys, else the first column."""
    return next((k for k in KEY_NAMES if k in columns), columns[0])


class KeyedTable:
    """A table of versions under `path`, with append, upsert, update, delete and lookup by key. `kind` is a known table or a DDL string."""

    def __init__(self, spark: SparkSession, path: str, kind: str, key: str | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.kind = schema(kind) if kind in SCHEMAS else T.StructType.fromDDL(kind)
        self.key = key or primary_key(self.kind.fieldNames())

    def _place(self, name: str = ""):
        """(file system, path) of the manifests, or of one."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/{name}".rstrip("/"))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifest(self) -> tuple[int, dict[str, list[str]]]:
        """(turn, directories of each bucket): what is in force."""
        fs, at = self._place()
        turns = sorted(n for s in (fs.listStatus(at) if fs.exists(at) else []) if (n := s.getPath().getName()).isdigit())
        if not turns:
            return 0, {}
        stream = fs.open(self._place(turns[-1])[1])
        try:
            return int(turns[-1]), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, turn: int, held: dict[str, list[str]]) -> None:
        fs, final = self._place(f"{turn:012d}")
        _, draft = self._place(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer took turn {turn} of {self.path}")

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: DataFrame) -> list[str]:
        return [str(r.b) for r in keys.select(self._bucket().alias("b")).distinct().collect()]

    def _read(self, held: dict[str, list[str]], only: Sequence[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{v}/__b={b}" for b, vs in held.items() if only is None or b in set(only) for v in vs]
        return self.spark.read.schema(self.kind).parquet(*paths) if paths else self.spark.createDataFrame([], self.kind)

    def read(self) -> DataFrame:
        return self._read(self.manifest()[1])

    def _written(self, df: DataFrame) -> tuple[str, list[str]]:
        """(directory, buckets in it) of rows that were written."""
        v = f"v-{uuid.uuid4().hex}"
        df.select(*self.kind.fieldNames()).withColumn("__b", self._bucket()).repartition("__b").write.partitionBy("__b").parquet(f"{self.path}/{v}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{v}")
        names = [s.getPath().getName() for s in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        return v, [n.split("=", 1)[1] for n in names if n.startswith("__b=")]

    def _rewrite(self, touched: Sequence[str], change) -> None:
        """The touched buckets replaced by change(their rows), all others left as they lie."""
        turn, held = self.manifest()
        v, full = self._written(change(self._read(held, touched)))
        kept = {b: vs for b, vs in held.items() if b not in set(touched)}
        for b in full:
            kept[b] = kept.get(b, []) + [v]
        self._commit(turn + 1, kept)

    def append(self, df: DataFrame) -> None:
        """Rows beside those that are there; nothing is rewritten."""
        self._rewrite([], lambda _: df)

    def upsert(self, df: DataFrame) -> None:
        """Rows of `df` replace those of the same key; of several the last in `df`'s own order is undefined, so keys must be unique."""
        rows = df.select(*self.kind.fieldNames())
        self._rewrite(self._touched(rows), lambda old: upserted(old, rows, self.key))

    def update(self, changes: DataFrame) -> None:
        """Non-null values of `changes` (key and some columns) replace those of the same key; unknown keys are ignored."""
        self._rewrite(self._touched(changes), lambda old: updated(old, changes, self.key))

    def delete(self, keys: DataFrame) -> None:
        self._rewrite(self._touched(keys), lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def replace(self, df: DataFrame, where: str) -> None:
        """What fulfils `where` is replaced by df, in one step."""
        touched = self._touched(self.read().where(where))
        self._rewrite(touched, lambda old: old.where(f"not coalesce({where}, false)").unionByName(df.select(*self.kind.fieldNames())))

    def compact(self) -> None:
        """Every bucket in one directory."""
        self._rewrite(list(self.manifest()[1]), lambda old: old)

    def count(self, where: str | None = None) -> int:
        rows = self.read()
        return (rows.where(where) if where else rows).count()

    def get(self, ids: Sequence) -> DataFrame:
        return ordered_lookup(self.read(), ids, self.key)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def updated(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    fresh = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in changes.columns if c != key])
    return old.join(fresh, key, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in old.columns])


def ordered_lookup(df: DataFrame, ids: Sequence, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, key, found, columns): one row per asked id in the asked order; missing ones have nulls. The first row of a key counts."""
    kind = df.schema[key].dataType
    asked = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], T.StructType([T.StructField("position", T.IntegerType()), T.StructField(key, kind)]))
    keep = [c for c in (columns or df.columns) if c != key]
    hit = df.join(F.broadcast(asked.select(key).distinct()), key, "left_semi") if len(ids) <= 80_000 else df.join(asked.select(key).distinct(), key, "left_semi")
    one = hit.select(key, *keep).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).cast("string") for c in keep if not isinstance(df.schema[c].dataType, T.ArrayType)] or [F.lit(0)]))).where("__n = 1").drop("__n").withColumn("found", F.lit(True))
    return asked.join(one, key, "left").select("position", key, F.coalesce("found", F.lit(False)).alias("found"), *keep).orderBy("position")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The last row of each key by the given descending order, which must end in something unique to be repeatable."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def read_jsonl(spark: SparkSession, path: str, kind: str | T.StructType) -> DataFrame:
    """JSON lines with a declared schema; a missing path is an empty table."""
    s = schema(kind) if isinstance(kind, str) and kind in SCHEMAS else kind
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) is None:
        return spark.createDataFrame([], s if isinstance(s, T.StructType) else T.StructType.fromDDL(s))
    return spark.read.schema(s).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_texts(spark: SparkSession, path: str, suffixes: Sequence[str] = (".txt", ".xml", ".json", ".md")) -> DataFrame:
    """(source_id, path, text): whole files of the wanted kinds; the id is the file's stem."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*{" + ",".join(suffixes) + "}", recursiveFileLookup=True).select(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("source_id"), "path", "text")


def read_papers(spark: SparkSession, xml_path: str, md_path: str, journals: DataFrame | None = None) -> DataFrame:
    """(paper_id, journal, reasoning_xml, paper_md): papers of which both files are there and not blank; ids with %2F are read as /."""
    xml = read_texts(spark, xml_path, (".xml",)).select(F.replace(F.regexp_replace("source_id", "_reasoning_chain$", ""), F.lit("%2F"), F.lit("/")).alias("paper_id"), F.col("text").alias("reasoning_xml"))
    md = read_texts(spark, md_path, (".md",)).select(F.replace("source_id", F.lit("%2F"), F.lit("/")).alias("paper_id"), F.col("text").alias("paper_md"))
    both = xml.join(md, "paper_id").where("trim(reasoning_xml) != '' and trim(paper_md) != ''")
    if journals is None:
        return both.select("paper_id", F.lit("Unknown").alias("journal"), "reasoning_xml", "paper_md")
    return both.join(journals.select("paper_id", "journal"), "paper_id", "left").select("paper_id", F.coalesce("journal", F.lit("Unknown")).alias("journal"), "reasoning_xml", "paper_md")


def listed_ids(spark: SparkSession, path: str, suffix: str, limit: int | None = None) -> DataFrame:
    """(paper_id): ids of the files with a suffix, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", f"([^/]+){re.escape(suffix)}$", 1).alias("paper_id")).orderBy("paper_id")
    return files.limit(limit) if limit else files


def workflow_directories(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """(directory): those named cluster_* that hold all the required files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("directory"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    return files.where(F.startswith(F.col("directory"), F.lit("cluster_")) & F.col("file").isin(*required)).groupBy("directory").agg(F.count_distinct("file").alias("n")).where(F.col("n") == len(set(required))).select("directory")


def journal_config(path: str, domain: str) -> list[str]:
    """The journals of a domain; an unknown domain or an empty list is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    if domain not in config:
        raise ValueError(f"unknown domain {domain}")
    journals = (config[domain] or {}).get("journals") or []
    if not journals:
        raise ValueError(f"no journals for {domain}")
    return list(journals)


def save_id_list(path: str, domain: str, journals: Sequence[str], ids: Sequence[str], counts: dict[str, int], now: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"domain": domain, "journals": list(journals), "created_at": now, "total_count": len(ids), "per_journal_count": counts, "paper_ids": list(ids)}, f, ensure_ascii=False, indent=2)


def load_id_list(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["paper_ids"]


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, change): what is new or differs after; what is gone isn't told."""
    old = before.select(key, F.struct(*values).alias("was"))
    new = after.select(key, F.struct(*values).alias("is"))
    return new.join(old, key, "left").select(key, F.when(F.col("was").isNull(), "new").when(~F.col("is").eqNullSafe(F.col("was")), "changed").alias("change")).where("change is not null")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a digest of key and seed, the same for every run, partitioning and engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def journal_ids(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """(paper_id, journal): each paper of the wanted journals once."""
    return papers.select("paper_id", "journal").where("paper_id is not null").join(F.broadcast(journals.select("journal").distinct()), "journal", "left_semi").distinct()


def cluster_chains(chains: DataFrame, domain: str, cluster: int) -> DataFrame:
    """All columns but the vector of one cluster's chains."""
    return chains.where((F.col("domain") == domain) & (F.col("cluster_id") == cluster)).drop("vector")


def numbered_names(rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """rows with `unique_name`: further rows of one name get _1, _2 and so on, in the given order."""
    turn = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return rows.withColumn("unique_name", F.when(turn == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), turn.cast("string"))))
