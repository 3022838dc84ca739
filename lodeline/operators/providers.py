"""Pluggable embedding and completion: protocols, offline defaults, and their use over partitions."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMBED_CHARS = 8000


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed hashing of words into `dim` values of unit length: offline, the same everywhere."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1)
        return out / np.where(n == 0, 1, n)[:, None]


def in_order(response: list[dict]) -> list[list[float]]:
    """Embeddings of a response in the order of their index."""
    return [r["embedding"] for r in sorted(response, key=lambda r: r["index"])]


def retried(call: Callable, times: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call with exponential, jittered waits between attempts; the last error is raised."""

    def run(*args):
        for a in range(times):
            try:
                return call(*args)
            except Exception:
                if a == times - 1:
                    raise
                sleep(base * 2**a + random.uniform(0, base))

    return run


def embed(rows: DataFrame, text: str, embedder: Embedder, key: str, batch: int = 64) -> DataFrame:
    """(key, vector, error): texts cut at EMBED_CHARS characters, batch by batch; a failing batch is tried one by one."""
    rows = rows.select(F.col(key), F.left(F.coalesce(F.col(text), F.lit("")), F.lit(EMBED_CHARS)).alias("__t"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = retried(embedder, sleep=lambda s: time.sleep(min(s, 4)))
        for b in batches:
            texts, vs, errors = b.column("__t").to_pylist(), [], []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    vs += [v.tolist() for v in call(part)]
                    errors += [None] * len(part)
                except Exception:
                    for t in part:
                        try:
                            vs.append(embedder([t])[0].tolist())
                            errors.append(None)
                        except Exception as e:
                            vs.append(None)
                            errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vs, pa.list_(pa.float32())), pa.array(errors, pa.string())], [key, "vector", "error"])

    return rows.mapInArrow(run, f"`{key}` {kind}, vector array<float>, error string")


def vectorised_increment(chains: DataFrame, existing: DataFrame, embedder: Embedder, domain: str, key: str = "chain_id") -> DataFrame:
    """Rows for the vector table of the chains that it doesn't hold yet; of a repeated key the last by text counts."""
    from pyspark.sql.window import Window

    fresh = chains.join(existing.where(F.col("domain") == domain).select(key).distinct(), key, "left_anti")
    fresh = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("full_text")))).where("__n = 1").drop("__n")
    vectors = embed(fresh, "full_text", embedder, key)
    return fresh.join(vectors.where("vector is not null"), key).withColumn("domain", F.lit(domain)).drop("full_text", "error")


class Completer(Protocol):
    def __call__(self, prompt: str) -> str: ...


def complete(rows: DataFrame, prompt: str, completer: Completer, key: str, times: int = 3) -> DataFrame:
    """(key, answer, error): one completion per row, retried; failures keep their row."""
    rows = rows.select(F.col(key), F.col(prompt).alias("__p"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = retried(completer, times, sleep=lambda s: time.sleep(min(s, 4)))
        for b in batches:
            answers, errors = [], []
            for p in b.column("__p").to_pylist():
                try:
                    answers.append(None if p is None else call(p))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], [key, "answer", "error"])

    return rows.mapInArrow(run, f"`{key}` {kind}, answer string, error string")


def parsed_answer(answer: str | None, required: Sequence[str] = (), default: dict | None = None) -> dict | None:
    """A JSON object out of an answer: as it is, out of a fence, or from the outermost braces; the default if a required key lacks."""
    tries = [answer or ""]
    if m := re.search(r"```\w*\s*\n(.*?)```", answer or "", re.S):
        tries.append(m.group(1))
    if m := re.search(r"\{.*\}", answer or "", re.S):
        tries += [m.group(), re.sub(r"\\(?![\"\\/bfnrtu])", r"\\\\", m.group())]
    for t in tries:
        try:
            got = json.loads(t)
        except ValueError:
            continue
        if isinstance(got, dict) and all(k in got for k in required):
            return got
    return default


def verdict(answer: str | None) -> str:
    """A, B or TIE out of an answer."""
    got = parsed_answer(answer, default={})
    v = str(got.get("better", "")).strip().upper()
    return v if v in ("A", "B") else "TIE"


def valid_code(code: str | None, function: str = "execute_workflow") -> bool:
    """Whether code parses and defines the function."""
    import ast

    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return False
    return any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == function for n in ast.walk(tree))


def contract_errors(value, contract: dict, path: str = "$") -> list[str]:
    """Sorted violations of a JSON contract: types, required keys, enumerations, patterns, bounds and items."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool}
    out = []
    want = contract.get("type")
    if want and (not isinstance(value, kinds[want]) or isinstance(value, bool) and want in ("number", "integer")):
        return [f"{path}: not of type {want}"]
    if "enum" in contract and value not in contract["enum"]:
        out.append(f"{path}: {value!r} is not allowed")
    if "pattern" in contract and isinstance(value, str) and not re.search(contract["pattern"], value):
        out.append(f"{path}: doesn't match {contract['pattern']}")
    for bound, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b)):
        if bound in contract and isinstance(value, (int, float)) and bad(value, contract[bound]):
            out.append(f"{path}: beyond {bound} {contract[bound]}")
    if isinstance(value, dict):
        out += [f"{path}.{k}: missing" for k in contract.get("required", ()) if k not in value]
        for k, sub in contract.get("properties", {}).items():
            if k in value:
                out += contract_errors(value[k], sub, f"{path}.{k}")
    if isinstance(value, list) and "items" in contract:
        for i, v in enumerate(value):
            out += contract_errors(v, contract["items"], f"{path}[{i}]")
    return sorted(out)
