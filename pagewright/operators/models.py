"""Slots for models: embedder, reranker, query expander. Each takes a plain function; the defaults are deterministic stand-ins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_strings

Embed = Callable[[list[str]], list]
Score = Callable[[str, list[str]], list]
DIMENSIONS = 64
# Fixed value: characters of a document that a reranker sees.
RERANKED_CHARS = 2000


def hashed_embedding(texts: list[str], dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """Signed counts of hashed words, of length one; a text without words has zeros."""
    out = []
    for text in texts:
        h = np.array([zlib.crc32(w.encode()) for w in "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in text.lower()).split()], np.int64)
        v = np.bincount(h % dimensions, np.where(h >> 16 & 1, 1.0, -1.0), dimensions) if len(h) else np.zeros(dimensions)
        out.append((v / (np.linalg.norm(v) + 1e-12)).astype(np.float32))
    return out


def embedding(text: Column, embed: Embed = hashed_embedding, at_once: int = 256) -> Column:
    """array<float> of a text column; the model gets `at_once` texts a call and must give as many vectors."""

    def run(texts: pa.Array) -> pa.Array:
        rows, out = [x or "" for x in texts.to_pylist()], []
        for i in range(0, len(rows), at_once):
            found = embed(rows[i : i + at_once])
            if len(found) != len(rows[i : i + at_once]):
                raise ValueError("the embedder gave another number of vectors than it got texts")
            out += [np.asarray(v, np.float32) for v in found]
        return pa.array(out, pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>").asNondeterministic()(text)


def embedded(rows: DataFrame, text: str, collection: str, routes: dict[str, Embed] | None = None, default: Embed = hashed_embedding) -> DataFrame:
    """rows with vec; collections named in routes have an embedder of their own."""
    parts = [rows.where(F.coalesce(F.col(collection), F.lit("")) == name).withColumn("vec", embedding(F.col(text), e)) for name, e in (routes or {}).items()]
    out = rows.where(~F.coalesce(F.col(collection), F.lit("")).isin(*(routes or {""})) if routes else F.lit(True)).withColumn("vec", embedding(F.col(text), default))
    for part in parts:
        out = out.unionByName(part)
    return out


def rerank_score(question: Column, text: Column, score: Score) -> Column:
    """A model's score of each text for its question; null wherever the model fails, so that the fused order stays."""

    def run(questions: pa.Array, texts: pa.Array) -> pa.Array:
        asked, rows = questions.to_pylist(), [(x or "")[:RERANKED_CHARS] for x in texts.to_pylist()]
        out: list = [None] * len(rows)
        for q in dict.fromkeys(asked):
            at = [i for i, x in enumerate(asked) if x == q]
            try:
                found = score(q or "", [rows[i] for i in at])
                for i, s in zip(at, found, strict=True):
                    out[i] = float(s)
            except Exception:  # noqa: BLE001  a model may fail in any way
                continue
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()(question, text)


def expanded(questions: DataFrame, reply: Column | None = None, most: int = 5) -> DataFrame:
    """question_id, query_id, text: each question and the sub-queries of a model's reply (question_id, text); without a usable reply the question alone.

    query_id numbers the queries of a question from 0; copies of the question don't count.
    """
    found = F.coalesce(json_strings(reply), F.array().cast("array<string>")) if reply is not None else F.array().cast("array<string>")
    some = F.slice(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    queries = F.concat(F.array(F.col("text")), F.filter(some, lambda x: F.lower(x) != F.lower(F.col("text"))))
    return questions.select("question_id", F.posexplode(queries).alias("query_id", "text"))


def described(content: Column, prompt: Column, describe: Callable[[bytes, str], str | None]) -> Column:
    """What a model says of a picture, or makes of a page (bytes and prompt); null for null content and wherever the model fails."""

    def run(contents: pa.Array, prompts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for data, asked in zip(contents, prompts.to_pylist(), strict=True):
            try:
                out.append(describe(data.as_py(), asked or "") if data.is_valid else None)
            except Exception:  # noqa: BLE001  a model may fail in any way; other rows go on
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()(content, prompt)
