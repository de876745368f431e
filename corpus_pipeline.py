"""Curation of a document table: quality, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; all but the last return the columns of documents. Null texts count
as empty; rows keep their null or repeated ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common, packing, quality, secrets, simhash, toxicity

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose labelled neighbours vote for them; the empty text, without neighbours, goes."""
    score = common.unused(docs, "__score")
    found = quality.scores(docs, quality.fit_on(spark, sf_dir), docs.columns, name=score)
    return found.where(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold."""
    score = common.unused(docs, "__score")
    found = toxicity.scores(docs, toxicity.fit_on(spark, sf_dir), docs.columns, name=score)
    return found.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints that ball hashing connects and bands of least hashes, then five-word shingles, similarity 0.8."""
    return simhash.without_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; n_chars follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    names = common.unused(docs, "__masked"), common.unused(docs, "__marks")
    found = secrets.mask_secrets(docs, rest, "text", names=names)
    text, size = F.col(names[0]), F.length(names[0]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(packing.token_pieces(docs, added=True))


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_dedup", near_dedup), ("secrets", mask_secrets), ("packing", pack)]

#: Classifiers, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
