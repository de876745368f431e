"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Terms are words, their stems (first STEM bytes), neighbouring pairs and pairs
with one word between, hashed into 2^bits places; a text has a term or not. Per-coordinate rates and an L1
penalty leave few weights, which are broadcast as (place, weight) pairs.

Fitting uses at most max_rows labelled texts (a documented bound), outside the
held-out fold. Scoring covers every row and the whole text. Defined cases: null
and empty texts get the score of a text without terms; without labels all
scores are 0.5; repeated rows and null ids give a row each.
"""

from __future__ import annotations

import io
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, terms


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    max_rows: int = 8000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.2
    positive: float = 4.0  # times that an error on a toxic text counts


SETTINGS = Settings()
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
STEM = 4


def places(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, text number) of all terms, with repeats."""
    words, owner = terms.hashed_words(texts)
    stems, _ = terms.hashed_words(texts, longest=STEM)
    found = [(words, owner), (terms.mix(stems + np.uint64(9)), owner), terms.pairs(words, owner, 1), terms.pairs(words, owner, 2)]
    shift = np.uint64(64 - bits)
    return np.concatenate([(h >> shift).astype(np.int64) for h, _ in found]), np.concatenate([o for _, o in found])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: Sequence[bytes], labels: list[int], s: Settings = SETTINGS) -> bytes:
    """Train, one text after another in a fixed random order; returns the bias and the non-zero weights.

    The texts' places wait in a temporary file: memory doesn't grow with the length of the texts.
    """
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    held, ends = tempfile.TemporaryFile(), [0]
    for t in texts:
        held.write(np.append(np.unique(places([t], s.bits)[0]), size).astype(np.int32).tobytes())  # the last place is the bias
        ends.append(held.tell())

    def row(i):
        held.seek(ends[i])
        return np.frombuffer(held.read(ends[i + 1] - ends[i]), np.int32)

    def weights(z, n):
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(ends) - 1):
            at = row(i)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            w[-1] = -zi[-1] / ((s.beta + np.sqrt(ni[-1])) / s.alpha)  # no penalty on the bias
            g = (sigmoid(w.sum()) - labels[i]) * (s.positive if labels[i] else 1.0)
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(n[at]) - np.sqrt(ni)) / s.alpha * w
    w = weights(z, n)
    bias = -z[-1] / ((s.beta + np.sqrt(n[-1])) / s.alpha)
    kept = np.flatnonzero(w[:-1])
    out = io.BytesIO()
    np.savez_compressed(out, bits=s.bits, bias=bias, place=kept.astype(np.int32), weight=w[kept].astype(np.float32))
    return out.getvalue()


class Scorer:
    def __init__(self, model: bytes):
        m = np.load(io.BytesIO(model))
        self.bits, self.bias = int(m["bits"]), float(m["bias"])
        self.weight = np.zeros(1 << self.bits, dtype=np.float32)
        self.weight[m["place"]] = m["weight"]

    def score(self, texts: list[bytes]) -> np.ndarray:
        place, owner = places(texts, self.bits)
        used = self.weight[place] != 0
        once = np.unique(owner[used] << self.bits | place[used])
        return sigmoid(self.bias + np.bincount(once >> self.bits, self.weight[once & ((1 << self.bits) - 1)], len(texts)))


def scores(df: DataFrame, model: bytes, keep: str | list[str] = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and the score under this name, the probability of label 1."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def work(texts):
        if not held:
            held.append(Scorer(sent.value))
        return [held[0].score(texts)]

    return common.map_texts(df, keep, text_col, f"`{name}` double", work, 1 << 20)


def fit_on(spark: SparkSession, sf_dir: str, s: Settings = SETTINGS) -> bytes:
    sample = common.labelled_sample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), "toxic", FOLDS, HELD_OUT, s.max_rows)
    return common.fitted(sample, lambda texts, y: fit(texts, y, s))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(common.table(spark, sf_dir, "documents"), fit_on(spark, sf_dir))
    return found.select("doc_id", (common.fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
