"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text's terms are its words, the shapes of its space-separated strings
(letters, digits and marks with runs collapsed), and terms for how much repeats:
pairs of equal neighbouring words and the share of distinct word pairs. Hashed
counts are weighted (log count times inverse document frequency), projected
onto the leading singular vectors and set to length one. The labelled vectors
are broadcast (at most max_rows times `rank` floats); every text takes exact
cosines with all of them, in blocks, and its nearest ones vote with their
similarities as weights.

Fitting uses at most max_rows labelled texts (a documented bound), outside the
held-out fold. Defined cases: null and empty texts have no terms: no neighbour
is similar to them and they get the score 0; without labels all scores are
0; repeated rows and null ids give a row each.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, terms

SHAPES, REPEATS, PLACES = 1024, 32, 4096
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20


@dataclass(frozen=True)
class Settings:
    max_rows: int = 4000
    rank: int = 64
    neighbours: int = 15


SETTINGS = Settings()
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def counts(texts: list[bytes]) -> np.ndarray:
    """[text, place]: how often each hashed term occurs."""
    n = len(texts)
    words, owner = terms.hashed_words(texts)
    shapes, shape_owner = terms.hashed_words(texts, terms.SHAPE_BYTES, collapse=True)
    again = owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])]
    both, both_owner = terms.pairs(words, owner, 1)
    order = np.lexsort((both, both_owner))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (both[order][1:] != both[order][:-1]) | (both_owner[order][1:] != both_owner[order][:-1])
    total, distinct = np.bincount(both_owner, minlength=n), np.bincount(both_owner[order][first], minlength=n)
    seen = total > 0
    share = (10 * distinct[seen] // total[seen]).astype(np.int64)
    place = np.concatenate(
        [
            owner * PLACES + SHAPES + REPEATS + (words % np.uint64(PLACES - SHAPES - REPEATS)).astype(np.int64),
            shape_owner * PLACES + (shapes % np.uint64(SHAPES)).astype(np.int64),
            again * PLACES + SHAPES,
        ]
    )
    out = np.bincount(place, minlength=n * PLACES)[: n * PLACES].reshape(n, PLACES).astype(np.float32)
    out[np.flatnonzero(seen), SHAPES + 1 + share] = 20
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(c) * idf)


def leading(a: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    rank = min(rank, *a.shape)
    q = np.random.default_rng(5).standard_normal((a.shape[1], rank + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, v = np.linalg.svd(a @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def fit(texts: Sequence[bytes], labels: list[int], s: Settings = SETTINGS) -> bytes:
    blocks = [counts(x) for x in common.pieces(texts, BYTES_AT_ONCE, ROWS_AT_ONCE)]
    c = np.concatenate(blocks) if blocks else np.zeros((0, PLACES), np.float32)
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))).astype(np.float32) + 1
    a = weighted(c, idf)
    v = leading(a, s.rank) if len(a) else np.zeros((PLACES, 1), np.float32)
    out = io.BytesIO()
    np.savez_compressed(out, idf=idf, v=v, known=unit(a @ v), y=np.array(labels, np.float32), k=s.neighbours)
    return out.getvalue()


class Voter:
    def __init__(self, model: bytes):
        m = np.load(io.BytesIO(model))
        self.idf, self.v, self.known, self.y, self.k = m["idf"], m["v"].astype(np.float64), m["known"].astype(np.float64), m["y"], int(m["k"])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.y):
            return np.zeros(len(texts))
        # In double precision and rounded, so that cosines don't depend on the block; of equal ones the earlier row counts.
        cosines = np.rint(unit(weighted(counts(texts), self.idf).astype(np.float64) @ self.v) @ self.known.T * 1e6)
        k, n = min(self.k, len(self.y)), len(self.y)
        place = cosines.astype(np.int64) * n - np.arange(n)
        near = np.sort(np.argpartition(-place, k - 1, axis=1)[:, :k], axis=1)
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) / 1e6
        total = weight.sum(axis=1)
        return np.clip(np.divide((weight * self.y[near]).sum(axis=1), total, out=np.zeros(len(texts)), where=total > 0), 0, 1)


def scores(df: DataFrame, model: bytes, keep: str | list[str] = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and the score under this name, the weighted share of neighbours with label 1."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    held: list[Voter] = []

    def work(texts):
        if not held:
            held.append(Voter(sent.value))
        return [held[0].score(texts)]

    return common.map_texts(df, keep, text_col, f"`{name}` double", work, BYTES_AT_ONCE, ROWS_AT_ONCE)


def fit_on(spark: SparkSession, sf_dir: str, s: Settings = SETTINGS) -> bytes:
    sample = common.labelled_sample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), "quality", FOLDS, HELD_OUT, s.max_rows)
    return common.fitted(sample, lambda texts, y: fit(texts, y, s))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(common.table(spark, sf_dir, "documents"), fit_on(spark, sf_dir))
    return found.select("doc_id", (common.fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
