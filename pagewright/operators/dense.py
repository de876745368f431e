"""Exact dense search of a stated set of questions, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PART = 50_000


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def knn(vectors: DataFrame, questions: DataFrame, k: int = 60, metric: str = "l2") -> DataFrame:
    """query_id, id, distance (6 digits), rank (from 0) of the nearest vectors (id, vec) for each question (query_id, vec).

    metric: l2 (squared Euclidean) or cosine (1 - cosine). Vectors are dealt to
    parts of bounded size; each part meets the questions in blocks and keeps its
    k nearest, of which the k nearest remain.
    """
    vectors = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).dropna()
    questions = questions.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).dropna()
    parts = max(1, -(-vectors.count() // ROWS_PER_PART))
    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts).cast("bigint")))
    asked = questions.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))

    def meet(left, right):
        out_q, out_i, out_d = [], [], []
        x, q = _matrix(left.column("vec")), _matrix(right.column("vec"))
        ids, names = left.column("id").to_numpy(), right.column("query_id").to_numpy()
        if len(x) and len(q):
            if metric == "cosine":
                x, q = (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12) for m in (x, q))
            for i in range(0, len(q), 16):
                block = q[i : i + 16]
                if metric == "cosine":
                    d = 1 - block @ x.T
                else:
                    d = np.concatenate([((block[:, None, :] - x[None, j : j + 2048, :]) ** 2).sum(axis=2) for j in range(0, len(x), 2048)], axis=1)
                for row, name in zip(np.round(d, 6), names[i : i + 16], strict=True):
                    near = np.lexsort((ids, row))[:k]
                    out_q.append(np.full(len(near), name))
                    out_i.append(ids[near])
                    out_d.append(row[near])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
        return pa.table({"query_id": join(out_q, np.int64), "id": join(out_i, np.int64), "distance": join(out_d, np.float64)})

    found = dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lambda a, b: meet(a, b), "query_id bigint, id bigint, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
