"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Index: equal vectors become one node. Leaves of random hyperplanes (of bounded
size) give each node first neighbours; then every node introduces its
neighbours, in both directions, to each other, and whoever is closer than a
node's farthest neighbour replaces it. The introductions are Spark joins of
neighbours of neighbours, computed in numpy blocks, until few change.

Search: a query starts from its nearest pivots (a bounded, broadcast sample of
nodes) and repeatedly expands the nearest unexpanded nodes of its beam along
the graph, until the beam has none. Distances of the result are computed anew
in double precision on the original vectors.

exact() holds the same queries against all rows, to measure recall.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, as query or candidate; vectors of different lengths
have no distance, so that each length has a graph of its own; ties go to the
smaller id; of repeated ids each row counts as a candidate; a query with fewer
candidates than asked for gets them all; empty tables give empty results.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Settings:
    """degree: neighbours kept, and so the most that one introduction can add; leaves: forests of the start; leaf: most nodes of a leaf; rounds, hops: beyond which it is an error not to have ended; pivots: at least, as they grow with the root of the table."""

    degree: int = 20
    leaves: int = 12
    leaf: int = 1000
    rounds: int = 100
    enough: float = 0.005
    pivots: int = 512
    beam: int = 384
    expand: int = 96
    hops: int = 1000


SETTINGS = Settings()
#: Distances between guests that a task holds at once.
MET_AT_ONCE = 1 << 20


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec array<double> of the rows that take part."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    return rows.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")


def nodes_of(rows: DataFrame, most: int) -> DataFrame:
    """node (smallest id of equal vectors), vec, members: the `most` smallest ids, which are all that `most` - 1 results can need."""
    order = Window.partitionBy("vec").orderBy("id")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("node"), "vec", "members")


def matrix(column: pa.Array) -> np.ndarray:
    """[row, component] of a column of equally long arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def squared(x: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of each matrix of a stack."""
    n = (x * x).sum(axis=-1)
    return np.maximum(n[..., :, None] + n[..., None, :] - 2 * (x @ np.swapaxes(x, -1, -2)), 0)


def _rows(node, nbr, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(nbr, pa.int64()), pa.array(d, pa.float64())], names=["node", "nbr", "d"])


_EDGE = "node bigint, nbr bigint, d double"


def nearest(edges: DataFrame, most: int, key: str = "node", other: str = "nbr") -> DataFrame:
    order = Window.partitionBy(key).orderBy("d", other)
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def first_edges(vectors: DataFrame, count: int, s: Settings) -> DataFrame:
    """Neighbours within leaves: nodes on the same side of random hyperplanes, large leaves split at random."""
    bits = max(0, int(np.ceil(np.log2(max(1, 2 * count / s.leaf)))))

    def coded(batches):
        for batch in batches:
            x = matrix(batch.column("vec"))
            for t in range(s.leaves):
                planes = np.random.default_rng(100 + t).standard_normal((x.shape[1], bits)).astype(np.float32)
                code = (((x - x.mean(axis=1, keepdims=True)) @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(batch), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(batch), pa.int32()), pa.array(code, pa.int64()), batch.column("node"), batch.column("vec")], names=["tree", "code", "node", "vec"])

    def joined(table):
        node, x = table.column("node").to_numpy(), matrix(table.column("vec").combine_chunks())
        d = squared(x)
        np.fill_diagonal(d, np.inf)
        k = min(s.degree, len(node) - 1)
        if k < 1:
            return pa.table({"node": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        return pa.Table.from_batches([_rows(np.repeat(node, k), node[near].ravel(), np.take_along_axis(d, near, axis=1).ravel())])

    coded_rows = vectors.select("node", F.col("vec").cast("array<float>").alias("vec")).mapInArrow(coded, "tree int, code bigint, node bigint, vec array<float>")
    sizes = coded_rows.groupBy("tree", "code").count()
    leaves = coded_rows.join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("count") / s.leaf)))
    found = leaves.select("tree", "code", "part", "node", "vec").groupBy("tree", "code", "part").applyInArrow(joined, _EDGE)
    return nearest(found.groupBy("node", "nbr").agg(F.min("d").alias("d")), s.degree)


def introduced(known: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """Pairs of neighbours of one node that are closer than the first one's farthest neighbour."""
    worst = known.groupBy("node").agg(F.when(F.count("*") >= s.degree, F.max("d")).otherwise(float("inf")).alias("worst"))
    near = known.select("node", "nbr").union(known.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()
    guests = vectors.select(F.col("node").alias("nbr"), F.col("vec").cast("array<float>").alias("vec")).join(worst.withColumnRenamed("node", "nbr"), "nbr")
    met = near.join(guests, "nbr").select("node", "nbr", "worst", "vec").repartition("node").sortWithinPartitions("node")

    def meet(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            host = table.column("node").to_numpy()
            cut = int(np.searchsorted(host, host[-1])) if len(host) else 0
            held = table.slice(cut)
            yield from blocks(table.slice(0, cut))
        if held is not None:
            yield from blocks(held)

    def blocks(table):
        host = table.column("node").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(host, prepend=host[:1] - 1)), len(host))
        sizes, i = np.diff(edges), 0
        while i < len(sizes):
            j = i + 1
            while j < len(sizes) and (j + 1 - i) * int(sizes[i : j + 1].max()) ** 2 <= MET_AT_ONCE:
                j += 1
            part = table.slice(edges[i], edges[j] - edges[i]).combine_chunks()
            if sizes[i] ** 2 > MET_AT_ONCE:
                yield from hub(part)
            else:
                yield block(part, edges[i : j + 1] - edges[i])
            i = j

    def hub(table):
        """block() for the one host of many guests, some guests at a time."""
        guest, bound, x = table.column("nbr").to_numpy(), table.column("worst").to_numpy(), matrix(table.column("vec").combine_chunks())
        n, k, step = (x * x).sum(axis=1), min(s.degree, len(guest)), max(1, MET_AT_ONCE // len(guest))
        for i in range(0, len(guest), step):
            d = np.maximum(n[i : i + step, None] + n[None, :] - 2 * (x[i : i + step] @ x.T), 0)
            d[(guest[i : i + step, None] == guest[None, :]) | (d >= bound[i : i + step, None])] = np.inf
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(d, best, axis=1)
            a, b = np.nonzero(np.isfinite(value))
            yield _rows(guest[i + a], guest[best[a, b]], value[a, b])

    def block(table, edges):
        sizes = np.diff(edges)
        group = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(group)) - edges[:-1][group]
        m = int(sizes.max())
        guest = np.full((len(sizes), m), -1, np.int64)
        guest[group, place] = table.column("nbr").to_numpy()
        bound = np.full((len(sizes), m), -np.inf)
        bound[group, place] = table.column("worst").to_numpy()
        vec = matrix(table.column("vec").combine_chunks())
        x = np.zeros((len(sizes), m, vec.shape[1]), np.float32)
        x[group, place] = vec
        d = squared(x)
        d[(guest[:, :, None] == guest[:, None, :]) | (guest[:, None, :] < 0) | (d >= bound[:, :, None])] = np.inf
        k = min(s.degree, m)
        best = np.argpartition(d, k - 1, axis=2)[:, :, :k]
        value = np.take_along_axis(d, best, axis=2)
        g, a, b = np.nonzero(np.isfinite(value))
        return _rows(guest[g, a], guest[g, best[g, a, b]], value[g, a, b])

    return met.mapInArrow(meet, _EDGE)


def build(vectors: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(node, nbr, d): the neighbour graph of vectors (node, vec)."""
    count = vectors.count()
    known = common.stored(first_edges(vectors, count, s), "graph")
    for _ in range(s.rounds):
        offers = introduced(known, vectors, s).groupBy("node", "nbr").agg(F.min("d").alias("d"), F.lit(1).alias("new"))
        both = offers.unionByName(known.withColumn("new", F.lit(0))).groupBy("node", "nbr").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        better = common.stored(nearest(both, s.degree), "graph")
        changed = better.agg(F.sum("new")).collect()[0][0] or 0
        common.dropped(known)
        known = better.drop("new")
        if changed <= s.enough * count * s.degree:
            break
    else:
        raise RuntimeError(f"the graph still changes after {s.rounds} rounds")
    return known


def distance(a: str, b: str):
    """Euclidean distance of two array columns in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(query, node, d): the beam of each query (query, vec) at the end of the greedy search."""
    spark = vectors.sparkSession
    sample = vectors.select("node", "vec").orderBy(F.xxhash64("node")).limit(max(s.pivots, 4 * math.isqrt(vectors.count()))).collect()
    ids, points = np.array([r[0] for r in sample], np.int64), np.array([r[1] for r in sample], np.float64)
    sent = spark.sparkContext.broadcast((ids, points))

    def start(batches):
        ids, points = sent.value
        k = min(s.beam, len(ids))
        for batch in batches:
            x, q = matrix(batch.column("vec")).astype(np.float64), batch.column("query").to_numpy()
            for i in range(0, len(q) if k else 0, 256):
                d = np.sqrt(np.maximum((x[i : i + 256] ** 2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * x[i : i + 256] @ points.T, 0))
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                part = _rows(np.repeat(q[i : i + 256], k), ids[near].ravel(), np.take_along_axis(d, near, axis=1).ravel())
                yield part.rename_columns(["query", "node", "d"])

    ways = common.stored(graph.select("node", "nbr").union(nearest(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "d"), s.degree).select("node", "nbr")).distinct(), "ways")
    beam = queries.select("query", "vec").mapInArrow(start, "query bigint, node bigint, d double").withColumn("done", F.lit(False))
    beam = common.stored(beam, "beam")
    for _ in range(s.hops):
        turn = Window.partitionBy("query", "done").orderBy("d", "node")
        marked = beam.withColumn("turn", F.row_number().over(turn)).withColumn("go", ~F.col("done") & (F.col("turn") <= s.expand))
        marked = common.stored(marked.select("query", "node", "d", "done", "go"), "marked")
        step = marked.where("go").select("query", "node").join(ways, "node").select("query", F.col("nbr").alias("node")).distinct()
        fresh = step.join(marked.select("query", "node"), ["query", "node"], "left_anti")
        far = fresh.join(vectors.select("node", F.col("vec").alias("there")), "node").join(queries.select("query", "vec"), "query")
        found = far.select("query", "node", distance("vec", "there").alias("d"), F.lit(False).alias("done"))
        old = marked.select("query", "node", "d", (F.col("done") | F.col("go")).alias("done"))
        grown = common.stored(nearest(old.unionByName(found), s.beam, "query", "node"), "beam")
        common.dropped(beam)
        common.dropped(marked)
        beam = grown
        if not beam.where("not done").limit(1).count():
            break
    else:
        raise RuntimeError(f"searches go on after {s.hops} hops")
    return beam.select("query", "node", "d")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score of the k nearest rows found (query_id, id, d)."""
    order = Window.partitionBy("query_id").orderBy("d", "id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "id", F.col("d").alias("score")).where(F.col("rank") <= k)


def for_each_length(rows: DataFrame, queries: DataFrame, k: int, search) -> DataFrame:
    """search(rows, queries, k) of the vectors of each length that a query has."""
    lengths = [r["n"] for r in queries.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]
    of = lambda df, n: df.where(F.size("vec") == n)
    found = [search(of(rows, n), of(queries, n), k) for n in lengths]
    return functools.reduce(DataFrame.unionByName, found) if found else ranked(rows.selectExpr("id as query_id", "id", "0D as d").limit(0), k)


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, s: Settings = SETTINGS) -> DataFrame:
    """query_id, rank, id, score of the k nearest rows (id, vec) found for each query (id, vec), its own id left out."""
    return for_each_length(rows, queries, k, lambda *x: found_for(*x, s))


EXACT_ROWS = 50_000


def exact(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """nearest_neighbours() by holding the stated queries against all rows, in blocks of both."""
    return for_each_length(rows, queries, k, held_against_all)


def held_against_all(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """exact() of vectors of one length."""
    parts = max(1, -(-rows.count() // EXACT_ROWS))
    dealt = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    asked = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("asked"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))

    def wide(column):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def met(left, right):
        ids, x, names, q = left.column("id").to_numpy(), wide(left.column("vec")), right.column("query_id").to_numpy(), wide(right.column("asked"))
        out = []
        for name, v in zip(names.tolist(), q, strict=True):
            d = np.sqrt(np.concatenate([((x[i : i + 4096] - v) ** 2).sum(axis=1) for i in range(0, len(x), 4096)]))
            d[ids == name] = np.inf
            best = np.lexsort((ids, d))[:k]
            best = best[np.isfinite(d[best])]
            out.append(_rows(np.full(len(best), name), ids[best], d[best]).rename_columns(["query_id", "id", "d"]))
        return pa.Table.from_batches(out)

    def meet(left, right):
        if len(left) and len(right):
            return met(left, right)
        return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})

    found = dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(meet, "query_id bigint, id bigint, d double")
    near = ranked(found, k).select("query_id", "id").distinct()
    ends = near.join(rows.withColumnRenamed("vec", "there"), "id").join(queries.select(F.col("id").alias("query_id"), "vec").dropDuplicates(["query_id"]), "query_id")
    return ranked(ends.select("query_id", "id", distance("vec", "there").alias("d")), k)


def found_for(rows: DataFrame, queries: DataFrame, k: int, s: Settings) -> DataFrame:
    """nearest_neighbours() of vectors of one length."""
    nodes = common.stored(nodes_of(rows, k + 1), "nodes")
    graph = build(nodes, s)
    asked = common.stored(queries.groupBy("vec").agg(F.min("id").alias("query")), "asked")
    beam = search(asked, nodes, graph, s)
    near = beam.join(nodes, "node").join(asked.withColumnRenamed("vec", "asked"), "query").select("query", distance("asked", "vec").alias("d"), F.explode("members").alias("id"))
    near = common.stored(nearest(near, k + 1, "query", "id"), "near")
    each = queries.select(F.col("id").alias("query_id"), "vec").join(asked, "vec").select("query_id", "query")
    return ranked(each.join(near, "query").where("id <> query_id"), k)


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.stored(usable(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    found = nearest_neighbours(rows, rows.where("id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
