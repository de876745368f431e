"""Retrieval evaluation: hits, citations, run deltas, IR metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, hit, hit_rank, matched: results (query_id, rank from 1, file) hold one of the expected parts (query_id, parts), in any case."""
    held = lambda p: F.contains(F.lower("file"), F.lower(p))
    found = results.join(expected, "query_id").withColumn("held", F.filter("parts", held)).where(F.size("held") > 0)
    ranks = found.groupBy("query_id").agg(F.min("rank").alias("hit_rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("held")))).alias("matched"))
    rows = expected.select("query_id").distinct().join(ranks, "query_id", "left")
    return rows.select("query_id", F.col("hit_rank").isNotNull().alias("hit"), "hit_rank", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


def top_files(results: DataFrame, most: int = 3) -> DataFrame:
    """query_id, files: those of the first results, in order."""
    first = results.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file"))).alias("x"))
    return first.select("query_id", F.col("x.file").alias("files"))


def cited_hits(citations: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, hit, matched, cited: expected parts (query_id, parts) that a cited file (query_id, file, with / as __) contains, in any case."""
    files = citations.groupBy("query_id").agg(F.array_sort(F.collect_list(F.replace(F.coalesce("file", F.lit("")), F.lit("__"), F.lit("/")))).alias("cited"))
    none = F.array().cast("array<string>")
    rows = expected.join(files, "query_id", "left").withColumn("cited", F.coalesce("cited", none))
    matched = F.array_sort(F.array_distinct(F.filter("parts", lambda p: F.exists("cited", lambda c: F.contains(F.lower(c), F.lower(p))))))
    return rows.select("query_id", (F.size(matched) > 0).alias("hit"), matched.alias("matched"), "cited")


def delta_counts(deltas: DataFrame) -> DataFrame:
    """One row: fixed, regressed, fresh and how many there are."""
    return deltas.agg(F.count_if(F.col("delta") == "FIXED").alias("fixed"), F.count_if(F.col("delta") == "REGRESSED").alias("regressed"), F.count_if(F.col("delta") == "new").alias("fresh"), F.count("*").alias("n"))


def hit_summary(hits: DataFrame) -> DataFrame:
    """n, hits, top1, top3 and the whole percentage of hits, rounded down."""
    n = F.count("*")
    return hits.agg(n.alias("n"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit_rank") <= 1).alias("top1"), F.count_if(F.col("hit_rank") <= 3).alias("top3"), F.floor(100 * F.count_if("hit") / F.greatest(n, F.lit(1))).alias("percent"))


def citations_pass(citations, rules, must_abstain, answer, abstain: str):
    """Whether an answer passes: every rule has a citation that contains its file and section parts (any case), or it abstains as it must."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    met = F.forall(rules, lambda r: F.exists(citations, lambda c: F.contains(low(c["file"]), low(r["file"])) & F.contains(low(c["section"]), low(r["section"]))))
    return F.when(must_abstain, F.trim(answer).startswith(abstain)).otherwise(met)


def run_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """id, delta: FIXED, REGRESSED, stable+, stable- or new."""
    b = before.select("id", F.col("passed").alias("was"))
    delta = F.when(F.col("was").isNull(), "new").when(F.col("passed") & ~F.col("was"), "FIXED").when(~F.col("passed") & F.col("was"), "REGRESSED").when(F.col("passed"), "stable+").otherwise("stable-")
    return now.join(b, "id", "left").select("id", "passed", delta.alias("delta"))


def upper_median(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, median: the element number floor(n / 2) of the sorted values, counted from 0."""
    n = Window.partitionBy(*keys)
    placed = rows.withColumns({"__n": F.count("*").over(n), "__i": F.row_number().over(n.orderBy(F.col(value).asc_nulls_last())) - 1})
    return placed.where(F.col("__i") == F.floor(F.col("__n") / 2)).select(*keys, F.col(value).alias("median"))


def ir_metrics(results: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """cut, ndcg, map, recall, precision, averaged over the queries with relevant items.

    results: query_id, rank from 1, rel (0 or 1); relevant: query_id, n_relevant.
    """
    upto = Window.partitionBy("query_id").orderBy("rank")
    gains = results.withColumn("hits", F.sum("rel").over(upto))
    each = relevant.select("query_id", "n_relevant", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    log2 = lambda c: F.log2(c.cast("double"))
    joined = each.join(gains, (each.query_id == gains.query_id) & (gains["rank"] <= each.cut), "left").select(each["*"], "rank", "rel", "hits")
    scored = joined.groupBy("query_id", "cut", "n_relevant").agg(
        F.coalesce(F.sum(F.col("rel") / log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("ap"),
        F.coalesce(F.sum("rel"), F.lit(0)).alias("found"),
    )
    best = F.least("cut", "n_relevant")
    ideal = F.aggregate(F.sequence(F.lit(1), best.cast("int")), F.lit(0.0), lambda a, i: a + 1 / log2(i + 1))
    return scored.groupBy("cut").agg(
        F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"),
        F.round(F.avg(F.col("ap") / F.col("n_relevant")), 6).alias("map"),
        F.round(F.avg(F.col("found") / F.col("n_relevant")), 6).alias("recall"),
        F.round(F.avg(F.col("found") / F.col("cut")), 6).alias("precision"),
    )
