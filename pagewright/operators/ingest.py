"""Incremental index maintenance as table-to-table operators: what to do with each file, and the next index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triage(files: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """file, mtime, status (new, changed, unchanged): files (file, mtime) against index rows (file, mtime); times compare as text."""
    known = index.groupBy("file").agg(F.min("mtime").alias("was"), F.lit(True).alias("seen"))
    status = F.when(F.col("seen").isNull(), "new").when(F.lit(force) | ~F.col("was").eqNullSafe(F.col("mtime")), "changed").otherwise("unchanged")
    return files.join(known, "file", "left").select("file", "mtime", status.alias("status"))


def without_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows of none of the files."""
    return index.join(files.select("file").distinct(), "file", "left_anti")


def only_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows of the files; the rest are orphans."""
    return index.join(files.select("file").distinct(), "file", "left_semi")


def upserted(index: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Index rows, those with a fresh row of their key replaced, then the other fresh rows."""
    return index.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def next_index(index: DataFrame, files: DataFrame, chunk, force: bool = False, key: str = "id") -> DataFrame:
    """The index after a run: rows of files that are gone or have changed leave, chunk(changed files) rows come.

    One swap: unlike deleting first, a run that fails leaves the old index.
    """
    found = triage(files, index.select("file", "mtime"), force)
    todo = files.join(found.where("status <> 'unchanged'").select("file"), "file", "left_semi")
    return upserted(only_files(without_files(index, todo), files), chunk(todo), key)


def sidecar_only(sidecars: DataFrame, originals: DataFrame) -> DataFrame:
    """Extracted files without an original."""
    return sidecars.join(originals.select("file"), "file", "left_anti").withColumn("mode", F.lit("sidecar"))


def report(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, total_chunks, skipped, processed."""
    counted = found.join(chunks.groupBy("file").agg(F.count("*").alias("n")), "file", "left")
    return counted.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.when(F.col("status") != "unchanged", F.col("n"))), F.lit(0)).alias("total_chunks"),
        F.count_if(F.col("status") == "unchanged").alias("skipped"),
        F.count_if(F.col("status") != "unchanged").alias("processed"),
    )


def first_times(index: DataFrame, order: str = "id") -> DataFrame:
    """file, mtime: of each file's rows the time of the first one that has one."""
    return index.where(F.col("mtime").isNotNull() & (F.col("mtime") != "")).groupBy("file").agg(F.min_by("mtime", order).alias("mtime"))


def with_index_flag(folders: DataFrame, indexed: DataFrame, active: str | None = None) -> DataFrame:
    """name, ingested, active of folders (name) against the names that have an index."""
    known = indexed.select("name").distinct().withColumn("__known", F.lit(True))
    return folders.join(known, "name", "left").select("name", F.coalesce("__known", F.lit(False)).alias("ingested"), F.col("name").eqNullSafe(active).alias("active"))


def counters(results: DataFrame) -> DataFrame:
    """One row: considered, extracted, unchanged, failed of results (status)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(F.count("*").alias("considered"), count("extracted"), count("unchanged"), count("failed"))
