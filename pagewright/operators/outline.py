"""Outlines of documents: breadcrumbs, their overlay on blocks, and when sections say too little."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed
from .blocks import resectioned
from .joins import as_of

#: An outline with fewer titles tells nothing; a document with at most as many sections is taken anew from its headings.
LEAST_LEAVES, FEW_SECTIONS = 3, 3


def breadcrumbs(entries: DataFrame, key: str = "doc") -> DataFrame:
    """key, pos, page, leaf, path of outline entries (key, pos, level, title, page) that have a title and a page.

    An entry's path holds, of the entries before it, those that are still open:
    an entry closes all open ones of its level and of deeper ones. One fold over
    the entries of a document.
    """
    some = entries.select(key, "pos", "level", collapsed(F.coalesce("title", F.lit(""))).alias("title"), "page").where("title <> '' and page >= 1")
    rows = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "level", "title", "page"))).alias("rows"))
    open_, found = "array<struct<level:int,title:string>>", "array<struct<pos:bigint,page:int,leaf:string,path:string>>"
    start = F.struct(F.array().cast(open_).alias("open"), F.array().cast(found).alias("found"))

    def step(held, x):
        now = F.concat(F.filter(held["open"], lambda o: o["level"] < x["level"]), F.array(F.struct(x["level"].cast("int").alias("level"), x["title"].alias("title"))))
        path = F.array_join(F.transform(now, lambda o: o["title"]), " > ")
        entry = F.struct(x["pos"].cast("bigint").alias("pos"), x["page"].cast("int").alias("page"), x["title"].alias("leaf"), path.alias("path"))
        return F.struct(now.alias("open"), F.concat(held["found"], F.array(entry)).alias("found"))

    return rows.select(key, F.explode(F.aggregate("rows", start, step, lambda held: held["found"])).alias("x")).select(key, "x.*")


def overlaid(blocks: DataFrame, outline: DataFrame, key: str = "doc") -> DataFrame:
    """Blocks (key, page, section, section_path, ...) with section and section_path of the last outline entry (key, pos, page, leaf, path) up to their page.

    Blocks before the first entry, and documents whose outline has fewer than
    LEAST_LEAVES different titles, keep their own.
    """
    known = outline.join(outline.groupBy(key).agg(F.countDistinct("leaf").alias("n")).where(F.col("n") >= LEAST_LEAVES).select(key), key, "left_semi")
    found = as_of(blocks, known.withColumnRenamed("page", "since"), [key], "page", "since", ["leaf", "path"], "pos")
    return found.withColumns({"section": F.coalesce("leaf", "section"), "section_path": F.coalesce("path", "section_path")}).drop("leaf", "path")


def section_counts(blocks: DataFrame, key: str = "doc") -> DataFrame:
    """key, n_sections: different sections that aren't empty."""
    return blocks.groupBy(key).agg(F.countDistinct(F.when(F.col("section") != "", F.col("section"))).alias("n_sections"))


def resectioned_where_few(blocks: DataFrame, key: str = "doc", order: str = "pos", most: int = FEW_SECTIONS) -> DataFrame:
    """Blocks, of which documents with few sections get theirs from the numbered headings."""
    few = section_counts(blocks, key).where(F.col("n_sections") <= most).select(key)
    anew = resectioned(blocks.join(few, key, "left_semi"), [key], order)
    return anew.withColumn("section_path", F.col("section")).unionByName(blocks.join(few, key, "left_anti")) if "section_path" in blocks.columns else anew.unionByName(blocks.join(few, key, "left_anti"))


def pictures_first(blocks: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Blocks numbered anew (order): pictures before all others of the same keys."""
    place = Window.partitionBy(*keys).orderBy((F.col("type") != "picture").cast("int"), order)
    return blocks.withColumn(order, F.row_number().over(place) - 1)
