"""Pictures of documents and their captions as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import TAGGED, picture_text
from .captions import stripped

# Kinds of blocks that hold text; least sides (points) and bytes of a picture worth keeping.
TEXTISH = ("text", "heading", "table", "code")
LEAST_SIDE, LEAST_BYTES = 100.0, 4000


def uncaptioned(blocks: DataFrame, force: bool = False) -> DataFrame:
    """Pictures without model text; an empty one counts as none."""
    open_ = F.lit(force) | (F.coalesce("vlm_description", F.lit("")) == "")
    return blocks.where((F.col("type") == "picture") & open_)


def textish(blocks: DataFrame) -> DataFrame:
    """Blocks of text (also without a kind) that isn't blank."""
    return blocks.where((F.col("type").isNull() | F.col("type").isin(*TEXTISH)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def large_enough(width: Column, height: Column, size: Column) -> Column:
    return (width >= LEAST_SIDE) & (height >= LEAST_SIDE) & (size >= LEAST_BYTES)


def of_backend(docs: DataFrame, backend: str) -> DataFrame:
    return docs.where(F.col("backend").eqNullSafe(backend))


def written_back(blocks: DataFrame, edits: DataFrame, keys: tuple[str, ...] = ("doc", "image_path")) -> DataFrame:
    """Blocks with the captions of edits (keys, caption); text is caption and description, however often it is done."""
    kind = F.col("type") == "picture"
    given = edits.groupBy(*keys).agg(F.min("caption").alias("__given"))
    both = blocks.join(given, list(keys), "left").withColumn("__given", F.when(kind, F.col("__given")))
    text = F.when(F.col("__given").isNotNull(), picture_text(F.col("caption"), F.col("__given"))).otherwise(F.col("text"))
    return both.withColumns({"text": text, "vlm_description": F.coalesce("__given", "vlm_description")}).drop("__given").select(blocks.columns)


def restripped(blocks: DataFrame) -> DataFrame:
    """Blocks whose stored raw captions are cleaned anew, and changed: whether that differs."""
    raw = F.coalesce("vlm_description_raw", F.lit(""))
    new = stripped(F.col("vlm_description_raw"))
    changed = (F.col("type") == "picture") & (raw != "") & ~new.eqNullSafe(F.col("vlm_description"))
    rows = blocks.withColumn("changed", F.coalesce(changed, F.lit(False)))
    text = picture_text(F.col("caption"), new)
    return rows.withColumns({"text": F.when(F.col("changed") & (text != ""), text).otherwise(F.col("text")), "vlm_description": F.when(F.col("changed"), new).otherwise(F.col("vlm_description"))})


def label_counts(members: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n: pictures (component) of each labelled component (component, label); labels without one have 0."""
    return labels.join(members.groupBy("component").agg(F.count("*").alias("n")), "component", "left").groupBy("label").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def without_records(text: Column, consumed: Column) -> Column:
    """Tagged layout text without the records whose numbers (from 0) are consumed; the rest stays as it is."""
    between, records = F.split(text, TAGGED, -1), F.regexp_extract_all(text, F.lit(TAGGED), 0)
    kept = F.transform(records, lambda r, i: F.when(F.array_contains(consumed, i), "").otherwise(r))
    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(kept, i), F.lit("")))), "")
