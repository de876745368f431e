"""Event-time windows, the decoding of delta streams, and ingest as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    """With a watermark, which needs times with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, event_type, n, value; late: watermark of a stream."""
    rows = _marked(events, late)
    found = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, stop, n."""
    rows = _marked(events, late)
    found = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def first_of(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """One event for each key, within the watermark of a stream."""
    return _marked(events, late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def decoded(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """The fields of lines of JSON; malformed lines are skipped."""
    return lines.withColumn("__x", F.from_json(line, schema, {"mode": "PERMISSIVE"})).where(F.expr("__x is not null")).select(*[c for c in lines.columns if c != line], "__x.*")


def carried(parts: list[str], tail: str = "") -> tuple[list[str], str]:
    """(complete lines, unfinished rest) of a stream's next parts after the rest of the last ones."""
    lines = (tail + "".join(parts)).split("\n")
    return [x.strip() for x in lines[:-1] if x.strip()], lines[-1]


def status_counts(progress: DataFrame) -> DataFrame:
    """collection, status, n of progress events."""
    return progress.groupBy("collection", "status").agg(F.count("*").alias("n"))


def merge_into(load: Callable[[], DataFrame], save: Callable[[DataFrame], None], chunk: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the files of a batch (file, mtime) replace their rows in the index."""

    def run(batch: DataFrame, number: int) -> None:
        index = load()
        files = batch.dropDuplicates(["file"])
        todo = ingest.triage(files, index.select("file", "mtime")).where("status <> 'unchanged'")
        changed = files.join(todo.select("file"), "file", "left_semi")
        save(ingest.upserted(ingest.without_files(index, changed), chunk(changed)))

    return run
