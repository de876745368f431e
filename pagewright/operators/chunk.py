"""Chunkers as array expressions over one document's row, so that nothing is shuffled.

What depends on the sum so far (greedy packing, windows bounded by size) is
found from lengths alone: Arrow functions get numbers and give the first place
and size of each run; texts stay on the JVM side.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clause_key, collapsed, collapsed_ends, embed_budget, embed_input
from ..sources.shared import small_batches

# Default sizes.
SIZE, OVERLAP, EMBED_CHARS, CLAUSE_LEVELS = 1000, 150, 1600, 3
WINDOW_LINES, WINDOW_CHARS, WINDOW_OVERLAP = 50, 800, 10


def windows(text: Column, size: Column | int, overlap: Column | int) -> Column:
    """Array of windows over the white-space-collapsed text; an empty text has none.

    The collapsed text is bound to a name by a transform over one element, so
    that it isn't made anew for each window.
    """
    size = F.greatest(F.lit(1), F.lit(size) if isinstance(size, int) else size)
    step = F.greatest(F.lit(1), size - overlap)

    def cut(clean: Column) -> Column:
        last = F.when(F.length(clean) <= size, 0).otherwise(F.ceil((F.length(clean) - size) / step)).cast("int")
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(clean, (i * step + 1).cast("int"), size.cast("int")))
        return F.when(clean != "", each).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(collapsed(F.coalesce(text, F.lit("")))), cut), F.lit(0))


def sliding(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk (from 0), text: windows over the white-space-collapsed text; empty texts give none."""
    size, step = max(1, size), max(1, max(1, size) - overlap)
    clean = docs.select(id_col, collapsed(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).where("t <> ''")
    last = F.when(F.length("t") <= size, 0).otherwise(F.ceil((F.length("t") - size) / F.lit(step))).cast("int")
    each = clean.select(id_col, "t", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return each.select(id_col, "chunk", F.substring(F.col("t"), F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def greedy(joins: np.ndarray, lengths: np.ndarray, limits: np.ndarray) -> list[tuple[int, int]]:
    """(first, size) of runs: an item goes to the run before it if it joins and the run's length, with a separator, stays in the item's limit."""
    out: list[tuple[int, int]] = []
    used = 0
    for i, (join, length, limit) in enumerate(zip(joins.tolist(), lengths.tolist(), limits.tolist(), strict=True)):
        if out and join and used + 1 + length <= limit:
            out[-1] = (out[-1][0], out[-1][1] + 1)
            used += 1 + length
        else:
            out.append((i, 1))
            used = length
    return out


_SPAN = pa.struct([("first", pa.int32()), ("size", pa.int32())])


def _edges(lists: pa.Array) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)


def _listed(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"first": i, "size": n} for i, n in runs]


def _spans(items: pa.Array, rows: pa.Array, rooms: pa.Array) -> pa.Array:
    """runs of each document's items (joins, length, limit), and of each of its blocks the cuts: runs of the table's rows below its head.

    rows: lengths of each block's rows, null of those that aren't cut by rows; rooms: how long a cut table may be.
    """
    fields, edges = [items.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3)], _edges(items)
    runs, cuts = [], []
    for a, b, tables, room in zip(edges, edges[1:], rows.to_pylist(), rooms.to_pylist(), strict=False):
        runs.append(_listed(greedy(*(c[a:b] for c in fields))))
        cuts.append([])
        for lengths, most in zip(tables or [], room or [], strict=True):
            body = np.array((lengths or [])[2:], np.int64)
            left = most - 2 - sum((lengths or [])[:2])
            cuts[-1].append(_listed(greedy(np.arange(len(body)) > 0, body, np.full(len(body), left))))
    kind = pa.list_(_SPAN)
    return pa.StructArray.from_arrays([pa.array(runs, kind), pa.array(cuts, pa.list_(kind))], names=["runs", "cuts"])


def _function(run, kind: str):
    """Declared as not deterministic, so that it is evaluated once and not moved into a lambda."""
    return F.arrow_udf(run, kind).asNondeterministic()


def _item(joins: Column, length: Column, limit: Column) -> Column:
    return F.struct(joins.alias("joins"), length.cast("int").alias("length"), limit.cast("int").alias("limit"))


def prepared(blocks: Column) -> Column:
    """Of the blocks that have text: text, page, section, kind, clause, room (for the text beside its context) and most (for packed text)."""
    kind = lambda b: F.coalesce(F.when(b["type"] != "", b["type"]), F.lit("text"))
    section = lambda b: F.coalesce(b["section"], F.lit(""))
    room = lambda b: embed_budget(section(b), b["type"], EMBED_CHARS)
    made = lambda b: F.struct(
        collapsed_ends(F.coalesce(b["text"], F.lit(""))).alias("text"), b["page"].alias("page"), section(b).alias("section"), kind(b).alias("kind"),
        clause_key(b["section_path"], b["section"], CLAUSE_LEVELS).alias("clause"), room(b).alias("room"), F.least(F.lit(SIZE), room(b)).alias("most"),
    )
    return F.filter(F.transform(F.coalesce(blocks, F.array()), made), lambda x: x["text"] != "")


def _packs(x: Column) -> Column:
    """Text that is short enough to stand with others."""
    return ~x["kind"].isin("heading", "table") & (F.length(x["text"]) <= x["most"])


def _head(rows: Column) -> Column:
    return F.array_join(F.slice(rows, 1, 2), "\n")


def _table_rows(x: Column) -> Column:
    """The rows of a table that must be cut by rows; null of others: text without pipes or with a head that leaves no room slides."""
    rows = F.filter(F.split(x["text"], "\n", -1), lambda r: collapsed_ends(r) != "")
    long = (x["kind"] == "table") & F.contains(x["text"], F.lit("|")) & (F.length(x["text"]) > x["room"])
    return F.when(long & (F.length(_head(rows)) < x["room"]), rows)


def chunked_blocks(docs: DataFrame, id_col: str = "doc_id", blocks_col: str = "blocks") -> DataFrame:
    """id, chunk, text, page, section, block_type, embed_input of documents with an array of blocks in order.

    Tables stand apart, cut by rows under their first two lines where they are
    too long; headings only separate; longer text slides; other text is packed
    within a clause, and such a chunk has its first block's page and section.
    """
    none = F.array().cast("array<string>")
    before = lambda i: F.get("b", i - 1)
    joins = lambda x, i: (i > 0) & _packs(x) & F.coalesce(_packs(before(i)) & (before(i)["clause"] == x["clause"]), F.lit(False))
    held = docs.select(F.col(id_col), prepared(F.col(blocks_col)).alias("b")).withColumn("rows", F.transform("b", _table_rows))
    items = F.transform("b", lambda x, i: _item(joins(x, i), F.length(x["text"]), x["most"]))
    lengths = F.transform("rows", lambda r: F.transform(r, lambda row: F.length(row)))
    span = "array<struct<first:int,size:int>>"
    found = _function(_spans, f"runs {span}, cuts array<{span}>")(items, lengths, F.transform("b", lambda x: x["room"]))
    held = held.select(id_col, "b", "rows", found.alias("s")).select(id_col, "b", "rows", "s.runs", "s.cuts")

    def parts(x: Column, i: Column) -> Column:
        """The texts of a block that stands alone."""
        rows = F.get("rows", i)
        groups = F.transform(F.get("cuts", i), lambda c: F.array_join(F.concat(F.slice(rows, 1, 2), F.slice(rows, c["first"] + 3, c["size"])), "\n"))
        slid = lambda most: windows(x["text"], most, F.least(F.lit(OVERLAP), most - 1))
        table = F.when(F.length(x["text"]) <= x["room"], F.array(x["text"])).when(rows.isNotNull(), groups).otherwise(slid(x["room"]))
        return F.when(x["kind"] == "heading", none).when(x["kind"] == "table", table).otherwise(slid(x["most"]))

    def chunks(run: Column) -> Column:
        x = F.get("b", run["first"])
        packed = F.array_join(F.transform(F.slice("b", run["first"] + 1, run["size"]), lambda y: y["text"]), " ")
        kind = F.when(x["kind"] == "table", "table").otherwise("text")
        texts = F.transform(F.when(_packs(x), F.array(packed)).otherwise(parts(x, run["first"])), collapsed_ends)
        return F.transform(F.filter(texts, lambda t: t != ""), lambda t: F.struct(t.alias("text"), x["page"].alias("page"), x["section"].alias("section"), kind.alias("block_type"), embed_input(x["section"], kind, t, EMBED_CHARS).alias("embed_input")))

    return held.select(id_col, F.posexplode(F.flatten(F.transform("runs", chunks))).alias("chunk", "c")).select(id_col, "chunk", "c.*")


#: Where a line ends, for any of the line ends that Unicode has.
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def line_windows(text: str, lines: int = WINDOW_LINES, chars: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> list[tuple[int, int, int, int]]:
    """(first line, last line, first character, characters) of windows bounded by lines and characters; a longer line stands alone.

    A window's last line is found by binary search among the ends of lines.
    """
    ends = np.array([m.end() for m in _LINE.finditer(text)], np.int64)
    if len(text) > (ends[-1] if len(ends) else 0):
        ends = np.append(ends, len(text))
    starts, out, at = np.concatenate(([0], ends[:-1])).astype(np.int64), [], 0
    while at < len(ends):
        fits = int(np.searchsorted(ends, starts[at] + chars, side="right"))
        stop = max(at + 1, min(fits, at + lines))
        out.append((at + 1, stop, int(starts[at]), int(ends[stop - 1] - starts[at])))
        at = len(ends) if stop == len(ends) else at + max(1, stop - at - overlap)
    return out


def _windows_of(texts: pa.Array) -> pa.Array:
    names = ("line_start", "line_end", "first", "size")
    found = [[dict(zip(names, w, strict=True)) for w in line_windows(t.as_py() or "")] for t in texts]
    return pa.array(found, pa.list_(pa.struct([(n, pa.int32()) for n in names])))


def windowed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_start, line_end, name, chunk_text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line_spans = _function(_windows_of, "array<struct<line_start:int,line_end:int,first:int,size:int>>")
    each = docs.select(F.col(id_col), text.alias("t"), line_spans(text).alias("w")).select(id_col, "t", F.posexplode("w").alias("n", "w"))
    return each.select(id_col, "w.line_start", "w.line_end", F.format_string("chunk-%d", F.col("n") + 1).alias("name"), F.substring("t", F.col("w.first") + 1, F.col("w.size")).alias("chunk_text"))


def by_document(docs: DataFrame, fold, fields: str, id_col: str = "doc_id", blocks_col: str = "blocks") -> DataFrame:
    """id and the fields of each row that fold(value of a document) gives; the document is one row, so nothing is shuffled."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {fields}"
    names = [f.split()[0] for f in re.split(r",\s*(?![^<]*>)", fields)]

    def run(batches):
        for frame in batches:
            rows = [(i, *r) for i, value in zip(frame[id_col], frame[blocks_col], strict=True) for r in fold(value)]
            yield pd.DataFrame(rows, columns=[id_col, *names])

    return small_batches(docs.select(id_col, blocks_col)).mapInPandas(run, schema)
