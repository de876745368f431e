"""Shared plumbing of the training-data operators.

Conventions that hold for every operator of this subpackage:

* An operator reads only the columns it is told to read and returns only its
  own columns (the id column plus results), so extra columns of any name in the
  input can't clash with anything.
* A null text counts as the empty text. A null id is an ordinary value: its
  row is kept and the null is passed through.
* Repeated rows each give a result row; empty tables give empty results.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import dropped, shared_path, small_batches, stored  # noqa: F401
from ..sources.tables import table  # noqa: F401

#: Bytes of text that a Python worker expands at once.
SLICE_BYTES = 4 << 20


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made of it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The kept columns, then the text (null: empty) as __text."""
    return df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))


def out_schema(df: DataFrame, keep: list[str], fields: str) -> T.StructType:
    """The kept fields as df has them, then the fields of a DDL string."""
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + T.StructType.fromDDL(fields).fields)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches with about max_bytes of text each, and their texts as UTF-8; a longer text comes alone."""
    for batch in batches:
        texts = batch.column("__text").cast(pa.binary())
        start, size, held = 0, 0, []
        for i in range(len(batch)):
            b = texts[i].as_py()
            if held and (size + len(b) > max_bytes or len(held) >= max_rows):
                yield batch.slice(start, i - start), held
                start, size, held = i, 0, []
            held.append(b)
            size += len(b)
        if held:
            yield batch.slice(start, len(batch) - start), held


def arrow_batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    cols = []
    for f, c in zip(want, columns, strict=True):
        a = c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False)
        cols.append(a if a.type == f.type else a.cast(f.type))
    return pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(f.name, f.type, True) for f in want]))


def text_function(work, fields: str, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 14):
    """A function of a text column (null: empty) that gives structs of these fields.

    work(list of UTF-8 texts) -> list of result columns, called with texts of
    bounded size. Only the texts go to Python and only the results come back.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = T.StructType.fromDDL(fields)

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        schema = to_arrow_schema(wanted)
        for array in arrays:
            batch = pa.RecordBatch.from_arrays([array], names=["__text"])
            done = [pa.StructArray.from_arrays(arrow_batch(wanted, work(texts)).columns, fields=list(schema)) for _, texts in slices([batch], max_bytes, max_rows)]
            yield pa.concat_arrays(done) if done else pa.array([], pa.struct(list(schema)))

    # Not deterministic, so that no optimisation evaluates it twice.
    function = F.arrow_udf(run, wanted).asNondeterministic()
    return lambda text: function(F.coalesce(text.cast("string"), F.lit("")))


def map_texts(df: DataFrame, keep: str | list[str], text_col: str, fields: str, work, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 14) -> DataFrame:
    """The kept columns, and the fields that work() gives for each text; all of df's columns are at hand for keep."""
    keep, made = [keep] if isinstance(keep, str) else keep, unused(df, "__made")
    small_batches(df)
    found = df.select(*[F.col(f"`{c}`") for c in keep], text_function(work, fields, max_bytes, max_rows)(F.col(f"`{text_col}`")).alias(made))
    return found.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"{made}.`{f.name}`").alias(f.name) for f in T.StructType.fromDDL(fields).fields])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """(text, y) of at most max_rows labelled documents outside the held-out fold, chosen by a hash of their ids.

    The fold of a row is crc32(doc_id as text) mod folds. Repeated ids count once
    (smallest text, largest label), so that the bound holds whatever repeats.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold(folds) != held_out)
    chosen = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fold(folds: int, id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


class SpilledTexts(Sequence):
    """Texts in a temporary file of this worker, in the order of their ids; only places and lengths are in memory."""

    def __init__(self, rows: Iterator[tuple[object, bytes]]):
        """rows: (id, text), in any order; ids differ."""
        self.file, ids, sizes = tempfile.TemporaryFile(), [], []
        for key, text in rows:
            self.file.write(text)
            ids.append(key)
            sizes.append(len(text))
        self.order = sorted(range(len(ids)), key=ids.__getitem__)
        self.starts = list(accumulate(sizes, initial=0))

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        k = self.order[i]
        self.file.seek(self.starts[k])
        return self.file.read(self.starts[k + 1] - self.starts[k])


def pieces(texts: Sequence[bytes], max_bytes: int, max_rows: int) -> Iterator[list[bytes]]:
    """Lists of neighbouring texts with about max_bytes; a longer text comes alone."""
    held, size = [], 0
    for t in texts:
        if held and (size + len(t) > max_bytes or len(held) >= max_rows):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def fitted(sample: DataFrame, fit) -> bytes:
    """fit(texts, labels) -> bytes, run by one task over a bounded sample in the order of its ids.

    The texts come in small batches and wait in a file, so that memory doesn't
    grow with their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = {}

        def rows():
            for batch in batches:
                keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
                labels.update(zip(keys, batch.column("y").to_pylist(), strict=True))
                yield from ((k, texts[i].as_py()) for i, k in enumerate(keys))

        texts = SpilledTexts(rows())
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, [labels[k] for k in sorted(labels)])], pa.binary())], names=["model"])

    found = small_batches(sample).withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(run, "model binary").collect()
    return bytes(found[0][0]) if found else fit([], [])
