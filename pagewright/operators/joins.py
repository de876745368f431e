"""Joins beyond equality: as-of, nearest above, bands of pages, Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str], tie: str | None = None) -> DataFrame:
    """left with the values of the last right row of its key with since <= at; nulls if there is none.

    One sort by key and place serves both sides: the right rows are laid between
    the left ones, and the last one is carried on. Ties of `since`: the largest `tie`.
    """
    own = [c for c in left.columns if c not in keys]
    some = F.struct(*[F.col(c) for c in own])
    a = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("bigint").alias("__tie"), some.alias("__l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__r"))
    b = right.select(*keys, F.col(since).cast(left.schema[at].dataType).alias("__at"), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("__tie"), F.lit(None).cast(left.select(some).schema[0].dataType).alias("__l"), F.struct(*values).alias("__r"))
    upto = Window.partitionBy(*keys).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.union(b).withColumn("__r", F.last("__r", ignorenulls=True).over(upto)).where("__side = 1")
    return carried.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in own], *[F.col(f"__r.{v}").alias(v) for v in values])


def caption_below(pictures: DataFrame, texts: DataFrame, gap: float = 0.10, overlap: float = 0.30, pattern: str = r"(?i)^(Figure|Fig\.?|Table) \d+", every: bool = False, share_of: str = "text") -> DataFrame:
    """(doc, page, pic, caption): the text below a picture that starts like a caption, nearest first.

    Boxes are x0, y0, x1, y1 in shares of the page. every: all matching texts
    by height, joined by line ends, instead of the nearest one. Ties go to the
    smaller block id.
    """
    t = texts.select("doc", "page", F.col("id").alias("block"), "text", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")]).where(F.col("text").rlike(pattern))
    both = pictures.join(t, ["doc", "page"])
    common = F.least("x1", "tx1") - F.greatest("x0", "tx0")
    hit = both.where((F.col("ty0") >= F.col("y1")) & (F.col("ty0") - F.col("y1") <= gap) & (common / F.greatest(F.col("tx1") - F.col("tx0"), F.lit(1e-9)) >= overlap))
    if every:
        found = hit.groupBy("doc", "page", F.col("id").alias("pic")).agg(F.array_sort(F.collect_list(F.struct("ty0", "block", "text"))).alias("c"))
        return found.select("doc", "page", "pic", F.array_join("c.text", "\n").alias("caption"))
    order = Window.partitionBy("doc", "page", "id").orderBy("ty0", "block")
    return hit.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc", "page", F.col("id").alias("pic"), F.col("text").alias("caption"))


def page_band(pictures: DataFrame, texts: DataFrame, reach: int = 2, enough: int = 500, budget: int = 4000) -> DataFrame:
    """(doc, pic, context): text of the pages around a picture, of its own section if that holds `enough` characters, cut to the budget.

    texts: doc, page, pos, section, text. The last block is cut if over 200
    characters of the budget remain.
    """
    spread = pictures.select("doc", F.col("id").alias("pic"), F.col("section").alias("own"), F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach)).alias("page"))
    both = spread.join(texts.where(F.trim("text") != ""), ["doc", "page"]).withColumn("same", F.coalesce(F.col("section") == F.col("own"), F.lit(False)))
    one = Window.partitionBy("doc", "pic")
    held = F.coalesce(F.sum(F.when(F.col("same"), F.length("text"))).over(one), F.lit(0))
    kept = both.withColumn("held", held).where((F.col("held") < enough) | F.col("same"))
    before = F.coalesce(F.sum(F.length("text") + 2).over(one.orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - F.col("before")
    part = F.when(F.length("text") <= left, F.col("text")).when(left > 200, F.substring(F.col("text"), F.lit(1), left.cast("int")))
    cut = kept.withColumn("before", before).withColumn("part", part).where("part is not null")
    found = cut.groupBy("doc", "pic").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "part"))).alias("c"))
    return found.select("doc", "pic", F.array_join("c.part", "\n\n").alias("context"))


#: Hashes of a block, and pairs of them that are compared at once.
BLOCK_ROWS, PAIRS_AT_ONCE = 1 << 15, 1 << 21
#: Rows of one hash that meet another's in one task.
SLOT_ROWS = 1024


def _near(kinds: DataFrame, distance: int, width: int, links: bool = False) -> DataFrame:
    """x, y, d: the tags of different hashes (h, tag; each hash once) that differ in at most `distance` of their `width` bits.

    Hashes are dealt to blocks of bounded size, and each pair of blocks is one
    group, in which all pairs are compared strip by strip, so that memory
    depends neither on the table nor on how many pairs are near. Each pair
    comes once. links: only so many pairs of each group as keep its components.
    """
    kinds = stored(kinds.select("h", "tag").where("h is not null"), "hashes")
    n = kinds.count()
    parts = max(-(-n // BLOCK_ROWS), min(8, -(-n // 2048)), 1)
    of = F.pmod(F.xxhash64("h"), F.lit(parts).cast("bigint"))
    dealt = kinds.select("h", "tag", of.alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("other"))
    dealt = dealt.select(F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "h", "tag")
    kind = np.dtype("u2" if width <= 16 else "u4" if width <= 32 else "u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        part, h = (rows.column(c).to_numpy() for c in ("part", "h"))
        h, tag = h.astype(np.int64).view(np.uint64).astype(kind), rows.column("tag").combine_chunks()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        left, right, label = np.flatnonzero(part == i), np.flatnonzero(part == j), np.arange(len(h))
        step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
        for at in range(0, len(left), step):
            own = left[at : at + step]
            d = np.bitwise_count(h[own][:, None] ^ h[right][None, :])
            found = d <= distance
            if i == j:
                found &= own[:, None] < right[None, :]
            a, b = np.nonzero(found)
            a, b, d = own[a], right[b], d[a, b]
            if links:
                kept, label = _joined(label, a, b)
                a, b, d = a[kept], b[kept], d[kept]
            if len(a):
                yield pa.RecordBatch.from_arrays([tag.take(pa.array(a)), tag.take(pa.array(b)), pa.array(d.astype(np.int32))], names=["x", "y", "d"])

    of_tag = kinds.schema["tag"].dataType.simpleString()
    return dealt.groupBy("i", "j").applyInArrow(run, f"x {of_tag}, y {of_tag}, d int")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (a, b) join different labels, one after another, and the labels afterwards."""
    x, y = label[a], label[b]
    _, first = np.unique(x * len(label) + y, return_index=True)
    root, kept = np.arange(len(label)), []
    for k, u, v in zip(first.tolist(), x[first].tolist(), y[first].tolist(), strict=True):
        while root[u] != u:
            root[u] = u = root[root[u]]
        while root[v] != v:
            root[v] = v = root[root[v]]
        if u != v:
            root[max(u, v)] = min(u, v)
            kept.append(k)
    while (root[root] != root).any():
        root = root[root]
    return np.array(kept, np.int64), root[label]


def _first_ids(hashes: DataFrame, bits: str, id_col: str) -> DataFrame:
    return hashes.groupBy(F.col(bits).alias("h")).agg(F.min(id_col).alias("tag"))


def hamming_pairs(hashes: DataFrame, bits: str, id_col: str = "id", distance: int = 12, width: int = 64) -> DataFrame:
    """(a, b, d), a < b: pairs of hashes of at most 64 bits that differ in at most `distance` bits.

    Equal hashes meet once, as one hash; hamming_pairs_64() gives their pairs too.
    """
    found = _near(_first_ids(hashes, bits, id_col), distance, width)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d").where("a < b")


def hamming_links(hashes: DataFrame, bits: str, id_col: str = "id", distance: int = 12, width: int = 64, copies: bool = False) -> DataFrame:
    """(a, b), a < b: so many of hamming_pairs() as keep every component; copies: and of each row a link to the first one of its hash."""
    kinds = _first_ids(hashes, bits, id_col)
    found = _near(kinds, distance, width, links=True).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if copies:
        rows = hashes.select(F.col(bits).alias("h"), F.col(id_col).alias("b"))
        found = found.union(rows.join(kinds, "h").select(F.col("tag").alias("a"), "b"))
    return found.where("a < b")


def hamming_pairs_64(hashes: DataFrame, bits: str, id_col: str = "id", distance: int = 12) -> DataFrame:
    """(a, b, d), a < b: all pairs of rows whose 64-bit hashes differ in at most `distance` bits, those with equal hashes as well.

    Hashes meet once; each pair of them is then expanded to the rows that have
    them, in slots of bounded size, so that a common hash is spread over tasks.
    """
    rows = stored(hashes.select(F.col(id_col).alias("id"), F.col(bits).alias("h")).dropna(), "rows")
    kinds = stored(rows.groupBy("h").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SLOT_ROWS).alias("slots")), "kinds")
    of = F.struct("h", "slots")
    same = kinds.where("n > 1").select(of.alias("x"), of.alias("y"), F.lit(0).alias("d"))
    pairs = same.union(_near(kinds.select("h", of.alias("tag")), distance, 64))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{c}.slots") - 1))
    pairs = pairs.select("x", "y", "d", upto("x").alias("i")).select("x", "y", "d", "i", upto("y").alias("j"))
    held = stored(rows.join(kinds, "h").select("h", F.pmod(F.xxhash64("id"), F.col("slots")).alias("slot"), "id"), "held")
    end = lambda x, h, i: held.select(F.col("id").alias(x), F.col("h").alias(h), F.col("slot").alias(i))
    found = pairs.select(F.col("x.h").alias("hx"), "i", F.col("y.h").alias("hy"), "j", "d").join(end("p", "hx", "i"), ["hx", "i"]).join(end("q", "hy", "j"), ["hy", "j"])
    both = found.where((F.col("hx") != F.col("hy")) | (F.col("p") < F.col("q")))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "d").where("a < b")
