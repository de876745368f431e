"""WARC archives: written and read with Spark's text source, verified along the chain of record boundaries.

Writing: a record per row; the text source puts the blank lines between them.
Of equal payloads the row with the largest id becomes a response, the others
revisits that refer to it. A revisit keeps its HTTP header, whose
Content-Length is that of the payload it stands for. Archives are plain files,
which readers can cut anywhere.

Reading: the text source cuts a file at every occurrence of the magic, also
inside payloads. Tasks number the pieces of their part of a file by offset and
emit, for each candidate, the offset of its successor (from Content-Length) and
the first offset behind its stretch (of about STRETCH bytes) that its chain
leads to. Pointer jumping over these exits, from the start of each file, finds
where each stretch is entered, in about log n joins for a file of n stretches;
a walk from there retains the reachable records of a stretch. Pieces that are
not reachable are payload and go back to the record that holds them. digests()
sums payloads up where they are read, so that only records cut by a magic in
their payload are shuffled with their bytes.

Defined cases: a null payload is the empty payload; null ids are written as
such and read back null; all rows with the largest id of a payload (repeated
rows) are responses; an empty table and empty files give no records. A file
that doesn't begin with the magic, or whose chain ends before the file does (a
header without a length, a length that leads into a payload or beyond the
end), raises BrokenArchive.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
SIZE = len(MAGIC)
#: Bytes of an archive whose chains a task collapses before pointer jumping.
STRETCH = 1 << 20
# Digits of base 32.
BASE32_OF = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenArchive(ValueError):
    """An archive whose records don't follow each other to its end."""


def sha1_base32(col):
    """The bare base 32 SHA-1: 5 hexadecimal digits are 4 digits of base 32."""
    hexa = F.sha1(col)
    parts = [F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), *BASE32_OF)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """id, digest, refers_to, value: the text of each row's record."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\\r\\n]+", " ").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    equal = rows.where(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("equal_digest")).agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    equal = common.stored(equal, "equal")  # its size is known when the join is planned, so that payloads only move if it is too large to broadcast
    rows = rows.join(equal, (F.col("digest") == F.col("equal_digest")) & (F.col("bytes") >= least_bytes), "left")
    revisit = F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), name(F.col("kept")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
    ]
    value = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), http, F.when(revisit, "").otherwise(F.col("payload")))
    return rows.select("id", "digest", F.when(revisit, F.col("kept")).alias("refers_to"), value.alias("value"))


def write(found: DataFrame, path: str, compression: str = "none") -> None:
    """Archives in the folder path. Compressed ones can't be cut: one task reads each."""
    found.select("value").write.option("lineSep", END).option("compression", compression).text(path)


_LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", re.IGNORECASE)


def successor(value: bytes, at: int) -> int | None:
    """Where the record after that of a piece must start; None if its header is none. at: the piece's place after its magic."""
    end = value.find(b"\r\n\r\n")
    found = _LENGTH.search(value, 0, end) if end >= 0 else None
    return at + end + 8 + int(found[1]) if found else None


_PAGE = re.compile(rb"urn:page:(-?\d+)>")


def _field(head: bytes, name: bytes) -> bytes:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return found[1] if found else b""


def summed_up(value: bytes) -> tuple:
    """(page_id, type, refers_to_page, payload_bytes, payload_digest) of a record after its magic; revisits by their headers."""
    head, _, rest = value.partition(b"\r\n\r\n")
    block = rest[: int(_LENGTH.search(head)[1])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page, refers = (_PAGE.search(_field(head, n)) for n in (b"warc-record-id", b"warc-refers-to"))
    kind = _field(head, b"warc-type").decode("utf-8", "replace")
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        length = _LENGTH.search(http)
        size, digest = int(length[1]) if length else None, _field(head, b"warc-payload-digest").decode("utf-8", "replace").removeprefix("sha1:")
    return int(page[1]) if page else None, kind, int(refers[1]) if refers else None, size, digest


_SUMS = "page_id bigint, type string, refers_to_page bigint, payload_bytes bigint, payload_digest string"
_CANDIDATE = "file string, part bigint, stretch bigint, place bigint, next bigint, way_out bigint, stop bigint, complete boolean"
KEYS = ["file", "part", "place"]


def placed(batches):
    """(file, part, place, value) of each piece, in order; place counts from the part's first byte.

    It is that of the piece's magic plus SIZE, so that what stands before a
    file's first magic is at 0.
    """
    now, place = None, 0
    for batch in batches:
        for value, file, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (file, part) != now:
                now, place = (file, part), 0
            v = value.as_py()
            yield file, part, place, v
            place += len(v) + SIZE


def raw_pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return common.small_batches(rows).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))


def candidates(spark: SparkSession, path: str, sums: bool = False, stretch: int = STRETCH) -> DataFrame:
    """A row per piece of the files.

    next: place of its successor; way_out: the first place of its chain behind
    its stretch (null: the chain ends within); stop: where the stretch ends;
    complete: its record ends with the piece; with sums also what summed_up()
    gives of complete ones. Places count from the part's first byte.
    """
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [f.split()[0] for f in f"{_CANDIDATE}, {_SUMS}".split(", ")]

    def closed(key, rows):
        """rows: (place, next, complete, sums) of one stretch, whose end is that of the last piece."""
        out: dict[int, int | None] = {}
        for place, after, *_ in reversed(rows[:-1]):
            out[place] = after if after is None or after >= rows[-1][0] else out.get(after)
        file, part, number = key
        body, stop = rows[:-1], rows[-1][0]
        n = len(body)
        cols = [pa.array([file] * n), *(pa.array([x] * n, pa.int64()) for x in (part, number)), *(pa.array([r[i] for r in body], pa.int64()) for i in (0, 1))]
        cols += [pa.array([out[r[0]] for r in body], pa.int64()), pa.array([stop] * n, pa.int64()), pa.array([r[2] for r in body])]
        cols += [pa.array([r[3][i] for r in body], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        key, rows, end = None, [], 0
        for file, part, place, v in placed(batches):
            if (now := (file, part, place // stretch)) != key:
                if rows:
                    yield closed(key, [*rows, (end,)])
                key, rows = now, []
            after, end = successor(v, place + SIZE), place + len(v) + SIZE
            complete = after is not None and after <= end + SIZE
            rows.append((place, after, complete, summed_up(v) if sums and complete else (None,) * 5))
        if rows:
            yield closed(key, [*rows, (end,)])

    return raw_pieces(spark, path).mapInArrow(run, f"{_CANDIDATE}, {_SUMS}")


def reachable(found: DataFrame) -> DataFrame:
    """(file, part, place): the records that the chain from each file's start leads to, of stored candidates()."""
    parts = found.groupBy("file", "part").agg(F.max("stop").alias("bytes"))
    whole = Window.partitionBy("file")
    base = F.coalesce(F.sum("bytes").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = common.stored(parts.select("file", "part", base.alias("base"), F.sum("bytes").over(whole).alias("size")), "parts")
    chains = found.join(parts, ["file", "part"]).select("file", "part", "stretch", "place", (F.col("base") + F.col("place")).alias("start"), (F.col("base") + F.col("way_out")).alias("to"))
    chains = common.stored(chains, "chains")
    # Jumps start at the files' first records and at places that some chain leaves its stretch for.
    firsts = parts.select("file", F.lit(SIZE).cast("bigint").alias("start"))
    doors = firsts.unionByName(chains.select("file", F.col("to").alias("start")).where("start is not null")).distinct()
    hop = common.stored(chains.join(doors, ["file", "start"]).select("file", "start", "to"), "hop")
    entered = common.stored(hop.where(f"start = {SIZE}").select("file", "start"), "entered")
    reached = entered.count()
    while reached:
        step = entered.join(hop, ["file", "start"]).select("file", F.col("to").alias("start")).where("start is not null")
        grown = common.stored(entered.union(step).distinct(), "entered")
        common.dropped(entered)
        entered, before, reached = grown, reached, grown.count()
        if reached == before:
            break
        onward = hop.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        farther = common.stored(hop.join(onward, ["file", "to"]).select("file", "start", F.col("further").alias("to")), "hop")
        common.dropped(hop)
        hop = farther

    def walk(table: pa.Table) -> pa.Table:
        after = dict(zip(table.column("place").to_pylist(), table.column("next").to_pylist(), strict=True))
        at, kept = table.column("entry")[0].as_py(), []
        while at in after:
            kept.append(at)
            at = after[at]
        n = len(kept)
        return pa.table({"file": table.column("file").slice(0, 1).to_pylist() * n, "part": pa.array(table.column("part").slice(0, 1).to_pylist() * n, pa.int64()), "place": pa.array(kept, pa.int64()), "next": pa.array([after[k] for k in kept], pa.int64())})

    doors = chains.join(entered, ["file", "start"]).select("file", "part", "stretch", F.col("place").alias("entry"))
    entries = found.select("file", "part", "stretch", "place", "next").join(doors.hint("merge"), ["file", "part", "stretch"])
    chain = entries.groupBy("file", "part", "stretch").applyInArrow(lambda t: walk(t), "file string, part bigint, place bigint, next bigint")
    chain = common.stored(chain, "chain")
    ends = chain.join(parts, ["file", "part"]).groupBy("file").agg(F.max(F.col("base") + F.col("next")).alias("end"), F.count_if(F.col("next").isNull()).alias("open"))
    sizes = parts.groupBy("file").agg(F.max("size").alias("size"))
    broken = sizes.join(ends, "file", "left").where("end is null or open > 0 or abs(end - size) > 4").orderBy("file")
    if first := broken.limit(1).collect():
        raise BrokenArchive(f"{broken.count()} of the files have records that don't follow each other to the end, as {first[0]['file']}")
    for x in (hop, entered, chains, parts):
        common.dropped(x)
    return chain.drop("next")


def valued(spark: SparkSession, path: str) -> DataFrame:
    """file, part, place, value of each piece."""

    def numbered(batches):
        rows: list[tuple] = []
        size = 0
        for row in placed(batches):
            rows.append(row)
            size += len(row[3])
            if size > common.SLICE_BYTES:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=[*KEYS, "value"])

    return raw_pieces(spark, path).mapInArrow(numbered, "file string, part bigint, place bigint, value binary")


def mended(spark: SparkSession, path: str, found: DataFrame, chain: DataFrame) -> DataFrame:
    """(value): the reachable records that a magic in their payload cuts, put together again."""
    known = found.select(*KEYS, "complete").join(chain.withColumn("real", F.lit(True)).hint("merge"), KEYS, "left").withColumn("real", F.coalesce("real", F.lit(False)))
    order = Window.partitionBy("file").orderBy("part", "place")
    owner = F.last(F.when(F.col("real"), F.struct("part", "place")), ignorenulls=True).over(order)
    cut = known.where("not real or not complete").withColumn("owner", owner).where("owner is not null").drop("complete")
    text = F.when(F.col("real"), F.col("value")).otherwise(F.concat(F.lit(MAGIC.encode()), F.col("value")))
    each = valued(spark, path).join(common.stored(cut, "cut").hint("merge"), KEYS).select("file", "owner", "part", "place", text.alias("piece"))
    return each.groupBy("file", "owner").agg(F.expr("listagg(piece, x'') within group (order by struct(part, place))").alias("value")).select("value")


def read(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """page_id, type, refers_to_page, record_id, refers_to, uri, digest, http_length, payload (null for revisits) of the records under path."""
    found = common.stored(candidates(spark, path, stretch=stretch), "candidates")
    chain = reachable(found)
    whole = found.where("complete").select(*KEYS).join(chain.hint("merge"), KEYS)
    values = valued(spark, path).join(whole.hint("merge"), KEYS).select("value")
    return parsed(values.unionByName(mended(spark, path, found, chain)))


def digests(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """page_id, type, refers_to_page, payload_bytes, payload_digest of the records under path, without their payloads."""
    found = common.stored(candidates(spark, path, True, stretch), "candidates")
    chain = reachable(found)
    names = [f.split()[0] for f in _SUMS.split(", ")]
    real = common.stored(found.join(chain.hint("merge"), KEYS).select("complete", *names), "records")
    whole = real.where("complete").select(*names)
    if not real.where("not complete").limit(1).count():
        common.dropped(found)
        return whole
    rest = parsed(mended(spark, path, found, chain))
    size = F.coalesce(F.octet_length("payload").cast("bigint"), F.col("http_length"))
    digest = F.when(F.col("payload").isNotNull(), sha1_base32(F.col("payload"))).otherwise(F.col("digest"))
    return whole.unionByName(rest.select("page_id", "type", "refers_to_page", size.alias("payload_bytes"), digest.alias("payload_digest")))


def parsed(found: DataFrame) -> DataFrame:
    head = F.substring_index(F.col("value").cast("string"), END, 1)
    get = lambda c, name: F.regexp_extract(c, f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)
    rows = found.select("value", head.alias("head"))
    rows = rows.withColumn("block", F.expr("substring(value, octet_length(head) + 5, cast(regexp_extract(head, '(?im)^content-length:[ \\\\t]*([0-9]+)', 1) as int))"))
    rows = rows.withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
    kind = get(F.col("head"), "warc-type")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:([0-9-]+)', 1) as bigint)")
    rows = rows.select("head", "http", "block", kind.alias("type"), get(F.col("head"), "warc-record-id").alias("record_id"), get(F.col("head"), "warc-refers-to").alias("refers_to"), get(F.col("head"), "warc-target-uri").alias("uri"), F.regexp_replace(get(F.col("head"), "warc-payload-digest"), "^sha1:", "").alias("digest"))
    rows = rows.withColumn("http_length", F.expr("try_cast(regexp_extract(http, '(?im)^content-length:[ \\\\t]*([0-9]+)', 1) as bigint)"))
    rows = rows.withColumn("payload", F.when(F.col("type") == "response", F.expr("substring(block, octet_length(http) + 5)")))
    return rows.select(page("record_id").alias("page_id"), "type", page("refers_to").alias("refers_to_page"), "record_id", "refers_to", "uri", "digest", "http_length", "payload")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    write(records(common.table(spark, sf_dir, "pages")), path)
    return digests(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
