"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two
fingerprints within the radius share a variant. Rows are shuffled on variants.
All fingerprints of a variant's bucket lie in one small ball, so a bucket holds
at most 65 of 64 bits (half radius 1), however many documents there are, and
copies never meet: they have one fingerprint. Each bucket links its members to
its smallest one; links are deduplicated and verified, and components follow.

Near-duplicates (similar_groups) are the texts whose sets of shingles (as 64-bit
hashes) have a similarity of 0.8. Candidates are the texts whose fingerprints
ball hashing connects. At 0.8 most pairs are beyond any ball, as 64 bits differ
in about ten places: bands of least hashes of the shingles (MinHash) add these.
All candidates' sets are compared. Each bucket's members are first held against its hub, the member that meets most
others; those that then still belong to different components are held against
each other, in blocks of bounded size.

Defined cases: null text is the empty text; texts without a word have
fingerprint zero and are linked like others (their sets of shingles count as
equal); texts with fewer words than a shingle are one shingle; a group whose
ids are all null has a null component; repeated rows are copies of each other;
an empty table gives no rows; columns of any name stay as they are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cluster import components
from . import common
from .terms import mix

SHINGLES_AT_ONCE = 1 << 17
#: A pair of similarity 0.8 shares none of 24 bands of 6 least hashes with probability 7e-4, and one of 0.5 shares one with probability 0.3.
BANDS, ROWS = 24, 6
#: Stands for a band where ball hashing made the bucket.
BALLS = -1
FACTORS = np.random.default_rng(80).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text sketched at once, so that the hashes stay in the processor's cache.
SKETCHED_BYTES = 1 << 19
#: Members of a bucket, and bytes of them, that are held against each other in one task; larger buckets are cut into blocks.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20


def least_equal(similarity: float) -> int:
    """Equal least hashes below which a pair isn't verified: the mean less four standard deviations."""
    n = BANDS * ROWS
    return math.floor(n * similarity - 4 * math.sqrt(n * similarity * (1 - similarity)))


def shingles(text: bytes, words: int) -> list[bytes]:
    """Space-joined runs of words of the ASCII-lower-cased text, repeats included; the whole if it has fewer words."""
    w = text.lower().split()
    if not w:
        return []
    if len(w) <= words:
        return [b" ".join(w)]
    joined, starts, at = b" ".join(w), [], 0
    for x in w:
        starts.append(at)
        at += len(x) + 1
    ends = [*(s - 1 for s in starts[words:]), len(joined)]
    return [joined[s:e] for s, e in zip(starts, ends, strict=False)]


def hashes(text: bytes, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles(text, words)], dtype=">u8")


def majority(h: np.ndarray) -> np.ndarray:
    """The 64 bits, highest first, that are set in over half of h."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), SHINGLES_AT_ONCE):
        counts += np.unpackbits(h[i : i + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * counts > len(h)


def fingerprint(h: np.ndarray) -> int:
    """The signed 64-bit fingerprint of a text with these hashes."""
    return int(np.packbits(majority(h)).view(">i8")[0])


def simhash(text: bytes, words: int = 3) -> int:
    """The signed 64-bit fingerprint of a text."""
    return fingerprint(hashes(text, words))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""
    return common.map_texts(df, id_col, text_col, "fp bigint", lambda texts: [[simhash(t, words) for t in texts]])


def ball(fp, bits: int = 64, half: int = 1):
    """All values within `half` (0 or 1) flipped bits of fp."""
    ones = [1 << i if i < 63 else -(1 << 63) for i in range(bits)] if half else []
    return F.array(fp, *[fp.bitwiseXOR(F.lit(x).cast("bigint")) for x in ones])


def similar_links(fps: DataFrame, fp_col: str = "fp", radius: int = 2) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints of at most `radius` (0 to 2) differing bits that keep every component.

    Every member of a variant's bucket is within half the radius of the
    variant, hence within the radius of all other members.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    distinct = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    variants = distinct.select("fp", F.explode(ball(F.col("fp"), 64, (radius + 1) // 2)).alias("variant"))
    bucket = Window.partitionBy("variant")
    met = variants.select(F.min("fp").over(bucket).alias("a"), F.col("fp").alias("b")).where("a < b").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """id, fp, component_id: the smallest id reachable through links, per input row.

    Rows only look up fingerprints that repeat or are linked; any other row is
    its own component.
    """
    docs = common.stored(fingerprints(df, id_col, text_col, words), "fingerprints")
    kinds = common.stored(docs.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n")), "kinds")
    linked = common.stored(components(similar_links(kinds, "fp", radius)).withColumnRenamed("node", "fp"), "linked")
    grouped = kinds.join(linked, "fp").select("fp", "least_id", "component")
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    several = kinds.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least_id").alias("component_id"))
    labels = common.stored(grouped.join(least, "component").select("fp", "component_id").unionByName(several), "labels")
    known = F.when(F.col("known"), F.col("component_id")).otherwise(F.col(id_col))
    return docs.join(labels.withColumn("known", F.lit(True)), "fp", "left").select(id_col, "fp", known.alias("component_id"))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes; of a text without a word the one hash 0."""
    return distinct_hashes(hashes(text, words))


def distinct_hashes(h: np.ndarray) -> np.ndarray:
    return np.unique(h.astype(np.uint64)) if len(h) else np.zeros(1, np.uint64)


def sketches(texts: list[bytes], words: int) -> list[list]:
    """Columns key (a digest of the set of shingles), shingles (their number), bands and sketch (least hashes) of each text."""
    return sketches_of([shingle_set(t, words) for t in texts])


def fingerprints_and_sketches(texts: list[bytes], words: int) -> list[list]:
    """Columns fp, then those of sketches(), from one pass over the texts."""
    found = [hashes(t, words) for t in texts]
    return [[fingerprint(h) for h in found], *sketches_of([distinct_hashes(h) for h in found])]


def sketches_of(sets: list[np.ndarray]) -> list[list]:
    starts = np.cumsum([0, *map(len, sets[:-1])])
    h = mix(np.concatenate(sets))
    least = np.empty((len(sets), len(FACTORS)), np.uint32)
    for j, factor in enumerate(FACTORS):
        least[:, j] = np.minimum.reduceat(h * factor, starts) >> np.uint64(32)
    digest = xxhash.xxh64_intdigest
    bands = [[int(np.int64(np.uint64(digest(row[ROWS * i : ROWS * (i + 1)].tobytes(), i)))) for i in range(BANDS)] for row in least]
    return [[hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], [len(x) for x in sets], bands, [row.tobytes() for row in least]]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if len(a) < len(b):
        a, b = b, a
    if len(b) < similarity * len(a):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    met = int((a[at] == b).sum())
    return met >= similarity * (len(a) + len(b) - met)


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough; held: kind, shingle_set."""
    ends = lambda x: held.select(F.col("kind").alias(x), F.col("shingle_set").alias(f"set_{x}"))

    def run(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            kept = [i for i in range(len(batch)) if similar(*(np.frombuffer(x[i].as_py(), np.uint64) for x in (a, b)), similarity)]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    both = common.small_batches(pairs).join(ends("b"), "b").join(ends("a"), "a").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def balls(kinds: DataFrame) -> DataFrame:
    """band (BALLS), bucket, kind, shingles: one bucket for the kinds (kind, fp, shingles) whose fingerprints ball hashing connects."""
    linked = common.stored(components(similar_links(kinds)).withColumnRenamed("node", "fp"), "linked")
    found = kinds.join(linked, "fp", "left").select(F.lit(BALLS).alias("band"), F.coalesce("component", "fp").alias("bucket"), "kind", "shingles")
    found = common.stored(found, "balls")
    common.dropped(linked)
    return found


def buckets(kinds: DataFrame, connected: DataFrame | None = None) -> DataFrame:
    """band, bucket, kind, hub, parts of the members of buckets with several; kinds: kind, shingles, bands; connected: buckets of balls().

    hub: the member that meets most others, over all bands (of equal ones the
    smallest); parts: into how many blocks the bucket is to be cut.
    """
    each = kinds.select("kind", "shingles", F.posexplode("bands").alias("band", "bucket"))
    each = each if connected is None else connected.unionByName(each)
    sizes = each.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("shingles").alias("bytes")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(8 * F.col("bytes") / BLOCK_BYTES))
    shared = common.stored(each.join(sizes, ["band", "bucket"]).select("band", "bucket", "kind", "n", parts.alias("parts")), "shared")
    met = shared.groupBy("kind").agg(F.sum("n").alias("met"))
    hubs = shared.join(met, "kind").groupBy("band", "bucket").agg(F.max_by("kind", F.struct("met", -F.col("kind"))).alias("hub"))
    members = common.stored(shared.join(hubs, ["band", "bucket"]).select("band", "bucket", "kind", "hub", "parts"), "members")
    common.dropped(shared)
    return members


def links_of(kinds: DataFrame, texts: DataFrame, words: int, similarity: float, connected: DataFrame | None = None) -> DataFrame:
    """(a, b): verified links that keep every component of the pairs which share a bucket of balls() or a band. kinds: kind, shingles, bands, sketch; texts: kind, text."""
    members = buckets(kinds, connected)
    needed = common.stored(members.select("kind").distinct(), "needed")  # of known size, so that other texts needn't move to leave
    held = kinds.join(needed, "kind", "left_semi").select("kind", "sketch").join(texts.join(needed, "kind", "left_semi"), "kind")
    held = common.stored(common.map_texts(held, ["kind", "sketch"], "text", "shingle_set binary", lambda t: [[shingle_set(x, words).tobytes() for x in t]]), "held")
    stars = members.where("kind <> hub").select(F.col("hub").alias("a"), F.col("kind").alias("b")).distinct()
    links = common.stored(verified(stars, held, similarity), "stars")
    placed = members.join(components(links).withColumnRenamed("node", "kind"), "kind", "left").withColumn("component", F.coalesce("component", "kind"))
    placed = common.stored(placed.select("band", "bucket", "kind", "component", "parts"), "placed")
    common.dropped(members)
    several = placed.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "bucket")
    apart = common.stored(placed.join(several, ["band", "bucket"]), "apart")
    common.dropped(placed)
    # Each member goes to the tasks of its own block with every other block of its bucket.
    own = F.pmod(F.xxhash64("kind"), F.col("parts"))
    dealt = apart.select("band", "bucket", "kind", "component", own.alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("band", "bucket", "kind", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    rows = dealt.join(held, "kind").select("band", "bucket", "i", "j", "kind", "component", "part", "sketch", "shingle_set")
    found = rows.groupBy("band", "bucket", "i", "j").applyInArrow(lambda t: met_in_block(t, similarity), "a bigint, b bigint")
    others = common.stored(found.distinct(), "others")
    for x in (apart, held, needed):
        common.dropped(x)
    return links.unionByName(others)


def met_in_block(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b): links between the members of one block, or of two blocks, of a bucket.

    Pairs are skipped that are already connected, belong to another task (both
    in one of two blocks), meet in an earlier band, or whose sketches have too
    few equal hashes (four standard deviations below the mean). The last two
    don't hold for pairs that ball hashing brought together.
    """
    band, two = table.column("band")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
    kind, part, label = (table.column(c).to_numpy() for c in ("kind", "part", "component"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(len(kind), -1)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingle_set").to_pylist()]
    size, least = np.array([len(x) for x in sets]), least_equal(similarity)
    label = label.copy()
    a, b = [], []
    for i in range(len(kind) - 1):
        later = np.arange(i + 1, len(kind))
        later = later[(label[later] != label[i]) & ((part[later] != part[i]) if two else True) & (np.minimum(size[later], size[i]) >= similarity * np.maximum(size[later], size[i]))]
        if band != BALLS:
            equal = sketch[later] == sketch[i]
            bands = equal.reshape(len(later), BANDS, ROWS).all(axis=2)
            later = later[(equal.sum(axis=1) >= least) & bands[:, band] & ~bands[:, :band].any(axis=1)]
        for k in later.tolist():
            if label[k] != label[i] and similar(sets[i], sets[k], similarity):
                label[label == label[k]] = label[i]
                a.append(min(kind[i], kind[k]))
                b.append(max(kind[i], kind[k]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """row (a number of each row), id, component: equal for the texts that links of at least `similarity` connect."""
    rows, number = numbered(df.select(id_col, text_col))
    return groups_of(rows, number, id_col, text_col, words, similarity)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number for each row, written once, and that column's name: the numbers follow how Spark cuts the input, which may differ between two scans."""
    number = common.unused(df, "__row")
    return common.stored(df.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def groups_of(rows: DataFrame, number: str, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """similar_groups() of rows that numbered() wrote."""
    source = rows.select(F.col(number).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    work = lambda texts: fingerprints_and_sketches(texts, words)
    docs = common.stored(common.map_texts(source, ["row", "id"], "text", "fp bigint, key binary, shingles bigint, bands array<bigint>, sketch binary", work, SKETCHED_BYTES), "sketches")
    least = common.stored(docs.groupBy("key").agg(F.min("row").alias("kind")), "least")
    kinds = common.stored(docs.join(least.select("kind"), F.col("row") == F.col("kind")).select("kind", "fp", "shingles", "bands", "sketch"), "kinds")
    connected = balls(kinds)
    texts = source.select(F.col("row").alias("kind"), "text")
    linked = components(links_of(kinds, texts, words, similarity, connected)).withColumnRenamed("node", "kind")
    labels = common.stored(least.join(linked, "kind", "left").select("key", F.coalesce("component", "kind").alias("component")), "labels")
    found = common.stored(docs.select("row", "id", "key").join(labels, "key").select("row", "id", "component"), "groups")
    for x in (docs, least, kinds, connected, labels):
        common.dropped(x)
    return found.withColumnRenamed("id", id_col) if id_col != "id" else found


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df, all columns, but of each group only the one with the smallest id (of repeated rows the first)."""
    rows, number = numbered(df)
    found = groups_of(rows, number, id_col, text_col, words, similarity).toDF("row", "id", "component")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("first"))
    kept = common.stored(first.select(F.col("first.row").alias(number)), "kept")
    dropped = common.stored(found.select(F.col("row").alias(number)).join(kept, number, "left_anti"), "dropped")
    common.dropped(found)
    return rows.join(dropped, number, "left_anti").drop(number)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
