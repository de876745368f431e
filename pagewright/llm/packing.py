"""Packing token sequences: first-fit decreasing in randomised groups.

A document's ids are cut at multiples of the sequence length; the pieces of
full length fill sequences of their own and the remainders are packed first-fit
decreasing, with a tournament tree over the free places of the bins. Groups are
dealt at random (by a hash of row place, document and piece), so that their
number follows the input, no group grows with it, and repeated rows spread.

Tokenising works on stretches that byte-level BPE keeps apart: every space
before a non-space starts one. Their ids are cached (bounded), so that the
tokenizer itself only sees new stretches.

Defined cases: null text is the empty text; an empty document is the single
closing id; repeated rows are packed each; ids equal those of encoding the
whole text at once; a piece as long as a power of two is packed like others (a
sequence of that many tokens needs no padding).
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEQUENCE = 1024
GROUP_PIECES = 8192
#: Fixed value: how byte-level BPE splits a text before merging.
BYTE_LEVEL_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies print each byte as a character: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def fast_encoder(path: str):
    """text -> ids equal to those of the tokenizers library, or None if the file isn't a plain byte-level BPE in rank order.

    The vocabulary's own ids serve as ranks of a second BPE implementation that
    takes a sixth of the time.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    vocab, byte = model["vocab"], _byte_of()
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or merged and merged[0] < 256:
        return None
    special = {x["content"] for x in spec["added_tokens"] if x["special"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def encoder(path: str, added: bool = False):
    """text -> its ids as little-endian 32-bit bytes. One per worker process and vocabulary file.

    added: literals of the file's added tokens become those tokens, as the
    library does by default; else they are spelled out.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    fast = fast_encoder(path)
    literals = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added else []

    def ids(text):
        if fast is None or any(x in text for x in literals):
            return tokenizer.encode(text, add_special_tokens=False).ids
        return fast(text)

    return lambda text: np.array(ids(text), dtype="<u4").tobytes()


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = SEQUENCE, closing: int = 0, added: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens and `deal`, the random number that deals it to a group. added: as for encoder()."""
    path = tokenizer or default_tokenizer()
    src = common.with_text(df, [id_col], text_col).withColumn("__part", F.spark_partition_id())
    schema = common.out_schema(src, [id_col], "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, deal bigint")
    end = np.array([closing], dtype="<u4").tobytes()

    def run(batches):
        encode, row = encoder(path, added), 0
        for piece, texts in common.slices(batches):
            part = piece.column("__part")[0].as_py()
            which, cols = [], ([], [], [], [], [])
            for i, b in enumerate(texts):
                data = memoryview(encode(b.decode("utf-8", "replace")) + end)
                n = len(data) // 4
                row += 1
                for start in range(0, n, length):
                    stop = min(start + length, n)
                    which.append(i)
                    deal = zlib.crc32(f"{part}:{row}:{start}".encode())
                    for c, v in zip(cols, (start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), n, deal), strict=True):
                        c.append(v)
            yield common.arrow_batch(schema, [piece.column(id_col).take(pa.array(which, type=pa.int64())), *cols])

    return src.mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the order of sizes; ties go to the earlier item.

    Leaves of the tournament tree are bins by number, and a node holds the
    largest free space below it; the first bin that fits is found from the root.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    width = 1
    while width < max(n, 1):
        width *= 2
    tree = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - width, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces as token_pieces() returns them, without deal, with sequence_id and offset."""
    pieces = common.stored(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType([f for f in pieces.schema if f.name != "deal"] + T.StructType.fromDDL("sequence_id bigint, offset bigint").fields)

    def run(key, group):
        group = group.sort_by([(id_col, "ascending"), ("start", "ascending"), ("deal", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        cols = [group.column(f.name).combine_chunks() for f in schema.fields[:-2]]
        batch = common.arrow_batch(schema, [*cols, bins + (key[0].as_py() << 32), offsets])
        return pa.Table.from_batches([batch])

    dealt = pieces.withColumn("__group", F.col("deal") % groups)
    return dealt.groupBy("__group").applyInArrow(run, schema)


def op9_pack_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(common.table(spark, sf_dir, "documents"), added=True))
