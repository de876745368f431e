"""Media columns: bytes stored as the coefficients of progressive JPEGs, and a numpy decoder of such files.

encode() lays each byte of a payload down as one quantised coefficient of a
4:2:0 picture (64 to a block; DC as byte - 128, AC by sign and a magnitude of
128 to 255) and writes it in scans: a spectral selection of first scans with the
seven upper bits, whose code words fill whole bytes (so that a table of files
compresses about as well as one of texts), then successive approximation of the
lowest one. Files are ordinary
progressive JPEGs; a comment holds the number of bytes.

decode() accumulates the scans of any Huffman-coded 8-bit progressive JPEG of
1 or 3 components without restart intervals into coefficient arrays. Runs whose
code words have one length, and correction bits of end-of-band runs, are taken
from the bit array at once; other code words one by one. The inverse transform
is a matrix product, chroma is upsampled, and RGB tensors have full resolution.

Payloads over FRAME_BYTES are several files, one after another, and their
tensor the files' tensors one after another, so that what a task expands at
once is bounded however long a text is.

Defined cases: null text is the empty text; an empty payload is one block of
zeros; equal texts give equal files and tensors; a file that breaks off or isn't
a progressive JPEG raises ValueError.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _inverse_transform() -> np.ndarray:
    """[coefficient in zigzag order, pixel]: the inverse DCT as a matrix."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = _inverse_transform()

#: Bytes of a payload that one file holds at most; a multiple of 64.
FRAME_BYTES = 1 << 20
#: Bits that successive approximation adds, one by one, to those of the first scans.
LOWER = 1
UPPER = 8 - LOWER
#: Huffman tables of encode(): code lengths and symbols. Every DC word has UPPER + 1 bits with its extra bits, and so has every word of an AC first scan.
_DC, _AC, _EOB = ({UPPER + 1 - s: [s] for s in range(UPPER, -1, -1)}, {1: [UPPER]}, {4: [n << 4 for n in range(15)]})


def _dc_words() -> np.ndarray:
    """[difference + 2^UPPER]: bits of the code word and extra bits."""
    out = []
    for d in range(-(1 << UPPER) + 1, 1 << UPPER):
        s = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << s) - 1
        out.append("1" * (UPPER - s) + "0" + (f"{extra:0{s}b}" if s else ""))
    return np.array([[0] * (UPPER + 1), *(list(map(int, w)) for w in out)], np.uint8)


_DC_WORDS = _dc_words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, table: dict[int, list[int]]) -> bytes:
    sizes = bytes(len(table.get(n, ())) for n in range(1, 17))
    return bytes([kind << 4 | number]) + sizes + bytes(s for n in sorted(table) for s in table[n])


def _scan(components: tuple[int, ...], dc: int, ac: int, band: tuple[int, int], high: int, low: int, bits: np.ndarray) -> bytes:
    header = bytes([len(components)]) + b"".join(bytes([c + 1, dc << 4 | ac]) for c in components) + bytes([*band, high << 4 | low])
    bits = np.concatenate((bits.ravel(), np.ones(-bits.size % 8, np.uint8)))
    return _segment(0xDA, header) + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


@lru_cache(maxsize=64)
def _mcu_order(rows: int, cols: int) -> np.ndarray:
    """Number of each block (all luma by row, then Cb, then Cr) in the order of an interleaved 4:2:0 scan."""
    mcu = np.arange(rows * cols).reshape(rows, cols)
    y = np.arange(4 * rows * cols).reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    m = mcu.reshape(-1, 1)
    return np.concatenate((y, 4 * rows * cols + m, 5 * rows * cols + m), axis=1).ravel()


@lru_cache(maxsize=1)
def _head() -> bytes:
    tables = _table(0, 0, _DC) + _table(1, 0, _AC) + _table(1, 1, _EOB)
    return b"\xff\xd8" + _segment(0xDB, bytes([0]) + b"\x01" * 64) + _segment(0xC4, tables)


def _eob_runs(blocks: int) -> list[tuple[int, np.ndarray]]:
    """Runs of at most 32767 blocks and the bits of their code words."""
    out = []
    while blocks:
        run = min(blocks, 32767)
        n = run.bit_length() - 1
        out.append((run, np.array([int(b) for b in f"{n:04b}" + (f"{run - (1 << n):0{n}b}" if n else "")], np.uint8)))
        blocks -= run
    return out


def encode(data: bytes) -> bytes:
    """The file whose coefficients are data with bytes 0 appended up to a positive multiple of 64."""
    used = max(1, -(-len(data) // 64))
    mcus = -(-used // 6)
    cols = int(np.ceil(np.sqrt(mcus)))
    rows = -(-mcus // cols)
    m = rows * cols
    filled = np.zeros(6 * m * 64, np.uint8)
    filled[: len(data)] = np.frombuffer(data, np.uint8)
    blocks = filled.reshape(-1, 64)
    planes = np.unpackbits(blocks, axis=1).reshape(-1, 64, 8)  # [block, coefficient, bit from the upper]
    order = _mcu_order(rows, cols)
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [_head(), _segment(0xFE, b"bytes=%d" % len(data)), _segment(0xC2, frame)]
    ends = ((0, 0, 4 * m), (1, 4 * m, 5 * m), (2, 5 * m, 6 * m))
    owner = np.tile(np.repeat(np.arange(3), [4, 1, 1]), m)
    upper = (blocks[order, 0].astype(np.int64) - 128) >> LOWER
    diff = np.empty_like(upper)
    for c in range(3):
        diff[owner == c] = np.diff(upper[owner == c], prepend=0)
    out.append(_scan((0, 1, 2), 0, 0, (0, 0), 0, LOWER, _DC_WORDS[diff + (1 << UPPER)]))
    first = np.zeros((6 * m, 63, UPPER + 1), np.uint8)  # a 0, then the value; of negative values all bits are turned
    first[:, :, 1] = 1 - planes[:, 1:, 0]
    first[:, :, 2:] = planes[:, 1:, 1:UPPER] ^ planes[:, 1:, :1]
    for c, a, b in ends:
        for low, high in ((1, 5), (6, 63)):
            out.append(_scan((c,), 0, 0, (low, high), 0, LOWER, first[a:b, low - 1 : high]))
    for bit in range(LOWER - 1, -1, -1):
        out.append(_scan((0, 1, 2), 0, 0, (0, 0), bit + 1, bit, planes[order, 0, 7 - bit]))
        for c, a, b in ends:
            parts, at = [], a
            for run, word in _eob_runs(b - a):
                parts += [word, planes[at : at + run, 1:, 7 - bit].ravel()]
                at += run
            out.append(_scan((c,), 0, 1, (1, 63), bit + 1, bit, np.concatenate(parts)))
    return b"".join(out) + b"\xff\xd9"


@dataclass
class Component:
    name: int
    h: int
    v: int
    quant: int
    rows: int = 0
    cols: int = 0
    own_rows: int = 0
    own_cols: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))

    def own(self) -> np.ndarray:
        """Numbers of the blocks of a scan of this component alone."""
        return np.arange(self.rows * self.cols).reshape(self.rows, self.cols)[: self.own_rows, : self.own_cols].ravel()


@dataclass
class Picture:
    height: int
    width: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes
    size: int = 0  # bytes of the file


class Codes:
    """A Huffman table: {(length, code): symbol}."""

    def __init__(self, sizes: bytes, symbols: bytes):
        self.symbol: dict[tuple[int, int], int] = {}
        code = at = 0
        for n, count in enumerate(sizes, 1):
            for _ in range(count):
                self.symbol[n, code] = symbols[at]
                code, at = code + 1, at + 1
            code *= 2

    def even(self, extra) -> int:
        """The length of every word with its extra bits, or 0 if they differ."""
        found = {n + extra(s) for (n, _), s in self.symbol.items()}
        return found.pop() if len(found) == 1 else 0


class Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> np.ndarray:
        if self.at + n > len(self.bits):
            raise ValueError("a scan breaks off")
        self.at += n
        return self.bits[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int("".join(map(str, self.take(n).tolist())), 2) if n else 0

    def signed(self, n: int) -> int:
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def word(self, codes: Codes) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(self.take(1)[0])
            if (n, code) in codes.symbol:
                return codes.symbol[n, code]
        raise ValueError("no such code word")


def _dc_first(bits: Bits, codes: Codes, owner: np.ndarray) -> np.ndarray:
    """The values of the blocks of a scan, in its order; owner: their component's number."""
    n = len(owner)
    length = codes.even(lambda s: s)
    if length and length <= 16:
        words = bits.take(n * length).reshape(n, length) @ (1 << np.arange(length - 1, -1, -1))
        known = np.zeros(1 << length, np.int64)
        for (size, code), s in codes.symbol.items():
            extra = np.arange(1 << s)
            known[(code << (length - size)) + extra] = np.where(extra >> max(s - 1, 0) | (s == 0), extra, extra - (1 << s) + 1)
        diff = known[words]
    else:
        diff = np.array([bits.signed(bits.word(codes)) for _ in range(n)], np.int64)
    out = np.empty(n, np.int64)
    for c in np.unique(owner):
        out[owner == c] = np.cumsum(diff[owner == c])
    return out


def _ac_first(bits: Bits, codes: Codes, band: np.ndarray, low: int) -> None:
    """band: [block, place], filled in."""
    n, width = band.shape
    only = next(iter(codes.symbol.values())) if len(codes.symbol) == 1 else None
    if only is not None and only >> 4 == 0 and only & 15:
        size, ((length, _), _) = only & 15, next(iter(codes.symbol.items()))
        words = bits.take(n * width * (length + size)).reshape(n, width, length + size)[:, :, length:]
        v = np.packbits(words, axis=2).astype(np.int32)[:, :, 0] >> (8 - size) if size <= 8 else words @ (1 << np.arange(size - 1, -1, -1))
        band[:] = np.where(words[:, :, 0] == 1, v, v - (1 << size) + 1) << low
        return
    skip = 0
    for row in band:
        if skip:
            skip -= 1
            continue
        k = 0
        while k < width:
            run, size = divmod(bits.word(codes), 16)
            if size:
                k += run
                if k >= width:
                    raise ValueError("a run leaves its band")
                row[k] = bits.signed(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) - 1 + bits.number(run)
                break


def _corrected(values: np.ndarray, got: np.ndarray, low: int) -> np.ndarray:
    return values + np.sign(values) * (got.astype(np.int32) << low)


def _ac_refine(bits: Bits, codes: Codes, band: np.ndarray, low: int) -> None:
    n, width = band.shape
    i = 0
    while i < n:
        row, k, run_of_blocks = band[i], 0, 0
        while k < width:
            run, size = divmod(bits.word(codes), 16)
            if not size and run < 15:
                run_of_blocks = (1 << run) + bits.number(run)
                break
            new = (1 << low if bits.number(1) else -(1 << low)) if size else 0
            while k < width:
                if row[k]:
                    row[k] = _corrected(row[k : k + 1], bits.take(1), low)[0]
                elif run == 0:
                    row[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if run_of_blocks:
            part = band[i : i + run_of_blocks]
            mask = part != 0
            mask[0, :k] = False
            part[mask] = _corrected(part[mask], bits.take(int(mask.sum())), low)
            i += run_of_blocks
        else:
            i += 1


def _apply_scan(p: Picture, chosen: list[tuple[Component, int, int]], band: tuple[int, int], high: int, low: int, bits: Bits, tables: dict) -> None:
    first, last = band
    if first == 0:
        if len(chosen) == 1:
            c = chosen[0][0]
            places, owner = [(c, c.own())], np.zeros(c.own_rows * c.own_cols, np.int64)
            order = None
        else:
            grids = []
            for c, _, _ in chosen:
                r, w = c.rows // c.v, c.cols // c.h
                grids.append(np.arange(c.rows * c.cols).reshape(r, c.v, w, c.h).transpose(0, 2, 1, 3).reshape(r * w, -1))
            owner = np.tile(np.repeat(np.arange(len(grids)), [g.shape[1] for g in grids]), len(grids[0]))
            places, order = [(c, g.ravel()) for (c, _, _), g in zip(chosen, grids, strict=True)], True
        if high:
            values = bits.take(len(owner)).astype(np.int64) << low
        else:
            if len({t for _, t, _ in chosen}) > 1:
                raise ValueError("components of one DC scan with different tables are not supported")
            values = _dc_first(bits, tables[0, chosen[0][1]], owner) << low
        for i, (c, where) in enumerate(places):
            mine = values[owner == i] if order else values
            c.coefficients[where, 0] = c.coefficients[where, 0] | mine if high else mine
        return
    ((c, _, table),) = chosen
    where = c.own()
    part = c.coefficients[where, first : last + 1]
    (_ac_refine if high else _ac_first)(bits, tables[1, table], part, low)
    c.coefficients[where, first : last + 1] = part


def _entropy_end(data: bytes, at: int) -> int:
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("a scan breaks off")
        if data[at + 1]:
            return at
        at += 2


def read_coefficients(data: bytes) -> Picture:
    """All scans of a progressive JPEG, accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, quant, comment, p = 2, {}, {}, b"", None
    while True:
        marker = data[at + 1] if at + 1 < len(data) else 0
        if marker == 0xD9:
            break
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("the file breaks off")
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = Codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3):
                raise ValueError("8-bit pictures of 1 or 3 components only")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            h, v = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.rows, c.cols = -(-height // (8 * v)) * c.v, -(-width // (8 * h)) * c.h
                c.own_rows, c.own_cols = -(-(-(-height * c.v // v)) // 8), -(-(-(-width * c.h // h)) // 8)
                c.coefficients = np.zeros((c.rows * c.cols, 64), np.int32)
            p = Picture(height, width, parts, quant, comment)
        elif marker == 0xDD and body != b"\0\0" or 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError(f"marker {marker:02x} is not supported")
        elif marker == 0xDA:
            if p is None:
                raise ValueError("a scan before the frame")
            chosen = [(next(c for c in p.components if c.name == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            first, last, approx = body[-3:]
            end = _entropy_end(data, at)
            _apply_scan(p, chosen, (first, last), approx >> 4, approx & 15, Bits(data[at:end]), tables)
            at = end
    if p is None:
        raise ValueError("no frame")
    p.comment, p.size = comment, at + 2
    return p


def to_rgb(p: Picture) -> np.ndarray:
    """[row, column, channel], bytes, full resolution."""
    h, v = max(c.h for c in p.components), max(c.v for c in p.components)
    planes = []
    for c in p.components:
        pixels = (c.coefficients * p.quant[c.quant]).astype(np.float32) @ INVERSE + np.float32(128)
        plane = np.clip(np.rint(pixels), 0, 255).reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.cols)
        if (h, v) != (c.h, c.v):
            plane = plane.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1)
        planes.append(plane[: p.height, : p.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb), axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def payload_of(p: Picture) -> bytes:
    """The padded bytes that encode() stored."""
    n = int(p.comment.removeprefix(b"bytes="))
    c = np.concatenate([x.coefficients for x in p.components])
    out = np.where(c < 0, -c, c - 128)  # AC: sign is the upper bit, magnitude - 128 the rest
    out[:, 0] = c[:, 0] + 128
    return out.astype(np.uint8).tobytes()[: max(64, -(-n // 64) * 64)]


def frames_of(data: bytes) -> bytes:
    """The files that store a payload of any length."""
    return b"".join(encode(data[i : i + FRAME_BYTES]) for i in range(0, max(1, len(data)), FRAME_BYTES))


def pictures(media: bytes):
    """The pictures of files that stand one after another, each read when it is asked for."""
    at = 0
    while at < len(media):
        p = read_coefficients(media[at:] if at else media)
        at += p.size
        yield p


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: the file that stores the text's UTF-8 bytes."""
    return common.map_texts(df, id_col, text_col, "n_bytes bigint, media binary", lambda texts: [[len(t) for t in texts], [frames_of(t) for t in texts]])


def decoded(media: bytes) -> tuple:
    """(payload, height, width, tensor, mean_rgb) of a column's value; of several files height is the sum and width the largest."""
    payload, tensor, height, width, total = [], [], 0, 0, np.zeros(3)
    for p in pictures(media):
        rgb = to_rgb(p)
        payload.append(payload_of(p))
        tensor.append(rgb.tobytes())
        height, width, total = height + p.height, max(width, p.width), total + rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    tensor = b"".join(tensor)
    return b"".join(payload), height, width, tensor, (total / (len(tensor) // 3)).tolist()


def decode_column(df: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The kept columns, payload, height, width, tensor (RGB bytes by row) and mean_rgb; a null file gives nulls."""
    src = common.small_batches(df).select(*keep, F.col(media_col).alias("__media"))
    schema = common.out_schema(src, keep, "payload binary, height int, width int, tensor binary, mean_rgb array<double>")

    def run(batches):
        for batch in batches:
            files = batch.column(len(keep))
            for at in range(0, len(batch), 64):
                cols = ([], [], [], [], [])
                for i in range(at, min(at + 64, len(batch))):
                    row = (None,) * 5
                    if (data := files[i].as_py()) is not None:
                        row = decoded(data)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                yield common.arrow_batch(schema, [*(batch.column(c).slice(at, 64) for c in keep), *cols])

    return src.mapInArrow(run, schema)


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = common.stored(encode_column(common.table(spark, sf_dir, "documents")), "media", "zstd")
    return decode_column(media, ["doc_id", "n_bytes", "media"]).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.format_string("%dx%d", "height", "width"), F.array_join(F.transform("mean_rgb", lambda x: F.format_string("%.4f", x)), ","), F.hex(F.crc32("tensor"))).alias("feature"),
    )
