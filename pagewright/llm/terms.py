"""Hashed terms of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes as word characters: ASCII letters lower-cased, digits and non-ASCII bytes kept, the rest a break.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Bytes as their kind: letters a or A, digits 0, white space a break, the rest kept.
SHAPE_BYTES = bytes(0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else 0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c for c in range(256))
#: Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


#: Bytes that are hashed at once.
BLOCK = 1 << 18


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 to BLOCK - 1."""

    def all_of(base):
        out = np.full(BLOCK, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return all_of(_BASE), all_of(_BASE_INVERSE)


def _scales(base: int, n: int) -> np.ndarray:
    """base to the powers BLOCK * (0 to n - 1)."""
    out = np.full(n, pow(base, BLOCK, 1 << 64), dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sums_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * _BASE^place over the bytes before each of the sorted places, modulo 2^64."""
    up, out, total, low = _powers()[0], np.zeros(len(places), np.uint64), np.uint64(0), 0
    scales = _scales(_BASE, len(data) // BLOCK + 1)
    for k, start in enumerate(range(0, len(data), BLOCK)):
        part = data[start : start + BLOCK]
        sums = np.concatenate(([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        high = int(np.searchsorted(places, start + len(part), side="right"))
        out[low:high] = total + sums[places[low:high] - start] * scales[k]
        total, low = total + sums[-1] * scales[k], high
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: list[bytes], kinds: bytes = WORD_BYTES, collapse: bool = False, longest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of each word of the texts in order; collapse: runs of one byte count as one; longest: only that many first bytes of a word count (0: all)."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(texts).translate(kinds), dtype=np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    where = None
    if collapse and len(data):
        where = np.flatnonzero(np.concatenate(([True], data[1:] != data[:-1])))
        data = data[where]
    edges = np.flatnonzero(np.diff(data != 0x20, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    if longest:
        stops = np.minimum(stops, starts + longest)
    down = _powers()[1][starts % BLOCK] * _scales(_BASE_INVERSE, len(data) // BLOCK + 1)[starts // BLOCK]
    words = mix((_sums_before(data, stops) - _sums_before(data, starts)) * down)
    return words, np.searchsorted(ends_of_texts, starts if where is None else where[starts], side="right")


def pairs(words: np.ndarray, owner: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the words that stand gap places apart in one text."""
    if len(words) <= gap:
        return words[:0], owner[:0]
    same = owner[gap:] == owner[:-gap]
    both = mix(words[:-gap][same] * np.uint64(3) + words[gap:][same] + np.uint64(gap))
    return both, owner[gap:][same]
