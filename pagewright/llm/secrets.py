"""Secret scan through a trigram inverted index.

Each rule's regex is parsed into a Boolean query over trigrams that any match
must contain. A segment (a bounded piece of the table) gets an inverted index:
one pass numbers the trigrams of all its lower-cased texts, and those that some
query mentions become postings of text numbers. Postings are intersected and
united, and only the surviving texts are matched with the regex. Rules without
mandatory trigrams scan every text. Segments are independent, so nothing is
shuffled and a lost executor costs only its own segments.

Defined cases: null text is the empty text (no spans); offsets are code points
of the whole text; overlapping spans of different kinds are all kept; repeated
rows and null ids give a row each.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as K
from re import _parser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


@dataclass(frozen=True)
class Rule:
    """kind: label of a span. group: group that must have at_least characters. run: of a rule that is one run of characters, these."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1
    either_case: bool = False
    run: str = ""

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


# The base rules, then rules for published token formats.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, run="0123456789abcdef"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: True (any text), a trigram, ("and", queries) or ("or", queries).
MOST_STRINGS = 64
#: Trigrams that are numbered at once.
INDEXED_AT_ONCE = 1 << 18


def _all_of(parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(s: str):
    """Trigrams beyond ASCII aren't asked for, as texts are lower-cased and indexed by bytes."""
    s = s.lower()
    return _all_of([s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii()])


def _members(av) -> set[str] | None:
    """The characters of a small class, else None."""
    out: set[str] = set()
    for op, x in av:
        if op is K.LITERAL:
            out.add(chr(x))
        elif op is K.RANGE and x[1] - x[0] < 16:
            out |= {chr(c) for c in range(x[0], x[1] + 1)}
        else:
            return None
    return out if len(out) <= 16 else None


def _strings(seq) -> tuple[set[str] | None, object]:
    """(all strings that seq matches, if few; else None, and a query that any match satisfies)."""
    open_, need, whole = {""}, [], True

    def close():
        nonlocal open_, whole
        need.append(_any_of([_grams(s) for s in sorted(open_)]))
        open_, whole = {""}, False

    for op, av in seq:
        query = True
        if op is K.LITERAL:
            more = {chr(av)}
        elif op is K.IN:
            more = _members(av)
        elif op is K.SUBPATTERN:
            more, query = _strings(av[-1])
        elif op is K.BRANCH:
            found = [_strings(x) for x in av[1]]
            more = set().union(*(x[0] for x in found)) if all(x[0] is not None for x in found) else None
            query = _any_of([x[1] for x in found])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, item = av
            more, query = _strings(item)
            if more is not None and high <= 3:
                base, total = more, {""} if low == 0 else set()
                grown = {""}
                for n in range(1, int(high) + 1):
                    grown = {a + b for a in grown for b in base} if len(grown) * len(base) <= MOST_STRINGS else None
                    if grown is None:
                        break
                    total |= grown if n >= low else set()
                more = None if grown is None else total
            else:
                more = None
            query = query if low else True
        elif op is K.AT:
            continue
        else:
            more = None
        if more is not None and len(open_) * len(more) > MOST_STRINGS:
            close()
        if more is not None and len(more) <= MOST_STRINGS:
            open_ = {a + b for a in open_ for b in more}
        else:
            close()
            need.append(query)
    query = _all_of([*need, _any_of([_grams(s) for s in sorted(open_)])])
    return (open_ if whole else None), query


@lru_cache(maxsize=256)
def trigram_query(pattern: str):
    """The Boolean query of lower-cased trigrams for a regex; True if none is mandatory."""
    return _strings(_parser.parse(pattern))[1]


def query_grams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(query_grams, query[1]))


@lru_cache(maxsize=4)
def _numbers(grams: tuple[str, ...]) -> np.ndarray:
    """[trigram as a 24-bit number]: its place in grams, from 1; 0 for all others."""
    out = np.zeros(1 << 24, np.uint8 if len(grams) < 256 else np.uint16)
    for i, g in enumerate(grams, 1):
        out[int.from_bytes(g.encode(), "big")] = i
    return out


class Segment:
    """Inverted index of a piece of the table: trigram -> sorted row numbers."""

    def __init__(self, texts: list[bytes], grams: set[str]):
        self.n, order = len(texts), tuple(sorted(grams))
        self.postings = {g: np.zeros(0, np.int64) for g in order}
        data = np.frombuffer(b"".join(texts).lower(), np.uint8)
        if len(data) < 3 or not order:
            return
        ends, numbers, found = np.cumsum([len(t) for t in texts]), _numbers(order), []
        for start in range(0, len(data) - 2, INDEXED_AT_ONCE):
            part = data[start : start + INDEXED_AT_ONCE + 2].astype(np.uint32)
            number = numbers[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            at = np.flatnonzero(number)
            row = np.searchsorted(ends, at + start, side="right")
            inside = at + start + 2 < ends[row]
            found.append(np.unique(number[at[inside]].astype(np.int64) * self.n + row[inside]))
        pairs = np.unique(np.concatenate(found))
        which, rows = pairs // self.n, pairs % self.n
        for i, g in enumerate(order, 1):
            low, high = np.searchsorted(which, (i, i + 1))
            self.postings[g] = rows[low:high]

    def rows(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        found = self.rows(query[1][0])
        for q in query[1][1:]:
            if query[0] == "and" and not len(found):
                break
            found = np.intersect1d(found, self.rows(q), assume_unique=True) if query[0] == "and" else np.union1d(found, self.rows(q))
        return found


def _run_mask(chars: str) -> bytes:
    inside = set(chars.encode())
    return bytes(1 if c in inside else 0 for c in range(256))


def scan(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text: spans (start, number of the rule, end), sorted."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = Segment(texts, set().union(*map(query_grams, queries)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    decoded: dict[int, str] = {}
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        regex, mask = rule.regex(), _run_mask(rule.run) if rule.run else None
        for i in index.rows(query).tolist():
            if mask and b"\x01" * rule.at_least not in texts[i].translate(mask):
                continue
            if i not in decoded:
                decoded[i] = texts[i].decode("utf-8", "replace")
            found[i] += [(m.start(), k, m.end()) for m in regex.finditer(decoded[i]) if m.end(rule.group) - m.start(rule.group) >= rule.at_least]
    for x in found:
        x.sort()
    return found


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id and spans: array of (kind, start, end), by start, then rule. Texts without a secret have an empty array."""

    def work(texts):
        return [[[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scan(texts, rules)]]

    return common.map_texts(df, id_col, text_col, "spans array<struct<kind:string,start:bigint,end:bigint>>", work)


def masked(text: bytes, spans: list[tuple[int, int, int]], mark: str) -> tuple[str, int]:
    """The text with each union of overlapping spans replaced by mark, and how many there were."""
    joined: list[list[int]] = []
    for s, _, e in spans:
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(e, joined[-1][1])
        else:
            joined.append([s, e])
    t, parts, at = text.decode("utf-8", "replace"), [], 0
    for s, e in joined:
        parts += [t[at:s], mark]
        at = e
    return "".join([*parts, t[at:]]), len(joined)


def mask_secrets(df: DataFrame, keep: str | list[str] = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", names: tuple[str, str] = ("masked_text", "n_masked")) -> DataFrame:
    """The kept columns, the masked text (null texts come back empty) and the number of marks, under these names."""

    def work(texts):
        found = [masked(t, s, mark) for t, s in zip(texts, scan(texts, rules), strict=True)]
        return [[x[0] for x in found], [x[1] for x in found]]

    return common.map_texts(df, keep, text_col, f"`{names[0]}` string, `{names[1]}` bigint", work)


def _digest(kinds: dict[str, int]):
    """SQL for 'kind:start:end' of the spans of these kinds, comma-joined."""
    keep = ",".join(f"'{k}'" for k in kinds)
    return f"array_join(transform(filter(spans, x -> x.kind in ({keep})), x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {r.kind: i for i, r in enumerate(BASE_RULES)}
    every = {r.kind: i for i, r in enumerate(RULES)}
    found = secret_spans(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base],
        F.expr(f"sha2({_digest(base)}, 256)").alias("base_sha256"),
        F.expr(_digest(every)).alias("spans"),
    )
