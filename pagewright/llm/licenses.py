"""License scan: exact phrases, and a fuzzy search of short notices.

Words are runs of ASCII letters, digits and non-ASCII characters of the
lower-cased text; matching works on the words joined by single spaces.

Base phrases are found wherever their words stand consecutively. Each notice is
searched with up to `errors` edits: it is cut into errors + SURE seeds, of which
an approximate match contains at least SURE unchanged and in about their places
(pigeonhole); one Aho-Corasick pass finds all seeds, and the regex library's
bounded-error matching verifies the windows around them and reports spans.
What tells licenses apart is outside the edits: words of a match that name the
license, the version behind it and the clauses of Creative Commons must stand
there exactly, and a match is widened to whole words at the cost of an edit for
each character.

Defined cases: null text is the empty text (no words, no labels, score 0);
equal texts give equal rows; texts of any length are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

# Phrases and labels of the contract.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Notice:
    """words: searched with edits. sure: words that a match must hold unchanged. then: (regex of the words that follow, label); label stands where none fits, "" for none. clauses: Creative Commons clauses that follow are part of the label."""

    words: str
    label: str
    errors: int
    sure: tuple[str, ...] = ()
    then: tuple[tuple[str, str], ...] = ()
    clauses: bool = False


# Versions and clauses as they are printed, in normalised words.
APACHE = ((r"2(?: 0)?(?![^ ]| [1-9])", "apache-2"), (r"1 1(?![^ ])", "apache-1.1"), (r"1 0(?![^ ])", "apache-1"))
MOZILLA = ((r"(?:version |v )?2(?: 0)?(?![^ ]| [1-9])", "mpl-2"), (r"(?:version |v )?1 1(?![^ ])", "mpl-1.1"))
CLAUSES = {"nc": "nc", "noncommercial": "nc", "non commercial": "nc", "nd": "nd", "noderivatives": "nd", "noderivs": "nd", "no derivatives": "nd", "no derivs": "nd", "sa": "sa", "sharealike": "sa", "share alike": "sa"}
# Short notices of common licenses as they are printed, in normalised words, with the edits allowed.
NOTICES = (
    Notice("permission is hereby granted free of charge", "mit", 3),
    Notice("under the mit license", "mit", 2, ("mit",)),
    Notice("apache license version", "", 2, ("apache",), APACHE),
    Notice("redistribution and use in source and binary forms", "bsd", 3),
    Notice("the terms of the gnu general public license", "gpl", 3, ("gnu", "general")),
    Notice("the gnu lesser general public license", "lgpl", 3, ("gnu", "lesser")),
    Notice("the gnu library general public license", "lgpl", 3, ("gnu", "library")),
    Notice("the gnu affero general public license", "agpl", 3, ("gnu", "affero")),
    Notice("mozilla public license", "mpl", 2, ("mozilla",), MOZILLA),
    Notice("creative commons attribution", "cc-by", 3, ("creative", "commons"), clauses=True),
    Notice("cc by", "cc-by", 0, clauses=True),
    Notice("all rights reserved", "all-rights-reserved", 1, ("all", "rights")),
)

#: Seeds that any match contains unchanged.
SURE = 3

_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def seeds_of(notice: Notice) -> list[tuple[str, int]]:
    """errors + SURE pieces that cover the notice, with their offsets."""
    n, k = len(notice.words), notice.errors + SURE
    cuts = [i * n // k for i in range(k + 1)]
    return [(notice.words[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def compiled(notices: tuple[Notice, ...]):
    """An automaton whose entries list (notice number, seed offset), and a bounded-error regex for each notice."""
    by_seed: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        if not notice.errors:
            continue
        for seed, at in seeds_of(notice):
            by_seed.setdefault(seed, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for seed, where in by_seed.items():
        automaton.add_word(seed, (len(seed), where))
    automaton.make_automaton()
    return automaton, [regex.compile(f"(?e)(?:{regex.escape(x.words)}){{e<={x.errors}}}") for x in notices]


_CLAUSE = regex.compile(rf"(?:(?:{'|'.join(sorted(CLAUSES, key=len, reverse=True))})(?![^ ]) ?)+")
_ONE_CLAUSE = regex.compile(rf"(?:{'|'.join(sorted(CLAUSES, key=len, reverse=True))})(?![^ ])")


def named(text: str, notice: Notice, start: int, end: int, edits: int) -> tuple[str, int, int, int] | None:
    """(label, start, end, edits) of a match widened to whole words, or None if it is of another license."""
    low, high = text.rfind(" ", 0, start) + 1, text.find(" ", end)
    high = len(text) if high < 0 else high
    if text[start] == " ":
        low = start + 1
    if end > start and text[end - 1] == " ":
        high = end - 1
    edits += max(0, start - low) + max(0, high - end)
    words = text[low:high].split(" ")
    if edits > notice.errors or not all(w in words for w in notice.sure):
        return None
    label, behind = notice.label, high + 1
    for pattern, name in notice.then:
        if m := regex.compile(pattern).match(text, behind):
            label, high = name, m.end()
            break
    if notice.clauses and (m := _CLAUSE.match(text, behind)):
        found = [CLAUSES[x] for x in _ONE_CLAUSE.findall(m[0])]
        label, high = "-".join([label, *dict.fromkeys(found)]), m.end() - m[0].endswith(" ")
    return (label, low, high, edits) if label else None


def spans_of(text: str, notices: tuple[Notice, ...]) -> list[dict]:
    """label, start, end, edits and share of the licenses found in a normalised text."""
    exact = [(i, m.start(), m.end(), 0) for i, x in enumerate(notices) if not x.errors for m in regex.finditer(rf"(?<![^ ]){regex.escape(x.words)}(?![^ ])", text)]
    out = []
    for i, *where in sorted([*fuzzy_matches(text, notices), *exact], key=lambda x: (x[1], x[0])):
        if found := named(text, notices[i], *where):
            label, start, end, edits = found
            out.append({"label": label, "start": start, "end": end, "edits": edits, "share": 1 - edits / len(notices[i].words)})
    return out


def fuzzy_matches(text: str, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice number, start, end, edits) of matches in a normalised text, in order."""
    automaton, patterns = compiled(notices)
    origins: dict[int, list[tuple[int, int]]] = {}
    for end, (length, where) in automaton.iter(text):
        for i, at in where:
            origins.setdefault(i, []).append((end + 1 - length - at, at))
    out = []
    for i, found in origins.items():
        if len(found) < SURE:
            continue
        n, k = len(notices[i].words), notices[i].errors
        found.sort()
        merged: list[list[int]] = []
        first = 0
        for last, (origin, _) in enumerate(found):  # unchanged seeds of a match agree on its origin up to k places either way
            while found[first][0] < origin - 2 * k:
                first += 1
            if len({at for _, at in found[first : last + 1]}) < SURE:
                continue
            low, high = max(0, found[first][0] - 2 * k), min(len(text), origin + n + 2 * k)
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(high, merged[-1][1])
            else:
                merged.append([low, high])
        for low, high in merged:
            out += [(i, m.start(), m.end(), sum(m.fuzzy_counts)) for m in patterns[i].finditer(text, low, high)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def exact_places(text: bytes, phrase: str) -> list[int]:
    """First word's number of each place in a normalised text where the phrase's words stand."""
    padded, wanted, out = b" " + text + b" ", b" " + phrase.encode() + b" ", []
    at, words, last = padded.find(wanted), 0, 0
    while at >= 0:
        words += padded.count(b" ", last, at)
        last = at
        out.append(words)
        at = padded.find(wanted, at + 1)
    return out


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """id, n_words, places: array of (label, word) of exact phrases, spans: array of (label, start, end, edits, share).

    start and end are offsets in the normalised text, share is 1 - edits / length of the notice.
    """
    phrases = BASE_PHRASES if phrases is None else phrases

    def work(texts):
        n_words, places, spans = [], [], []
        for t in texts:
            words = words_of(t)
            text = b" ".join(words)
            n_words.append(len(words))
            places.append(sorted(({"label": label, "word": w} for p, label in phrases.items() for w in exact_places(text, p)), key=lambda x: (x["word"], x["label"])))
            spans.append(spans_of(text.decode("utf-8", "replace"), notices))
        return [n_words, places, spans]

    fields = "n_words bigint, places array<struct<label:string,word:bigint>>, spans array<struct<label:string,start:bigint,end:bigint,edits:bigint,share:double>>"
    return common.map_texts(df, id_col, text_col, fields, work)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(common.table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_words",
        "cast(size(places) as bigint) as n_base",
        "array_min(places.word) as first_word",
        "array_max(places.word) as last_word",
        "array_join(array_sort(array_distinct(places.label)), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(places.label, spans.label))), ',') as labels",
        "case when size(places) > 0 then 1D when size(spans) > 0 then array_max(spans.share) else 0D end as score",
        "cast(size(spans) as bigint) as n_fuzzy",
    )
