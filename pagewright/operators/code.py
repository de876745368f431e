"""Source files as chunks: what a parser finds, with its comments, else windows of lines."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import code_link, language_of
from .chunk import WINDOW_CHARS, line_windows

#: (first line, last line, name) from 0 of the definitions of a text; None if it can't be parsed.
Parser = Callable[[str], list[tuple[int, int, str]] | None]
# How lines of a comment start.
COMMENT = ("//", "/*", "*/", "*")


def python_definitions(text: str) -> list[tuple[int, int, str]] | None:
    """Functions and classes of Python that stand in no other one, with their decorators."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found, open_ = [], [tree]
    while open_:
        for node in ast.iter_child_nodes(open_.pop()):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                found.append((first - 1, (node.end_lineno or node.lineno) - 1, node.name))
            else:
                open_.append(node)
    return sorted(found)


#: Parsers by language; others can be added where a parser library is installed.
PARSERS: dict[str, Parser] = {"python": python_definitions}


def comment_above(lines: list[str], at: int) -> int:
    """Where the comment right above a line starts; blank lines count only between lines of the comment."""
    kinds = ["blank" if not x.strip() else "comment" if x.strip().startswith(COMMENT) else "code" for x in lines[:at]]
    code = max((i for i, k in enumerate(kinds) if k == "code"), default=-1)
    if not kinds or kinds[-1] != "comment":
        return at
    return next(i for i in range(code + 1, at) if kinds[i] == "comment")


def code_chunks(text: str, parser: Parser | None) -> list[tuple[int, int, str, str]]:
    """(first line, last line, name, text): a chunk for each definition with the comment above it, and one for what stands before the first.

    Chunks over twice a window's size are cut into windows; so is a text that no
    parser takes or that defines nothing.
    """
    windows = lambda t, first, name: [(first + a, first + b, f"{name}chunk-{i}", t[c : c + n]) for i, (a, b, c, n) in enumerate(line_windows(t), 1)]
    found = parser(text) if parser else None
    if not found:
        return windows(text, 0, "")
    lines = text.splitlines(keepends=True)
    places = [(comment_above(lines, a), b + 1, name or f"chunk-{a + 1}") for a, b, name in found]
    before = min(a for a, _, _ in places)
    if "".join(lines[:before]).strip():
        places.insert(0, (0, before, "preamble"))
    out = []
    for a, b, name in places:
        body = "".join(lines[a:b])
        out += windows(body, a, f"{name}:") if len(body) > 2 * WINDOW_CHARS else [(a + 1, b, name, body)]
    return out


def code_blocks(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """path, block, section, section_path, text, line_start, line_end, language, github_url of files (path, text, base); base: where the repository's files are shown, or null."""
    known, names = PARSERS if parsers is None else parsers, ("line_start", "line_end", "name", "text")
    kind = pa.list_(pa.struct([("line_start", pa.int32()), ("line_end", pa.int32()), ("name", pa.string()), ("text", pa.string())]))

    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        rows = [code_chunks(t.as_py() or "", known.get(x.as_py() or "")) for t, x in zip(texts, languages, strict=True)]
        return pa.array([[dict(zip(names, c, strict=True)) for c in r] for r in rows], kind)

    chunks = F.arrow_udf(run, "array<struct<line_start:int,line_end:int,name:string,text:string>>").asNondeterministic()
    rows = files.select("path", "base", language_of(F.col("path")).alias("language"), "text")
    each = rows.select("path", "base", "language", chunks("text", "language").alias("c")).select("path", "base", "language", F.posexplode("c").alias("block", "c"))
    link = code_link(F.col("base"), F.col("path"), F.col("c.line_start"), F.col("c.line_end"))
    return each.select("path", "block", F.concat_ws(" :: ", "path", "c.name").alias("section"), F.replace("path", F.lit("/"), F.lit(",")).alias("section_path"), "c.text", "c.line_start", "c.line_end", "language", link.alias("github_url"))
