"""Documents as Markdown, tables as Markdown tables, picture reviews as HTML."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped_html, heading_level
from .chunk import by_document

_CLAUSE = re.compile(r"(\d+(?:\.\d+)*)\b")


def level_of(section: str) -> int:
    """2 to 4 by the depth of the clause number (up to two levels: 2); 3 without one."""
    number = _CLAUSE.match(section.lstrip("*_# ").strip())
    return 3 if not number else min(4, max(2, 1 + number[1].count(".")))


def table_of(rows: list[list[str]]) -> str:
    """A Markdown table; rows are filled up to the commonest width, single cells among wider rows start a new table."""
    rows = [[c.strip().replace("|", "\\|").replace("\n", "<br>") for c in r] for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    sizes = [len(r) for r in rows]
    width = max(dict.fromkeys(sizes), key=sizes.count)
    out: list[str] = []
    fresh = True
    for r in rows:
        if len(r) == 1 < width:
            out += [*([""] if out else []), f"**{r[0]}**", ""]
            fresh = True
            continue
        r = (r + [""] * width)[: max(width, len(r))]
        out.append("| " + " | ".join(r) + " |")
        if fresh:
            out.append("|" + " --- |" * len(r))
            fresh = False
    return "\n".join(out)


def cells_of_latex(text: str) -> list[list[str]]:
    """Rows and cells of a LaTeX tabular body; escaped ampersands stay."""
    body = re.sub(r"\\(?:begin|end)\{tabular\}(?:\{[^}]*\})?|\\hline|\\(?:top|mid|bottom)rule", "", text)
    return [[c.replace("\\&", "&").strip() for c in re.split(r"(?<!\\)&", row)] for row in re.split(r"\\\\", body) if row.strip()]


def latex_tables(text: str) -> str:
    """LaTeX tabulars become Markdown tables, or lists if they have one column."""

    def one(m: re.Match) -> str:
        rows = cells_of_latex(m[0])
        return "\n".join(f"- {r[0]}" for r in rows if r[0]) if rows and max(map(len, rows)) == 1 else table_of(rows)

    return re.sub(r"\\begin\{tabular\}.*?\\end\{tabular\}", one, text, flags=re.DOTALL)


def markdown(blocks: list[dict]) -> str:
    """A document's blocks: a comment where the page changes, headings by clause depth, pictures as quoted figures."""
    out, page = [], None
    for b in blocks:
        text, kind = (b.get("text") or "").strip(), b.get("type") or "text"
        if b.get("page") is not None and b["page"] != page:
            page = b["page"]
            out.append(f"<!-- page {page} -->")
        if not text:
            continue
        if kind == "heading":
            text = "#" * level_of(text) + " " + text.lstrip("# ")
        elif kind == "picture":
            text = "\n".join("> " + x for x in text.split("\n"))
        elif kind == "code":
            text = f"```\n{text}\n```"
        elif kind == "table" and "\\begin{tabular}" not in text:
            text = table_of([[c for c in row.strip().strip("|").split("|")] for row in text.split("\n") if not re.fullmatch(r"[\s|:-]+", row)])
        out.append(latex_tables(text))
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(out)).strip()


def documents_as_markdown(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, markdown of documents with an array of blocks in order."""
    return by_document(docs, lambda blocks: [(markdown([dict(b) for b in (blocks if blocks is not None else [])]),)], "markdown string", id_col)


def review_page(pictures: DataFrame) -> DataFrame:
    """doc, n, n_captioned, html: the pictures (doc, id, caption, captioned) of each document as table rows."""
    row = F.concat(F.lit("<tr><td>"), F.col("id").cast("string"), F.lit("</td><td>"), escaped_html(F.coalesce("caption", F.lit(""))), F.lit("</td></tr>"))
    found = pictures.groupBy("doc").agg(F.count("*").alias("n"), F.count_if("captioned").alias("n_captioned"), F.array_sort(F.collect_list(F.struct("id", row.alias("row")))).alias("rows"))
    return found.select("doc", "n", "n_captioned", F.concat(F.lit("<h2>"), escaped_html(F.col("doc")), F.lit("</h2><table>"), F.array_join("rows.row", ""), F.lit("</table>")).alias("html"))


__all__ = ["documents_as_markdown", "heading_level", "latex_tables", "markdown", "review_page", "table_of"]
