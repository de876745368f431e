"""Blocks of documents: from Markdown and tagged text, running sections, page furniture, repetitions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CLAUSE, WHITE, collapsed, furniture_key
from ..sources.shared import small_batches

BLOCK = "struct<id:string,page:int,section:string,section_path:string,type:string,text:string>"


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos (from 0), line."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", section_col: str = "source") -> DataFrame:
    """id, blocks: the lines of a text as blocks; lines with two pipes and more are tables, lines that start with # headings."""
    kind = lambda x: F.when(F.ltrim(x).startswith("#"), "heading").when(F.size(F.split(x, r"\|", -1)) > 2, "table").otherwise("text")
    block = lambda x, i: F.struct(F.concat(F.lit("p1-b"), i.cast("string")).alias("id"), F.lit(1).alias("page"), F.col(section_col).alias("section"), F.col(section_col).alias("section_path"), kind(x).alias("type"), x.alias("text"))
    return docs.select(id_col, F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), block).alias("blocks"))


def from_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: int = 1) -> DataFrame:
    """id, block, page, section, type, block_text of documents in Markdown, each of which is a page.

    Lines are classified, and neighbours of one kind form a block. Within a
    stretch without blank lines, the first line that is neither heading nor
    table begins a paragraph that takes the rest of the stretch. Before it, a
    line that starts with # is a heading, a line with a pipe belongs to a
    table, and a line with both to what the line before it is. A heading sets
    the section from there on; blocks without text only do that. Each row is a
    page of its own, folded where it is, so that no line is shuffled.
    """
    kept = small_batches(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")))
    fields = T.StructType([docs.select(id_col).schema[0], *T.StructType.fromDDL("block string, page int, section string, type string, block_text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary())
            found = [(i, f"p{page}-b{n}", page, *b) for i in range(len(batch)) for n, b in enumerate(_markdown_blocks(texts[i].as_py().decode("utf-8", "replace")))]
            columns = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=fields.names)

    return kept.mapInArrow(run, fields)


_LINE_END = re.compile("\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]")


def _markdown_blocks(text: str) -> list[tuple[str, str, str]]:
    """(section, type, text) of the blocks of one page, as from_markdown() has them."""
    runs: list[tuple[str, list[tuple[str, str]]]] = []
    like, paragraph, fresh = "heading", False, True
    for line in _LINE_END.split(text):
        bare = line.strip(WHITE)
        if not bare:
            like, paragraph, fresh = "heading", False, True
            continue
        marked, piped = bare.startswith("#"), "|" in bare
        paragraph = paragraph or not marked and not piped
        if marked != piped:
            like = "heading" if marked else "table"
        kind = "text" if paragraph else like
        if fresh or kind == "heading" or runs[-1][0] != kind:
            runs.append((kind, []))
        runs[-1][1].append((line, bare))
        fresh = False
    out, section = [], ""
    for kind, lines in runs:
        if kind == "heading":
            body = section = lines[0][1].lstrip("#").strip(WHITE)
        else:
            body = "\n".join(x for x, _ in lines).strip(WHITE) if kind == "table" else " ".join(x for _, x in lines)
        if body:
            out.append((section, kind, body))
    return out


def running_section(blocks: DataFrame, keys: list[str], order: str, heading: str = "heading") -> DataFrame:
    """Adds section: the text of the last heading up to each block, null before the first."""
    upto = Window.partitionBy(*keys).orderBy(order)
    return blocks.withColumn("section", F.last(F.when(F.col("type") == heading, F.col("text")), ignorenulls=True).over(upto))


def resectioned(blocks: DataFrame, keys: list[str], order: str, role: str | None = None) -> DataFrame:
    """Sections from numbered headings: a bare number waits for the next heading as its title, other headings count as noise.

    A block before the first numbered heading keeps its section. role: a column
    that tells what a heading is, whatever its text looks like: a number (with
    or without its title), a title, or noise; null: the text decides.
    """
    upto = Window.partitionBy(*keys).orderBy(order)
    head = F.coalesce(F.col("type") == "heading", F.lit(False))
    same = Window.partitionBy(*keys, "__head").orderBy(order)
    given = F.col(role) if role else F.lit(None).cast("string")
    text = collapsed(F.coalesce(F.col("text"), F.lit("")))
    rows = blocks.withColumns({"__head": head, "__t": text, "__role": given})
    part = lambda i: F.when(F.coalesce(F.col("__role") == "number", F.lit(True)), F.regexp_extract("__t", CLAUSE, i)).otherwise("")
    rows = rows.withColumns({"__num": part(1), "__title": part(2)})
    before = F.lag(F.struct("__num", "__title")).over(same)
    waiting = (before["__num"] != "") & (before["__title"] == "") & F.coalesce(F.col("__role") == "title", F.lit(True))
    value = F.when((F.col("__num") != "") & (F.col("__title") != ""), F.concat_ws(" ", "__num", "__title")).when(F.col("__num") != "", F.col("__num")).when(waiting, F.concat_ws(" ", before["__num"], F.col("__t")))
    found = rows.withColumn("__section", F.when(F.col("__head"), value))
    now = F.last("__section", ignorenulls=True).over(upto)
    return found.withColumn("section", F.coalesce(now, F.col("section"))).drop("__head", "__t", "__role", "__num", "__title", "__section")


def first_lines(lines: DataFrame, keys: list[str], order: str = "pos", line: str = "line") -> DataFrame:
    """The first occurrence of each line."""
    place = Window.partitionBy(*keys, line).orderBy(order)
    return lines.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def until_runaway(lines: DataFrame, keys: list[str], order: str = "pos", line: str = "line", times: int = 3, least: int = 20) -> DataFrame:
    """Lines before a line of at least `least` characters that comes for more than the `times`-th time."""
    key = F.lower(collapsed(F.col(line)))
    counted = lines.withColumn("__k", key)
    nth = F.row_number().over(Window.partitionBy(*keys, "__k").orderBy(order))
    marked = counted.withColumn("__cut", (F.length("__k") >= least) & (nth > times))
    first = F.min(F.when(F.col("__cut"), F.col(order))).over(Window.partitionBy(*keys))
    return marked.withColumn("__first", first).where(F.col("__first").isNull() | (F.col(order) < F.col("__first"))).drop("__k", "__cut", "__first")


def page_furniture(lines: DataFrame, keys: list[str], marker: str, order: str = "pos", line: str = "line", reach: int = 4, simple: bool = False) -> DataFrame:
    """keys, furniture, n: keys of lines that recur within `reach` lines of page markers; marker: SQL condition.

    simple: as in furniture_key(). At least three markers must be there; a line counts once for each marker
    near it, and must reach a fifth of the markers, and two.
    """
    marked = lines.withColumn("__m", F.expr(marker).cast("int"))
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    own = Window.partitionBy(*keys)
    text = F.trim(F.col(line))
    rows = marked.withColumns({"__near": F.sum("__m").over(near) - F.col("__m"), "__all": F.sum("__m").over(own), "furniture": furniture_key(text, simple=simple)})
    kept = rows.where((F.col("__near") > 0) & (F.col("__all") >= 3) & (text != "") & (F.length(text) <= 500) & (F.length("furniture") >= 8))
    found = kept.groupBy(*keys, "furniture").agg(F.sum("__near").alias("n"), F.first("__all").alias("__all"))
    return found.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("__all") / 5))).drop("__all")


# Fixed value: tagged layout output: corner, content, corner, class.
TAGGED = r"(?s)<x_([0-9.]+)><y_([0-9.]+)>(.*?)<x_([0-9.]+)><y_([0-9.]+)><class_([^>]+)>"


def layout_records(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, cls, content, bbox of the records of tagged layout text."""
    group = lambda i: F.regexp_extract_all(F.col(text_col), F.lit(TAGGED), i)
    each = F.arrays_zip(*[group(i).alias(f"g{i}") for i in range(1, 7)])
    rows = pages.select(id_col, F.posexplode(each).alias("pos", "r"))
    number = lambda i: F.col(f"r.g{i}").cast("double")
    return rows.select(id_col, "pos", F.col("r.g6").alias("cls"), F.trim("r.g3").alias("content"), F.array(number(1), number(2), number(4), number(5)).alias("bbox"))


def without_layout_tags(text):
    """Text without coordinate, class and box tags; escaped \\<...\\> stays."""
    return F.trim(F.regexp_replace(text, r"(?<!\\)<(?:x_[0-9.]+|y_[0-9.]+|class_[^>]+|/?(?:bbox|text|page|s))>", ""))


def furniture_of_plain_page(blocks: DataFrame, top: str = "y0", bottom: str = "y1", height: str = "height", band: float = 60) -> DataFrame:
    """Adds is_chrome: a single line in the top or bottom band, or one that ends in [Page n]."""
    single = ~F.contains(F.trim("text"), F.lit("\n"))
    edge = (F.col(bottom) < band) | (F.col(top) > F.col(height) - band)
    return blocks.withColumn("is_chrome", (single & edge) | F.col("text").rlike(r"\[Page \d+\]\s*$"))


def picture_text(caption, description):
    """Caption and description as a picture's text, whichever there are."""
    some = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    return F.concat_ws("\n\n", some(caption), some(description))


def invalidated(blocks: DataFrame, only_prompt: str | None = None) -> DataFrame:
    """Pictures (of one prompt) without their model text; their text is the caption again."""
    hit = F.col("type") == "picture"
    if only_prompt is not None:
        hit = hit & F.col("vlm_prompt_id").eqNullSafe(only_prompt)
    hit = F.coalesce(hit, F.lit(False))
    cleared = {c: F.when(~hit, F.col(c)) for c in ("vlm_description", "vlm_description_raw", "vlm_model", "vlm_prompt_id")}
    return blocks.withColumns(cleared | {"text": F.when(hit, F.coalesce("caption", F.lit(""))).otherwise(F.col("text"))})


def normalised_box(x0, y0, x1, y1, width, height, pad: float = 0.0):
    """A box as shares of the page, padded and clamped."""
    share = lambda v, size, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size + d))
    return F.array(share(x0, width, -pad), share(y0, height, -pad), share(x1, width, pad), share(y1, height, pad))


# Languages of source files by extension.
LANGUAGES = {"c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "hh": "cpp", "py": "python", "go": "go", "rs": "rust", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "rb": "ruby"}


def language_of(path):
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension]


def encoded_path(path):
    return F.regexp_replace(path, r"[/\\]", "__")


def decoded_path(name):
    return F.replace(name, F.lit("__"), F.lit("/"))


def code_link(base, path, first, last):
    return F.when(F.coalesce(base, F.lit("")) != "", F.format_string("%s/%s#L%d-L%d", base, path, first, last))
