"""PDFs through whichever library is installed: readers give raw rows of one file, and the operators make blocks of them.

Readers are plain functions of a file's bytes, so that others can be passed in.
None of the libraries is needed to import this module.
"""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_art, collapsed_ends
from ..operators import blocks, joins, pictures

# Libraries by preference.
BACKENDS = ("docling", "pymupdf4llm", "pypdf")
#: Pixels of the longer side of a rendered page.
RENDERED = 2048


def installed(name: str) -> bool:
    return importlib.util.find_spec(name) is not None


def pick_backend(there: Callable[[str], bool] = installed) -> str:
    """The best library that is there."""
    for name in BACKENDS:
        if there(name):
            return name
    raise RuntimeError("no library that reads PDFs is installed: " + ", ".join(BACKENDS))


# Readers: bytes of a file -> tuples


def plain_pages(content: bytes) -> Iterator[tuple[int, str]]:
    """(page, text)."""
    from pypdf import PdfReader

    for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        yield number, page.extract_text() or ""


def markdown_pages(content: bytes) -> Iterator[tuple[int, str]]:
    """(page, Markdown)."""
    import fitz
    import pymupdf4llm

    with fitz.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(pymupdf4llm.to_markdown(doc, page_chunks=True), 1):
            yield (page.get("metadata") or {}).get("page", number), page.get("text") or ""


def document_items(content: bytes) -> Iterator[tuple[int, str, str]]:
    """(page, label, text) of a document model's items; tables as Markdown, page 0 where none is known."""
    from docling.datamodel.base_models import DocumentStream
    from docling.document_converter import DocumentConverter

    doc = DocumentConverter().convert(DocumentStream(name="file.pdf", stream=io.BytesIO(content))).document
    for item, _ in doc.iterate_items():
        where = getattr(item, "prov", None)
        label = str(getattr(item, "label", "")).lower()
        text = item.export_to_markdown() if "table" in label else getattr(item, "text", "")
        yield (where[0].page_no or 0) if where else 0, label, text or ""


def text_boxes(content: bytes) -> Iterator[tuple[int, float, float, float, float, float, float, str]]:
    """(page, width, height, x0, y0, x1, y1, text) of the text boxes."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            for x0, y0, x1, y1, text, _, kind in page.get_text("blocks"):
                if kind == 0:
                    yield number, page.rect.width, page.rect.height, x0, y0, x1, y1, text


def raster_images(content: bytes) -> Iterator[tuple[int, int, float, float, float, float, float, float, bytes]]:
    """(page, xref, width, height, x0, y0, x1, y1, png) of where each embedded picture first stands, rendered with a little room around it."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            width, height = page.rect.width, page.rect.height
            room = 0.02 * max(width, height), 0.01 * max(width, height)
            for image in page.get_images(full=True):
                for box in page.get_image_rects(image[0])[:1]:
                    clip = fitz.Rect(max(0, box.x0 - room[0]), max(0, box.y0 - room[1]), min(width, box.x1 + room[0]), min(height, box.y1 + room[1]))
                    zoom = RENDERED / max(width, height)
                    png = page.get_pixmap(matrix=fitz.Matrix(zoom, zoom), clip=clip, alpha=False).tobytes("png")
                    yield number, image[0], width, height, box.x0, box.y0, box.x1, box.y1, png


def outline_entries(content: bytes) -> Iterator[tuple[int, int, str, int]]:
    """(pos, level, title, page) of the bookmarks."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for pos, (level, title, page) in enumerate(doc.get_toc(simple=True)):
            yield pos, level, str(title), page


def rows_of(files: DataFrame, reader: Callable[[bytes], Iterator[tuple]], fields: str) -> DataFrame:
    """file, the fields of each row that the reader gives of a file (file, content), and error: a file that can't be read is one row with its error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(fields).fieldNames()
    kind = StructType.fromDDL(f"file string, {fields}, error string")

    def run(batches):
        schema = to_arrow_schema(kind)
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [{"file": file, **dict(zip(names, r, strict=True))} for r in reader(content.as_py())]
                except Exception as e:  # noqa: BLE001  readers fail in many ways on broken files
                    rows = [{"file": file, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file", "content").mapInArrow(run, kind)


# Blocks: file, page, block, type, section, text


def flat_text(pages: DataFrame) -> DataFrame:
    """file, text of pages (file, page, text)."""
    found = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return found.select("file", F.array_join("p.text", "\n").alias("text"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """One block for each page (file, page, text) that has text."""
    text = collapsed_ends(F.coalesce("text", F.lit("")))
    return pages.select("file", "page", F.lit(0).alias("block"), F.lit("text").alias("type"), F.lit("").alias("section"), text.alias("text")).where("text <> ''")


def markdown_page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages (file, page, text) of Markdown; a section goes on over pages until the next heading."""
    found = blocks.from_markdown(pages.select(F.struct("file", "page").alias("of"), "text"), "of")
    rows = found.select("of.file", "of.page", F.regexp_extract("block", "b([0-9]+)$", 1).cast("int").alias("block"), "type", F.col("block_text").alias("text"))
    upto = Window.partitionBy("file").orderBy("page", "block")
    section = F.coalesce(F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(upto), F.lit(""))
    return rows.select("file", "page", "block", "type", section.alias("section"), "text")


def item_blocks(items: DataFrame) -> DataFrame:
    """Blocks of a document model's items (file, pos, page, label, text); all items of a page are counted, also those without text."""
    kind = F.when(F.contains("label", F.lit("table")), "table").when(F.col("label").rlike("title|header"), "heading").otherwise("text")
    order = Window.partitionBy("file").orderBy("pos")
    rows = items.withColumns({"type": kind, "text": collapsed_ends(F.coalesce("text", F.lit(""))), "block": F.row_number().over(Window.partitionBy("file", "page").orderBy("pos")) - 1})
    section = F.coalesce(F.last(F.when((F.col("type") == "heading") & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(order), F.lit(""))
    return rows.select("file", "page", "block", "type", section.alias("section"), "text").where("text <> ''")


def plain_text_blocks(boxes: DataFrame) -> DataFrame:
    """Blocks of text boxes (file, pos, page, height, y0, y1, text) of a monospaced document: running heads go, drawings stay as code, lines of prose are joined."""
    rows = blocks.furniture_of_plain_page(boxes.withColumn("text", F.regexp_replace("text", r"\s+$", "")).where("trim(text) <> ''")).where("not is_chrome")
    lines = F.filter(F.transform(F.split("text", "\n"), collapsed_ends), lambda x: x != "")
    drawn = ascii_art(F.col("text"))
    number = F.row_number().over(Window.partitionBy("file", "page").orderBy("pos")) - 1
    return rows.select("file", "page", number.alias("block"), F.when(drawn, "code").otherwise("text").alias("type"), F.lit("").alias("section"), F.when(drawn, F.col("text")).otherwise(F.array_join(lines, " ")).alias("text"))


def picture_blocks(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """file, page, id, bbox, caption of pictures (file, page, xref, width, height, x0, y0, x1, y1, png) that are large enough: each once, with the caption right below it."""
    first = images.withColumn("n", F.row_number().over(Window.partitionBy("file", "xref").orderBy("page", "y0", "x0"))).where("n = 1")
    kept = first.where(pictures.large_enough(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.octet_length("png")))
    share = lambda df: df.withColumns({"x0": F.col("x0") / F.col("width"), "x1": F.col("x1") / F.col("width"), "y0": F.col("y0") / F.col("height"), "y1": F.col("y1") / F.col("height")})
    number = F.row_number().over(Window.partitionBy("file", "page").orderBy("xref"))
    rows = share(kept).withColumn("id", F.format_string("p%d-pic%d", F.col("page"), number))
    texts = share(boxes).select(F.col("file").alias("doc"), "page", F.monotonically_increasing_id().alias("id"), collapsed_ends(F.col("text")).alias("text"), "x0", "y0", "x1", "y1")
    found = joins.caption_below(rows.select(F.col("file").alias("doc"), "page", "id", "x0", "y0", "x1", "y1"), texts)
    both = rows.join(found.select(F.col("doc").alias("file"), "page", F.col("pic").alias("id"), "caption"), ["file", "page", "id"], "left")
    return both.select("file", "page", "id", F.array("x0", "y0", "x1", "y1").alias("bbox"), F.coalesce("caption", F.lit("")).alias("caption"))
