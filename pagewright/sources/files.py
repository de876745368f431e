"""Collections of files: listings, source trees, extracted documents, and how they are written.

A collection is a folder below the root. Its extracted documents are JSON files
of one document each, <collection>/.rag-cache/<file>.json, or a table of JSON
lines that write_documents() partitions by collection.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import any_glob, looks_binary

# Where extracted documents stand, and their fields.
CACHE = ".rag-cache"
BLOCKS = (
    "array<struct<id:string,page:int,section:string,section_path:string,type:string,text:string,bbox:array<double>,caption:string,image_path:string,"
    "vlm_description:string,vlm_description_raw:string,vlm_model:string,vlm_prompt_id:string,file_path:string,line_start:int,line_end:int,language:string,github_url:string>>"
)
DOCUMENT = f"doc string, source_mtime string, backend string, blocks {BLOCKS}"
# Which files of a source tree count by default, and how large one may be.
INCLUDE = [
    "*.c", "*.h", "*.cpp", "*.hpp", "*.cc", "*.hh", "*.py", "*.go", "*.rs", "*.js", "*.jsx", "*.ts", "*.tsx", "*.java", "*.kt", "*.swift", "*.rb", "*.md", "*.txt", "*.rst",
    "*.yaml", "*.yml", "*.toml", "*.ini", "*.json", "*.cfg", "*.conf", "Makefile", "Dockerfile", "CMakeLists.txt", "*.cmake", "*.sh", "*.bash",
]
EXCLUDE = [
    ".git/*", ".git/**/*", "node_modules/*", "node_modules/**/*", "vendor/*", "vendor/**/*", "__pycache__/*", "**/__pycache__/*", "**/__pycache__/**/*", "build/*", "build/**/*", "dist/*", "dist/**/*",
    "*.min.js", "*.lock", "*.map", "*.pb.go", "*.pb.cc", "*.pb.h", "testdata/*", "**/testdata/*", "**/testdata/**/*",
]
MOST_BYTES = 1024 * 1024
GIT_SOURCE = ".git-source.yaml"


def _fs(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def collections(spark: SparkSession, root: str) -> DataFrame:
    """name of each folder of the root that isn't hidden, sorted; none if there is no root."""
    fs, path = _fs(spark, root)
    found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return spark.createDataFrame([(n,) for n in sorted(found) if not n.startswith(".")], "name string")


def _listing(spark: SparkSession, pattern: str, glob: str | None = None) -> DataFrame:
    """path, mtime, bytes, content of files; content is read only where it is used."""
    fs, path = _fs(spark, pattern)
    if not fs.globStatus(path):
        return spark.createDataFrame([], "path string, mtime timestamp, bytes bigint, content binary")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (read.option("pathGlobFilter", glob) if glob else read).load(pattern)
    return found.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"), "content")


def _base(spark: SparkSession, root: str) -> str:
    """The root as paths of listed files start."""
    fs, path = _fs(spark, root)
    return fs.makeQualified(path).toString().rstrip("/") + "/"


def pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """collection, file, mtime, bytes of the PDFs right below each collection's folder."""
    below = F.split(F.substring("path", len(_base(spark, root)) + 1, 1 << 20), "/")
    found = _listing(spark, f"{root.rstrip('/')}/*", "*.[pP][dD][fF]").select(below.alias("p"), "mtime", "bytes").where("size(p) = 2")
    return found.select(F.col("p")[0].alias("collection"), F.col("p")[1].alias("file"), "mtime", "bytes").where(~F.col("collection").startswith("."))


def small_enough(size: Column, most_mb: float) -> Column:
    """Under a cap in millions of bytes; 0 is no cap."""
    return F.lit(most_mb <= 0) | (size <= most_mb * 1_000_000)


def plain_text_pdf(file: Column) -> Column:
    return F.lower(file).endswith(".txt.pdf")


def smallest_first(files: DataFrame) -> DataFrame:
    """Files with their place (from 1) in the order in which a collection's are processed."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy("collection").orderBy("bytes", "file")))


def eligible(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """A path of a source tree counts: some pattern includes it, none excludes it. Own exclusions come before the default ones, own inclusions replace those."""
    return any_glob(path, include or INCLUDE) & ~any_glob(path, [*(exclude or []), *EXCLUDE])


def source_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path (below the root), mtime, bytes, text of the source files of a tree: eligible, not too large, not binary; hidden folders don't count."""
    found = _listing(spark, root).where(F.col("bytes") <= most_bytes)
    rows = found.withColumn("path", F.substring("path", len(_base(spark, root)) + 1, 1 << 20)).where(eligible(F.col("path"), include, exclude))
    return rows.where(~looks_binary(F.col("content"))).withColumn("text", F.expr("try_validate_utf8(cast(content as string))")).drop("content")


def source_options(options: dict) -> dict:
    """Options of a source tree: url, ref, sparse_paths, include_globs, exclude_globs; lists may be comma-separated text."""
    parts = lambda x: [p.strip() for p in x.split(",") if p.strip()] if isinstance(x, str) else list(x or [])
    return {"url": options.get("url"), "ref": options.get("ref"), **{k: parts(options.get(k)) for k in ("sparse_paths", "include_globs", "exclude_globs")}}


def code_collections(files: DataFrame) -> DataFrame:
    """collection, is_code of files (collection, file): it has options of a source tree, or a source file."""
    base = F.regexp_extract("file", "([^/]*)$", 1)
    source = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)).isin("c", "h", "cpp", "hpp", "cc", "hh", "py", "go", "rs", "js", "jsx", "ts", "tsx", "java", "rb")
    return files.groupBy("collection").agg(F.max((base == GIT_SOURCE) | source).alias("is_code"))


def parsed_documents(rows: DataFrame, text_col: str = "value") -> DataFrame:
    """rows with doc, source_mtime, backend, blocks of their JSON, and malformed: it isn't an object with blocks.

    A section_path that is a list becomes its parts, comma-joined, as clause keys take it.
    """
    names = ["doc", "source_mtime", "backend", "blocks"]
    found = rows.withColumn("__d", F.from_json(text_col, DOCUMENT, {"mode": "PERMISSIVE"}))
    path = lambda b: F.when(b["section_path"].startswith("["), F.array_join(F.from_json(b["section_path"], "array<string>"), ",")).otherwise(b["section_path"])
    blocks = F.transform("__d.blocks", lambda b: b.withField("section_path", path(b)))
    rows = found.select(*rows.columns, *[(blocks if n == "blocks" else F.col(f"__d.{n}")).alias(n) for n in names])
    return rows.withColumn("malformed", F.col("blocks").isNull())


def cached_documents(spark: SparkSession, root: str) -> DataFrame:
    """collection, file, doc, source_mtime, backend, blocks, malformed of the extracted documents of all collections."""
    pattern = f"{root.rstrip('/')}/*/{CACHE}/*.json"
    fs, path = _fs(spark, pattern)
    if not fs.globStatus(path):
        return spark.createDataFrame([], f"collection string, file string, {DOCUMENT}, malformed boolean")
    raw = spark.read.option("wholetext", "true").text(pattern).select("value", F.split("_metadata.file_path", "/").alias("p"))
    name = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    rows = raw.select("value", name(F.get("p", F.size("p") - 3)).alias("collection"), F.regexp_replace(name(F.element_at("p", -1)), r"(?i)\.json$", "").alias("file"))
    return parsed_documents(rows).drop("value")


def write_documents(docs: DataFrame, path: str) -> None:
    """docs (collection, file, doc, source_mtime, backend, blocks) as JSON lines, a folder for each collection."""
    docs.write.partitionBy("collection").option("ignoreNullFields", "true").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """What write_documents() wrote."""
    return spark.read.schema(f"file string, {DOCUMENT}, collection string").json(path)


def replaced(df: DataFrame, path: str) -> None:
    """Write df beside the table at the path, as Parquet, then take its place by renaming: readers see the old table or the new one."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    df.write.parquet(fresh)
    fs, target = _fs(spark, path)
    if fs.exists(target) and not fs.rename(target, _fs(spark, old)[1]):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(_fs(spark, fresh)[1], target):
        raise OSError(f"{fresh} can't be moved to {path}")
    fs.delete(_fs(spark, old)[1], True)


def write_run(results: DataFrame, path: str) -> None:
    """Results of a run as JSON lines; a run of that name must not be there."""
    results.write.mode("errorifexists").json(path)


def stale(sources: DataFrame, extracted: DataFrame, backend: str | None = None, force: bool = False) -> DataFrame:
    """Sources (file, mtime) to extract: no document of theirs has the same time (and backend, if one is named)."""
    same = extracted.select("file", F.col("source_mtime").alias("mtime"), "backend")
    if backend is not None:
        same = same.where(F.col("backend").eqNullSafe(backend))
    return sources if force else sources.join(same.select("file", "mtime").distinct(), ["file", "mtime"], "left_anti")


def stale_renderings(docs: DataFrame, rendered: DataFrame) -> DataFrame:
    """Documents (file, mtime) whose rendering (file, rendered_at) is missing or older."""
    at = rendered.groupBy("file").agg(F.max("rendered_at").alias("rendered_at"))
    return docs.join(at, "file", "left").where(F.col("rendered_at").isNull() | (F.col("rendered_at") < F.col("mtime"))).drop("rendered_at")

