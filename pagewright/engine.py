"""The whole way from extracted documents to answers, over one folder of collections and one of indexes.

    engine = Engine(spark, "/data", "/index")
    engine.ingest("specs")
    engine.search("how are gates timed", "specs", top_k=8, section="8.6.*")

Models are plain functions (operators.models); without any, stand-ins serve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import chunk_id
from .operators import chat, chunk, dense, fusion, ingest, lexical, models
from .sources import files
from .sources.cache import Kept
from .sources.shared import stored

INDEX = "id string, file string, mtime string, collection string, number int, text string, page int, section string, block_type string, vec array<float>"
# Results of a search, candidates that are reranked, and most results a caller gets.
TOP_K, RERANKED, MOST_RESULTS = 8, 30, 40


class UnknownCollection(KeyError):
    """There is no such collection."""


class Engine:
    def __init__(self, spark: SparkSession, root: str, index: str, embed: models.Embed = models.hashed_embedding, routes: dict[str, models.Embed] | None = None, score: models.Score | None = None, preferred: tuple[str, ...] = ()):
        self.spark, self.root, self.index = spark, root.rstrip("/"), index.rstrip("/")
        self.embed, self.routes, self.score, self.preferred = embed, routes or {}, score, preferred
        self.names = Kept(lambda: [r["name"] for r in files.collections(spark, self.root).collect()])
        self._active: str | None = None

    def _known(self, name: str) -> str:
        if name not in self.names.having(lambda found: name in found):
            raise UnknownCollection(name)
        return name

    def _rows(self, name: str) -> DataFrame:
        path = f"{self.index}/{name}"
        found = files._fs(self.spark, path)
        return self.spark.read.schema(INDEX).parquet(path) if found[0].exists(found[1]) else self.spark.createDataFrame([], INDEX)

    def health(self) -> dict:
        return {"ok": True, "collections": len(self.names())}

    def collections(self) -> DataFrame:
        """name, ingested, active."""
        return ingest.with_index_flag(files.collections(self.spark, self.root), files.collections(self.spark, self.index), self.active)

    @property
    def active(self) -> str | None:
        """The collection that serves where none is named; at first the first one."""
        return self._active or next(iter(self.names()), None)

    @active.setter
    def active(self, name: str) -> None:
        self._active = self._known(name)

    def documents(self, name: str) -> DataFrame:
        """file, mtime, blocks of the extracted documents of a collection, and malformed."""
        found = files.cached_documents(self.spark, self.root).where(F.col("collection") == name)
        return found.select("file", F.coalesce("source_mtime", F.lit("")).alias("mtime"), "blocks", "malformed")

    def chunks(self, docs: DataFrame, name: str) -> DataFrame:
        """Index rows of documents (file, mtime, blocks)."""
        found = chunk.chunked_blocks(docs.select(F.struct("file", "mtime").alias("of"), "blocks"), "of")
        rows = found.select(chunk_id(F.lit(name), F.col("of.file"), F.col("chunk")).alias("id"), "of.file", "of.mtime", F.lit(name).alias("collection"), F.col("chunk").alias("number"), "text", "page", "section", "block_type", "embed_input")
        return models.embedded(rows, "embed_input", "collection", self.routes, self.embed).drop("embed_input")

    def ingest(self, name: str, force: bool = False) -> dict:
        """Bring the index of a collection up to date: new and changed documents replace their rows, those that are gone leave. The new index takes the old one's place at once."""
        self._known(name)
        docs = self.documents(name)
        usable = docs.where("not malformed").drop("malformed")
        index = self._rows(name)
        status = stored(ingest.triage(usable.select("file", "mtime"), index.select("file", "mtime"), force), "triage")
        todo = usable.join(status.where("status <> 'unchanged'").select("file"), "file", "left_semi")
        fresh = stored(self.chunks(todo, name), "chunks")
        kept = ingest.only_files(ingest.without_files(index, todo.select("file")), usable.select("file"))
        files.replaced(kept.unionByName(fresh), f"{self.index}/{name}")
        counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        skipped = counts.get("unchanged", 0)
        return {"collection": name, "files": sum(counts.values()), "skipped": skipped, "processed": sum(counts.values()) - skipped, "failed": docs.where("malformed").count(), "total_chunks": fresh.count()}

    def ingest_all(self, force: bool = False) -> list[dict]:
        return [self.ingest(name, force) for name in self.names()]

    def candidates(self, queries: DataFrame, name: str) -> DataFrame:
        """question_id, id, distance, rrf of queries (question_id, query_id, text): both channels fused for each, copies reduced to the preferred one, and the best of a question's queries."""
        rows = self._rows(name)
        limit = fusion.fetch_size(rows.count(), TOP_K, RERANKED)
        asked = stored(queries.select(F.monotonically_increasing_id().alias("q"), "question_id", "query_id", "text"), "asked")
        by_q = asked.select(F.col("q").alias("query_id"), "text")
        near = dense.knn(rows.select(F.xxhash64("id").alias("id"), "vec"), by_q.select("query_id", models.embedding(F.col("text"), self.routes.get(name, self.embed)).alias("vec")), limit)
        keyed = rows.select(F.xxhash64("id").alias("id"), "text", "file")
        fused = stored(fusion.reciprocal_ranks(near, lexical.bm25(keyed, by_q, limit)), "fused")
        best = fusion.canonical_best(keyed.join(fused, "id"), F.col("text"), F.col("file"), list(self.preferred))
        cut = fusion.best(best, RERANKED).join(asked.select(F.col("q").alias("query_id"), "question_id"), "query_id")
        return fusion.union_best(cut.select("question_id", "query_id", "id", "distance", "rrf"))

    def search(self, question: str, name: str | None = None, top_k: int = TOP_K, section: str | None = None, reply: str | None = None) -> DataFrame:
        """rank, id, file, page, section, block_type, text, distance, rrf, rerank_score of the best chunks; reply: a query expander's, whose sub-queries are asked too."""
        name = self._known(name) if name else self.active
        if not question.strip() or name is None:
            raise ValueError("a question and a collection are needed")
        asked = self.spark.createDataFrame([(0, question)], "question_id bigint, text string")
        queries = models.expanded(asked, F.lit(reply) if reply else None)
        rows = self._rows(name).withColumn("key", F.xxhash64("id"))
        found = rows.join(stored(self.candidates(queries, name).withColumnRenamed("id", "key"), "candidates"), "key")
        found = fusion.filtered_section(found, "section", section)
        score = models.rerank_score(F.lit(question), F.col("text"), self.score) if self.score else fusion.overlap_scores(F.lit(question), F.col("text"))
        ranked = fusion.rerank(found, score, min(top_k, MOST_RESULTS), candidates=RERANKED)
        return ranked.select("rank", "id", "file", "page", "section", "block_type", "text", "distance", "rrf", "rerank_score").orderBy("rank")

    def models(self) -> DataFrame:
        """model_id: every collection bare and with its deep profile."""
        return chat.model_catalog(files.collections(self.spark, self.root), "name")

    def prompt(self, question: str, name: str | None = None, rule: str = "Answer only from the numbered context and cite it as [n].", abstain: str = "I don't have enough information in the provided sources to answer that.", **options) -> DataFrame:
        """query_id, prompt, sources, answer: what a generator gets; without matches the abstaining answer."""
        found = self.search(question, name, **options).select(F.lit(0).alias("query_id"), "rank", "file", "page", "section", "text")
        asked = self.spark.createDataFrame([(0, question)], "query_id int, question string")
        return chat.prompts(asked, chat.citations(found), rule, abstain)
