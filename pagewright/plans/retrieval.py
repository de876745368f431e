"""Retrieval: lexical, dense, fused."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector
from ..functions.text import signature
from ..operators import dense, fusion, lexical
from ..sources.shared import stored
from ..sources.tables import table
from .registry import query

PREFERRED = ["src3", "src5", "src0"]
WS = r"[ \t\n\r\f\v\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SIG = f"substring(trim(regexp_replace(regexp_replace(lower(text), '[*_`#|>-]', ' ', 'g'), '{WS}', ' ', 'g')), 1, 300)"
CANON = "case when contains(source, 'src3') then 0 when contains(source, 'src5') then 1 when contains(source, 'src0') then 2 else 3 end"

BM25_CTE = """
tok as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') w from documents),
st as (select count(*)::double n, avg(len(w))::double avgdl from tok),
q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) term from benchmark),
tf as (select doc_id, len, term, count(*)::double tf from (select doc_id, len(w)::double len, unnest(w) term from tok) where term in (select term from q) group by all),
df as (select term, count(*)::double n from tf group by term),
sc as (select q.item_id, tf.doc_id, round(sum(ln(1 + (st.n - df.n + 0.5::double) / (df.n + 0.5::double)) * (tf.tf * 2.5::double) / (tf.tf + 1.5::double * (0.25::double + 0.75::double * (tf.len / st.avgdl)))), 6) score
  from q join tf using (term) join df using (term), st group by all),
bm as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) - 1 as rank from sc where score > 0 qualify rank < 60)"""
KNN_CTE = """
dist as (select b.item_id, e.vec_id as doc_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))), 6) distance
  from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings e),
kn as (select item_id, doc_id, distance, row_number() over (partition by item_id order by distance, doc_id) - 1 as rank from dist qualify rank < 60)"""
RRF_CTE = """
rrf as (select coalesce(k.item_id, b.item_id) item_id, coalesce(k.doc_id, b.doc_id) doc_id, k.distance,
  round(coalesce(1 / (60.0::double + k.rank), 0) + coalesce(1 / (60.0::double + b.rank), 0), 9) rrf
  from kn k full outer join bm b on k.item_id = b.item_id and k.doc_id = b.doc_id)"""
BEST_CTE = f"""
dd as (select r.*, row_number() over (partition by item_id, {SIG} order by {CANON}, rrf desc, doc_id) n from rrf r join documents d using (doc_id)),
cut as (select item_id, doc_id, distance, rrf, row_number() over (partition by item_id order by rrf desc, doc_id) place from dd where n = 1 qualify place <= 30)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _question_vectors(spark, sf_dir):
    """Stand-in for embedding a question: the vector of the same number."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return asked.join(_vectors(spark, sf_dir), F.col("query_id") == F.col("id")).select("query_id", "vec")


@query("select doc_id, term, count(*)::bigint tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) term from documents) group by all")
def tokenize_tf(spark, sf_dir):
    return lexical.term_counts(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), "term", "tf")


@query("""with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) term from documents), n as (select count(*)::double n from documents)
select term, count(*)::bigint n_docs, round(ln(1 + (any_value(n.n) - count(*) + 0.5::double) / (count(*) + 0.5::double)), 6) idf from t, n group by term""")
def doc_freq_idf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    total = docs.select(F.count("*").cast("double")).scalar()
    return lexical.document_frequencies(lexical.term_counts(docs), total).select("term", F.col("n").alias("n_docs"), F.round("idf", 6).alias("idf"))


@query("select count(*)::bigint n_docs, sum(len(w))::bigint n_tokens, round(avg(len(w)), 6)::double avgdl from (select regexp_extract_all(lower(text), '[a-z0-9_]+') w from documents)")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(_docs(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"with {BM25_CTE} select item_id, doc_id, score, rank::int rank from bm")
def bm25_batch(spark, sf_dir):
    found = lexical.bm25(_docs(spark, sf_dir), _questions(spark, sf_dir))
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(f"with {KNN_CTE} select item_id, doc_id vec_id, distance, rank::int rank from kn")
def knn_l2_topk(spark, sf_dir):
    found = dense.knn(_vectors(spark, sf_dir), _question_vectors(spark, sf_dir))
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("vec_id"), "distance", "rank")


@query("""with dist as (select b.item_id, e.vec_id, round(1 - list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: x[1]::double * x[2]::double))
 / ((sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) + 1e-12::double) * (sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))) + 1e-12::double)), 6) distance
 from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings e)
select item_id, vec_id, distance, (row_number() over (partition by item_id order by distance, vec_id) - 1)::int as rank from dist qualify rank < 60""")
def knn_cosine_topk(spark, sf_dir):
    found = dense.knn(_vectors(spark, sf_dir), _question_vectors(spark, sf_dir), metric="cosine")
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("vec_id"), F.abs("distance").alias("distance"), "rank")


@query("""with n as (select vec_id, embedding e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-12::double s from embeddings)
select vec_id, round(s - 1e-12::double, 6) norm, round(list_sum(list_transform(e, lambda x: abs(x::double / s))), 6) l1 from n""")
def vec_normalize(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", "vec", vector.normalised("vec").alias("unit"))
    l1 = F.aggregate("unit", F.lit(0.0), lambda a, x: a + F.abs(x))
    return rows.select(F.col("id").alias("vec_id"), F.round(vector.norm("vec"), 6).alias("norm"), F.round(l1, 6).alias("l1"))


def _fused(spark, sf_dir):
    lex = lexical.bm25(_docs(spark, sf_dir), _questions(spark, sf_dir))
    return fusion.reciprocal_ranks(dense.knn(_vectors(spark, sf_dir), _question_vectors(spark, sf_dir)), lex)


@query(f"with {BM25_CTE}, {KNN_CTE}, {RRF_CTE} select item_id, doc_id, distance, rrf from rrf")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "distance", "rrf")


def candidates(spark, sf_dir):
    """query_id, id, distance, rrf, place and the document's text and source: at most 30 for each question."""
    fused = stored(_fused(spark, sf_dir), "fused")  # at most 120 for each question; texts only move if these can't be broadcast
    items = _docs(spark, sf_dir).join(fused, "id")
    return fusion.best(fusion.canonical_best(items, F.col("text"), F.col("source"), PREFERRED), 30)


@query(f"with {BM25_CTE}, {KNN_CTE}, {RRF_CTE}, {BEST_CTE} select item_id, doc_id, distance, rrf, place::int place from cut where place <= 8")
def hybrid_search(spark, sf_dir):
    found = candidates(spark, sf_dir).where("place <= 8")
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "distance", "rrf", "place")


@query(f"""with {BM25_CTE},
part as (select item_id // 3 question_id, item_id, doc_id, round(1 / (60.0::double + rank), 9) rrf from bm)
select question_id::bigint question_id, doc_id, max(rrf) rrf from part group by all""")
def multiquery_union(spark, sf_dir):
    """Three neighbouring items as the sub-queries of one question."""
    lex = lexical.bm25(_docs(spark, sf_dir), _questions(spark, sf_dir))
    parts = lex.select(F.floor(F.col("query_id") / 3).alias("question_id"), "query_id", "id", F.lit(None).cast("double").alias("distance"), F.round(1 / (60.0 + F.col("rank")), 9).alias("rrf"))
    return fusion.union_best(parts).select("question_id", F.col("id").alias("doc_id"), "rrf")


@query(f"""with {BM25_CTE}, {KNN_CTE}, {RRF_CTE}, {BEST_CTE},
w as (select c.item_id, c.doc_id, c.place, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+')) a, regexp_extract_all(lower(substring(d.text, 1, 2000)), '[a-z0-9_]+') t
 from cut c join benchmark b using (item_id) join documents d using (doc_id)),
s as (select item_id, doc_id, place, case when len(a) > 0 then round(len(list_intersect(a, t))::double / len(a), 6) else 0 end rerank_score from w)
select item_id, doc_id, rerank_score, row_number() over (partition by item_id order by rerank_score desc, place)::int as rank from s qualify rank <= 8""")
def rerank_overlap(spark, sf_dir):
    asked = _questions(spark, sf_dir).select("query_id", F.col("text").alias("question"))
    items = candidates(spark, sf_dir).drop("place").join(asked, "query_id")
    found = fusion.rerank(items, fusion.overlap_scores(F.col("question"), F.col("text")), 8, "query_id")
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rerank_score", "rank")


@query(f"select doc_id, {SIG} sig from documents")
def dedupe_signature(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("id").alias("doc_id"), signature(F.col("text")).alias("sig"))


@query(f"select {SIG} sig, count(*)::bigint n, min(doc_id) first_id from documents group by 1 having count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(signature(F.col("text")).alias("sig")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query(f"select doc_id, source from documents qualify row_number() over (partition by {SIG} order by {CANON}, n_chars desc, doc_id) = 1")
def canonical_best(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("n_chars").alias("rrf"))
    return fusion.canonical_best(docs, F.col("text"), F.col("source"), PREFERRED, []).select(F.col("id").alias("doc_id"), "source")
