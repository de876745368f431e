"""Evaluation, prompts and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chat, dense, evaluation, lexical
from ..sources.tables import table
from ..streaming import events as stream
from .registry import query
from .retrieval import BEST_CTE, BM25_CTE, KNN_CTE, RRF_CTE, _docs, _question_vectors, _questions, _vectors, candidates

RULE, ABSTAIN = "Answer only from the numbered context and cite it as [n].", "I don't have enough information in the provided sources to answer that."


def _results(spark, sf_dir):
    lex = lexical.bm25(_docs(spark, sf_dir), _questions(spark, sf_dir), 10)
    return lex.join(_docs(spark, sf_dir), "id").select("query_id", (F.col("rank") + 1).alias("rank"), F.col("source").alias("file"))


def _expected(spark, sf_dir):
    """The source of the document of the same number stands for the file that a question must find."""
    asked = _questions(spark, sf_dir).join(_docs(spark, sf_dir).select(F.col("id").alias("query_id"), "source"), "query_id")
    return asked.select("query_id", F.array("source").alias("parts"))


_HITS = f"""{BM25_CTE}, ex as (select item_id, source from benchmark b join documents d on d.doc_id = b.item_id),
hit as (select ex.item_id, min(case when contains(d.source, ex.source) then bm.rank + 1 end)::int hit_rank from ex left join bm on bm.item_id = ex.item_id and bm.rank < 10 left join documents d using (doc_id) group by 1)"""


@query(f"with {_HITS} select item_id, hit_rank is not null hit, hit_rank from hit")
def score_retrieval(spark, sf_dir):
    return evaluation.retrieval_hits(_results(spark, sf_dir), _expected(spark, sf_dir)).select(F.col("query_id").alias("item_id"), "hit", "hit_rank")


@query(f"with {_HITS} select count(*)::bigint n, count_if(hit_rank is not null)::bigint hits, count_if(hit_rank <= 1)::bigint top1, count_if(hit_rank <= 3)::bigint top3, (100 * count_if(hit_rank is not null) // greatest(count(*), 1))::bigint percent from hit")
def hit_at_k(spark, sf_dir):
    return evaluation.hit_summary(evaluation.retrieval_hits(_results(spark, sf_dir), _expected(spark, sf_dir)))


@query(f"""with {_HITS} select h.item_id id, coalesce(hit_rank <= 3, false) passed,
case when coalesce(hit_rank <= 3, false) then (case when hit_rank <= 1 then 'stable+' else 'FIXED' end) else 'stable-' end delta from hit h""")
def run_delta(spark, sf_dir):
    """A run that passes with a hit among three against one that needs the first."""
    hits = evaluation.retrieval_hits(_results(spark, sf_dir), _expected(spark, sf_dir))
    run = lambda k: hits.select(F.col("query_id").alias("id"), F.coalesce(F.col("hit_rank") <= k, F.lit(False)).alias("passed"))
    return evaluation.run_delta(run(3), run(1))


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value nulls last) - 1 i, count(*) over (partition by event_type) n from events)
select event_type, value median from r where i = n // 2""")
def upper_median(spark, sf_dir):
    return evaluation.upper_median(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("""with d as (select q.vec_id qid, e.vec_id, (q.label = e.label)::int rel, round(1 - list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: x[1]::double * x[2]::double))
  / ((sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) + 1e-12::double) * (sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))) + 1e-12::double)), 6) dist
  from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings e),
r as (select *, row_number() over (partition by qid order by dist, vec_id) rank from d qualify rank <= 10),
g as (select *, sum(rel) over (partition by qid order by rank) hits from r),
n as (select q.vec_id qid, count(*)::double n from benchmark b join embeddings q on q.vec_id = b.item_id join embeddings e using (label) group by 1),
c as (select qid, n, unnest([1, 3, 5, 10]) cut from n),
s as (select c.qid, cut, any_value(n) n, coalesce(sum(rel / log2(rank + 1)), 0) dcg, coalesce(sum(case when rel = 1 then hits / rank::double end), 0) ap, coalesce(sum(rel), 0)::double found from c left join g on g.qid = c.qid and g.rank <= c.cut group by c.qid, cut),
i as (select *, list_sum(list_transform(range(1, least(cut, n)::int + 1), lambda k: 1 / log2(k + 1))) ideal from s)
select cut, round(avg(dcg / ideal), 6) ndcg, round(avg(ap / n), 6) map, round(avg(found / n), 6) recall, round(avg(found / cut), 6) "precision" from i group by cut""")
def ndcg_map_recall(spark, sf_dir):
    """Vectors of the question's label are relevant."""
    rows, asked = _vectors(spark, sf_dir), _question_vectors(spark, sf_dir)
    label = rows.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")).join(asked.select("query_id"), "query_id")
    near = dense.knn(rows, asked, 10, "cosine").join(rows.select("id", "label"), "id").join(label, "query_id")
    found = near.select("query_id", (F.col("rank") + 1).alias("rank"), (F.col("label") == F.col("wanted")).cast("int").alias("rel"))
    sizes = label.join(rows.groupBy(F.col("label").alias("wanted")).agg(F.count("*").alias("n_relevant")), "wanted")
    return evaluation.ir_metrics(found, sizes.select("query_id", "n_relevant"))


_CITED = f"with {BM25_CTE}, {KNN_CTE}, {RRF_CTE}, {BEST_CTE}"


def _cited(spark, sf_dir):
    rows = candidates(spark, sf_dir).where("place <= 8")
    return chat.citations(rows.select("query_id", F.col("place").alias("rank"), F.col("source").alias("file"), (F.col("id") % 3).cast("int").alias("page"), F.when(F.col("id") % 2 == 0, F.col("source")).alias("section"), "text"))


@query(_CITED + """ select item_id, place::int n, source file, (doc_id % 3)::int page, case when doc_id % 2 = 0 then source else '' end section,
source || case when doc_id % 3 <> 0 then ' — p.' || (doc_id % 3) else '' end || case when doc_id % 2 = 0 then ', §' || source else '' end label, substring(text, 1, 240) snippet
from cut join documents using (doc_id) where place <= 8""")
def citations(spark, sf_dir):
    return _cited(spark, sf_dir).drop("text").withColumnRenamed("query_id", "item_id")


@query(_CITED + f""", lab as (select item_id, place n, text, source || case when doc_id % 3 <> 0 then ' — p.' || (doc_id % 3) else '' end || case when doc_id % 2 = 0 then ', §' || source else '' end label from cut join documents using (doc_id) where place <= 8)
select b.item_id, '{RULE}' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[' || n || '] ' || label || chr(10) || lab.text, chr(10) || chr(10) order by n) || chr(10) || chr(10) || 'Question: ' || any_value(b.text) prompt,
chr(10) || chr(10) || '---' || chr(10) || '**Sources**' || chr(10) || string_agg('[' || n || '] ' || label, chr(10) order by n) sources, null::varchar answer
from benchmark b join lab on lab.item_id = b.item_id group by b.item_id""")
def prompt_assembly(spark, sf_dir):
    asked = _questions(spark, sf_dir).withColumnRenamed("text", "question")
    return chat.prompts(asked, _cited(spark, sf_dir), RULE, ABSTAIN).withColumnRenamed("query_id", "item_id")


CITED_CASES = [
    (1, [("A.pdf", "8.2 Gates")], [("a", "gates")], False, "text", True),
    (2, [("A.pdf", "8.2 Gates")], [("a", "gates"), ("b", "")], False, "text", False),
    (3, [], [], False, "text", True),
    (4, [("B.pdf", "")], [("", "")], False, "text", True),
    (5, [], [], True, ABSTAIN + " Sorry.", True),
    (6, [], [], True, "It is so.", False),
]


@query(f"""with c as (select * from (values (1, [{{'file': 'A.pdf', 'section': '8.2 Gates'}}], [{{'file': 'a', 'section': 'gates'}}], false, 'text'), (2, [{{'file': 'A.pdf', 'section': '8.2 Gates'}}], [{{'file': 'a', 'section': 'gates'}}, {{'file': 'b', 'section': ''}}], false, 'text'),
(3, [], [], false, 'text'), (4, [{{'file': 'B.pdf', 'section': ''}}], [{{'file': '', 'section': ''}}], false, 'text'), (5, [], [], true, '{ABSTAIN.replace("'", "''")} Sorry.'), (6, [], [], true, 'It is so.')) t(id, cits, rules, must, answer))
select id, case when must then starts_with(trim(answer), '{ABSTAIN.replace("'", "''")}')
else len(list_filter(rules, lambda r: len(list_filter(cits, lambda c: contains(lower(c.file), lower(r.file)) and contains(lower(c.section), lower(r.section)))) = 0)) = 0 end passed from c""")
def score_citations(spark, sf_dir):
    pair = "array<struct<file:string,section:string>>"
    rows = spark.createDataFrame([c[:5] for c in CITED_CASES], f"id int, citations {pair}, rules {pair}, must_abstain boolean, answer string")
    return rows.select("id", evaluation.citations_pass(F.col("citations"), F.col("rules"), F.col("must_abstain"), F.col("answer"), ABSTAIN).alias("passed"))


@query("select event_id, (props->>'k')::bigint k from events where json_valid(props)")
def ndjson_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("line"))
    return stream.decoded(rows, "k bigint")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*)::bigint n, round(sum(value), 2) \"value\" from events group by 1, 2")
def events_tumbling(spark, sf_dir):
    return stream.tumbling(table(spark, sf_dir, "events"))


@query("""with g as (select user_id, ts, case when ts < lag(ts) over w + interval '30 minutes' then 0 else 1 end new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from g)
select user_id, min(ts) as start, max(ts) + interval '30 minutes' as stop, count(*)::bigint n from s group by user_id, k""")
def events_session(spark, sf_dir):
    return stream.sessions(table(spark, sf_dir, "events"))


@query("select user_id, event_type from events group by all")
def events_dedup_watermark(spark, sf_dir):
    return stream.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("select 'c' || (user_id % 5) collection, event_type status, count(*)::bigint n from events group by all")
def progress_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id") % 5).alias("collection"), F.col("event_type").alias("status"))
    return stream.status_counts(rows)


@query("select role, count(*)::bigint n, sum(length(text))::bigint n_chars, max(turn) last_turn from conversations group by role")
def token_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.max("turn").alias("last_turn"))


@query("""with h as (select source, lang, count(*) n from documents group by all) select source, lang mode, n::bigint n, n >= 2 and 2 * n >= sum(n) over (partition by source) dominant from h qualify row_number() over (partition by source order by n desc, lang) = 1""")
def mode_column(spark, sf_dir):
    """The commonest value of each group, the first on ties, and whether it dominates."""
    own = Window.partitionBy("source")
    counted = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    placed = counted.withColumns({"i": F.row_number().over(own.orderBy(F.desc("n"), "lang")), "total": F.sum("n").over(own)})
    return placed.where("i = 1").select("source", F.col("lang").alias("mode"), "n", ((F.col("n") >= 2) & (2 * F.col("n") >= F.col("total"))).alias("dominant"))
