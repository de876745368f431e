"""Index maintenance, clustering, layout joins and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector
from ..operators import blocks, chat, cluster, ingest, joins, render
from ..operators.captions import cleaned_captions
from ..sources.tables import table
from .registry import query

# An index made before: without one source, and with other times for one language. The files of today lack another source.
_OLD = "old as (select doc_id, source, 'd' || doc_id file, case when lang = 'de' then 'x' else '' end || n_chars mtime from documents where source <> 'src3')"
_NOW = "now as (select doc_id, 'd' || doc_id file, n_chars::varchar mtime from documents where source <> 'src5')"
_TRIAGE = f"{_OLD}, {_NOW}, tri as (select n.file, n.mtime, case when o.file is null then 'new' when o.mtime is distinct from n.mtime then 'changed' else 'unchanged' end status from now n left join old o using (file))"


def _old(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source <> 'src3'")
    mtime = F.concat(F.when(F.col("lang") == "de", "x").otherwise(""), F.col("n_chars").cast("string"))
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id")).alias("file"), mtime.alias("mtime"))


def _now(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source <> 'src5'")
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id")).alias("file"), F.col("n_chars").cast("string").alias("mtime"))


@query(f"with {_TRIAGE} select file, mtime, status from tri")
def ingest_triage(spark, sf_dir):
    return ingest.triage(_now(spark, sf_dir), _old(spark, sf_dir))


@query(f"with {_OLD}, {_NOW} select file, 'sidecar' as mode from now where file not in (select file from old)")
def sidecar_only(spark, sf_dir):
    return ingest.sidecar_only(_now(spark, sf_dir), _old(spark, sf_dir)).select("file", "mode")


@query(f"with {_TRIAGE} select doc_id id, file, mtime from old where file not in (select file from tri where status = 'changed')")
def stale_delete(spark, sf_dir):
    old = _old(spark, sf_dir)
    return ingest.without_files(old, ingest.triage(_now(spark, sf_dir), old).where("status = 'changed'")).select("id", "file", "mtime")


@query(f"with {_OLD}, {_NOW} select doc_id id, file, mtime from old where file in (select file from now)")
def orphan_prune(spark, sf_dir):
    return ingest.only_files(_old(spark, sf_dir), _now(spark, sf_dir)).select("id", "file", "mtime")


@query(f"with {_NOW} select doc_id id, file, mtime from now")
def upsert_merge(spark, sf_dir):
    """The whole run: what is new or changed replaces, what is gone leaves; the index then equals the files."""
    return ingest.next_index(_old(spark, sf_dir), _now(spark, sf_dir), lambda todo: todo).select("id", "file", "mtime")


@query(f"""with {_TRIAGE} select count(*)::bigint files, coalesce(sum(case when status <> 'unchanged' then 1 end), 0)::bigint total_chunks, count_if(status = 'unchanged')::bigint skipped, count_if(status <> 'unchanged')::bigint processed from tri""")
def ingest_report(spark, sf_dir):
    now = _now(spark, sf_dir)
    return ingest.report(ingest.triage(now, _old(spark, sf_dir)), now)


_BITS = """b as (select vec_id id, list_sum(list_transform(embedding[1:16], lambda x, i: case when x > 0 then 1::bigint << (i - 1)::int else 0 end))::bigint h from embeddings),
k as (select h, min(id) id from b group by h),
p as (select x.id a, y.id b, bit_count(xor(x.h, y.h))::int d from k x join k y on x.id < y.id and bit_count(xor(x.h, y.h)) <= 2)"""


def _hashes(spark, sf_dir):
    """Sign bits of the first 16 components stand for perceptual hashes."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 16).alias("v"))
    return rows.select("id", vector.sign_bits("v").alias("h"))


@query(f"with {_BITS} select a, b, d from p")
def simhash_pairs(spark, sf_dir):
    return joins.hamming_pairs(_hashes(spark, sf_dir), "h", distance=2, width=16)


@query(f"""with recursive {_BITS}, e as (select a u, b v from p union all select b, a from p),
r(n, c) as (select u, u from e union select e.v, r.c from r join e on e.u = r.n)
select n node, min(c) component from r group by n""")
def near_dup_components(spark, sf_dir):
    return cluster.components(joins.hamming_links(_hashes(spark, sf_dir), "h", distance=2, width=16))


# DuckDB's bigint has no room for bit 63, so that it takes the signs in two halves.
_HALF = "list_sum(list_transform(embedding[{}:{}], lambda x, i: case when x > 0 then 1::bigint << (i - 1)::int else 0 end))::bigint"
_BITS_64 = f"""b as (select vec_id id, {_HALF.format(1, 32)} h, {_HALF.format(33, 64)} g from embeddings),
p as (select x.id a, y.id b, (bit_count(xor(x.h, y.h)) + bit_count(xor(x.g, y.g)))::int d from b x join b y on x.id < y.id and bit_count(xor(x.h, y.h)) + bit_count(xor(x.g, y.g)) <= 12)"""


def _hashes_64(spark, sf_dir):
    """The sign bits of all 64 components, for the reference's distance."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vector.sign_bits("embedding").alias("h"))


@query(f"with {_BITS_64} select a, b, d from p")
def simhash_pairs_64(spark, sf_dir):
    return joins.hamming_pairs_64(_hashes_64(spark, sf_dir), "h")


@query(f"""with recursive {_BITS_64}, e as (select a u, b v from p union all select b, a from p),
r(n, c) as (select u, u from e union select e.v, r.c from r join e on e.u = r.n)
select n node, min(c) component from r group by n""")
def near_dup_components_64(spark, sf_dir):
    return cluster.components(joins.hamming_links(_hashes_64(spark, sf_dir), "h", copies=True))


@query("""select coalesce(source, 'total') source, count(*)::bigint total, count_if(toxic = 1)::bigint captioned, count_if(toxic = 0)::bigint blank, count_if(toxic is null)::bigint missing
 from documents left join labels using (doc_id) group by rollup (source)""")
def picture_stats_rollup(spark, sf_dir):
    """Labels stand for captioned, empty and missing."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    found = both.rollup("source").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("captioned"), F.count_if(F.col("toxic") == 0).alias("blank"), F.count_if(F.col("toxic").isNull()).alias("missing"))
    return found.withColumn("source", F.coalesce("source", F.lit("total")))


PICTURES = [("d", 1, "p1", "S", 0.1, 0.1, 0.5, 0.4), ("d", 1, "p2", "S", 0.6, 0.1, 0.9, 0.4), ("d", 2, "p3", "T", 0.1, 0.1, 0.9, 0.5)]
TEXTS = [("d", 1, "t1", "Figure 1 left", 0.1, 0.45, 0.5, 0.5), ("d", 1, "t2", "Fig. 2 right", 0.55, 0.42, 0.9, 0.47), ("d", 1, "t3", "Figure 9 far", 0.1, 0.6, 0.5, 0.65), ("d", 2, "t4", "Table 3 below", 0.7, 0.55, 1.2, 0.6), ("d", 2, "t5", "no caption", 0.1, 0.51, 0.9, 0.53)]


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)


@query(f"""with p as (select * from (values {_values(PICTURES)}) t(doc, page, pic, section, x0, y0, x1, y1)), t as (select * from (values {_values(TEXTS)}) t(doc, page, id, text, x0, y0, x1, y1))
select pic, t.text caption from p join t using (doc, page) where regexp_matches(t.text, '(?i)^(Figure|Fig\\.?|Table) \\d+') and t.y0 >= p.y1 and t.y0 - p.y1 <= 0.1::double and (least(p.x1, t.x1) - greatest(p.x0, t.x0)) / (t.x1 - t.x0) >= 0.3
qualify row_number() over (partition by doc, page, pic order by t.y0, t.id) = 1""")
def spatial_pairs(spark, sf_dir):
    p = spark.createDataFrame(PICTURES, "doc string, page int, id string, section string, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame(TEXTS, "doc string, page int, id string, text string, x0 double, y0 double, x1 double, y1 double")
    return joins.caption_below(p, t).select("pic", "caption")


@query("""with d as (select doc_id, source doc, (doc_id // 20)::int page, doc_id pos, lang section, text from documents where trim(text) <> ''),
s as (select doc, doc_id pic, page, section own from d where section = 'de'),
b as (select s.doc, pic, d.page, d.pos, d.text, coalesce(d.section = s.own, false) same from s join d on s.doc = d.doc and d.page between s.page - 2 and s.page + 2),
h as (select *, coalesce(sum(case when same then length(text) end) over (partition by doc, pic), 0) held from b),
k as (select * from h where held < 500 or same),
r as (select *, 4000 - coalesce(sum(length(text) + 2) over (partition by doc, pic order by page, pos rows between unbounded preceding and 1 preceding), 0) rest from k),
c as (select *, case when length(text) <= rest then text when rest > 200 then substring(text, 1, rest::bigint) end part from r)
select doc, pic, string_agg(part, chr(10) || chr(10) order by page, pos) context from c where part is not null group by doc, pic""")
def band_context(spark, sf_dir):
    """Twenty numbers stand for a page, languages for sections, German documents for pictures."""
    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", F.col("source").alias("doc"), F.expr("cast(doc_id div 20 as int)").alias("page"), F.col("doc_id").alias("pos"), F.col("lang").alias("section"), "text")
    pictures = docs.where("section = 'de'").select("doc", "page", F.col("doc_id").alias("id"), "section")
    return joins.page_band(pictures, docs.select("doc", "page", "pos", "section", "text"))


@query()
def caption_strip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return cleaned_captions(rows).select("conv_id", "turn", "caption", "usable")


_FRAMED = "'<think>' || conv_id || '</think>' || chr(10) || 'Here is a summary:' || chr(10) || chr(10) || 'Node ' || turn || ' ' || left(regexp_replace(text, '[^a-z ]', '', 'g'), (turn % 5) * 10::int) || chr(10) || '---'"


@query(f"""with r as (select conv_id, turn, {_FRAMED} framed from conversations where role = 'assistant'),
c as (select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(framed, '^<think>[0-9]*</think>\\s*', ''), '^Here is a summary:\\s*', ''), '\\s*---$', '')) caption from r)
select conv_id, turn, caption, length(caption) >= 40 usable from c""")
def caption_usable(spark, sf_dir):
    """Turns, framed as models frame captions."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.substring(F.regexp_replace("text", "[^a-z ]", ""), F.lit(1), ((F.col("turn") % 5) * 10).cast("int"))
    framed = F.concat(F.lit("<think>"), "conv_id", F.lit("</think>\nHere is a summary:\n\nNode "), "turn", F.lit(" "), said, F.lit("\n---"))
    return cleaned_captions(rows.select("conv_id", "turn", framed.alias("text"))).select("conv_id", "turn", "caption", "usable")


@query("""select conv_id, max(turn) turn, arg_max(text, turn) question from conversations where role = 'user' group by conv_id""")
def last_user_message(spark, sf_dir):
    return chat.last_user_message(table(spark, sf_dir, "conversations")).withColumnRenamed("text", "question")


@query("select conv_id, count(*)::bigint n, sum(length(text))::bigint n_chars from conversations where role <> 'system' group by conv_id")
def drop_system(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


MODEL_FIELDS = ["specs", "specs!deep", " specs ! FAST ", "code!qwen3.6:27b", "a!b!c", ""]


@query(f"""with f as (select unnest({MODEL_FIELDS!r}) field), s as (select field, trim(split_part(field, '!', 1)) collection, lower(trim(case when contains(field, '!') then substring(field, instr(field, '!') + 1) else '' end)) profile from f)
select field, collection, case when profile = 'deep' then 'chat-model-deep' when profile in ('', 'fast') then 'chat-model' else profile end model,
case when starts_with(profile, 'qwen3.6:') then greatest(12288, 24576) when profile = 'deep' then 16384 else 12288 end::int context, case when profile = 'deep' then 15 else 8 end::int top_k from s""")
def resolve_model(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in MODEL_FIELDS], "field string").select("field", *chat.resolved_model(F.col("field")))


@query("select distinct unnest([source, source || '!deep']) model_id from documents")
def model_catalog(spark, sf_dir):
    return chat.model_catalog(table(spark, sf_dir, "documents"), "source")


@query()
def markdown_render(spark, sf_dir):
    return render.documents_as_markdown(blocks.line_blocks(table(spark, sf_dir, "documents")))


@query()
def html_report(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return render.review_page(both.select(F.col("source").alias("doc"), F.col("doc_id").alias("id"), T.collapsed(F.substring("text", 1, 80)).alias("caption"), F.col("quality").isNotNull().alias("captioned")))


@query("select doc_id, replace(replace(replace(replace(source || ' <' || left(text, 40) || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') cell from documents")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escaped_html(F.concat("source", F.lit(" <"), F.substring("text", 1, 40), F.lit(">"))).alias("cell"))


@query("select doc_id, replace(replace(replace(replace(source || ' <' || text || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') cell from documents")
def html_escape_whole(spark, sf_dir):
    """html_escape of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.escaped_html(F.concat("source", F.lit(" <"), "text", F.lit(">"))).alias("cell"))
