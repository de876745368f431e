"""Files, extracted documents, pictures, outlines, code and small transforms.

The tables hold no PDFs, pictures or code: paths, times, boxes and captions are made of the columns there are, alike in both languages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks, chat, code, evaluation, ingest, joins, models, outline, pictures
from ..sources import files
from ..sources.shared import shared_path
from ..sources.tables import table
from .registry import query


def _docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", *columns)


# Files and extracted documents

_NAME = "'d' || doc_id"
_MTIME = "lpad((doc_id % 28 + 1)::varchar, 2, '0')"


def _extracted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n"))
    block = lambda x, i: F.struct(F.concat(F.lit("b"), i).alias("id"), (i % 3 + 1).alias("page"), F.col("lang").alias("section"), F.concat_ws(" > ", "source", "lang").alias("section_path"), F.lit("text").alias("type"), x.alias("text"))
    return docs.select(F.col("source").alias("collection"), F.concat(F.lit("d"), "doc_id").alias("file"), F.concat(F.lit("d"), "doc_id").alias("doc"), F.format_string("2024-01-%02dT00:00:00.000Z", F.col("doc_id") % 28 + 1).alias("source_mtime"), F.col("lang").alias("backend"), F.transform("lines", block).alias("blocks"))


@query(f"""with l as (select source collection, {_NAME} file, unnest(string_split(text, chr(10))) line, lang, source from documents)
select collection, file, count(*)::bigint n_blocks, sum(length(line))::bigint n_chars, any_value(source || ' > ' || lang) section_path from l group by all""")
def documents_written_and_read(spark, sf_dir):
    """Extracted documents as JSON lines by collection, and back."""
    path = shared_path(spark, "documents")
    files.write_documents(_extracted(spark, sf_dir), path)
    rows = files.read_documents(spark, path).select("collection", "file", F.explode("blocks").alias("b"))
    return rows.groupBy("collection", "file").agg(F.count("*").alias("n_blocks"), F.sum(F.length("b.text")).alias("n_chars"), F.first("b.section_path").alias("section_path"))


@query("select distinct 'collection=' || source as name from documents")
def list_collections(spark, sf_dir):
    path = shared_path(spark, "documents")
    _docs(spark, sf_dir, "source as collection").write.partitionBy("collection").parquet(path)
    return files.collections(spark, path)


@query("""select doc_id, doc_id % 3 <> 2 malformed, case when doc_id % 3 = 2 then 1::int end n_blocks, case when doc_id % 3 = 2 then case when doc_id % 2 = 0 then source || ',' || lang else source || ' > ' || lang end end section_path from documents""")
def document_parse(spark, sf_dir):
    """JSON that breaks off, that has no blocks, and that has them with a list or a text as path."""
    path = "case when doc_id % 2 = 0 then concat('[\"', source, '\",\"', lang, '\"]') else concat('\"', source, ' > ', lang, '\"') end"
    value = f"case doc_id % 3 when 0 then '{{\"blocks\": [' when 1 then '{{\"doc\": \"x\"}}' else concat('{{\"doc\": \"d\", \"blocks\": [{{\"text\": \"t\", \"section_path\": ', {path}, '}}]}}') end as value"
    found = files.parsed_documents(_docs(spark, sf_dir, value))
    return found.select("doc_id", "malformed", F.when(~F.col("malformed"), F.size("blocks")).alias("n_blocks"), F.get("blocks.section_path", F.lit(0)).alias("section_path"))


_PATHS = "p as (select doc_id, n_chars, source || case when doc_id % 5 = 0 then '/vendor' else '' end || case when doc_id % 7 = 0 then '/testdata' else '' end || '/f' || doc_id || (['.py', '.min.js', '.bin', '.c', '.txt.pdf'])[doc_id % 5 + 1] path from documents)"


def _paths(spark, sf_dir):
    return _docs(spark, sf_dir, "source", "n_chars", "concat(source, if(doc_id % 5 = 0, '/vendor', ''), if(doc_id % 7 = 0, '/testdata', ''), '/f', doc_id, array('.py', '.min.js', '.bin', '.c', '.txt.pdf')[cast(doc_id % 5 as int)]) as path")


@query(f"with {_PATHS} select doc_id, path from p where regexp_matches(path, '\\.(py|c)$') and not contains(path, '/testdata/')")
def source_tree_filter(spark, sf_dir):
    """Patterns with a folder first (vendor/*) hold at the start of the path only, as they do for whole paths."""
    return _paths(spark, sf_dir).where(files.eligible(F.col("path"))).select("doc_id", "path")


@query(f"with {_PATHS} select d.source collection, bool_or(regexp_matches(path, '\\.(py|js|c)$')) is_code from p join documents d using (doc_id) group by 1")
def code_collections(spark, sf_dir):
    return files.code_collections(_paths(spark, sf_dir).select(F.col("source").alias("collection"), F.col("path").alias("file")))


@query(f"with {_PATHS} select doc_id, n_chars * 1000 <= 2000000 small, regexp_matches(path, '\\.txt\\.pdf$') plain, (row_number() over (partition by source order by n_chars, path))::int place from p join documents using (doc_id, n_chars)")
def file_routing(spark, sf_dir):
    """Size cap, plain-text PDFs, and the smallest of a collection first."""
    rows = _paths(spark, sf_dir).select("doc_id", F.col("source").alias("collection"), F.col("path").alias("file"), F.col("n_chars").alias("bytes"))
    return files.smallest_first(rows).select("doc_id", files.small_enough(F.col("bytes") * 1000, 2).alias("small"), files.plain_text_pdf(F.col("file")).alias("plain"), "place")


@query("select doc_id, doc_id % 3 = 0 is_binary from documents")
def binary_sniff(spark, sf_dir):
    rows = _docs(spark, sf_dir, "if(doc_id % 3 = 0, concat(X'6100', cast(text as binary)), concat(cast(repeat('é', 5000) as binary), X'00')) as content")
    return rows.select("doc_id", T.looks_binary(F.col("content")).alias("is_binary"))


@query("select 'd' || doc_id file, n_chars::varchar mtime from documents where not (source <> 'src3' and lang <> 'de')")
def stale_extraction(spark, sf_dir):
    """Files to extract: without a document, or with one of another time or backend."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("n_chars").cast("string").alias("mtime"), "source", "lang")
    done = docs.where("source <> 'src3'").select("file", F.col("mtime").alias("source_mtime"), F.when(F.col("lang") == "de", "old").otherwise("new").alias("backend"))
    return files.stale(docs.select("file", "mtime"), done, "new")


@query("select 'd' || doc_id file, (doc_id % 50)::int mtime from documents where doc_id % 4 = 0 or n_chars % 50 < doc_id % 50")
def stale_markdown(spark, sf_dir):
    docs = _docs(spark, sf_dir, "concat('d', doc_id) as file", "cast(doc_id % 50 as int) as mtime", "n_chars")
    rendered = docs.where("doc_id % 4 <> 0").select("file", (F.col("n_chars") % 50).cast("int").alias("rendered_at"))
    return files.stale_renderings(docs.select("file", "mtime"), rendered)


@query("select source file, arg_min(n_chars::varchar, doc_id) mtime from documents where doc_id % 3 <> 0 group by 1")
def first_times(spark, sf_dir):
    return ingest.first_times(_docs(spark, sf_dir, "source as file", "doc_id as id", "if(doc_id % 3 = 0, null, cast(n_chars as string)) as mtime"))


@query("select source as name, source in (select source from documents where lang = 'de') ingested, source = 'src1' active from documents group by source")
def index_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), "lang")
    return ingest.with_index_flag(docs.select("name").distinct(), docs.where("lang = 'de'"), "src1")


@query("select count(*)::bigint considered, count_if(doc_id % 3 = 0)::bigint extracted, count_if(doc_id % 3 = 1)::bigint unchanged, count_if(doc_id % 3 = 2)::bigint failed from documents")
def extraction_counters(spark, sf_dir):
    return ingest.counters(_docs(spark, sf_dir, "array('extracted', 'unchanged', 'failed')[cast(doc_id % 3 as int)] as status"))


# Sections and outlines

_SECTIONED = "s as (select source doc, doc_id pos, case when doc_id % 4 = 0 then '' else lang end section from documents)"


@query(f"with {_SECTIONED} select doc, count(distinct case when section <> '' then section end)::bigint n_sections from s group by doc")
def section_counts(spark, sf_dir):
    return outline.section_counts(_docs(spark, sf_dir, "source as doc", "if(doc_id % 4 = 0, '', lang) as section"))


@query("""with d as (select source doc, doc_id pos, doc_id % 3 = 0 head, case when source < 'src3' then 'one' else 's' || doc_id % 9 end section from documents),
n as (select doc, count(distinct section) n from d group by doc), r as (select d.*, n, last_value(case when head then '7.' || pos || ' T' end ignore nulls) over (partition by doc order by pos) found from d join n using (doc))
select doc, pos, case when n <= 3 then coalesce(found, section) else section end section from r""")
def degenerate_sections(spark, sf_dir):
    """Only documents with few sections take theirs from headings."""
    rows = _docs(spark, sf_dir, "source as doc", "doc_id as pos", "if(doc_id % 3 = 0, 'heading', 'text') as type", "if(doc_id % 3 = 0, concat('7.', doc_id, '  T'), lang) as text", "if(source < 'src3', 'one', concat('s', doc_id % 9)) as section")
    return outline.resectioned_where_few(rows.drop("doc_id")).select("doc", "pos", "section")


_OUTLINE = """o as (select conv_id doc, turn::bigint pos, (1 + (turn + conv_id) % 3)::int lev, case when turn % 7 = 6 then ' ' else role || '  ' || turn end title, turn::int + 1 page from conversations),
k as (select doc, pos, lev, replace(title, '  ', ' ') title, page from o where trim(title) <> ''),
a as (select *, max(case when lev = 1 then pos end) over w p1, max(case when lev = 2 then pos end) over w p2 from k window w as (partition by doc order by pos)),
b as (select a.doc, a.pos, a.page, a.title leaf, case a.lev when 1 then a.title when 2 then concat_ws(' > ', x.title, a.title)
  else concat_ws(' > ', x.title, case when a.p2 > coalesce(a.p1, -1) then y.title end, a.title) end path
 from a left join k x on x.doc = a.doc and x.pos = a.p1 left join k y on y.doc = a.doc and y.pos = a.p2)"""


def _outline(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id as doc", "cast(turn as bigint) as pos", "cast(1 + (turn + conv_id) % 3 as int) as level", "if(turn % 7 = 6, ' ', concat(role, '  ', turn)) as title", "cast(turn as int) + 1 as page")
    return outline.breadcrumbs(rows)


@query(f"with {_OUTLINE} select doc, pos, page, leaf, path from b")
def outline_breadcrumbs(spark, sf_dir):
    """Turns stand for outline entries of three levels."""
    return _outline(spark, sf_dir)


@query(f"""with {_OUTLINE}, n as (select doc from b group by doc having count(distinct leaf) >= 3), s as (select conv_id doc, turn::int page, role section, 'own' section_path from conversations),
f as (select s.*, max_by(leaf, (b.page, b.pos)) leaf, max_by(path, (b.page, b.pos)) path from s left join (select b.* from b join n using (doc)) b on b.doc = s.doc and b.page <= s.page group by all)
select doc, page, coalesce(leaf, section) section, coalesce(path, section_path) section_path from f""")
def outline_overlay(spark, sf_dir):
    blocks_ = table(spark, sf_dir, "conversations").selectExpr("conv_id as doc", "cast(turn as int) as page", "role as section", "'own' as section_path").distinct()
    return outline.overlaid(blocks_, _outline(spark, sf_dir))


@query("select conv_id doc, role type, (row_number() over (partition by conv_id order by (role <> 'user')::int, turn) - 1)::int pos, turn::int was from conversations")
def pictures_first(spark, sf_dir):
    """User turns stand for pictures."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id as doc", "if(role = 'user', 'picture', role) as type", "cast(turn as int) as pos", "cast(turn as int) as was")
    return outline.pictures_first(rows, ["doc"]).withColumn("type", F.when(F.col("type") == "picture", "user").otherwise(F.col("type")))


@query("select doc_id, case when k = 0 then 3 when k <= 2 then 2 when k = 3 then 3 else 4 end::int heading_level from (select doc_id, doc_id % 6 k from documents)")
def heading_levels(spark, sf_dir):
    number = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest((F.col("doc_id") % 6).cast("int"), F.lit(1))), lambda i: i.cast("string")), ".")
    title = F.when(F.col("doc_id") % 6 == 0, F.lit("**Annex A**")).otherwise(F.concat(F.lit("** "), number, F.lit(" Title")))
    return _docs(spark, sf_dir).select("doc_id", T.heading_level(title).alias("heading_level"))


# Pictures

_PICTURES = """p as (select doc_id pos, source doc, 'i' || doc_id image_path, case when doc_id % 3 = 0 then 'text' else 'picture' end type, case when doc_id % 4 = 0 then 'Figure ' || doc_id end caption,
 case doc_id % 5 when 0 then '' when 1 then 'done ' || doc_id end vlm_description, 'raw' as text from documents)"""


def _pictures(spark, sf_dir):
    return _docs(
        spark, sf_dir, "doc_id as pos", "source as doc", "concat('i', doc_id) as image_path", "if(doc_id % 3 = 0, 'text', 'picture') as type", "if(doc_id % 4 = 0, concat('Figure ', doc_id), null) as caption",
        "case doc_id % 5 when 0 then '' when 1 then concat('done ', doc_id) end as vlm_description", "'raw' as text",
    ).drop("doc_id")


@query(f"with {_PICTURES} select pos, doc from p where type = 'picture' and coalesce(vlm_description, '') = ''")
def uncaptioned_pictures(spark, sf_dir):
    return pictures.uncaptioned(_pictures(spark, sf_dir)).select("pos", "doc")


@query("select doc_id from documents where doc_id % 4 <> 3 and trim(text, ' ') <> ''")
def textish_blocks(spark, sf_dir):
    return pictures.textish(_docs(spark, sf_dir, "array('text', null, 'code', 'picture')[cast(doc_id % 4 as int)] as type", "text")).select("doc_id")


@query("select doc_id, (n_chars % 200 >= 100 and doc_id % 200 >= 100 and n_chars >= 4000) kept from documents")
def picture_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pictures.large_enough(F.col("n_chars") % 200, F.col("doc_id") % 200, F.col("n_chars")).alias("kept"))


@query("select doc_id from documents where lang = 'de'")
def backend_filter(spark, sf_dir):
    return pictures.of_backend(_docs(spark, sf_dir, "lang as backend"), "de").select("doc_id")


@query(f"""with {_PICTURES} select pos, case when type = 'picture' and pos % 2 = 0 then concat_ws(chr(10) || chr(10), caption, 'label ' || pos % 10) else text end as text,
case when type = 'picture' and pos % 2 = 0 then 'label ' || pos % 10 else vlm_description end vlm_description from p""")
def caption_write_back(spark, sf_dir):
    rows = _pictures(spark, sf_dir)
    edits = rows.where("pos % 2 = 0").select("doc", "image_path", F.concat(F.lit("label "), F.col("pos") % 10).alias("caption"))
    return pictures.written_back(rows, edits).select("pos", "text", "vlm_description")


@query("""with c as (select doc_id, doc_id % 7 component from documents), l as (select 'label ' || i % 3 as label, i component from range(9) t(i))
select label, count(doc_id)::bigint n from l left join c using (component) group by label""")
def cluster_label_counts(spark, sf_dir):
    labels = spark.range(9).selectExpr("concat('label ', id % 3) as label", "id as component")
    return pictures.label_counts(_docs(spark, sf_dir, "doc_id % 7 as component"), labels)


@query("""with g as (select doc_id, doc_id % 6 component, case when doc_id % 11 = 0 then lang || doc_id end caption from documents), r as (select component, arg_min(caption, doc_id) caption from g where caption is not null group by component)
select doc_id id, component, r.caption from g left join r using (component)""")
def cluster_captions(spark, sf_dir):
    """Each cluster takes the caption of its first labelled member."""
    from ..operators import cluster

    rows = _docs(spark, sf_dir, "doc_id as id", "doc_id % 6 as component", "doc_id as path", "if(doc_id % 11 = 0, concat(lang, doc_id), null) as caption")
    return cluster.cluster_labels(rows.select("id", "component", "path"), rows.where("caption is not null").select("path", "caption"))


@query("""select doc_id, doc_id % 3 <> 0 and doc_id % 2 = 0 changed, case when doc_id % 3 <> 0 and doc_id % 2 = 0 then 'Node ' || doc_id || ' sends to B.' else 'old' end vlm_description,
case when doc_id % 3 <> 0 and doc_id % 2 = 0 then 'cap' || chr(10) || chr(10) || 'Node ' || doc_id || ' sends to B.' else 'old text' end as text from documents""")
def caption_restrip(spark, sf_dir):
    raw = "if(doc_id % 2 = 0, concat('Here is a summary:\\n\\nNode ', doc_id, ' sends to B.\\n\\n---'), null) as vlm_description_raw"
    rows = _docs(spark, sf_dir, "if(doc_id % 3 = 0, 'text', 'picture') as type", "'cap' as caption", "'old' as vlm_description", raw, "'old text' as text")
    return pictures.restripped(rows).select("doc_id", "changed", "vlm_description", "text")


@query("select doc_id, case doc_id % 4 when 0 then 'c' || chr(10) || chr(10) || 'd' when 1 then 'c' when 2 then 'd' else '' end as text from documents")
def picture_texts(spark, sf_dir):
    rows = _docs(spark, sf_dir, "if(doc_id % 4 < 2, ' c ', null) as caption", "if(doc_id % 2 = 0, 'd', '  ') as description")
    return rows.select("doc_id", blocks.picture_text(F.col("caption"), F.col("description")).alias("text"))


@query("select doc_id, case when hit then null else 'd' end vlm_description, case when hit then 'cap' else 't' end as text from (select doc_id, doc_id % 2 = 0 and doc_id % 3 = 0 hit from documents)")
def caption_invalidation(spark, sf_dir):
    rows = _docs(spark, sf_dir, "if(doc_id % 2 = 0, 'picture', 'text') as type", "concat('p', doc_id % 3) as vlm_prompt_id", "'d' as vlm_description", "'r' as vlm_description_raw", "'m' as vlm_model", "'cap' as caption", "'t' as text")
    return blocks.invalidated(rows, "p0").select("doc_id", "vlm_description", "text")


# Layout

_TAGGED = "'lead<x_0.1><y_0.2>A' || doc_id || '<x_0.3><y_0.4><class_Text>mid<x_0.5><y_0.6> B <x_0.7><y_0.8><class_Picture>tail'"


def _tagged(spark, sf_dir):
    return _docs(spark, sf_dir, "concat('lead<x_0.1><y_0.2>A', doc_id, '<x_0.3><y_0.4><class_Text>mid<x_0.5><y_0.6> B <x_0.7><y_0.8><class_Picture>tail') as t")


@query("""select doc_id, 0::int pos, 'Text' cls, 'A' || doc_id as content, [0.1, 0.2, 0.3, 0.4]::double[] bbox from documents
union all select doc_id, 1::int, 'Picture', 'B', [0.5, 0.6, 0.7, 0.8]::double[] from documents""")
def layout_records(spark, sf_dir):
    return blocks.layout_records(_tagged(spark, sf_dir), "doc_id", "t")


@query("select doc_id, 'leadA' || doc_id || 'mid B tail' clean, 'lead<x_0.1><y_0.2>A' || doc_id || '<x_0.3><y_0.4><class_Text>midtail' rest from documents")
def layout_text(spark, sf_dir):
    """Without its tags, and without the second record."""
    return _tagged(spark, sf_dir).select("doc_id", blocks.without_layout_tags(F.col("t")).alias("clean"), pictures.without_records(F.col("t"), F.array(F.lit(1))).alias("rest"))


@query("select doc_id, list_transform([a - 0.1, a - 0.1, a + 0.6, a + 0.6], lambda x: round(greatest(0.0, least(1.0, x)), 6))::double[] box from (select doc_id, (doc_id % 10) / 10.0::double a from documents)")
def boxes_normalised(spark, sf_dir):
    a = (F.col("doc_id") % 10) * 10.0
    box = blocks.normalised_box(a, a, a + 50, a + 50, F.lit(100.0), F.lit(100.0), 0.1)
    return _docs(spark, sf_dir).select("doc_id", F.transform(box, lambda x: F.round(x, 6)).alias("box"))


@query("select doc_id, case doc_id % 4 when 0 then true when 1 then true when 2 then false else true end is_chrome from documents")
def plain_page_chrome(spark, sf_dir):
    """In the top band, in the bottom band, in the middle, and in the middle with a page number at its end."""
    rows = _docs(spark, sf_dir, "array(10D, 740D, 300D, 300D)[cast(doc_id % 4 as int)] as y0", "array(20D, 750D, 310D, 310D)[cast(doc_id % 4 as int)] as y1", "792D as height", "if(doc_id % 4 = 3, 'a\\nb [Page 7]', 'line') as text")
    return blocks.furniture_of_plain_page(rows).select("doc_id", "is_chrome")


@query("""with p as (select * from (values (1, 'p1', 0.1, 0.1, 0.5, 0.4), (1, 'p2', 0.3, 0.1, 0.9, 0.4)) t(page, pic, x0, y0, x1, y1)),
t as (select * from (values (1, 't1', 'Figure 1 left', 0.1, 0.45, 0.5, 0.5), (1, 't2', 'Fig. 2 right', 0.35, 0.42, 0.8, 0.44), (1, 't3', 'Table 9 far', 0.1, 0.7, 0.5, 0.75)) t(page, id, text, x0, y0, x1, y1)),
h as (select pic, t.text, t.y0, t.id from p join t using (page) where t.y0 >= p.y1 and t.y0 - p.y1 <= 0.15 and (least(p.x1, t.x1) - greatest(p.x0, t.x0)) / (t.x1 - t.x0) >= 0.5)
select pic, string_agg(text, chr(10) order by y0, id) caption from h group by pic""")
def captions_of_pictures(spark, sf_dir):
    """All captions below a picture, by height; one may serve several pictures."""
    p = spark.createDataFrame([("d", 1, "p1", "S", 0.1, 0.1, 0.5, 0.4), ("d", 1, "p2", "S", 0.3, 0.1, 0.9, 0.4)], "doc string, page int, id string, section string, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([("d", 1, "t1", "Figure 1 left", 0.1, 0.45, 0.5, 0.5), ("d", 1, "t2", "Fig. 2 right", 0.35, 0.42, 0.8, 0.44), ("d", 1, "t3", "Table 9 far", 0.1, 0.7, 0.5, 0.75)], "doc string, page int, id string, text string, x0 double, y0 double, x1 double, y1 double")
    return joins.caption_below(p, t, gap=0.15, overlap=0.5, every=True).select("pic", "caption")


# Code

_CODE = "case when doc_id % 3 = 0 then 'import os' || chr(10) || chr(10) || 'def f' || doc_id || '():' || chr(10) || '    return 1' || chr(10) else 'x = (' || chr(10) || 'y' || doc_id end"


@query("""with d as (select doc_id, source || '/f' || doc_id || '.py' path from documents),
c as (select doc_id, path, 0::int block, 'preamble' as name, 1::int line_start, 2::int line_end from d where doc_id % 3 = 0 union all select doc_id, path, 1::int, 'f' || doc_id, 3::int, 4::int from d where doc_id % 3 = 0 union all select doc_id, path, 0::int, 'chunk-1', 1::int, 2::int from d where doc_id % 3 <> 0)
select path, block, path || ' :: ' || name section, replace(path, '/', ',') section_path, line_start, line_end, 'python' as "language", 'https://github.com/a/b/blob/main/' || path || '#L' || line_start || '-L' || line_end github_url from c""")
def code_blocks(spark, sf_dir):
    """Files that a parser takes, and files that it doesn't."""
    text = "if(doc_id % 3 = 0, concat('import os\\n\\ndef f', doc_id, '():\\n    return 1\\n'), concat('x = (\\ny', doc_id)) as text"
    rows = _docs(spark, sf_dir, "concat(source, '/f', doc_id, '.py') as path", text).withColumn("base", T.blob_base(F.lit("https://github.com/a/b.git"), F.lit("main")))
    return code.code_blocks(rows).drop("text")


@query("""select doc_id, (['c', 'typescript', 'ruby', null])[doc_id % 4 + 1] as "language", 'a__b__' || doc_id encoded, 'a/b/' || doc_id decoded from documents""")
def code_paths(spark, sf_dir):
    path = F.concat(F.lit("x/f."), F.get(F.array(*map(F.lit, ("H", "tsx", "rb", "none"))), (F.col("doc_id") % 4).cast("int")))
    encoded = blocks.encoded_path(F.concat(F.lit("a/b\\"), F.col("doc_id").cast("string")))
    return _docs(spark, sf_dir).select("doc_id", blocks.language_of(path).alias("language"), encoded.alias("encoded"), blocks.decoded_path(encoded).alias("decoded"))


# Small transforms

@query("select doc_id, source || ':d' || doc_id || ':' || doc_id % 7 chunk_id from documents")
def chunk_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(F.col("source"), F.concat(F.lit("d"), "doc_id"), F.col("doc_id") % 7).alias("chunk_id"))


@query("select doc_id, case doc_id % 4 when 0 then source || chr(10) || lang when 1 then source when 2 then lang else ' ' end as text from documents")
def benchmark_text(spark, sf_dir):
    rows = _docs(spark, sf_dir, "if(doc_id % 4 < 2, source, null) as title", "if(doc_id % 2 = 0, lang, '') as body")
    return rows.select("doc_id", T.titled(F.col("title"), F.col("body")).alias("text"))


@query("select doc_id query_id, text, case when doc_id % 2 = 0 then n_chars::double else 0.5::double end score, source file, lang section, 1::int page from documents")
def match_reshape(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id as query_id", "text", "if(doc_id % 2 = 0, cast(n_chars as double), null) as score", "0.5D as distance", "source as file", "lang as section", "1 as page")
    return chat.reshaped(rows)


@query("select distinct source as name from documents")
def collections_of_models(spark, sf_dir):
    return chat.collections_of(chat.model_catalog(table(spark, sf_dir, "documents"), "source").union(spark.createDataFrame([("rag-active",)], "model_id string")))


@query("select doc_id, list_distinct([source, lang, 'x'])::varchar[] is not null ok, list_sort(list_distinct([source, lang, 'x', lang])) names from documents")
def allow_lists(spark, sf_dir):
    names = chat.allowed(F.array("source", "lang"), F.lit(None).cast("array<string>"), F.array(F.lit("x"), F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("ok"), F.array_sort(names).alias("names"))


@query("select doc_id, list_filter(list_transform(string_split(source || ' , ,' || lang || ',', ','), lambda x: trim(x)), lambda x: x <> '') parts from documents")
def list_parse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.listed(F.concat("source", F.lit(" , ,"), "lang", F.lit(","))).alias("parts"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' iso from events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.iso_millis(F.col("ts")).alias("iso"))


@query("select doc_id, case doc_id % 3 when 0 then source || '<br>' || lang when 1 then '(no caption detected)' else source end as caption from documents")
def caption_lines(spark, sf_dir):
    raw = "case doc_id % 3 when 0 then concat(' **', source, '\\n\\n', lang, '** ') when 1 then '****' else source end as raw"
    return _docs(spark, sf_dir, raw).select("doc_id", T.caption_line(F.col("raw")).alias("caption"))


_LATEX = r"""'{tabular}{cc} a \multicolumn{2}{c}{' || source || '} — ' || lang || ' \multirow{2{*}{}} x — tail' || chr(10) || '\\multirow{1}{*}{y}'"""


@query(rf"""select doc_id, regexp_replace(regexp_replace(regexp_replace({_LATEX}, '\{{(?:tabular|tabularx|array|longtable|table|matrix)\}}(?:\s*\{{[^}}]*\}})+', '', 'g'),
 '\\+(?:multicolumn|multirow)\s*\{{[^}}]*\}}\s*\{{[^}}]*\}}\s*\{{([^}}]*)\}}', '\1', 'g'), '\\+(?:multicolumn|multirow)\b[^\n—]*', '', 'g') clean from documents""")
def orphan_latex(spark, sf_dir):
    text = F.concat(F.lit("{tabular}{cc} a \\multicolumn{2}{c}{"), "source", F.lit("} — "), "lang", F.lit(" \\multirow{2{*}{}} x — tail\n\\\\multirow{1}{*}{y}"))
    return table(spark, sf_dir, "documents").select("doc_id", T.without_orphan_latex(text).alias("clean"))


@query("""select doc_id, case when doc_id % 3 = 0 then 'Intro ' || doc_id || chr(10) || chr(10) || '```asn.1' || chr(10) || 'X-MIB DEFINITIONS ::=' || chr(10) || 'BEGIN' || chr(10) || 'IMPORTS a' || chr(10) || 'FROM b' || chr(10) || '```'
when doc_id % 3 = 1 then '```asn.1' || chr(10) || 'obj' || doc_id || chr(10) || 'OBJECT-TYPE' || chr(10) || 'SYNTAX Gauge32' || chr(10) || 'STATUS current ::= { x 1 }' || chr(10) || '```' else source end as text from documents""")
def fenced_modules(spark, sf_dir):
    raw = "case doc_id % 3 when 0 then concat('Intro ', doc_id, '  X-MIB DEFINITIONS ::= BEGIN IMPORTS a   FROM b ') when 1 then concat('obj', doc_id, ' OBJECT-TYPE SYNTAX Gauge32  STATUS current ::= { x 1 }') else source end as raw"
    return _docs(spark, sf_dir, raw).select("doc_id", T.fenced_module(F.col("raw")).alias("text"))


@query("""select doc_id, case when doc_id % 2 = 0 then '| Name | Value |' || chr(10) || '|---|---|' || chr(10) || '| ' || source || ' | 1 |' || chr(10) || chr(10) || '**Part**' || chr(10) || chr(10) || '| Name | Value |' || chr(10) || '|---|---|' || chr(10) || '| ' || lang || ' | a\\|b |' end as md from documents""")
def bullet_tables(spark, sf_dir):
    """Bullets of two cells with a heading between them, and bullets without a common width."""
    table_ = F.array(F.lit("- Name — Value"), F.concat(F.lit("- "), "source", F.lit(" — 1 — ")), F.lit("- Part"), F.concat(F.lit("- "), "lang", F.lit("  —  a|b")))
    other = F.array(F.lit("- one"), F.lit("- two — three"), F.lit("- four"))
    return table(spark, sf_dir, "documents").select("doc_id", T.bullet_table(F.when(F.col("doc_id") % 2 == 0, table_).otherwise(other)).alias("md"))


@query("select doc_id, replace(replace(source || '|' || lang, '|', '\\|'), chr(10), '<br>') || '<br>x' cell, [source, lang] strings from documents")
def cells_and_strings(spark, sf_dir):
    raw = F.concat(F.lit('say ["'), "source", F.lit('", "'), "lang", F.lit('"] done'))
    return table(spark, sf_dir, "documents").select("doc_id", T.escaped_cell(F.concat("source", F.lit("|"), "lang", F.lit("\r\nx"))).alias("cell"), T.json_strings(raw).alias("strings"))


@query("""with q as (select item_id question_id, text from benchmark)
select question_id, 0::int query_id, text from q union all select question_id, 1::int, 'sub ' || question_id from q where question_id % 2 = 0""")
def query_expansion(spark, sf_dir):
    """Half of the replies hold a copy of the question, a blank and one other query; the rest can't be parsed."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    reply = F.when(F.col("question_id") % 2 == 0, F.concat(F.lit("Sure: "), F.to_json(F.array(F.lower("text"), F.lit(" "), F.concat(F.lit("sub "), "question_id"))))).otherwise("none")
    return models.expanded(asked, reply)


# Evaluation and streams

_CITED = "c as (select item_id query_id, 'a__' || item_id || '__f.c' file from benchmark), e as (select item_id query_id, ['A/' || item_id, 'zz'] parts from benchmark where item_id % 5 <> 0)"


@query(f"with {_CITED} select query_id, true hit, ['A/' || query_id] matched, [replace(file, '__', '/')] cited from e join c using (query_id)")
def cited_files(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    cited = items.withColumn("file", F.concat(F.lit("a__"), "query_id", F.lit("__f.c")))
    expected = items.where("query_id % 5 <> 0").withColumn("parts", F.array(F.concat(F.lit("A/"), "query_id"), F.lit("zz")))
    return evaluation.cited_hits(cited, expected)


@query("select count_if(item_id % 4 = 0)::bigint fixed, count_if(item_id % 4 = 1)::bigint regressed, count_if(item_id % 4 = 2)::bigint fresh, count(*)::bigint n from benchmark")
def delta_counts(spark, sf_dir):
    item = F.col("item_id") % 4
    return evaluation.delta_counts(table(spark, sf_dir, "benchmark").select(F.when(item == 0, "FIXED").when(item == 1, "REGRESSED").when(item == 2, "new").otherwise("stable+").alias("delta")))


@query("""with r as (select lang, source, (row_number() over (partition by lang order by doc_id))::int k from documents) select lang query_id, list(source order by k) files from r where k <= 3 group by lang""")
def top_files(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return evaluation.top_files(table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), rank.alias("rank"), F.col("source").alias("file")))


@query("""with c as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int n, count(*) over (partition by conv_id) k, case when turn % 3 = 2 then '' else role || turn end said from conversations),
e as (select conv_id, max(n) + 1 n from c group by conv_id),
h as (select 'data: {"id":"' || conv_id || '","object":"chat.completion.chunk","model":"m","choices":[{"index":0,"delta":' a, conv_id from e)
select c.conv_id, n, a || case when said = '' then '{}' else '{"role":"assistant","content":"' || said || '"}' end || ',"finish_reason":' || case when n = k - 1 then '"stop"' else 'null' end || '}]}' || chr(10) || chr(10) line from c join h using (conv_id)
union all select e.conv_id, n::int, a || '{"content":"src' || e.conv_id || '"},"finish_reason":null}]}' || chr(10) || chr(10) from e join h using (conv_id) where e.conv_id % 2 = 0
union all select conv_id, (n + 1)::int, 'data: [DONE]' || chr(10) || chr(10) from e""")
def chat_stream(spark, sf_dir):
    """Turns stand for a model's deltas."""
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations")
    n = F.row_number().over(own.orderBy("turn")) - 1
    said = F.when(F.col("turn") % 3 == 2, "").otherwise(F.concat("role", F.col("turn").cast("string")))
    deltas = rows.select("conv_id", n.alias("n"), said.alias("content"), (n == F.count("*").over(own) - 1).alias("done"))
    sources = rows.select("conv_id").distinct().where("conv_id % 2 = 0").withColumn("sources", F.concat(F.lit("src"), "conv_id"))
    return chat.stream_lines(deltas, sources, "m")
