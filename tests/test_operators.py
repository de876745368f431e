"""Operators on small hand-made rows."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import blocks, captions, chat, chunk, cluster, evaluation, fusion, ingest, joins, render
from pagewright.streaming import events as stream


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_windows_of_every_length(spark):
    for size, overlap in ((10, 3), (10, 9), (1, 0), (5, 7)):
        texts = ["", "   ", None, *("x" * n for n in range(1, 40)), "a  b\n c" * 9]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        got = {}
        for r in chunk.sliding(docs, size, overlap).orderBy("doc_id", "chunk").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        for i, t in enumerate(texts):
            clean, expected, at = " ".join((t or "").split()), [], 0
            while clean:
                expected.append(clean[at : at + size])
                if at + size >= len(clean):
                    break
                at += max(1, size - overlap)
            assert got.get(i, []) == expected
        assert column(spark, texts, lambda c: chunk.windows(c, size, overlap)) == [got.get(i, []) for i in range(len(texts))]


def chunks_of(spark, *found):
    rows = [(1, [tuple(x.get(k) for k in ("id", "page", "section", "section_path", "type", "text")) for x in found])]
    return [r.asDict() for r in chunk.chunked_blocks(spark.createDataFrame(rows, f"doc_id int, blocks array<{blocks.BLOCK}>")).orderBy("chunk").collect()]


def test_tables_keep_their_head(spark):
    head = "| a | b |\n|---|---|"
    rows = [f"| {i} | {'x' * 60} |" for i in range(60)]
    found = chunks_of(spark, {"type": "table", "text": "\n".join([head, *rows]), "section": "S"})
    assert len(found) > 1 and all(c["text"].startswith(head) and len(c["text"]) <= 1600 for c in found)
    assert [r for c in found for r in c["text"].split("\n")[2:]] == rows
    assert all(c["embed_input"].startswith("Section: S Table:\n") for c in found)
    for text in ("x" * 5000, "| " + "h" * 1700 + " |\n|---|\n" + "\n".join(rows)):  # no pipes; a head that leaves no room
        slid = [c["text"] for c in chunks_of(spark, {"type": "table", "text": text, "section": "S"})]
        assert len(slid) > 1 and slid[0] == " ".join(text.split())[: len(slid[0])] and slid[1].startswith(slid[0][-150:])


def test_text_is_packed_within_a_clause(spark):
    b = lambda t, path, kind="text": {"type": kind, "text": t, "section": path, "section_path": path}
    count = lambda *x: len(chunks_of(spark, *x))
    assert count(b("one", "A > B > C > D"), b("two", "A > B > C > E")) == 1
    assert count(b("one", "A > B"), b("two", "A > C")) == 2
    assert count(b("one", "A"), b("head", "A", "heading"), b("two", "A")) == 2
    assert count(b("only", "A", "heading")) == count(b(None, "A"), b(" ", None)) == 0
    assert count(b("x" * 600, "A"), b("y" * 399, "A")) == 1
    assert count(b("x" * 600, "A"), b("y" * 400, "A")) == 2


def test_greedy_runs_match_a_plain_loop():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(0, 30))
        joins, lengths, limits = rng.random(n) < 0.8, rng.integers(1, 50, n), rng.integers(40, 120, n)
        groups: list[list[int]] = []
        for i in range(n):
            if groups and joins[i] and sum(lengths[k] for k in groups[-1]) + len(groups[-1]) + lengths[i] <= limits[i]:
                groups[-1].append(i)
            else:
                groups.append([i])
        assert chunk.greedy(joins, lengths, limits) == [(g[0], len(g)) for g in groups]


def test_line_windows(spark):
    text = "".join(f"line {i}\n" for i in range(120)) + "z" * 2000 + "\nend"
    found = [(r.line_start, r.line_end, r.name, r.chunk_text) for r in chunk.windowed_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()]
    assert found[0][:3] == (1, 50, "chunk-1") and found[1][0] == 41 and found[0][3].endswith("line 49\n")
    assert any(len(c[3]) > 2000 and c[0] == c[1] == 121 for c in found)
    assert found[-1][1] == 122 and found[-1][3].endswith("end")


def test_markdown_blocks(spark):
    page = "# One\ntext a\n# swallowed\n| not | table\n\n| a | b |\n# c | d |\nafter\n\n#\n\n# x | y\n# Two"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "\n\n")], "doc_id int, text string")
    got = [(r.block, r.type, r.section, r.block_text) for r in blocks.from_markdown(rows).orderBy("block").collect()]
    want = [("heading", "One", "One"), ("text", "One", "text a # swallowed | not | table"), ("table", "One", "| a | b |\n# c | d |"), ("text", "One", "after"), ("heading", "x | y", "x | y"), ("heading", "Two", "Two")]
    assert got == [(f"p1-b{i}", *w) for i, w in enumerate(want)]


def test_shared_tables(spark, tmp_path, monkeypatch):
    from pagewright.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda s: f"file://{tmp_path}")
    kept, gone = (shared.stored(spark.range(n), "x", "zstd") for n in (3, 5))
    assert (kept.count(), gone.count()) == (3, 5)
    files = lambda: {p.parent for p in tmp_path.rglob("*.parquet")}
    assert len(files()) == 2
    shared.dropped(gone)
    assert len(files()) == 1 and kept.count() == 3
    shared.clean(spark)
    assert not files()


def test_resectioning(spark):
    rows = [("heading", "3.1"), ("heading", "Title"), ("text", "a"), ("heading", "Noise"), ("text", "b"), ("heading", "4 Next  one"), ("text", "c")]
    df = spark.createDataFrame([(1, i, k, t, "old") for i, (k, t) in enumerate([("text", "before"), *rows])], "doc int, pos int, type string, text string, section string")
    got = [r.section for r in blocks.resectioned(df, ["doc"], "pos").orderBy("pos").collect()]
    assert got == ["old", "3.1", "3.1 Title", "3.1 Title", "3.1 Title", "3.1 Title", "4 Next one", "4 Next one"]


def test_cascades(spark):
    prose = "Some ordinary words that vary enough to be prose, number %d. "
    clean = "".join(prose % i for i in range(9))
    cases = [clean, clean + "foo " * 16 + "foo", "foo " * 20, clean + "." * 80, clean + "ab!" * 20, "😀" * 5 + clean + "(S) " * 30, None]
    got = column(spark, cases, T.without_cascade)
    assert got[0] == clean and got[2] == cases[2] and got[6] is None
    assert all(got[i].endswith(T.CUT_MARK) and len(got[i]) < len(cases[i]) for i in (3, 4, 5)) and got[1] == clean.rstrip() + T.CUT_MARK
    again = column(spark, got[:6], T.without_cascade)
    assert again == got[:6]


def test_captions(spark):
    loop = "Node one connects to node two.\n"
    cases = {
        "<think>hm</think>\nHere is a summary:\n\nA sends to B.\n\nThis summary is accurate.": "A sends to B.",
        "The diagram shows two agents.": "The diagram shows two agents.",
        loop * 8: (loop * 3).strip(),
        "A is \\boxed{42}\n---\n1. **Label**:\n**Whole bold sentence here**\nend": "A is 42\nWhole bold sentence here\nend",
        None: "",
        " \n ": "",
        "- a\n- b\n\n\n\n- c": "- a\n- b\n\n- c",
        "Notes:\n# Head\nA to B\n***": "A to B",
        "The diagram shows X.\nThe diagram depicts Y.": "The diagram shows X.\nThe diagram depicts Y.",
        "A to B\nFor more details\n\n**Note**:": "A to B",
    }
    got = column(spark, list(cases), captions.stripped)
    assert got == list(cases.values())
    assert column(spark, got, captions.stripped) == got


def test_globs(spark):
    sections = ["8.6.9.4.1 x", "18.6.9.4.1", "Some Hot-plug part", "", None]
    hits = lambda g: column(spark, sections, lambda c: T.section_matches(c, g))
    assert hits("8.6.9.4.*") == [True, False, False, False, False]
    assert hits("*Hot-Plug*") == [False, False, True, False, False]
    assert hits(None) == [True] * 5
    paths = ["a/b/test.c", "test.c", "x.py", "a/[b].c"]
    assert column(spark, paths, lambda c: T.any_glob(c, ["*.c"])) == [True, True, False, True]
    assert column(spark, paths, lambda c: T.any_glob(c, ["a/*", "x.[pq]y"])) == [True, False, True, True]


def test_fusion_and_canonical_copies(spark):
    dense = spark.createDataFrame([(1, 10, 0.1, 0), (1, 11, 0.2, 1)], "query_id long, id long, distance double, rank int")
    lex = spark.createDataFrame([(1, 11, 5.0, 0), (1, 12, 4.0, 1)], "query_id long, id long, score double, rank int")
    got = {r.id: (r.distance, r.rrf) for r in fusion.reciprocal_ranks(dense, lex).collect()}
    assert got == {10: (0.1, round(1 / 60, 9)), 11: (0.2, round(1 / 61 + 1 / 60, 9)), 12: (None, round(1 / 61, 9))}
    items = spark.createDataFrame([(1, 1, "Same  text", "draft", 0.9), (1, 2, "same *text*", "std-main", 0.1), (1, 3, "other", "x", 0.5)], "query_id long, id long, text string, source string, rrf double")
    kept = fusion.canonical_best(items, F.col("text"), F.col("source"), ["std"])
    assert sorted(r.id for r in kept.collect()) == [2, 3]


def test_as_of_takes_the_last_of_a_tie(spark):
    left = spark.createDataFrame([("d", 1), ("d", 5), ("d", 9), ("e", 3)], "doc string, page int")
    right = spark.createDataFrame([("d", 2, 0, "a"), ("d", 5, 1, "b"), ("d", 5, 2, "c")], "doc string, since int, ord int, leaf string")
    got = {(r.doc, r.page): r.leaf for r in joins.as_of(left, right, ["doc"], "page", "since", ["leaf"], "ord").collect()}
    assert got == {("d", 1): None, ("d", 5): "c", ("d", 9): "c", ("e", 3): None}


def test_hamming_pairs_and_components(spark):
    rows = [(1, 0), (2, 0b1111), (3, 0b11111111), (4, -1), (5, -1), (6, -2)]
    pairs = joins.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "h", distance=4)
    assert sorted((r.a, r.b, r.d) for r in pairs.collect()) == [(1, 2, 4), (2, 3, 4), (4, 6, 1)]
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (900, 900)]
    got = {r.node: r.component for r in cluster.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500, 900: 900}
    assert cluster.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_index_maintenance(spark):
    index = spark.createDataFrame([("a:0", "a", "1"), ("a:1", "a", "1"), ("b:0", "b", "1"), ("gone:0", "gone", "1")], "id string, file string, mtime string")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "file string, mtime string")
    status = {r.file: r.status for r in ingest.triage(files, index).collect()}
    assert status == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r.status for r in ingest.triage(files, index, force=True).collect()} == {"changed", "new"}
    rows = ingest.next_index(index, files, lambda todo: todo.select(F.concat("file", F.lit(":0")).alias("id"), "file", "mtime")).collect()
    assert sorted((r.id, r.mtime) for r in rows) == [("a:0", "1"), ("a:1", "1"), ("b:0", "2"), ("c:0", "1")]


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1)], "query_id long, rank int, rel int")
    relevant = spark.createDataFrame([(1, 1), (2, 2)], "query_id long, n_relevant long")
    got = {r.cut: r for r in evaluation.ir_metrics(results, relevant, (1, 3)).collect()}
    assert got[1].ndcg == 0.5 and got[1].recall == 0.25 and got[1].precision == 0.5
    assert got[3].map == pytest.approx((0.5 + 0.5) / 2) and got[3].recall == pytest.approx(0.75)
    runs = evaluation.run_delta(spark.createDataFrame([(1, True), (2, False), (3, True)], "id int, passed boolean"), spark.createDataFrame([(1, False), (2, True)], "id int, passed boolean"))
    assert {r.id: r.delta for r in runs.collect()} == {1: "FIXED", 2: "REGRESSED", 3: "new"}


def test_prompts_abstain_without_matches(spark):
    asked = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, question string")
    matches = spark.createDataFrame([(1, 1, "f.pdf", 0, "8.1", "body")], "query_id long, rank int, file string, page int, section string, text string")
    got = {r.query_id: r for r in chat.prompts(asked, chat.citations(matches), "Rule.", "No.").collect()}
    assert got[1].sources.endswith("[1] f.pdf, §8.1") and "[1] f.pdf, §8.1\nbody" in got[1].prompt
    assert got[2].answer == "No." and got[2].prompt is None
    reply = 'Sure: ["Q1", " a ", "", "b"] ok'
    assert column(spark, [reply, "none"], lambda c: chat.sub_queries(F.lit("q1"), c)) == [["q1", "a", "b"], ["q1"]]


def test_layout_tags(spark):
    raw = "noise<x_0.1><y_0.2>A | B<x_0.8><y_0.4><class_Picture><x_0.1><y_0.5>\nCaption\n<x_0.8><y_0.6><class_Caption>"
    rows = blocks.layout_records(spark.createDataFrame([(1, raw)], "page int, raw string"), "page", "raw").orderBy("pos").collect()
    assert [(r.cls, r.bbox) for r in rows] == [("Picture", [0.1, 0.2, 0.8, 0.4]), ("Caption", [0.1, 0.5, 0.8, 0.6])]


def test_render():
    assert render.table_of([["a", "b"], ["1"], ["c", "x|y"]]) == "| a | b |\n| --- | --- |\n\n**1**\n\n| c | x\\|y |\n| --- | --- |"
    assert render.latex_tables("x \\begin{tabular}{ll} a & b \\\\ c\\&d & e \\end{tabular}") == "x | a | b |\n| --- | --- |\n| c&d | e |"
    assert render.markdown([{"type": "heading", "text": "8.6.9 T", "page": 1}, {"type": "text", "text": "t", "page": 2}]) == "<!-- page 1 -->\n\n### 8.6.9 T\n\n<!-- page 2 -->\n\nt"


def test_delta_stream():
    lines, tail = stream.carried(['{"a":1}\n{"a"', ':2}\n{"a":'], "")
    assert lines == ['{"a":1}', '{"a":2}'] and tail == '{"a":'
    assert stream.carried(["3}\n"], tail) == (['{"a":3}'], "")


def test_stream_of_files_updates_the_index(spark, tmp_path):
    src, held = str(tmp_path / "src"), {}
    files = [("a", "1"), ("b", "1")]
    spark.createDataFrame(files, "file string, mtime string").write.parquet(src)
    index = lambda: spark.createDataFrame(held.get("rows", []), "id string, file string, mtime string")
    save = lambda df: held.update(rows=[tuple(r) for r in df.select("id", "file", "mtime").collect()])
    merge = stream.merge_into(index, save, lambda todo: todo.select(F.col("file").alias("id"), "file", "mtime"))
    run = spark.readStream.schema("file string, mtime string").parquet(src).writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    assert sorted(held["rows"]) == [("a", "a", "1"), ("b", "b", "1")]
    merge(spark.createDataFrame([("a", "2")], "file string, mtime string"), 1)
    assert sorted(held["rows"]) == [("a", "a", "2"), ("b", "b", "1")]


def test_event_windows_in_a_stream(spark, data):
    rows = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(data)
    run = stream.tumbling(rows, late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    run.awaitTermination(90)
    batch = stream.tumbling(spark.read.parquet(f"{data}/events.parquet"))
    assert spark.table("tumbling").count() == batch.count() > 0


def test_hamming_pairs_over_64_bits_match_brute_force(spark):
    rng = np.random.default_rng(16)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 20)]
    hashes = base + [base[i] ^ sum(1 << int(b) for b in rng.choice(63, 1 + j, replace=False)) for i in range(20) for j in range(14)]
    want = {(a, b, d) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if (d := ((hashes[a] ^ hashes[b]) & (1 << 64) - 1).bit_count()) <= 12}
    got = joins.hamming_pairs_64(spark.createDataFrame(list(enumerate(hashes)), "id long, h long"), "h").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 240


def test_whole_tables_and_texts_are_examined(spark, tmp_path):
    from pagewright.plans import catalog

    page = "\n".join(["Seite 1", "Jahresbericht der Firma"] * 6)
    rows = [(1, page, "de", "s", len(page)), (2, "x" * 60 + " <b> & tail", "fr", "s", 71)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["chrome_detect_all"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {1} and any("jahresbericht" in r.furniture for r in found)
    cells = {r.doc_id: r.cell for r in catalog.QUERIES["html_escape_whole"](spark, str(tmp_path)).collect()}
    assert cells[2] == "s &lt;" + "x" * 60 + " &lt;b&gt; &amp; tail&gt;"
