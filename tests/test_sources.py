"""Files, code, model slots and the engine on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.engine import Engine, UnknownCollection
from pagewright.operators import code, models
from pagewright.sources import files
from pagewright.sources.cache import Kept


def cached(root, collection, name, value):
    folder = root / collection / files.CACHE
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def block(text, **more):
    return {"id": "b", "type": "text", "text": text, **more}


def test_collections_and_pdfs(spark, tmp_path):
    assert files.collections(spark, f"file://{tmp_path}/none").count() == 0
    for name in ("b", "a", ".hidden"):
        (tmp_path / name / "sub").mkdir(parents=True)
        (tmp_path / name / "One.PDF").write_bytes(b"x" * 7)
        (tmp_path / name / "sub" / "deep.pdf").write_bytes(b"x")
        (tmp_path / name / "note.txt").write_bytes(b"x")
    root = f"file://{tmp_path}"
    assert [r.name for r in files.collections(spark, root).collect()] == ["a", "b"]
    assert sorted((r.collection, r.file, r.bytes) for r in files.pdf_files(spark, root).collect()) == [("a", "One.PDF", 7), ("b", "One.PDF", 7)]


def test_extracted_documents(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert files.cached_documents(spark, root).count() == 0
    cached(tmp_path, "c", "a b.pdf", {"doc": "a b.pdf", "source_mtime": "t", "backend": "x", "blocks": [block("é", section_path=["src", "f.c"]), block("z", section_path="A > B")], "extra": 1})
    cached(tmp_path, "c", "broken", "{")
    cached(tmp_path, "c", "no+blocks", {"doc": "x"})
    found = {r.file: r for r in files.cached_documents(spark, root).collect()}
    assert set(found) == {"a b.pdf", "broken", "no+blocks"} and {f for f, r in found.items() if r.malformed} == {"broken", "no+blocks"}
    assert [(b.text, b.section_path) for b in found["a b.pdf"].blocks] == [("é", "src,f.c"), ("z", "A > B")] and found["a b.pdf"].collection == "c"


def test_source_trees(spark, tmp_path):
    for path, data in {"a/x.c": b"int x;", "a/big.c": b"y" * 2000, "a/bin.c": b"a\0b", "vendor/v.c": b"v", ".git/g.c": b"g", "a/x.min.js": b"m", "Makefile": b"all:", "a/x.dat": b"d", "a/bad.py": b"\xff"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    found = {r.path: r.text for r in files.source_tree(spark, f"file://{tmp_path}", most_bytes=1000).collect()}
    assert found == {"a/x.c": "int x;", "Makefile": "all:", "a/bad.py": None}
    assert {r.path for r in files.source_tree(spark, f"file://{tmp_path}", ["*.dat"], ["b/*"]).collect()} == {"a/x.dat"}
    assert files.source_options({"url": "u", "sparse_paths": "a, b,"}) == {"url": "u", "ref": None, "sparse_paths": ["a", "b"], "include_globs": [], "exclude_globs": []}


def test_tables_are_replaced_and_runs_are_not(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.replaced(spark.range(3), path)
    files.replaced(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    files.write_run(spark.range(2), f"{path}-run")
    with pytest.raises(Exception, match="already exists"):
        files.write_run(spark.range(2), f"{path}-run")


def test_kept_values():
    now, loads = [0.0], []
    kept = Kept(lambda: loads.append(1) or len(loads), 30, lambda: now[0])
    assert (kept(), kept()) == (1, 1)
    now[0] = 30
    assert kept() == 2 and kept.having(lambda v: v > 2) == 3 and kept.having(lambda v: v > 99) == 4


def test_code_chunks():
    lines = ["// one\n", "\n", "/* two\n", " * more */\n", "int f() {\n", "}\n", "\n", "int g() {}\n"]
    assert [code.comment_above(lines, i) for i in (4, 7, 0)] == [0, 7, 0]
    assert code.comment_above(["x\n", "// c\n", "\n", "f\n"], 3) == 3 and code.comment_above(["x\n", "// c\n", "f\n"], 2) == 1
    text = "import os\n\n@deco\ndef f():\n    def inner(): pass\n\nif x:\n    class C:\n        pass\n"
    assert [c[:3] for c in code.code_chunks(text, code.python_definitions)] == [(1, 2, "preamble"), (3, 5, "f"), (8, 9, "C")]
    long = "def f():\n" + "    x = 1\n" * 300
    names = [c[2] for c in code.code_chunks(long, code.python_definitions)]
    assert names[:2] == ["f:chunk-1", "f:chunk-2"] and code.code_chunks("", None) == []
    assert [c[2] for c in code.code_chunks("def (", code.python_definitions)] == ["chunk-1"]


def test_model_slots(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", None)], "collection string, text string")
    got = {r.collection: r.vec for r in models.embedded(rows, "text", "collection", {"b": lambda texts: [[1.0, 2.0]] * len(texts)}).collect()}
    assert len(got["a"]) == 64 and abs(sum(x * x for x in got["a"]) - 1) < 1e-5 and got["b"] == [1.0, 2.0] and not any(got["c"])
    with pytest.raises(Exception, match="another number"):
        rows.select(models.embedding(F.col("text"), lambda texts: [])).collect()

    def failing(question, texts):
        raise OSError("down")

    pairs = spark.createDataFrame([("q", "a"), ("q", "bbb")], "q string, t string")
    assert [r[0] for r in pairs.select(models.rerank_score(F.col("q"), F.col("t"), lambda q, t: [len(x) for x in t])).collect()] == [1.0, 3.0]
    assert [r[0] for r in pairs.select(models.rerank_score(F.col("q"), F.col("t"), failing)).collect()] == [None, None]


def test_engine(spark, tmp_path):
    root = tmp_path / "data"
    doc = lambda text, t, **more: {"doc": "d", "source_mtime": t, "backend": "x", "blocks": [block("Gates", type="heading"), block(text, page=2, section="8.6 Gates", **more)]}
    cached(root, "specs", "gates.pdf", doc("The gate control list opens queues at stated times.", "1"))
    cached(root, "specs", "clock.pdf", doc("A grandmaster clock distributes time to bridges.", "1"))
    cached(root, "specs", "broken.pdf", "{")
    (root / "other").mkdir()
    engine = Engine(spark, f"file://{root}", f"file://{tmp_path}/index", preferred=("gates",))
    assert engine.ingest("specs") == {"collection": "specs", "files": 2, "skipped": 0, "processed": 2, "failed": 1, "total_chunks": 2}
    assert engine.ingest("specs")["skipped"] == 2
    cached(root, "specs", "clock.pdf", doc("A grandmaster clock serves time.", "2"))
    (root / "specs" / files.CACHE / "gates.pdf.json").unlink()
    cached(root, "specs", "gate.pdf", doc("The gate control list opens queues at stated times.", "1"))
    changed = engine.ingest("specs")
    assert (changed["files"], changed["processed"], changed["skipped"]) == (2, 2, 0)
    found = engine.search("when does the gate control list open queues", "specs", top_k=5).collect()
    assert [r.file for r in found] == ["gate.pdf", "clock.pdf"] and found[0].id == "specs:gate.pdf:0" and found[0].page == 2
    assert engine.search("gate control", "specs", section="9.*").count() == 0
    assert engine.search("clock", "specs", reply='["gate control list"]', top_k=1).count() == 1
    assert {(r.name, r.ingested, r.active) for r in engine.collections().collect()} == {("other", False, True), ("specs", True, False)}
    engine.active = "specs"
    row = engine.prompt("gate control list", section="8.*").collect()[0]
    assert "[1]" in row.prompt and row.answer is None and engine.prompt("gate", section="9.*").collect()[0].answer.startswith("I don't have")
    assert engine.models().count() == 4 and engine.health()["ok"]
    with pytest.raises(UnknownCollection):
        engine.ingest("none")


def test_pdf_readers_and_blocks(spark):
    from pagewright.sources import pdf

    assert pdf.pick_backend(lambda n: n != "docling") == "pymupdf4llm"
    with pytest.raises(RuntimeError):
        pdf.pick_backend(lambda n: False)

    def reader(content):
        if content == b"bad":
            raise OSError("broken")
        for n, text in enumerate(content.decode().split("\f"), 1):
            yield n, text

    files_ = spark.createDataFrame([("a", bytearray("# One\nx\f\ny\n\n# Two\f ".encode())), ("b", bytearray(b"bad"))], "file string, content binary")
    pages = pdf.rows_of(files_, reader, "page int, text string")
    assert {(r.file, r.page, r.error) for r in pages.collect()} == {("a", 1, None), ("a", 2, None), ("a", 3, None), ("b", None, "OSError: broken")}
    good = pages.where("error is null")
    assert [(r.page, r.block, r.type, r.section, r.text) for r in pdf.markdown_page_blocks(good).orderBy("page", "block").collect()] == [(1, 0, "heading", "One", "One"), (1, 1, "text", "One", "x"), (2, 0, "text", "One", "y"), (2, 1, "heading", "Two", "Two")]
    assert [r.page for r in pdf.page_blocks(good).orderBy("page").collect()] == [1, 2] and pdf.flat_text(good).collect()[0].text.startswith("# One")
    items = spark.createDataFrame([("a", 0, 1, "section_header", "H"), ("a", 1, 1, "text", " "), ("a", 2, 1, "table", "| t |"), ("a", 3, 2, "text", "p")], "file string, pos int, page int, label string, text string")
    assert [(r.page, r.block, r.type, r.section) for r in pdf.item_blocks(items).orderBy("page", "block").collect()] == [(1, 0, "heading", "H"), (1, 2, "table", "H"), (2, 0, "text", "H")]
    boxes = spark.createDataFrame([("a", 0, 1, 600.0, 800.0, 50.0, 10.0, 90.0, 20.0, "RFC head"), ("a", 1, 1, 600.0, 800.0, 50.0, 100.0, 300.0, 150.0, "some\n  prose \n"), ("a", 2, 1, 600.0, 800.0, 50.0, 200.0, 300.0, 250.0, "+--+\n|a |"), ("a", 3, 1, 600.0, 800.0, 110.0, 420.0, 280.0, 440.0, "Figure 3 Gates")], "file string, pos int, page int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string")
    assert [(r.block, r.type, r.text) for r in pdf.plain_text_blocks(boxes).orderBy("block").collect()] == [(0, "text", "some prose"), (1, "code", "+--+\n|a |"), (2, "text", "Figure 3 Gates")]
    images = spark.createDataFrame([("a", 1, 7, 600.0, 800.0, 100.0, 250.0, 300.0, 400.0, bytearray(5000)), ("a", 2, 7, 600.0, 800.0, 0.0, 0.0, 300.0, 400.0, bytearray(5000)), ("a", 1, 8, 600.0, 800.0, 0.0, 0.0, 50.0, 400.0, bytearray(5000)), ("a", 1, 9, 600.0, 800.0, 0.0, 0.0, 500.0, 400.0, bytearray(50))], "file string, page int, xref int, width double, height double, x0 double, y0 double, x1 double, y1 double, png binary")
    found = pdf.picture_blocks(images, boxes).collect()
    assert [(r.id, r.caption, [round(x, 3) for x in r.bbox]) for r in found] == [("p1-pic1", "Figure 3 Gates", [0.167, 0.312, 0.5, 0.5])]


def test_described_pictures(spark):
    rows = spark.createDataFrame([(bytearray(b"ab"), "p"), (None, "p"), (bytearray(b""), None)], "png binary, prompt string")

    def describe(data, prompt):
        return f"{len(data)}{prompt}" if data else 1 / 0

    assert [r[0] for r in rows.select(models.described(F.col("png"), F.col("prompt"), describe)).collect()] == ["2p", None, None]


def test_progress_of_streams(spark, tmp_path):
    import time

    from pagewright.streaming import progress

    fanout, seen, done = progress.Fanout(), [], []
    remove = fanout.add(lambda event, payload: seen.append(payload["state"]))
    fanout.add(lambda event, payload: 1 / 0)
    fanout.send("ingest.progress", {"state": "skipped"})
    assert seen == ["skipped"] and len(fanout._listeners) == 1 and progress.line("e", {"a": "é"}) == 'event: e\ndata: {"a": "é"}\n\n'
    listener = progress.QueryProgress(fanout)
    spark.streams.addListener(listener)
    try:
        for n in range(2):
            spark.createDataFrame([(f"f{n}", "1")], "file string, mtime string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
            stream = spark.readStream.schema("file string, mtime string").json(f"{tmp_path}/in")
            progress.ingest_stream(stream, lambda batch, number: done.extend(r.file for r in batch.collect()), f"{tmp_path}/state")
        assert done == ["f0", "f1"]
        for _ in range(50):
            if seen.count("completed") == 2:
                break
            time.sleep(0.2)
        assert seen.count("started") == seen.count("completed") == 2 and "batch-flushed" in seen
    finally:
        spark.streams.removeListener(listener)
    remove()
    assert not fanout._listeners
