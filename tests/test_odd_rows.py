"""Copies, odd letters and blocks: what a round of findings was about."""

import duckdb
import numpy as np
import pytest

from pagewright.operators import cluster, joins
from pagewright.plans.catalog import ORACLE_SQL, QUERIES

from test_oracle import sorted_rows


def like_sql(spark, name, folder, **tables):
    """Rows of the query over these tables, which must be DuckDB's."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = sorted_rows(found.collect(), found.columns)
    assert rows == sorted_rows(want.fetchall(), columns)
    return rows


def vectors(spark):
    """40 vectors, most of them near others, and copies of three."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((8, 64))
    rows = [base[i] * np.where(rng.permutation(64) < 3 * k, -1, 1) for i in range(8) for k in range(4)] + [base[i] * 2.0 for i in (0, 0, 1, 2)]
    return spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")


def test_pairs_of_equal_hashes_are_pairs(spark, tmp_path):
    rows = like_sql(spark, "simhash_pairs_64", tmp_path, embeddings=vectors(spark))
    assert sum(d == 0 for *_, d in rows) == 5


def test_copies_have_components(spark, tmp_path):
    rows = like_sql(spark, "near_dup_components_64", tmp_path, embeddings=vectors(spark))
    assert {32, 33, 34, 35} <= {int(x) for r in rows for x in r}


@pytest.mark.parametrize("block", [3, 1 << 15])
def test_blocks_of_hashes_give_each_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK_ROWS", block)
    monkeypatch.setattr(joins, "PAIRS_AT_ONCE", 8)
    monkeypatch.setattr(joins, "SLOT_ROWS", 2)
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1 << 6, 40).tolist() + [-1, -1, -1, -2]
    rows = spark.createDataFrame(list(enumerate(values)) + [(99, None)], "id long, h long")
    d = lambda a, b: ((values[a] ^ values[b]) & (1 << 64) - 1).bit_count()
    want = sorted((a, b, d(a, b)) for a in range(44) for b in range(a + 1, 44) if d(a, b) <= 1)
    assert sorted(tuple(r) for r in joins.hamming_pairs_64(rows, "h", distance=1).collect()) == want
    links = joins.hamming_links(rows, "h", distance=1, copies=True)
    pairs = spark.createDataFrame([x[:2] for x in want], "a long, b long")
    assert sorted(cluster.components(links).collect()) == sorted(cluster.components(pairs).collect())


def test_links_are_fewer_than_pairs(spark):
    near = spark.createDataFrame([(i, i) for i in range(256)], "id long, h long")  # all within 8 bits
    assert joins.hamming_pairs(near, "h", distance=8).count() == 256 * 255 // 2
    assert joins.hamming_links(near, "h", distance=8).count() == 255


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"src{i % 7}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_furniture_with_letters_beyond_ascii(spark, tmp_path):
    lines = ["Éxi annual report", "İstanbul annual report", "ΟΔΟΣ annual report", "annual report xiv -\u0085"]
    page = "\n".join(x for _ in range(4) for x in ("page", *lines))
    rows = like_sql(spark, "chrome_detect", tmp_path, documents=documents(spark, [page, "page\n" * 3]))
    assert {r[1] for r in rows} >= {"é# annual report", "istanbul annual report"}


def test_headings_that_look_like_numbers(spark, tmp_path):
    texts = ["a\n1219 Title\nb\n77 noise\nc", "a\n\n\n 12 x\nb\n9\n8\n7 y", "a\nb\n\nnoise after a bare number\nc", "a\nb\nx\u0085y\nd"]
    rows = like_sql(spark, "resection_headings", tmp_path, documents=documents(spark, texts))
    assert (0, 1, "1.1 1219 Title") in rows and (0, 3, "2.3 b") in rows


def test_scores_in_pieces(spark, tmp_path, monkeypatch):
    from pagewright.operators import lexical

    for name, n in (("QUESTIONS_AT_ONCE", 2), ("POSTINGS_AT_ONCE", 5), ("CELLS_AT_ONCE", 6)):
        monkeypatch.setattr(lexical, name, n)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)] + ["Straße", "x_1"]
    texts = ["", "w1", *(" ".join(rng.choice(words, k)) for k in rng.integers(1, 40, 150))]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id < 9")).union(docs.where("doc_id between 3 and 5").selectExpr("doc_id", "concat(text, ' w1 w2')", "lang", "source", "n_chars"))
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 6))) for i in range(7)] + [(3, "w1 w5 w5"), (9, ""), (10, "nowhere")], "item_id long, text string")
    rows = like_sql(spark, "bm25_batch", tmp_path, documents=docs, benchmark=asked)
    assert len({r[1] for r in rows}) == 7 and len(rows) > 7 * 50


def test_no_task_sorts_all_scores_of_a_question(spark):
    from pagewright.operators import lexical

    docs = spark.range(0, 4000, 1, 4).selectExpr("id", "concat('common ', id) as text")
    asked = [{"query_id": 1, "term": "common"}]
    best = lexical._best_of(docs, asked, spark.createDataFrame([(1,)], "query_id long").schema[0], 3)
    assert best.count() <= 3 * best.rdd.getNumPartitions() and {r["id"] for r in best.collect()} >= {0, 1, 2}


def test_all_cascades_are_suspected(spark):
    import re

    from pyspark.sql import functions as F

    from pagewright.functions import text as T

    prose = "".join(f"Some ordinary words, number {i}. " for i in range(12))
    runs = ["foo " * 16, "xfoo  foo\t" + "foo\n" * 13 + "foo foox", "abc" * 11, "é😀x" * 11, "abcdefghijkl" * 11, "ab" * 24, ". " * 50, "(S) \\" * 16, "Electronic address: a " * 3]
    texts = [prose] + [prose[k:] + r + prose for k in range(4) for r in runs] + [prose + "foo " * 6, prose + "abc" * 5]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(*[F.regexp_substr("t", F.lit(p)).isNotNull() for p in T.CASCADES]).collect()
    may = T._may_cascade([t.encode() for t in texts])
    assert all(m >> i & 1 for r, m in zip(got, may, strict=True) for i in range(5) if r[i])
    assert may[0] == may[-1] == may[-2] == 0 and all(any(r) for r in got[1:-2]) and re.search("é", texts[4])


def test_windows_collapse_a_text_once(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import chunk

    df = spark.createDataFrame([("a  b " * 999,)], "t string").select(chunk.windows(F.col("t"), 100, F.lit(10)).alias("w"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert len(df.collect()[0].w[0]) == 100


def test_markdown_moves_no_lines_and_goes_in_small_batches(spark):
    from pagewright.operators import blocks, render

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = documents(spark, ["# A\nx", "y"]).union(documents(spark, ["# B\nz"]))
    found = blocks.from_markdown(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.section, r.block_text) for r in found.collect()) == [(0, "A", "A"), (0, "A", "x"), (0, "B", "B"), (0, "B", "z"), (1, "", "y")]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert render.documents_as_markdown(blocks.line_blocks(docs)).count() == 3
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
