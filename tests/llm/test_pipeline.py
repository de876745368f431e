"""The pipeline's stages: what goes, what stays, and that each works on what the one before kept."""

import corpus_pipeline
from pagewright.llm import common, quality, secrets, toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    labels = {r.doc_id: r for r in common.table(spark, SF, "labels").collect()}
    kept, texts = [{r.doc_id for r in docs.collect()}], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        texts[name] = {r.doc_id: r.text for r in rows}
        kept.append(set(texts[name]))
        assert kept[-1] <= kept[-2] and len(rows) == len(kept[-1])
    good = [i for i, r in labels.items() if r.quality == 1]
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in kept[1] for i in good) >= 0.98 * len(good) and sum(i in kept[1] for i in bad) <= 0.2 * len(bad)
    toxic = [i for i, r in labels.items() if r.toxic == 1 and i in kept[1]]
    clean = [i for i, r in labels.items() if r.toxic == 0 and i in kept[1]]
    assert sum(i in kept[2] for i in toxic) <= 0.3 * len(toxic) and sum(i in kept[2] for i in clean) >= 0.97 * len(clean)
    before = texts["toxicity"]
    seen = {}
    for i in sorted(before):
        seen.setdefault(before[i], i)
    assert all(seen[before[i]] == i for i in kept[3])  # of exact copies the smallest stays, if any
    assert not any(secrets.scan([t.encode()])[0] for t in list(texts["secrets"].values()))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == kept[4] == kept[3]


def test_extra_columns_with_the_stages_own_names(spark):
    names = ["score", "spans", "__text", "__score", "__row", "__masked", "__marks", "__made", "row", "id", "key"]
    rows = [(1, "some clean words stand here", "en", "s", 27, *range(11)), (1, "some clean words stand here", "en", "s", 27, *range(11)), (None, None, None, None, None, *[None] * 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, "/root/testdata/sf0.001"), "odd")
    assert docs.columns[5:] == names and [tuple(r)[5:] for r in docs.collect()] == [tuple(range(11))]
    assert corpus_pipeline.ORACLE_SQL is None and quality.THRESHOLD == toxicity.THRESHOLD == 0.7
