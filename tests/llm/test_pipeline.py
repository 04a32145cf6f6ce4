"""The pipeline's stages: each keeps the columns, drops what it should and leaves clean documents."""

import re

import pytest

import corpus_pipeline
from graphloom.llm.decontaminate import find_leaks

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lab = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        kept[name] = docs.count()
    assert kept["language"] >= 990
    junk = spark.read.parquet(f"{DATA}/documents.parquet").join(lab.where("quality = 0"), "doc_id")
    assert docs.join(junk.select("doc_id"), "doc_id", "left_semi").count() < 0.3 * junk.count()
    assert kept["near_duplicates"] < kept["quality"] and find_leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).isEmpty()
    texts = [re.sub(r"\s+", " ", r.text.lower()).strip() for r in docs.select("text").collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, row string, sid string, words string, _lang_pred string, item_id string"


def awkward(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    more = [(None, data[0].text), (None, data[0].text), (data[1].doc_id, data[1].text), (900, None), (901, ""), (902, " \n"), (903, "123 !!"), (904, "wort " * 50_000), (None, item), (905, "x" * 200_000)]
    rows = [(r.doc_id, r.text, r.lang, r.source, len(r.text or "")) for r in data] + [(i, t, None, "s", 0) for i, t in more]
    return spark.createDataFrame([(*r, "r", "s", "w", "l", "i") for r in rows], AWKWARD), len(rows), item


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(spark, name, stage):
    """Null and repeated ids, null, empty and long texts, columns of clashing names; then no rows at all."""
    docs, n, item = awkward(spark)
    got = stage(spark, docs, "/root/testdata/sf0.001")
    assert name == "packing" or got.columns == docs.columns
    rows = got.collect()
    texts = [r.text for r in rows] if name != "packing" else []
    if name == "language":
        assert not {None, "", " \n", "123 !!"} & set(texts) and len(rows) > 30
    if name == "near_duplicates":
        worded = [" ".join(t.lower().split()) for t in texts if t and t.split()]
        assert len(worded) == len(set(worded)) and texts.count(None) == 1 and texts.count("") == 1 and set(worded) == {" ".join(t.lower().split()) for t in worded}
    if name == "decontamination":
        assert item not in texts and {None, ""} <= set(texts) and len(rows) >= n - 8
    if name == "packing":
        assert {r.doc_id for r in rows} >= {900, 901, 902} and sum(r.length for r in rows if r.start == 0 and r.doc_id == 900) == 1
    empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
    assert empty.isEmpty() and (name == "packing" or empty.columns == docs.columns)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 100 and rows.columns[:3] == ["doc_id", "start", "length"]
