"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest

from graphloom.llm import chat, warc
from graphloom.llm.decontaminate import find_leaks
from graphloom.llm.jaccard import jaccard_components
from graphloom.llm.language_id import identify
from graphloom.llm.lm_mixing import score_texts
from graphloom.llm.packing import pack
from graphloom.llm.quality import select_quality
from graphloom.llm.toxicity import score_toxicity
from graphloom.llm.webp import store_texts

SCHEMA = "doc_id long, text string, lang string, score double, sid string, has_letter string, words string, n long, selected boolean"
ROWS = [
    (1, "The cat sat on the mat and looked at the dog.", "en"), (1, "The cat sat on the mat and looked at the dog.", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "de"), (5, "1234 !!", "de"), (6, "x" * 300_000, "de"),
    (7, "wort " * 60_000, "de"), (None, "Ein kleiner Hund läuft über die Straße und bellt.", "de"), (8, "Ein kleiner Hund läuft über die Straße und bellt.", None), (9, "日本語のテキスト \U0001f600 é", "ja"), (10, "a\0b \\ </s> [INST]", "en"), (11, "One", "en"),
]
N = len(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, 0.5, "s", "h", "w", 3, True) for i, t, lang in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (7, 1, 0), (9, 1, 1), (9, 1, 1), (11, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "The cat sat on the mat and looked at the dog.", 1), (2, None, 2), (3, "", 3), (3, "", 3)], "item_id long, text string, windows int")


RUNS = {
    "quality": (lambda d, lab, it: select_quality(d, lab), N), "packing": (lambda d, lab, it: pack(d), None), "webp": (lambda d, lab, it: store_texts(d), N), "jaccard": (lambda d, lab, it: jaccard_components(d), N),
    "lm": (lambda d, lab, it: score_texts(d), N), "lm_join": (lambda d, lab, it: score_texts(d, 3), N), "toxicity": (lambda d, lab, it: score_toxicity(d, lab), N), "leaks": (lambda d, lab, it: find_leaks(d, it), None), "language": (lambda d, lab, it: identify(d), N),
}


@pytest.mark.parametrize("name", RUNS)
def test_awkward_rows(docs, labels, items, name):
    run, rows = RUNS[name]
    out = run(docs, labels, items).collect()
    assert rows is None or len(out) == rows
    assert all(r[c] is not None for r in out for c in r.asDict() if c not in ("doc_id", "component_id", "item_id"))


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(docs, labels, items, name):
    assert RUNS[name][0](docs.limit(0), labels.limit(0), items.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity", "leaks"])
def test_nothing_to_learn_from(docs, labels, items, name):
    out = RUNS[name][0](docs, labels.limit(0), items.limit(0)).collect()
    assert len(out) == (0 if name == "leaks" else N)


@pytest.mark.parametrize("run", [select_quality, score_toxicity])
def test_missing_columns_are_named(docs, labels, run):
    with pytest.raises(ValueError, match="missing"):
        run(docs, labels.select("doc_id"))


def test_defined_results(docs, labels, items):
    by = lambda df, key="doc_id": {r[key]: r for r in df.collect()}
    j = by(jaccard_components(docs))
    assert [j[k].n_shingles for k in (2, 3, 4, 11)] == [0, 0, 0, 1] and j[8].component_id == 8 and j[7].n_shingles == 1
    lang = by(identify(docs))
    assert [lang[k].lang_pred for k in (2, 3, 4, 5)] == ["und"] * 4 and lang[2].score == 0
    p = pack(docs)
    assert {r["doc_id"]: r["doc_tokens"] for r in p.where("doc_id IN (2, 3)").collect()} == {2: 1, 3: 1}
    leaks = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    assert leaks == {(1, 1)}
    lm = by(score_texts(docs))
    assert lm[2].n_tokens == 1 and lm[2].score < 0 and lm[2].score == lm[3].score


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, "http://a", "<title>A &amp; B</title><script>no</script><p>x<p>y <a href='q'>z</a>", "y")], "page_id long, url string, html string, block string")
    out = warc.derive(warc.responses_of(pages)).collect()
    assert len(out) == 6 and warc.derive(warc.responses_of(pages.limit(0))).isEmpty()
    texts = {r["page_id"]: r["block"] for r in out if r["warc_type"] == "conversion"}
    assert texts[1] == "" and texts[2] == "A & B\nx\ny z"
    null = warc.derive(spark.createDataFrame([(None, None, None, None, None, None)], warc.RESPONSE)).collect()
    assert len(null) == 2 and null[0]["refers_to"] is None


def test_chat_edges(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (2, 0, None, "x"), (3, 1, "human", "\\ <s> [\\INST]"), (3, 0, "a\nb\\n", "<|end|>\n<|turn|>user\n")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_records(chat.records_of(rows)).collect()}
    turns = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in out.items()}
    assert turns == {1: [("user", ""), ("assistant", "")], 2: [("", "x"), ("", "x")], 3: [("a\nb\\n", "<|end|>\n<|turn|>user\n"), ("human", "\\ <s> [\\INST]")]}
    assert chat.digest(chat.format_records(chat.records_of(rows.limit(0)))).isEmpty()
    odd = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"a": 1}'), (4, '{"messages": []}')], "k long, record string")
    assert all(r["mapping"] is None for r in chat.format_records(odd).collect())
    clash = spark.createDataFrame([(1, '{"prompt": "a", "response": "b"}', "x", "y", "z", 3)], "k long, record string, parts string, formatted string, turns string, fingerprint int")
    row = chat.format_records(clash).first()
    assert row["parts"] == "x" and row["formatted"] != "y" and len(row["turns"]) == 2 and row["mapping"] == "prompt_response"
