"""Every operator and stage on awkward rows, and on none."""

import hashlib
import re

import pytest

import corpus_pipeline
from tessella.llm import alignment, decontaminate, licenses, lines, mixing, neardup, neighbours, quality, scoring, secrets, substrings, toxicity
from tests.llm.conftest import SCHEMA, prose, rows_of


def per_document(docs, labels):
    return {
        "licenses": licenses.scan_licenses(docs),
        "substrings": substrings.remove_repeats(docs),
        "secrets": secrets.scan_secrets(docs),
        "lines": lines.report(docs),
        "toxicity": toxicity.score_toxicity(docs, labels),
        "mixing": mixing.mix_sources(docs),
        "quality": quality.score_quality(docs, labels),
        "neardup": neardup.link_near_duplicates(docs),
        "alignment": alignment.align_tokenizers(docs),
        "scoring": scoring.score_texts(docs),
    }


NAMES = ["licenses", "substrings", "secrets", "lines", "toxicity", "mixing", "quality", "neardup", "alignment", "scoring"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_per_row(corpus, labels, name):
    rows = per_document(corpus, labels)[name].collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus.collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(empty, labels, name):
    assert per_document(empty, labels)[name].collect() == []


def test_empty_labels(corpus, labels):
    none = labels.limit(0)
    assert {r["score"] for r in quality.score_quality(corpus, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(corpus, none).collect()} == {0.5}
    assert quality.keep_good(corpus, none).count() == corpus.count()


def test_null_and_empty_texts(corpus, labels):
    got = {k: {r["doc_id"]: r for r in v.filter("doc_id < 3").collect()} for k, v in per_document(corpus, labels).items()}
    for i in range(3):
        assert got["licenses"][i]["n_words"] == 0 and got["licenses"][i]["labels"] == ""
        assert got["substrings"][i]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
        assert got["secrets"][i]["spans"] == ""
        assert got["mixing"][i]["size"] == got["mixing"][i]["taken"] == 0
        assert got["neardup"][i]["n_shingles"] == 0 and got["neardup"][i]["kept"]
        assert got["scoring"][i]["n_tokens"] == 1
    assert [got["alignment"][i]["n_a"] for i in range(3)] == [0, 0, 4]  # the third is a space, a tab and a line end, behind the space that is added


def test_texts_longer_than_a_chunk(spark, labels):
    """Texts over a megabyte, of one line and of many, whose tails differ from all that is before."""
    body = prose(11, 150_000)
    texts = [body, body + "\nthe very end differs", body.replace("\n", " "), "x" * 1_500_000]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {k: {r["doc_id"]: r for r in v.collect()} for k, v in per_document(docs, labels).items()}
    assert all(len(rows) == 4 for rows in got.values()) and all(len(t.encode()) > 1 << 20 for t in texts)
    assert [got["substrings"][i]["n_words"] for i in range(4)] == [150_000, 150_004, 150_000, 1]
    assert got["substrings"][1]["n_removed"] == got["substrings"][2]["n_removed"] == 150_000
    assert [got["mixing"][i]["size"] for i in range(4)] == [150_000, 150_004, 150_000, 1]
    words = body.split()
    assert got["neardup"][0]["n_shingles"] == len(set(zip(*(words[i:] for i in range(5))))) and [got["neardup"][i]["component_id"] for i in range(4)] == [0, 0, 0, 3]
    assert got["lines"][1]["n_deleted"] == 12_500 and got["lines"][2]["n_deleted"] == 0
    assert got["licenses"][3]["n_words"] == 1 and got["secrets"][3]["spans"] == ""


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, corpus, empty, labels, tmp_path, name, stage):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(3, 300).replace("\n", " ")[:200]), (2, None), (3, ""), (4, "few words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = stage(spark, corpus, folder)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.schema.fieldNames() == corpus.schema.fieldNames()
        assert {r["doc_id"] for r in out.collect()} >= {None, 0, 3, 20, 25} or name == "quality_filter"
    assert stage(spark, empty, folder).collect() == []


def test_run_is_its_stages(spark, corpus, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    corpus.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "nothing that is there at all in any text")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(0 < r["taken"] <= 2 * r["size"] for r in rows)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(0, None), (100, [0.0, 0.0]), (200, [nan, 1.0]), (300, [inf, 1.0]), (400, [None, 1.0]), (500, [1.0]), (None, [1.0, 1.0])]
    good = [(600, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0]), (700, [5.0, 5.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in bad + good], "vec_id long, embedding array<float>, vector int, vb int")
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(frame).collect())
    assert rows[:4] == [(600, 1, 1, 0.0), (600, 2, 3, 0.0), (600, 3, 2, round(5**0.5, 6)), (600, 4, 700, round(41**0.5, 6))] and len(rows) == 8
    assert neighbours.nearest(frame.limit(0)).collect() == []


def test_words_are_byte_exact():
    text = "a b c\x0bd\x1ce   f"
    assert [w.decode() for w in text.encode().split()] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_decontamination_of_nothing(spark, corpus, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(corpus, items).collect() == []
    assert decontaminate.drop_contaminated(corpus, items).count() == corpus.count()
