"""Every stage of the corpus pipeline against a plain version of it, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import lines, mixing, quality
from tests.llm.conftest import SCHEMA, prose, rows_of
from tests.llm.test_operators import brute_groups, brute_mix

STAGE = dict(corpus_pipeline.STAGES)
ITEM = prose(9001, 30).replace("\n", " ")


def junk(seed):
    return "\n".join("### " + " | ".join(w + "$%&" for w in line.split()) for line in prose(seed, 60).split("\n"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad documents with labels, blocks that repeat, near copies and leaked items."""
    block, base = prose(60, 48), prose(61, 200).split()
    texts = [prose(i, 60) if i % 4 else junk(i) for i in range(200)]
    texts += [prose(700 + i, 36) + "\n" + block + "\n" + prose(720 + i, 36) for i in range(6)]
    texts += [" ".join([*base[:k], f"odd{k}", *base[k + 1 :]]) for k in range(0, 60, 10)]
    texts += [prose(800 + i, 20) + " " + ITEM + " " + prose(820 + i, 20) for i in range(5)] + [None, "", " \n", prose(1, 60)]
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([*rows_of(texts), (None, block, "en", "s0", 1, 1, "x", "k")], SCHEMA).withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "too few"), (3, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def keyed(df):
    return sorted(map(str, df.collect()))


def test_quality_filter_removes_bad_documents_only(spark, folder):
    docs = docs_of(spark, folder)
    kept = {r["doc_id"] for r in STAGE["quality_filter"](spark, docs, folder).collect()}
    rows = quality.score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert kept == {r["doc_id"] for r in rows if r["score"] >= 0.3}
    assert not kept & {i for i in range(200) if i % 4 == 0} and kept >= {i for i in range(200) if i % 4}


def test_line_dedup_removes_repeated_blocks(spark, folder):
    docs = docs_of(spark, folder)
    got = {r["doc_id"]: r for r in STAGE["line_dedup"](spark, docs, folder).collect() if r["doc_id"] is not None}
    seen, want = {}, {}
    for r in sorted((r for r in docs.collect() if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        rows = (r["text"] or "").split("\n")
        own = {x.strip(" ") for x in rows if len(x.strip(" ").split(" ")) >= lines.ANCHOR_WORDS}
        gone = {x for x in own if x in seen}
        seen |= dict.fromkeys(own)
        kept = [x for x in rows if x.strip(" ") not in gone]
        if kept or not gone:
            want[r["doc_id"]] = r["text"] if not gone else "\n".join(kept)
    assert {k: r["text"] for k, r in got.items()} == want and len(want) < docs.count() - 1
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_dedup_keeps_one_of_each_group(spark, folder):
    docs = docs_of(spark, folder)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").collect() if r["doc_id"] is not None)
    groups = brute_groups([t for _, t in rows], 2)
    want = {i for (i, _), g in zip(rows, groups) if rows[g][0] == i} | {None}
    assert {r["doc_id"] for r in STAGE["near_dedup"](spark, docs, folder).collect()} == want and len(want) < len(rows)


def test_decontamination_drops_documents_that_hold_an_item(spark, folder):
    docs = docs_of(spark, folder)
    shingles = lambda t: {tuple(w) for w in zip(*((t or "").lower().split()[i:] for i in range(5)))}
    item = shingles(ITEM)
    want = sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] is None or len(item & shingles(r["text"])) < 0.8 * len(item))
    assert sorted(str(r["doc_id"]) for r in STAGE["decontamination"](spark, docs, folder).collect()) == want and len(want) == docs.count() - 5


def test_mixing_takes_what_the_sorted_queue_gives(spark, folder):
    docs = docs_of(spark, folder).filter("doc_id is not null")
    rows, size = docs.collect(), {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + len((r["text"] or "").split())
    goal = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    want = {k: v for k, v in brute_mix(rows, goal, mixing.PACKET).items() if v}
    assert {r["doc_id"]: r["taken"] for r in STAGE["mixing_sources"](spark, docs, folder).collect()} == want


def test_run_is_its_stages_in_order(spark, folder):
    docs = docs_of(spark, folder)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "line_dedup", "near_dedup", "decontamination", "mixing_sources"]
    assert keyed(corpus_pipeline.run(spark, folder)) == keyed(docs)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, folder, name):
    docs = docs_of(spark, folder)
    for extra in ("_tessella_id", "_tessella_mark", "id", "component_id", "score", "batch"):
        docs = docs.withColumn(extra, F.lit("own"))
    out = STAGE[name](spark, docs, folder)
    assert out.columns == docs.columns and {r[0] for r in out.select("_tessella_id").distinct().collect()} == {"own"}
    assert STAGE[name](spark, docs.limit(0), folder).collect() == []
