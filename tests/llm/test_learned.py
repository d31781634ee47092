"""Learned operators: held-out accuracy and odd inputs; and the pipeline stage by stage."""

import collections

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from heliogale.llm import langid, quality, toxicity
from heliogale.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    read = lambda name: QUERIES[name](spark, LARGER).join(labels, "doc_id").filter("held_out").collect()
    return {name: read(name) for name in ("op1_compression_quality", "op7_pu_toxicity")}


def test_quality(scored):
    seen = collections.Counter((r["quality"], r["predicted"]) for r in scored["op1_compression_quality"])
    assert seen[1, 1] >= 0.95 * (seen[1, 1] + seen[1, 0]) and seen[0, 0] >= 0.6 * (seen[0, 0] + seen[0, 1])


def test_toxicity(scored):
    seen = collections.Counter((r["toxic"], r["predicted"]) for r in scored["op7_pu_toxicity"])
    assert seen[0, 1] <= 0.05 * (seen[0, 0] + seen[0, 1]) and seen[1, 1] >= 0.5 * (seen[1, 0] + seen[1, 1])


def test_language(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op2_kernel_language"](spark, LARGER).join(docs, "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count()


def test_language_of_repeated_ids(spark):
    """Texts of two languages, and of none, under the same ids."""
    texts = [(0, "en", "plain words of a calm text"), (100, "ru", "простые слова"), (200, None, "otras cosas")]
    learned = [(k % 7, lang, f"{text} {k}") for k in range(60) for _, lang, text in texts]
    asked = spark.createDataFrame([(first + k, f"{text} {k}") for k in range(60) for first, lang, text in texts if lang], "doc_id long, text string")
    model = langid.train(spark.createDataFrame(learned, "doc_id long, lang string, text string"), F.lit(True))
    got = {(r["doc_id"] // 100, r["lang_pred"]) for r in model.predict(asked).collect()}
    assert got == {(0, "en"), (1, "ru")}


def test_odd_texts(frame, hard_rows, spark):
    docs = frame(hard_rows, True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    yes = F.lit(True)
    for out in (quality.classify(docs, none, 0.3, yes, yes), toxicity.classify(docs, none, 0.5, yes, yes), langid.identify(docs, yes, yes)):
        rows = out.collect()
        assert len(rows) == len(hard_rows) and all(0 <= r["score"] <= 1 for r in rows)
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, yes, yes).collect() if r["doc_id"] in (1, 2, 3, 4)}
    assert lang == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert {r["lang_pred"] for r in langid.identify(docs, F.lit(False), yes).collect()} == {"und"}
    empty = frame([])
    assert quality.classify(empty, none, 0.3, yes, yes).count() == toxicity.classify(empty, none, 0.5, yes, yes).count() == 0
    assert langid.identify(empty, yes, yes).count() == 0


def test_labels_with_nulls(frame, spark):
    rows = [(k, ("plain words in a calm row " * 8 + f"n{k}") if k % 2 else ("$$$ BUY!!! ###" * 12 + f"n{k}")) for k in range(200)]
    labels = spark.createDataFrame(
        [(k, k % 2, 1 - k % 2) for k in range(150)] + [(None, 1, 1), (3, None, None), (9999, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs, yes = frame(rows + [(None, None)], True), F.lit(True)
    for out, good in ((quality.classify(docs, labels, 0.3, yes, yes), 1), (toxicity.classify(docs, labels, 0.5, yes, yes), 0)):
        assert all(r["predicted"] == (good if r["doc_id"] % 2 else 1 - good) for r in out.collect() if r["doc_id"] is not None)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF).cache())
    good, single, clean, mixed, shards = tables[1:]
    assert all(t.columns == names for t in tables[1:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in good.collect()}
    assert sum(q == 1 and i not in left for i, q in labels.items()) <= 3
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in single.collect()} == {i for i, _, c in brute.jaccard_components(rows) if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = lambda t: any(i in (t or "") for i in items)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not held(r["text"])}
    assert mixed.select("doc_id").distinct().count() <= clean.count() and shards.count() == mixed.count()


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() > 0
