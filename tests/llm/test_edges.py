"""Nulls, empty and long texts, repeated rows, empty tables, clashing column names: no operator crashes."""

import random

import corpus_pipeline
import pytest
from biblion.llm import registry
from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long, rep long, `key` string, bucket int, spans string, _salt int, component long"


def table(spark, path, rows):
    made = [(i, t, lang, "s", len(t or ""), 1, "k", 2, "x", 3, 4) for i, t, lang in rows]
    spark.createDataFrame(made, DDL).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", 0), (2, None, 1), (3, "", 1), (None, "short item", 1)], "item_id long, text string, extra int").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["the", "and", "house", "idiot", "über", "maison", "être", "casa", "niño"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))), rng.choice(["en", "de", None])) for i in range(1, 40)]
    rows += [(100, None, "en"), (101, "", None), (102, "a", "en"), (103, "   \n", "de"), (104, "12 34 !!", "en"), (105, long, "en"), (106, long, "en"), (105, long, "en"), (None, "no id here at all", "en"), (None, None, None), (107, "x" * 5000, "en"), (108, "😀 日本語 текст", None), (109, "zero one two three four five six seven eight nine ten eleven", "en")]
    path = str(tmp_path_factory.mktemp("odd"))
    table(spark, path, rows)
    return path, rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    table(spark, path, [])
    return path


#: Queries with a row for each document (or piece); test_new_operators has the odd rows of the others.
BY_DOCUMENT = [n for n in registry.queries() if n not in ("op12_chat_format", "op13_spelling_variants")]


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_odd_rows(spark, odd, name):
    path, rows = odd
    out = registry.queries()[name](spark, path).collect()
    per_row = len(out) if name != "op6_packing" else sum(r["piece"] == 0 for r in out)
    assert per_row == len(rows)
    if name in ("op1_language_id", "op5_toxicity"):
        assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in out)
    if name == "op10_suffix_dedup":
        by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
        assert by[106]["n_removed"] == by[106]["n_bytes"] and by[102]["n_removed"] == 0


@pytest.mark.parametrize("name", [*BY_DOCUMENT, "op13_spelling_variants"])
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).collect() == []


def test_pipeline_on_odd_and_empty(spark, odd, empty):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, odd[0])
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert docs.count() > 5
    assert docs.where(F.col("text").contains("one two three four five six seven eight nine ten")).count() == 0
    assert corpus_pipeline.run(spark, odd[0]).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
