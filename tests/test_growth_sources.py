"""Answers read their own pages only; payloads are parsed by many tasks."""

import pytest
from biblion.sources import harvest, normalize
from pyspark.sql import functions as F


def test_an_answer_reads_its_own_pages_only(spark, monkeypatch):
    pages = spark.range(1000).select(F.concat(F.lit("https://x.org/?q=é&page="), F.col("id").cast("string")).alias("url"), F.concat(F.lit("body "), F.col("id").cast("string")).alias("body"))
    table = harvest.record(pages)
    get, read, real = harvest.recorded_table(table.written_to), [], harvest.pq.read_table
    monkeypatch.setattr(harvest.pq, "read_table", lambda where, **k: read.append(real(where, columns=["url"], partitioning=None).num_rows) or real(where, **k))
    assert [get(f"https://x.org/?q=é&page={i}") for i in (0, 17, 999)] == ["body 0", "body 17", "body 999"]
    assert max(read) < 3 * harvest.PAGES_PER_FOLDER
    with pytest.raises(FileNotFoundError):
        get("https://x.org/?q=é&page=1000")
    assert harvest.recorded_table(harvest.written(pages, "plain").written_to)("https://x.org/?q=é&page=5") == "body 5"


def test_no_pages(spark):
    table = harvest.record(spark.createDataFrame([], "url string, body string"))
    with pytest.raises(FileNotFoundError):
        harvest.recorded_table(table.written_to)("https://x.org")


@pytest.mark.parametrize("normaliser, payload", [(normalize.works, '{"id": "W1"}'), (normalize.items, '{"_embedded": {"indexableObject": {"uuid": "u"}}}'), (normalize.oai, "<record><header><identifier>x</identifier></header></record>")])
def test_payloads_of_one_file_are_dealt_to_tasks(spark, normaliser, payload):
    raw = spark.range(400, numPartitions=1).select(F.lit("s").alias("source"), F.lit("S").alias("label"), F.lit(payload).alias("payload"), F.col("id").alias("_ord"))
    made = normaliser(raw)
    assert [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()] and made.count() == 400
    assert made.rdd.getNumPartitions() == 4
