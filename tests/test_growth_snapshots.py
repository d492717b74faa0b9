"""Batches merged into stored works: a bucket is written by several tasks, stored rows are read in the columns in use, records are listed once."""

from biblion.operators import merge, snapshots
from biblion.schemas import SOURCE_FIELDS
from biblion.streaming import upsert
from pyspark.sql import functions as F


def layered(spark, path):
    store = snapshots.Snapshots(spark, path, buckets=1)
    for first, note in ((0, "old"), (500, "new"), (900, "newest")):
        store.upsert({"results": spark.range(first, 1000).select(F.concat(F.lit("k"), "id").alias("publication_key"), F.lit("m").alias("model"), F.lit(note).alias("v"), F.lit("x").alias("text"))})
    return store


def test_tasks_share_a_bucket(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = layered(spark, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for folder in store.tables()["results"]["folders"]["0"]:
        index = spark.read.parquet(f"{tmp_path}/s/{folder}/index").collect()
        rows = spark.read.parquet(f"{tmp_path}/s/{folder}/rows")
        assert len({r["file"] for r in index}) == len(index) > 1 and sum(r["n"] for r in index) == rows.count()
    for i, note in ((3, "old"), (600, "new"), (999, "newest")):
        assert [r["v"] for r in store.look_up("results", f"k{i}", "m").collect()] == [note]


def test_the_last_folder_of_a_key_counts(spark, tmp_path):
    rows = layered(spark, str(tmp_path / "s")).read("results")
    assert {r["v"]: r["n"] for r in rows.groupBy("v").agg(F.count("*").alias("n")).collect()} == {"old": 500, "new": 400, "newest": 100}
    plan = rows.select("publication_key", "v")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text:string" not in plan


def test_records_of_a_publication_are_listed_once(spark):
    rows = spark.range(10).select(*[F.lit(None if f == "is_oa" else "a").cast("boolean" if f == "is_oa" else "string").alias(f) for f in SOURCE_FIELDS], F.col("id").alias("_ord"))
    plan = merge.merge_publications(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1


def test_of_records_of_a_key_the_last(spark):
    given = spark.createDataFrame([("a", "p1", 1), ("b", "p2", 2), ("a", "p3", 3)], "source_record_key string, publication_key string, _ord long")
    given = given.select("source_record_key", "publication_key", *[F.lit("x").alias(f) for f in upsert.RECORD_FIELDS[2:]], "_ord")
    for rows, want in ((given, {("a", "p3"), ("b", "p2")}), (given.where("_ord > 1"), {("a", "p3"), ("b", "p2")})):
        found = upsert.last_of_each(rows)
        assert found.columns == upsert.RECORD_FIELDS and {tuple(r)[:2] for r in found.collect()} == want
