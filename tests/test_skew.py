"""Keys and rows that hold most of the data: same results, work spread over tasks."""

import random
from itertools import combinations

import pytest
from biblion.operators import analytics, merge
from pyspark.sql import functions as F
from test_snapshots import source_rows


def told(df):
    return {r["publication_key"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_hot_keys_fold_in_two_levels(spark, monkeypatch, bits):
    monkeypatch.setattr(merge, "RUN_BITS", bits)
    rng = random.Random(bits)
    rows = source_rows(spark, rng, 60, 5).withColumns({
        "publication_key": F.when(F.col("_ord") % 2 == 0, "doi:hot").otherwise(F.col("publication_key")),
        "abstract": F.when(F.col("_ord") % 5 == 0, F.repeat(F.lit("a"), (F.col("_ord") % 9).cast("int"))),
        "doi": F.when(F.col("_ord") % 7 == 0, F.concat(F.lit("10.1/"), F.col("_ord").cast("string"))).otherwise(""),
        "type": F.when(F.col("_ord") % 3 == 0, "book").when(F.col("_ord") % 3 == 1, "article").otherwise("other"),
        "oa_status": F.when(F.col("_ord") % 11 == 0, "gold").otherwise("unknown"),
        "record_url": F.when(F.col("_ord") % 4 > 0, F.concat(F.lit("u; "), (F.col("_ord") % 4).cast("string"))),
        "institution_affiliations_json": F.concat(F.lit('[{"id":"I'), (F.col("_ord") % 6).cast("string"), F.lit('","name":"N","country":""}]')),
    })
    hot = merge.hot_keys(rows, 20)
    assert [r["publication_key"] for r in hot.collect()] == ["doi:hot"]
    want = told(merge.merge_publications(rows))
    assert told(merge.merge_publications(rows, hot)) == want == told(merge.merge_publications(rows, rows.select("publication_key").distinct()))
    assert want["doi:hot"]["source_provenance_json"].count("source_record_key") == 30


def test_pairs_of_a_heavy_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(analytics, "HEAVY_IDS", 20)
    monkeypatch.setattr(analytics, "BLOCK_IDS", 7)
    ids = [[f"i{k:03d}" for k in range(n)] for n in (0, 1, 2, 19, 20, 21, 95)] + [["x", "x", "y"], ["z", "z"]]
    rows = spark.createDataFrame([(x,) for x in ids], "ids array<string>")
    want = sorted(p for x in ids for p in combinations(sorted(set(x)), 2))
    made = analytics.pairs(rows, "ids")
    assert sorted(map(tuple, made.collect())) == want
    heavy = analytics.pairs(rows.where(F.size("ids") == 95), "ids")
    by_task = [r["n"] for r in heavy.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(by_task) == 4 and max(by_task) < 0.5 * sum(by_task)


def test_a_row_of_many_ids(spark):
    n = 3000
    row = spark.range(n).agg(F.collect_list(F.concat(F.lit("i"), F.col("id").cast("string"))).alias("ids"))
    by_task = [r["n"] for r in analytics.pairs(row, "ids").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(by_task) == n * (n - 1) // 2 and max(by_task) < 2 * sorted(by_task)[len(by_task) // 2]
