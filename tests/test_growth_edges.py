"""What a task of the network steps holds stays bounded as tables grow; same results."""

import random
from collections import Counter
from itertools import combinations

from biblion.operators import analytics
from pyspark.sql import functions as F


def members(spark):
    rng = random.Random(5)
    rows = [(r, rng.randrange(40)) for r in range(60) for _ in range(rng.randrange(9))]
    labels = [(i, f"L{i % 7}") for i in range(35)] + [(3, "L5"), (3, "L5"), (4, "L4"), (36, None), (38, "L1")]  # an id of two labels, a label told twice, null, none
    return spark.createDataFrame(rows, "row int, id int"), spark.createDataFrame(labels, "id int, label string"), rows, labels


def test_labels_before_pairs(spark):
    rows, labels, own, told = members(spark)
    edge = analytics.relabelled(analytics.edges(rows.groupBy("row").agg(F.collect_list("id").alias("ids")), "ids"), labels)
    want = Counter()
    for r in {r for r, _ in own}:
        for a, b in combinations(sorted({i for k, i in own if k == r}), 2):
            for x in (y for i, y in told if i == a and y):
                for z in (y for i, y in told if i == b and y and y != x):
                    want[min(x, z), max(x, z)] += 1
    assert {(r["a"], r["b"]): r["w"] for r in analytics.label_edges(rows, "row", labels).collect()} == want == {(r["a"], r["b"]): r["w"] for r in edge.collect()}
    degrees = {r["label"]: r["degree"] for r in analytics.label_degrees(rows, "row", labels).collect()}
    assert degrees == {r["label"]: r["degree"] for r in analytics.weighted_degree(edge).collect()}


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(analytics, "ROWS_PER_TASK", 10)
    rows, _, own, _ = members(spark)
    assert analytics.gathered(rows, "row", "id").rdd.getNumPartitions() == -(-len(own) // 10)
    edge = analytics.edges(analytics.gathered(rows, "row", "id"), "ids")
    pairs = Counter(p for r in {r for r, _ in own} for p in combinations(sorted({i for k, i in own if k == r}), 2))
    assert edge.rdd.getNumPartitions() == -(-sum(pairs.values()) // 10)
    assert {(r["a"], r["b"]): r["w"] for r in edge.collect()} == pairs
