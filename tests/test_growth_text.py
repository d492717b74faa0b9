"""Long texts are folded some at a time; same results."""

from biblion.functions import text
from pyspark.sql import functions as F


def test_texts_are_folded_some_at_a_time(spark, monkeypatch):
    assert text.FOLDED_AT_ONCE <= 64  # a batch has up to 10,000 texts
    told = ["Éa  B-c", None, "", "ﬁ ½ Ω", "x" * 5000] * 100
    rows = spark.createDataFrame(list(enumerate(told)), "i int, t string").coalesce(1)
    got = rows.select("i", text.match_key(F.col("t")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in got] == [text.fold_key(t or "") for t in told]
    assert spark.createDataFrame([], "t string").select(text.match_key("t")).count() == 0
