"""Rows that share an id or have none, samples, and shared folders."""

import pytest
from biblion.llm import common, crf_langid, decontaminate, registry, setsketch, suffix_dedup, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_near_duplicates_by_row(spark):
    a, b = "a b c d e f g h", "other words that stand for nothing here at all"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, "x y z"), (7, "x y z"), (8, "P q  r S t u"), (8, "p Q r s T U"), (None, a), (9, None), (9, None)], "doc_id long, text string")
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(docs).collect() if r["doc_id"] in (3, 5, 7))
    assert found == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True), (7, 7, True)]
    kept = sorted((r["doc_id"] or -1, (r["text"] or "").lower().split()) for r in setsketch.keep_one(docs).collect())
    assert kept == sorted([(3, a.split()), (5, b.split()), (7, ["x", "y", "z"]), (8, list("pqrstu")), (-1, a.split()), (9, []), (9, [])])


def test_repeats_by_row(spark):
    a, b = "".join(f"{i} alpha " for i in range(30)), "".join(f"{i} beta " for i in range(40))
    docs = spark.createDataFrame([(1, a, 0), (2, a, 0), (2, b, 0), (3, b, 0), (3, b, 0), (None, a, 0)], "doc_id long, text string, __spans int")
    found = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(suffix_dedup.repeated_spans(docs)).collect())
    assert found == sorted([(1, len(a), 0), (2, len(a), len(a)), (2, len(b), 0), (3, len(b), len(b)), (3, len(b), len(b)), (-1, len(a), 0)])
    assert sorted((r["doc_id"] or -1, r["text"]) for r in suffix_dedup.remove_repeats(docs).collect()) == sorted([(1, a), (2, b), (-1, a)])


def test_benchmark_slices_of_any_size(spark):
    words = [f"w{i}" for i in range(200)]
    part = lambda x, y: " ".join(words[x:y])
    items = spark.createDataFrame([(1, part(0, 40)), (2, part(20, 32)), (None, part(40, 44)), (3, part(0, 40)), (4, "w9 w8"), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {part(0, 12)} y"), (1, f"x {part(20, 32)}"), (None, part(5, 35)), (None, f"a {part(40, 44)}"), (2, None), (3, part(28, 44))], "doc_id long, text string")
    runs = []
    for windows, size in ((10**6, 1 << 26), (1, 1 << 26), (2, 1 << 26), (7, 1 << 26), (10**6, 1)):
        found = decontaminate.contamination(docs, items, max_windows=windows, max_bytes=size)
        left = decontaminate.remove_contamination(docs, items, max_windows=windows, max_bytes=size, max_hit_share=0.9)
        runs.append((sorted(map(str, found.collect())), sorted(map(str, decontaminate.digest(found).collect())), sorted(map(str, left.collect()))))
    assert all(r == runs[0] for r in runs)
    by_id = [r for r in decontaminate.digest(decontaminate.contamination(docs, items)).collect() if r["n_words"] == 5]
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in by_id] == [(4, 0, True)]  # an item without id hits, unlisted


def test_no_letter_is_undetermined():
    model = crf_langid.train([("en", "the house and the tree"), ("de", "das haus und der baum")])
    found = [x for x, _, _ in crf_langid.decide(["½".encode(), "²".encode(), "ⅷ ①".encode(), b"12 !", "日本".encode(), b"the"], model)]
    assert found == ["und", "und", "und", "und", found[4], "en"] and found[4] != "und"


def test_samples_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(crf_langid, "ROW_BYTES", 1000)
    monkeypatch.setattr(crf_langid, "SAMPLE_BYTES", 8000)
    rows = [(i, "word " * 100, "en") for i in range(50)] + [(100 + i, "lang " * 5000, "xx") for i in range(5)]
    taken = crf_langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1500)
    sizes = {lang: [len(t) for x, t in taken if x == lang] for lang in ("en", "xx")}
    assert sizes == {"en": [500] * 8, "xx": [25000]}  # a language of long rows only keeps one
    monkeypatch.setattr(toxicity, "ROW_BYTES", 1000)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 8000)
    docs = spark.createDataFrame([(i, "word " * (100 if i < 80 else 500)) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, toxic int")
    assert sorted(t for _, t in toxicity.sample(docs, labels, 3000)) == [0] * 8 + [1] * 8


def test_rows_without_id_are_held_out(spark, tmp_path):
    spark.createDataFrame([(i, "the house and the tree" if i % 2 else "das haus und der baum", "en" if i % 2 else "de") for i in range(30)] + [(None, "the tree", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_language_id", "op5_toxicity", "op9_lm_scoring"):
        out = registry.queries()[name](spark, str(tmp_path)).where("doc_id is null").collect()
        assert [r["held_out"] for r in out] == [True], name


def test_language_of_held_out_rows(spark):
    out = registry.queries()["op1_language_id"](spark, SF).where("held_out")
    known = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    hit = [r["lang"] == r["lang_pred"] for r in out.join(known, "doc_id").collect()]
    assert len(hit) > 200 and sum(hit) > 0.95 * len(hit)


def test_toxicity_of_held_out_rows(spark):
    """Precision and recall; some labels of the tables mark documents without any toxic word."""
    sf = "/root/testdata/sf0.1"
    out = registry.queries()["op5_toxicity"](spark, sf).where("held_out")
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic", "score").collect()
    both = sum(r["predicted"] and r["toxic"] for r in rows)
    assert both >= 0.95 * sum(r["predicted"] for r in rows) and both >= 0.85 * sum(r["toxic"] for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_scratch_drops_what_is_not_kept(spark):
    frame = spark.range(3)
    with common.scratch() as keep:
        a, b = common.materialize(frame, "a"), keep(common.materialize(frame, "b"))
        with common.scratch() as hold:
            c, d = hold(common.materialize(frame, "c")), common.materialize(frame, "d")
        assert c.count() == 3
    assert b.count() == 3
    for gone in (a, d):
        with pytest.raises(Exception):  # noqa: B017
            spark.read.parquet(gone.written_to).where(F.lit(True)).count()
