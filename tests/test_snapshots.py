"""The cache's tables: deltas by bucket, compaction, look-ups by index, conflicts, declared columns, merges batch by batch."""

import random

import pytest
from biblion.operators import cache, merge, snapshots
from biblion.schemas import CACHE_TABLES, SOURCE_FIELDS
from biblion.streaming import upsert
from pyspark.sql import functions as F

DDL = "publication_key string, model string, v int"


def rows(spark, pairs, v):
    return spark.createDataFrame([(k, m, v) for k, m in pairs], DDL)


def held(store, name="results"):
    return {tuple(r) for r in store.read(name).collect()}


def test_upserts_write_their_own_rows_only(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"), buckets=16, deltas=2)
    rng = random.Random(1)
    want = {(f"k{i}", m): 0 for i in range(300) for m in "ab"}
    store.publish({"results": rows(spark, want, 0), "plain": spark.range(3)})
    for v in range(1, 5):
        before = store.tables()["results"]["folders"]
        few = [(f"k{rng.randrange(320)}", rng.choice("ab")) for _ in range(3)]
        want |= dict.fromkeys(few, v)
        store.upsert({"results": rows(spark, set(few), v)})
        after = store.tables()["results"]["folders"]
        changed = [b for b in after if after[b] != before.get(b)]
        assert 1 <= len(changed) <= 3 and all(after[b][:-1] == before.get(b, []) for b in changed)
        assert spark.read.parquet(f"{tmp_path}/s/{after[changed[0]][-1]}/rows").count() == len(set(few))
        assert held(store) == {(k, m, x) for (k, m), x in want.items()}
    crowded = {b for b, f in after.items() if len(f) > 2}
    n = store.version()
    assert crowded and store.compact(1) == n + 1 and store.compact(1) == n + 1
    now = store.tables()["results"]["folders"]
    assert all(len(now[b]) == 1 if b in crowded else now[b] == after[b] for b in now)
    assert held(store) == {(k, m, x) for (k, m), x in want.items()} and store.read("plain").count() == 3 and store.read("none") is None
    with pytest.raises(ValueError, match="no keys"):
        store.upsert({"plain": spark.range(1)})


def test_look_ups_open_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "ROWS_PER_FILE", 40)
    store = snapshots.Snapshots(spark, str(tmp_path / "s"), buckets=4)
    store.publish({"results": rows(spark, [(f"k{i}", "m") for i in range(800)], 0)})
    for v in (1, 2, 3):
        store.upsert({"results": rows(spark, [(f"k{i}", "m") for i in range(v, 60, 7)], v)})
    every = {f for x in store.tables()["results"]["folders"].values() for f in x}
    total = sum(spark.read.parquet(f"{tmp_path}/s/{f}/rows").select(F.input_file_name()).distinct().count() for f in every)
    want = {(k, m): v for k, m, v in held(store)}
    opened = []
    for i in (0, 1, 2, 3, 8, 59, 400, 799):
        found = store.look_up("results", f"k{i}", "m")
        assert [tuple(r) for r in found.collect()] == [(f"k{i}", "m", want[f"k{i}", "m"])]
        files = store.files_for("results", f"k{i}", "m")
        assert sorted(x.rsplit("/", 1)[-1] for x in found.inputFiles()) == sorted(x.rsplit("/", 1)[-1] for x in files)
        opened.append(len(files))
    assert total > 25 and max(opened) <= 4 and sum(opened) < 2 * len(opened)
    assert store.look_up("results", "absent", "m").count() == 0 and store.look_up("results", "k1", "other").count() == 0 and store.look_up("none", "k") is None
    some = spark.createDataFrame([("k1", "m"), ("k700", "m"), ("gone", "m")], "publication_key string, model string")
    assert {r["publication_key"] for r in store.current("results", some).collect()} == {"k1", "k700"}


def test_filters_have_no_false_negatives():
    import numpy as np

    rng = np.random.default_rng(3)
    inside, outside = (rng.integers(-(1 << 63), 1 << 63, 1000) for _ in range(2))
    on = np.zeros(1 << 14, bool)
    on[snapshots._places(inside, 1 << 14).reshape(-1).astype(np.int64)] = True
    bits = np.packbits(on, bitorder="little").tobytes()
    assert all(snapshots.may_hold(bits, int(h)) for h in inside) and sum(snapshots.may_hold(bits, int(h)) for h in outside) < 30


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "PATIENCE_S", 0.1)
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    store.publish({"results": rows(spark, [("a", "m")], 0)})
    told = store.tables()
    store.upsert({"results": rows(spark, [("b", "m")], 1)})
    with pytest.raises(RuntimeError, match="someone else"):
        store._commit(1, told)  # planned on version 1
    (tmp_path / "s" / "manifest-00000003").write_text('{"results": {"ke')  # its writer died
    assert store.version() == 2 and len(held(store)) == 2
    assert store.upsert({"results": rows(spark, [("c", "m")], 1)}) == 4 and len(held(store)) == 3


def test_declared_tables(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    assert store.bootstrap() == 1 == store.bootstrap()
    for name, ddl in CACHE_TABLES.items():
        assert store.read(name).schema == spark.createDataFrame([], ddl).schema and store.read(name).count() == 0
    store.upsert({"results": spark.createDataFrame([("k", "m", "{}", 7)], "publication_key string, model string, sdg_response string, unknown int")})
    assert store.read("results").first().asDict() == {"publication_key": "k", "model": "m", "text_hash": None, "sdg_response": "{}", "sdg_formatted": None, "sdg_note": None, "classified_at": None}


def source_rows(spark, rng, n, start):
    made = []
    for i in range(n):
        r = dict.fromkeys(SOURCE_FIELDS, "")
        key = rng.randrange(12)
        r |= {"publication_key": f"doi:{key}", "source": rng.choice("st"), "source_label": "L", "source_record_id": f"r{rng.randrange(15)}", "title": "t" * rng.randrange(9), "authors": "A; B"[: rng.choice([1, 4])], "is_oa": rng.choice([None, True, False]), "institutions": rng.choice(["U", "V; U"]), "institution_affiliations_json": "[]", "oa_status": "unknown"}
        r["source_record_key"] = f"{r['source']}:{r['source_record_id']}"
        made.append((*[r[f] for f in SOURCE_FIELDS], start + i))
    ddl = ", ".join(f"{f} {'boolean' if f == 'is_oa' else 'string'}" for f in SOURCE_FIELDS) + ", _ord long"
    return spark.createDataFrame(made, ddl)


def whole_merge(spark, works, records, batch):
    """The same batch merged into whole tables."""
    new = merge.merge_publications(batch)
    one = batch.groupBy("source_record_key").agg(F.max_by(F.struct(*upsert.RECORD_FIELDS[1:]), "_ord").alias("r")).select("source_record_key", "r.*").select(*upsert.RECORD_FIELDS)
    records = one if records is None else cache.upsert_latest(records, one, ["source_record_key"])
    merged = new if works is None else cache.merge_canonical(works, new)
    told = ["source", "source_record_id", "source_record_keys", "record_urls", "source_count"]
    origin = cache.provenance(records).select("publication_key", *[F.col(c).alias(f"_{c}") for c in told])
    works = merged.join(origin, "publication_key", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in told})
    return tuple(spark.createDataFrame(x.collect(), x.schema) for x in (works, records))


def test_batches_end_as_a_merge_of_whole_tables(spark, tmp_path):
    rng = random.Random(4)
    store = snapshots.Snapshots(spark, str(tmp_path / "s"), buckets=8, deltas=1)
    works = records = None
    compared = ["publication_key", "title", "authors", "institutions", "is_oa", "oa_status", "source", "source_record_id", "source_record_keys", "source_count"]
    for turn in range(3):
        batch = source_rows(spark, rng, 9, turn * 100)
        upsert.upsert(store, batch)
        works, records = whole_merge(spark, works, records, batch)
        assert {tuple(r) for r in store.read("works").select(*compared).collect()} == {tuple(r) for r in works.select(*compared).collect()}
        assert {tuple(r) for r in store.read("records").select(*upsert.RECORD_FIELDS).collect()} == {tuple(r) for r in records.select(*upsert.RECORD_FIELDS).collect()}
    assert store.read("works").where("updated_at is null").count() == 0 and max(len(f) for f in store.tables()["works"]["folders"].values()) <= 2
