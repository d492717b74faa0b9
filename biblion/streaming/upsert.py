"""Continuous harvest: an OAI-PMH stream of changed records, merged into the snapshot cache batch by batch.

An extension beyond one-off harvests. The stream's offset is the day of metadata change and, in
mid-harvest, the token of the next page, so that a restart goes on there. Every batch (some pages) is
normalised, merged by publication and written as the deltas of one snapshot version, which never loses
richer data, so that a batch that runs twice after a failure leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache, merge
from ..operators.shared import discard, written
from ..sources import harvest, normalize

RECORD_FIELDS = ["source_record_key", "publication_key", "source", "source_label", "source_record_id", "record_url"]


def last_of_each(records: DataFrame) -> DataFrame:
    """Of records (``RECORD_FIELDS``, _ord) of one key the last. Most keys come once: only keys that come again are grouped with all their fields."""
    again = records.groupBy("source_record_key").agg(F.count("*").alias("n")).where("n > 1").select("source_record_key")
    if again.isEmpty():
        return records.select(*RECORD_FIELDS)
    last = records.join(again, "source_record_key", "left_semi").groupBy("source_record_key").agg(F.max_by(F.struct(*RECORD_FIELDS[1:]), "_ord").alias("_r"))
    return records.join(again, "source_record_key", "left_anti").select(*RECORD_FIELDS).unionByName(last.select("source_record_key", "_r.*"))


def upsert(store: cache.Snapshots, source_records: DataFrame) -> int:
    """Merge source records into the store's ``works`` and ``records``; returns the new version.

    A source record that moves to another publication is re-pointed, and the provenance of all
    publications that gain or lose one is derived anew from the stored records. Only these
    publications and records are written.
    """
    fresh = source_records.where("source_record_key <> '' and source_record_id <> ''")
    given = written(fresh.select(*RECORD_FIELDS, "_ord"), "records")
    records = last_of_each(given).withColumn("fetched_at", F.current_timestamp())
    new = written(merge.merge_publications(source_records), "publications")
    stored, ours = (store.declared("records") if x is None else x for x in (store.read("records"), store.current("records", records.select("source_record_key"))))
    touched = written(new.select("publication_key").union(ours.select("publication_key")).distinct(), "touched")
    works = store.current("works", touched)
    merged = cache.merge_canonical(store.declared("works") if works is None else works, new.withColumn("updated_at", F.current_timestamp()))
    told = [c for c in ("source", "source_record_id", "source_record_keys", "record_urls", "source_count") if c in merged.columns]
    own = cache.upsert_latest(stored.join(touched, "publication_key", "left_semi").select(*RECORD_FIELDS), records.select(*RECORD_FIELDS), ["source_record_key"])
    origin = cache.provenance(own).select("publication_key", *[F.col(c).alias(f"_{c}") for c in told])
    synced = merged.join(origin, "publication_key", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in told}).drop(*[f"_{c}" for c in told])
    synced = synced.withColumn("updated_at", F.current_timestamp())
    version = store.upsert({"works": synced, "records": records}, declared=True)
    discard(given, new, touched)
    return max(version, store.compact())


def harvest_stream(spark: SparkSession, options: dict[str, str], store: cache.Snapshots, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the stream of one repository into ``store``; ``once`` takes what there is, batch after batch, and ends."""
    harvest.register(spark)
    raw = spark.readStream.format("oai_pmh").options(**options).load()

    def batch(rows: DataFrame, _: int) -> None:
        found = normalize.oai(rows)
        if not found.isEmpty():
            upsert(store, found)

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if not once:
        return writer.trigger(processingTime="1 hour").start()
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
