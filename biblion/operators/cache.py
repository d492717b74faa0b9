"""How new rows meet those of the cache: merges that never lose richer data, latest rows, provenance, repairs.

``snapshots`` keeps the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as lists
from ..functions import text
from ..functions.access import OPEN_STATUSES
from .snapshots import Snapshots as Snapshots

REPLACED = ("record_url", "openalex_id", "publication_date", "doi", "type", "language")
LONGEST = ("title", "abstract", "authors")
UNITED = ("institutions", "institution_ids", "institution_countries", "institution_names_raw")


def filled(new: Column, old: Column) -> Column:
    """The new value unless it is empty."""
    return F.coalesce(text.nullify(new), old)


def longer(new: Column, old: Column) -> Column:
    """The longer text, the new one on a tie."""
    n, o = F.coalesce(new, F.lit("")), F.coalesce(old, F.lit(""))
    return F.when(F.length(n) >= F.length(o), n).otherwise(o)


def merge_canonical(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Full outer merge on publication_key; one row per key on either side."""
    o, n = current.alias("o"), incoming.alias("n")
    both = o.join(n, F.col("o.publication_key") == F.col("n.publication_key"), "full_outer")

    def sides(c: str) -> tuple[Column, Column]:
        return F.col(f"n.{c}"), F.col(f"o.{c}")

    open_ = F.coalesce(F.col("n.is_oa"), F.lit(False)) | F.coalesce(F.col("o.is_oa"), F.lit(False))
    closed = (F.col("n.is_oa") == F.lit(False)) | (F.col("o.is_oa") == F.lit(False))
    specific = [F.when(F.col(f"{s}.oa_status").isin([x for x in OPEN_STATUSES if x != "open"]) & F.col(f"{s}.is_oa"), F.col(f"{s}.oa_status")) for s in ("o", "n")]
    update = {"institution_affiliations_json": lists.updated_affiliations, "source_provenance_json": lists.updated_provenance}
    kept = {c: f(*reversed(sides(c))) for c, f in update.items() if c in current.columns and c in incoming.columns}
    kept |= {c: text.merged(*reversed(sides(c))) for c in ("source", "source_record_id", "source_record_keys", "record_urls") if c in current.columns and c in incoming.columns}
    return both.select(
        F.coalesce(*sides("publication_key")).alias("publication_key"),
        *[filled(*sides(c)).alias(c) for c in REPLACED],
        *[longer(*sides(c)).alias(c) for c in LONGEST],
        *[text.merged(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in UNITED],
        F.when(open_, True).when(closed, False).alias("is_oa"),
        F.when(open_, F.coalesce(*specific, F.lit("open"))).when(closed, "closed").otherwise("unknown").alias("oa_status"),
        *[made.alias(c) for c, made in kept.items()],
        F.greatest(*sides("source_count"), F.lit(1)).alias("source_count"),
    )


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``incoming`` replace those of equal keys (re-pointing included). Where it may hold
    a key twice, ``order`` names the column whose greatest value wins."""
    if order:
        rest = [c for c in incoming.columns if c not in keys]
        incoming = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    return current.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def provenance(records: DataFrame) -> DataFrame:
    """Source columns of each canonical row, from all its stored source records in key order."""
    own = F.sort_array(F.collect_list(F.struct("source_record_key", "source", "source_record_id", "record_url")))
    r = records.groupBy("publication_key").agg(own.alias("r"))

    def distinct(c: str) -> Column:
        return F.array_except(F.col("r")[c], F.array(F.lit(""), F.lit(None).cast("string")))

    return r.select(
        "publication_key",
        text.joined(distinct("source")).alias("source"),
        text.joined(distinct("source_record_id")).alias("source_record_id"),
        text.joined(distinct("source_record_key")).alias("source_record_keys"),
        text.joined(distinct("record_url")).alias("record_urls"),
        F.size(distinct("source")).alias("source_count"),
    )


def repair_access(rows: DataFrame) -> DataFrame:
    """Contradictory flags and statuses of stored rows repaired; what agrees, or says nothing, stays as it is."""
    told, flag = F.lower(F.trim(F.coalesce("oa_status", F.lit("")))), F.col("is_oa").cast("boolean")
    status = F.when(flag & ~told.isin(OPEN_STATUSES), "open").when(~flag & (told != "closed"), "closed").otherwise(F.col("oa_status"))
    made = F.when(flag.isNotNull(), flag).when(told.isin(OPEN_STATUSES), True).when(told == "closed", False)
    return rows.withColumns({"is_oa": made, "oa_status": status})


def add_missing(current: DataFrame, legacy: DataFrame, keys: list[str]) -> DataFrame:
    """Additive migration: legacy rows whose key is not there yet, one per key."""
    return current.unionByName(legacy.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def cache_changed(new_keys: Column, old_keys: Column, new_abstract: Column, old_abstract: Column) -> Column:
    """New provenance, or a longer abstract."""
    fresh = F.size(F.array_except(text.parts(new_keys), text.parts(old_keys))) > 0
    return fresh | (F.length(F.coalesce(new_abstract, F.lit(""))) > F.length(F.coalesce(old_abstract, F.lit(""))))


#: Key of a stored classification result.
RESULT_KEYS = ["publication_key", "model"]
