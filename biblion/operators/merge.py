"""Group-merge of source records into canonical publications.

One ordered fold per key, written as associative aggregates over (metric, -ordinal), so the
result does not depend on how rows are partitioned. Ties keep the earlier record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, records, text
from ..functions.access import OPEN_STATUSES, reconciled

# Preference of publication types.
TYPE_SCORES = {"artistic-work": 5, "book-chapter": 5, "proceedings-article": 5, "article": 4, "book": 4, "other": 1, "": 0}
OTHER_TYPES_SCORE = 3
# End of the fixed values.

LISTS = ("institutions", "institution_ids", "institution_countries", "institution_names_raw")


def publication_key(doi: Column, title: Column, date: Column, authors: Column, record_key: Column) -> Column:
    """doi:…, else metadata:… of title, year and first author if all are there, else the record's own key."""
    d, t = text.doi(doi), text.match_key(title)
    y, a = dates.leading_year(date), text.match_key(text.first_author(authors))
    whole = (t != "") & (y != "") & (a != "")
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(whole, F.concat(F.lit("metadata:"), text.text_hash(F.concat_ws("\n", t, y, a)))).otherwise(F.coalesce(record_key, F.lit("")))


def type_score(kind: Column) -> Column:
    score = F.lit(OTHER_TYPES_SCORE)
    for name, value in TYPE_SCORES.items():
        score = F.when(F.coalesce(kind, F.lit("")) == name, value).otherwise(score)
    return score


def longest(c: str, order: str = "_ord") -> Column:
    return F.max_by(F.coalesce(c, F.lit("")), F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col(order))).alias(c)


def first_filled(c: str, order: str = "_ord") -> Column:
    filled = F.coalesce(F.col(c), F.lit("")) != ""
    return F.coalesce(F.min_by(F.when(filled, F.col(c)), F.when(filled, F.col(order))), F.lit("")).alias(c)


def ordered(c: Column, order: str = "_ord") -> Column:
    """Values of a group in arrival order."""
    return F.sort_array(F.collect_list(F.struct(F.col(order), c.alias("v"))))["v"]


#: Fields of a record that its publication's provenance tells.
TOLD = ("source", "source_label", "source_record_id", "source_record_key", "record_url")
#: Columns whose distinct values a publication lists, and under which name.
LISTED = {"source": "source", "source_record_id": "source_record_id", "source_record_key": "source_record_keys", "record_url": "record_urls"}
#: Records from which a key counts as hot, and ordinals of one run of it.
HOT_RECORDS, RUN_BITS = 100_000, 12


def _best(order: str) -> list[Column]:
    """What a group keeps of single values: of equals the earlier."""
    return [
        *[longest(c, order) for c in ("title", "publication_date", "language", "abstract")],
        F.max_by("authors", F.struct("_authors", -F.col(order))).alias("authors"),
        F.max_by("type", F.struct("_score", -F.col(order))).alias("type"),
        F.bool_or("_flag").alias("_flag"),
    ]


def _first(order: str) -> list[Column]:
    """What a group of partial results keeps of values that the first record to have one tells."""
    return [
        *[first_filled(c, order) for c in ("doi", "openalex_id", "record_url")],
        F.min_by(F.coalesce("source_label", F.lit("")), order).alias("source_label"),
        F.min_by("_named", F.when(F.col("_named").isNotNull(), F.col(order))).alias("_named"),
    ]


def _distinct(arrays: Column) -> Column:
    return F.array_distinct(F.flatten(arrays))


def _measured(rows: DataFrame) -> DataFrame:
    """With what authors and types are chosen by, told once for a row."""
    return rows.withColumns({"_authors": F.size(text.parts(F.col("authors"))), "_score": type_score(F.col("type"))})


def _folded(rows: DataFrame, by: list[str]) -> DataFrame:
    """Records (with _flag and _named) of each group as one partial result. What a group lists comes from one
    list of its records, put in order once. Records are dealt before any are grouped: a group has few of one file, so
    that grouping them there first costs much and saves little."""
    records = F.collect_list(F.struct("_ord", F.struct(*TOLD).alias("told"), *LISTS, F.col("institution_affiliations_json").alias("aff"), "doi", "openalex_id", "_named"))
    dealt = _measured(rows).repartition(*by).sortWithinPartitions(*by)
    folded = dealt.groupBy(*by).agg(*_best("_ord"), F.sort_array(records).alias("_all"))
    told, missing = F.col("_all")["told"], F.lit(None).cast("string")

    def filled(c: Column) -> Column:
        return F.array_except(c, F.array(F.lit(""), missing))

    return folded.withColumns({
        "_n": F.size("_all").cast("long"),
        **{c: F.coalesce(F.col("_all")[c][0], F.lit("")) for c in LISTS},
        **{f"_{c}": text.parts(F.array_join(F.array_distinct(F.col("_all")[c]), ";")) for c in LISTS},
        "_aff": F.array_except(F.col("_all")["aff"], F.array(F.lit("[]"), missing)),
        **{f"_{n}": filled(told[c]) for c, n in LISTED.items()},
        **{c: F.coalesce(F.get(filled(x), F.lit(0)), F.lit("")) for c, x in (("doi", F.col("_all")["doi"]), ("openalex_id", F.col("_all")["openalex_id"]), ("record_url", told["record_url"]))},
        "source_label": F.coalesce(told["source_label"][0], F.lit("")),
        "_named": F.get(F.array_except(F.col("_all")["_named"], F.array(missing)), F.lit(0)),
        "_sources": F.array_except(told["source"], F.array(missing)),
        "_told": F.to_json(told),
    }).drop("_all")


def _refolded(runs: DataFrame) -> DataFrame:
    """Partial results of a key's runs, which follow each other in arrival order, as one."""
    inner = F.transform(ordered(F.col("_told"), "_run"), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    united = _measured(runs.withColumn("_aff", records.united_affiliations("_aff")))
    return united.groupBy("publication_key").agg(
        *_best("_run"),
        *_first("_run"),
        F.sum("_n").alias("_n"),
        *[F.first(c).alias(c) for c in LISTS],
        *[_distinct(ordered(F.col(c), "_run")).alias(c) for c in (*[f"_{c}" for c in LISTS], *[f"_{n}" for n in LISTED.values()], "_sources")],
        ordered(F.col("_aff"), "_run").alias("_aff"),
        F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")).alias("_told"),
    )


def _finished(folded: DataFrame) -> DataFrame:
    status = F.when(F.col("_flag"), F.coalesce("_named", F.lit("open"))).when(~F.col("_flag"), "closed").otherwise("unknown")
    return folded.select(
        "publication_key", "title", "publication_date", "language", "abstract", "authors", "type", "doi", "openalex_id", "record_url",
        F.col("_flag").alias("is_oa"),
        *[F.when(F.col("_n") > 1, F.array_join(f"_{c}", "; ")).otherwise(F.col(c)).alias(c) for c in LISTS],
        "source_label",
        *[F.array_join(f"_{n}", "; ").alias(n) for n in LISTED.values()],
        F.size("_sources").alias("source_count"),
        F.col("_told").alias("source_provenance_json"),
        status.alias("oa_status"),
        records.united_affiliations("_aff").alias("institution_affiliations_json"),
    )


def hot_keys(source_records: DataFrame, least: int = HOT_RECORDS) -> DataFrame:
    """publication_key of publications with at least so many source records; reads the keys alone."""
    return source_records.groupBy("publication_key").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.coalesce("publication_key", F.lit("")) != "")).select("publication_key")


def merge_publications(source_records: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Source records with ``publication_key`` and arrival ordinal ``_ord`` -> canonical rows.

    Records without a key go. Repeated records count once per occurrence in the provenance.
    Keys in ``hot`` (``hot_keys`` of the same records) are folded in two levels: runs of ordinals,
    dealt to tasks by (key, run) and each of bounded size, become partial results, and these, in order,
    one row. What meets in one task then is what the row itself holds.
    """
    pair = reconciled(F.col("is_oa"), F.col("oa_status"))
    rows = source_records.where(F.coalesce("publication_key", F.lit("")) != "").withColumns({"_flag": pair["is_oa"], "_status": pair["oa_status"]})
    named = (F.col("_status").isin([s for s in OPEN_STATUSES if s != "open"])) & F.col("_flag")
    rows = rows.withColumn("_named", F.when(named, F.col("_status")))
    if hot is None:
        return _finished(_folded(rows, ["publication_key"]))
    runs = rows.join(hot, "publication_key", "left_semi").withColumn("_run", F.shiftright("_ord", RUN_BITS))
    apart = _refolded(_folded(runs, ["publication_key", "_run"]))
    return _finished(_folded(rows.join(hot, "publication_key", "left_anti"), ["publication_key"])).unionByName(_finished(apart))


def duplicates_removed(source_records: DataFrame) -> DataFrame:
    """One row: records less groups (keyless records count as removed)."""
    key = F.nullif(F.col("publication_key"), F.lit(""))
    return source_records.agg((F.count("*") - F.count_distinct(key)).alias("duplicates_removed"))
