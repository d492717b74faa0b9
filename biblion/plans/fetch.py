"""A selection's publications: all sources asked in one job, then normalise, merge, newest first, limit as one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions import dates, text
from ..operators import analytics, merge, shared
from ..schemas import SOURCE_FIELDS
from ..sources import harvest, normalize
from ..sources.config import Selection, Source, entity_types, works_filters

WORKS_LABEL = "OpenAlex"
WORKS_URL = "https://api.openalex.org/works"
INSTITUTIONS_URL = "https://api.openalex.org/institutions"
#: Arrival ordinals of a source lie in a range of its own, in the order of the union.
SOURCE_SPAN = 1 << 44
RECORD = StructType([StructField(f, BooleanType() if f == "is_oa" else StringType()) for f in SOURCE_FIELDS] + [StructField("_ord", LongType())])


def search_institutions(name: str, get: Callable[[str], str], limit: int = 10) -> list[dict]:
    """Institutions that match a name, as the service ranks them."""
    return json.loads(get(harvest.with_query(INSTITUTIONS_URL, search=name, **{"per-page": limit}))).get("results") or []


def lineage(institution: str, get: Callable[[str], str]) -> list[str]:
    """Identifiers of an institution and those above it; none where the look-up fails."""
    try:
        found = json.loads(get(f"{INSTITUTIONS_URL}/{institution.strip().rsplit('/', 1)[-1] if 'openalex.org/' in institution else institution.strip()}")).get("lineage")
    except (OSError, ValueError):
        return []
    return [str(x).rsplit("/", 1)[-1] for x in found if x] if isinstance(found, list) else []


def with_lineage(institutions: list[str], get: Callable[[str], str]) -> list[str]:
    """The institutions, then their lineages, each once."""
    return list(dict.fromkeys([*institutions, *(x for i in institutions for x in lineage(i, get))]))


def of_types(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return rows.where(F.col("type").isin(list(types))) if types else rows


def newest_per_source(rows: DataFrame, limit: int | None) -> DataFrame:
    """The rows whose dates' periods end last; ties keep arrival order. A top-k, not a sort of all."""
    if limit is None:
        return rows
    return rows.withColumn("_end", dates.upper_bound(F.col("publication_date"))).orderBy(F.desc_nulls_last("_end"), "_ord").limit(limit).drop("_end")


@dataclass(frozen=True)
class Harvest:
    """What a selection's sources gave.

    ``records`` are source records in arrival order (``_ord``), none of a failed source; ``asked`` and
    ``failures`` name sources in the order they were asked; ``raw`` is the table of answers behind
    them (``shared.discard`` deletes it).
    """

    records: DataFrame
    asked: tuple[str, ...]
    failures: tuple[str, ...]
    raw: DataFrame | None = None


def _scans(spark: SparkSession, chosen: Selection) -> list[tuple[Source | None, DataFrame]]:
    """(source, None for the works API; its raw answers), in the order of asking."""
    harvest.register(spark)
    common = dict(chosen.options) | ({"useragent": chosen.user_agent} if chosen.user_agent else {})

    def load(kind: str, **options: object) -> DataFrame:
        return spark.read.format(kind).options(**common, **{k: str(v) for k, v in options.items() if v not in (None, "")}).load()

    found: list[tuple[Source | None, DataFrame]] = []
    if chosen.works_api and (filters := works_filters(chosen)):
        found.append((None, load("works_api", url=WORKS_URL, id="openalex", label=WORKS_LABEL, filters=";;".join(filters), rowlimit=chosen.limit)))
    for s in chosen.sources:
        if s.kind == "dspace":
            raw = load("repository_search", url=f"{s.base_url}/discover/search/objects", home=s.home, id=s.id, label=s.label, configuration=s.configuration, scope=s.scope, entities=",".join(s.types), types=",".join(chosen.types),
                       rowlimit=chosen.limit, issuedfrom=chosen.from_date, issuedto=chosen.to_date, isolate="true")
            found.append((s, raw.where(F.col("entity").isin(entity_types(s, chosen.types)))))
        elif not chosen.types or set(chosen.types) & set(s.types):
            found.append((s, load("oai_pmh", url=s.base_url, id=s.id, label=s.label, prefix=s.prefix, set=s.set_spec, isolate="true")))
    return found


def _records(source: Source | None, raw: DataFrame, chosen: Selection) -> DataFrame:
    """Source records of one source's answers, with the filters and limits that are checked here."""
    if source is None:
        return normalize.works(raw)
    if source.kind == "dspace":
        rows = of_types(normalize.items(raw), chosen.types)
        if chosen.limit is None:
            return rows
        # the reader has stopped at the limit of each entity type; this holds where an answer has repeated an item
        chain = W.partitionBy(F.floor(F.col("_ord") / harvest.CHAIN_SPAN)).orderBy("_ord")
        return rows.withColumn("_n", F.row_number().over(chain)).where(F.col("_n") <= chosen.limit).drop("_n")
    rows = of_types(normalize.oai(raw), chosen.types)
    if chosen.from_date or chosen.to_date:
        begin, end = (F.lit(d).cast("date") for d in (chosen.from_date or "0001-01-01", chosen.to_date or "9999-12-31"))
        rows = rows.where(dates.overlaps(F.col("publication_date"), begin, end))
    return newest_per_source(rows, chosen.limit)


def harvested(spark: SparkSession, chosen: Selection) -> Harvest:
    """Ask all sources of a selection at once, in one job, and keep their answers as a table.

    The table has a folder per source, so normalising reads each source's own; it is also what
    makes a retry of later steps ask nobody again. A source that tells of a failure is left out whole.
    """
    scans = _scans(spark, chosen)
    asked = [(s.label if s else WORKS_LABEL) for s, _ in scans]
    names = asked[:1] * bool(scans and scans[0][0] is None) + [s.label for s in chosen.sources]  # also those that have none of the types
    if not scans:
        return Harvest(spark.createDataFrame([], RECORD), tuple(names), ())
    columns = ["source", "label", "payload", "home", "_ord", "failure"]
    raw = reduce(DataFrame.unionByName, [df.select(F.lit(i).alias("place"), *columns) for i, (_, df) in enumerate(scans)])
    table = shared.written(raw, "answers", by=("place",))
    told = {r["place"]: r["failure"] for r in table.where("failure is not null").groupBy("place").agg(F.min("failure").alias("failure")).collect()}  # a row for a source at most
    kept = [_records(s, table.where(F.col("place") == i), chosen).withColumn("_ord", F.col("_ord") + i * SOURCE_SPAN) for i, (s, _) in enumerate(scans) if i not in told]
    failures = tuple(f"{asked[i]} ({told[i]})" for i in sorted(told))
    return Harvest(reduce(DataFrame.unionByName, kept) if kept else spark.createDataFrame([], RECORD), tuple(names), failures, table)


def source_records(spark: SparkSession, chosen: Selection) -> DataFrame:
    """Source records of the works API, then of each repository, with ordinals in that order."""
    return harvested(spark, chosen).records


def run(spark: SparkSession, chosen: Selection) -> tuple[DataFrame, DataFrame]:
    """(canonical publications of a selection, newest first where it has a limit; one row of statistics)."""
    if wrong := chosen.errors():
        raise ValueError("; ".join(wrong))
    found = harvested(spark, chosen)
    records = shared.written(found.records, "records")  # three steps read them: hot keys, the merge, the counts
    if found.raw is not None:
        shared.discard(found.raw)
    found = replace(found, records=records, raw=None)
    hot = merge.hot_keys(records)
    merged = merge.merge_publications(records, None if hot.isEmpty() else hot)
    rows = analytics.newest(merged, "publication_date", "publication_key", chosen.limit) if chosen.limit is not None else merged
    return rows, run_statistics(found, merged, chosen.limit)


def run_statistics(found: Harvest, merged: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: sources_queried, source_failures, total_source_records, duplicates_removed (records without a key count as such), total_expected."""
    records, publications = found.records.agg(F.count("*").alias("r")), merged.agg(F.count("*").alias("p"))
    named = {"sources_queried": found.asked, "source_failures": found.failures}
    expected = F.col("p") if limit is None else F.least("p", F.lit(limit).cast("long"))
    return records.crossJoin(publications).select(  # one row each
        *[F.array(*[F.lit(x) for x in values]).cast("array<string>").alias(n) for n, values in named.items()],
        F.col("r").alias("total_source_records"), (F.col("r") - F.col("p")).alias("duplicates_removed"), expected.alias("total_expected"))


def publications(spark: SparkSession, chosen: Selection) -> DataFrame:
    """Canonical publications of a selection, newest first where it has a limit."""
    return run(spark, chosen)[0]


def resolved_labels(institutions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Labels of chosen identifiers, which may be full links, links with a slash at the end, or bare.

    institutions: id, label; chosen: id.
    """
    bare = lambda c: F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    known = institutions.select(bare(F.col("id")).alias("_bare"), "label")
    return chosen.select(bare(F.col("id")).alias("_bare")).distinct().join(known, "_bare").select("label").distinct()


def zipped_affiliations(ids: str = "institution_ids", names: str = "institution_names_raw", countries: str = "institution_countries"):
    """Array of struct(id, name, country) by position of three semicolon lists; for rows without the JSON list."""
    cut = [F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)).alias(n) for c, n in ((ids, "id"), (names, "name"), (countries, "country"))]
    return F.filter(F.arrays_zip(*cut), lambda x: F.coalesce(text.nullify(x["id"]), text.nullify(x["name"])).isNotNull())
