"""Queries that run sources, normalisers, merges, the cache and enrichment on rows made of the driver
tables, and the SQL that must give the same rows."""

from __future__ import annotations

import json
import re
import uuid
from datetime import date
from urllib.parse import parse_qs, urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import access, dates, text
from ..operators import analytics, cache, classify, enrich, merge, shared
from ..operators.shared import shared_dir
from ..sources import config, export, harvest, normalize
from ..streaming import upsert
from . import fetch, network
from .queries import origins
from .registry import query


def _key(c: str, prefix: str = "k") -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _every(c: str, n: int, *values: object) -> Column:
    """values[i] where the column modulo ``n`` is i; the last one otherwise."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col(c) % n == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


@query("""
SELECT c_custkey, 'eł' || replace(lower(c_name), '#', '') || lower(c_mktsegment) AS compact, c_custkey % 2 <> 0 AS alike, lower(c_mktsegment) AS token, c_name AS bare,
  c_custkey % 2 <> 0 AS ror, 'I' || c_custkey AS institution,
  CASE WHEN c_custkey % 3 = 0 THEN 'I' || c_custkey ELSE c_name END || CASE WHEN c_custkey % 2 = 0 THEN ' (PL)' ELSE '' END AS label,
  left(repeat(c_name, 8), 117) || '...' AS short, '10.1234/a' || c_custkey AS doi, CAST(1990 + c_custkey % 20 AS VARCHAR) AS year,
  CAST(CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 7 ELSE 0 END AS BIGINT) AS rank
FROM customer""")
def text_columns(table):
    segment, number = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    things, other = F.concat(segment, F.lit(" of things")), _every("c_custkey", 2, "Zq 99", F.concat(segment, F.lit(": of thing")))
    author = _every("c_custkey", 2, F.concat(segment, F.lit(", Łuk Jan")), F.concat(F.lit("Jan Łuk "), segment))
    return text.with_similar(table("customer"), "alike", text.compact_key(things), text.compact_key(other)).select(
        "c_custkey",
        text.compact_key(F.concat(F.lit("Éł-"), "c_name", F.lit(" "), segment)).alias("compact"),
        "alike",
        text.author_token(author).alias("token"),
        text.without_orcid(F.concat("c_name", F.lit(" ; https://orcid.org/0000-0001-2345-678X "))).alias("bare"),
        text.is_ror(F.concat(_every("c_custkey", 2, "https://ror.org/x", " HTTPS://ror.org/"), F.lpad(number, 9, "0"))).alias("ror"),
        text.institution_id(F.concat(F.lit(" https://openalex.org/I"), number)).alias("institution"),
        text.institution_label(_every("c_custkey", 3, " ", F.col("c_name")), F.concat(F.lit("https://x.org/I"), number), _every("c_custkey", 2, "PL", "")).alias("label"),
        text.shortened(F.repeat("c_name", 8)).alias("short"),
        text.first_doi(F.array(F.lit("none"), F.concat(F.lit("doi: 10.1234/A"), number, F.lit(".")), F.lit("10.9999/z"))).alias("doi"),
        dates.year_anywhere(F.concat(F.lit("no 12024 but "), (1990 + F.col("c_custkey") % 20).cast("string"), F.lit("!"))).alias("year"),
        access.status_rank(_every("c_custkey", 3, "gold", "closed", "what")).cast("long").alias("rank"),
    )


_RECORDS = """
r AS (SELECT o_orderkey AS ord, 'k' || o_custkey AS publication_key, o_orderpriority AS source, repeat('t', CAST(o_orderkey % 7 AS INTEGER)) AS title,
  left(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS day, 1 + o_orderkey % 4 AS n_authors,
  CASE o_orderkey % 5 WHEN 0 THEN 'book-chapter' WHEN 1 THEN 'article' WHEN 2 THEN 'preprint' WHEN 3 THEN 'other' ELSE '' END AS type,
  CASE o_orderkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS score,
  CASE WHEN o_orderkey % 4 = 0 THEN '10.1234/' || o_orderkey ELSE '' END AS doi, 'S' || o_orderkey % 7 AS place,
  CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE ELSE CASE WHEN o_orderkey % 6 = 0 THEN TRUE END END AS flag, o_orderkey % 6 = 0 AS gold
  FROM orders WHERE o_orderkey % 11 <> 0)"""


def _source_records(table) -> DataFrame:
    orders, k = table("orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date").cast("string")
    names = F.array_join(F.transform(F.sequence(F.lit(0), k % 4), lambda x: F.concat(F.lit("A"), x.cast("string"))), "; ")
    blank = F.lit("")
    return orders.select(
        _every("o_orderkey", 11, "", _key("o_custkey")).alias("publication_key"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderpriority").alias("source_label"),
        _key("o_orderkey", "i").alias("source_record_id"),
        _key("o_orderkey", "r").alias("source_record_key"),
        _every("o_orderkey", 2, "", _key("o_orderkey", "u")).alias("record_url"),
        blank.alias("openalex_id"),
        F.repeat(F.lit("t"), (k % 7).cast("int")).alias("title"),
        F.left(day, F.when(k % 3 == 0, 4).when(k % 3 == 1, 7).otherwise(10)).alias("publication_date"),
        _every("o_orderkey", 4, F.concat(F.lit("10.1234/"), k.cast("string")), "").alias("doi"),
        _every("o_orderkey", 5, "book-chapter", "article", "preprint", "other", "").alias("type"),
        blank.alias("language"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("is_oa"),
        _every("o_orderkey", 6, "gold", "").alias("oa_status"),
        names.alias("authors"),
        _key_mod("S", k % 7).alias("institutions"),
        blank.alias("institution_ids"),
        blank.alias("institution_countries"),
        blank.alias("institution_names_raw"),
        F.lit("[]").alias("institution_affiliations_json"),
        blank.alias("abstract"),
        k.alias("_ord"),
    )


def _key_mod(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


@query(f"""
WITH {_RECORDS},
p AS (SELECT publication_key, string_agg(place, '; ' ORDER BY m) AS institutions FROM (SELECT publication_key, place, min(ord) AS m FROM r GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT publication_key, string_agg(source, '; ' ORDER BY m) AS source, count(*) AS source_count FROM (SELECT publication_key, source, min(ord) AS m FROM r GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT publication_key, arg_max(title, {{'a': length(title), 'b': -ord}}) AS title, arg_max(day, {{'a': length(day), 'b': -ord}}) AS publication_date, max(n_authors) AS n_authors,
  arg_max(type, {{'a': score, 'b': -ord}}) AS type, coalesce(arg_min(doi, ord) FILTER (doi <> ''), '') AS doi, bool_or(flag) AS is_oa, count(*) FILTER (gold AND flag) > 0 AS gold, count(*) AS n FROM r GROUP BY 1)
SELECT g.publication_key, title, publication_date, CAST(n_authors AS INTEGER) AS n_authors, type, doi, CAST(is_oa AS VARCHAR) AS is_oa,
  CASE WHEN is_oa THEN CASE WHEN gold THEN 'gold' ELSE 'open' END WHEN NOT is_oa THEN 'closed' ELSE 'unknown' END AS oa_status, institutions, source, CAST(source_count AS INTEGER) AS source_count, CAST(n AS INTEGER) AS n_records
FROM g JOIN p USING (publication_key) JOIN s USING (publication_key)""")
def merged_publications(table):
    merged = merge.merge_publications(_source_records(table))
    return merged.select(
        "publication_key", "title", "publication_date", F.size(text.parts(F.col("authors"))).alias("n_authors"), "type", "doi", F.col("is_oa").cast("string").alias("is_oa"), "oa_status",
        "institutions", "source", "source_count", F.size(F.from_json("source_provenance_json", "array<struct<source:string>>")).alias("n_records"),
    )


@query(f"""
WITH {_RECORDS.replace("r AS", "q AS", 1).replace(" WHERE o_orderkey % 11 <> 0", "")}, r AS (SELECT *, 'r' || ord AS rec, 'i' || ord % 5 AS id, CASE WHEN ord % 2 = 0 THEN '' ELSE 'u' || ord END AS url FROM q),
a AS (SELECT publication_key, string_agg(source, '; ' ORDER BY m) AS source, count(*) AS source_count FROM (SELECT publication_key, source, min(rec) AS m FROM r GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT publication_key, string_agg(id, '; ' ORDER BY m) AS source_record_id FROM (SELECT publication_key, id, min(rec) AS m FROM r GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT publication_key, string_agg(rec, '; ' ORDER BY rec) AS source_record_keys, coalesce(string_agg(url, '; ' ORDER BY rec) FILTER (url <> ''), '') AS record_urls FROM r GROUP BY 1)
SELECT publication_key, source, source_record_id, source_record_keys, record_urls, CAST(source_count AS INTEGER) AS source_count FROM a JOIN b USING (publication_key) JOIN c USING (publication_key)""")
def resynced_provenance(table):
    k = F.col("o_orderkey")
    return cache.provenance(table("orders").select(
        _key("o_custkey").alias("publication_key"), _key("o_orderkey", "r").alias("source_record_key"), F.col("o_orderpriority").alias("source"),
        _key_mod("i", k % 5).alias("source_record_id"), _every("o_orderkey", 2, "", _key("o_orderkey", "u")).alias("record_url"),
    ))


def _canonical(rows: DataFrame, **values: Column) -> DataFrame:
    """Canonical rows of customers with the given columns; others are empty."""
    columns = {c: F.lit("") for c in (*cache.REPLACED, *cache.LONGEST, *cache.UNITED)} | {"is_oa": F.lit(None).cast("boolean"), "oa_status": F.lit("unknown"), "source_count": F.lit(1)} | values
    return rows.select(_key("c_custkey").alias("publication_key"), *[c.alias(n) for n, c in columns.items()])


def _old_works(customers: DataFrame) -> DataFrame:
    flag = _every("c_custkey", 5, True, False, F.lit(None).cast("boolean")).cast("boolean")
    status = F.when(flag, "gold").when(~flag, "closed").otherwise("unknown")
    return _canonical(customers, title=F.col("c_name"), abstract=F.col("c_mktsegment"), authors=F.lit("A"), institutions=F.lit("X; Y"), type=F.lit("article"), is_oa=flag, oa_status=status, source_count=F.lit(2))


@query("""
WITH o AS (SELECT c_custkey AS i, c_name AS t, c_mktsegment AS ab, CASE c_custkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS f FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey AS i, 'n' || c_custkey AS t, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE repeat(c_mktsegment, 2) END AS ab, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'book' END AS ty,
  CASE c_custkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS f FROM customer WHERE c_custkey % 2 = 0)
SELECT 'k' || coalesce(o.i, n.i) AS publication_key, CASE WHEN o.i IS NULL OR length(n.t) >= length(o.t) THEN n.t ELSE o.t END AS title,
  CASE WHEN o.i IS NULL THEN n.ab WHEN n.i IS NULL THEN o.ab WHEN length(n.ab) >= length(o.ab) THEN n.ab ELSE o.ab END AS abstract,
  CASE WHEN n.i IS NULL THEN 'A' ELSE 'BB' END AS authors, CASE WHEN o.i IS NULL THEN 'Y; Z' WHEN n.i IS NULL THEN 'X; Y' ELSE 'X; Y; Z' END AS institutions,
  coalesce(nullif(n.ty, ''), CASE WHEN o.i IS NOT NULL THEN 'article' END) AS type,
  CAST(CASE WHEN o.f OR n.f THEN TRUE WHEN NOT o.f OR NOT n.f THEN FALSE END AS VARCHAR) AS is_oa,
  CASE WHEN o.f THEN 'gold' WHEN n.f THEN 'open' WHEN NOT o.f OR NOT n.f THEN 'closed' ELSE 'unknown' END AS oa_status, CASE WHEN o.i IS NULL THEN 1 ELSE 2 END AS source_count
FROM o FULL JOIN n ON o.i = n.i""")
def canonical_merge(table):
    customer = table("customer")
    flag = _every("c_custkey", 7, True, False, F.lit(None).cast("boolean")).cast("boolean")
    status = F.when(flag, "open").when(~flag, "closed").otherwise("unknown")
    new = _canonical(customer.where("c_custkey % 2 = 0"), title=_key("c_custkey", "n"), abstract=_every("c_custkey", 4, "", F.repeat("c_mktsegment", 2)), authors=F.lit("BB"), institutions=F.lit("Y; Z"), type=_every("c_custkey", 4, "", "book"), is_oa=flag, oa_status=status)
    merged = cache.merge_canonical(_old_works(customer.where("c_custkey % 3 <> 0")), new)
    return merged.select("publication_key", "title", "abstract", "authors", "institutions", "type", F.col("is_oa").cast("string").alias("is_oa"), "oa_status", "source_count")


@query("""
WITH n AS (SELECT 'k' || user_id AS publication_key, event_type AS model, max(event_id) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
o AS (SELECT DISTINCT 'k' || user_id AS publication_key, event_type AS model FROM events WHERE event_id % 2 = 0)
SELECT publication_key, model, v FROM n UNION ALL SELECT publication_key, model, 0 FROM o ANTI JOIN n USING (publication_key, model)""")
def stored_results(table):
    rows = table("events").select(_key("user_id").alias("publication_key"), F.col("event_type").alias("model"), F.col("event_id").alias("v"))
    old = rows.where("v % 2 = 0").select("publication_key", "model").distinct().withColumn("v", F.lit(0).cast("long"))
    return cache.upsert_latest(old, rows.where("v % 3 = 0"), cache.RESULT_KEYS, order="v")


@query("""
SELECT 'k' || c_custkey AS publication_key, c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN 'again' WHEN c_custkey % 2 = 0 THEN 'first' END AS sdg_note FROM customer""")
def snapshot_tables(table):
    """Three versions: works, results, results anew; the works are carried over."""
    customer = table("customer")
    spark = customer.sparkSession
    store = cache.Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")

    def results(rows: DataFrame, note: str) -> DataFrame:
        return rows.select(_key("c_custkey").alias("publication_key"), F.lit("m").alias("model"), F.lit(note).alias("sdg_note"))

    store.publish({"works": _old_works(customer)})
    store.publish_results(results(customer.where("c_custkey % 2 = 0"), "first"))
    store.publish_results(results(customer.where("c_custkey % 4 = 0"), "again"))
    return store.read("works").select("publication_key", "title").join(store.read("results").drop("model"), "publication_key", "left")


@query("""
SELECT 'k' || c_custkey AS publication_key, 'm' || c_custkey % 3 AS model, CASE WHEN c_custkey % 7 = 0 THEN 'second' WHEN c_custkey % 10 = 0 THEN 'first' ELSE 'base' END AS sdg_note FROM customer
UNION ALL SELECT 'n' || c_custkey, 'm', 'new' FROM customer WHERE c_custkey % 50 = 0""")
def snapshot_upserts(table):
    """A base and three deltas, some of their buckets compacted."""
    return _results_store(table).read("results")


@query("""
SELECT 'k' || c_custkey AS publication_key, 'm' || c_custkey % 3 AS model, CASE WHEN c_custkey % 7 = 0 THEN 'second' WHEN c_custkey % 10 = 0 THEN 'first' ELSE 'base' END AS sdg_note FROM customer WHERE c_custkey % 13 = 0""")
def stored_for_keys(table):
    """The stored results of given keys, some of which the table does not hold."""
    keys = table("customer").where("c_custkey % 13 = 0").select(_key("c_custkey").alias("publication_key"), F.concat(F.lit("m"), (F.col("c_custkey") % 3).cast("string")).alias("model"))
    return _results_store(table).current("results", keys.union(keys.select(F.concat("publication_key", F.lit("-")), "model")))


def _results_store(table) -> cache.Snapshots:
    customer = table("customer")
    spark = customer.sparkSession
    store = cache.Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", buckets=16)

    def results(rows: DataFrame, note: str, prefix: str = "k") -> DataFrame:
        return rows.select(_key("c_custkey", prefix).alias("publication_key"), (F.concat(F.lit("m"), (F.col("c_custkey") % 3).cast("string")) if prefix == "k" else F.lit("m")).alias("model"), F.lit(note).alias("sdg_note"))

    store.publish({"results": results(customer, "base")})
    store.publish_results(results(customer.where("c_custkey % 10 = 0"), "first"))
    store.publish_results(results(customer.where("c_custkey % 7 = 0"), "second"))
    store.publish_results(results(customer.where("c_custkey % 50 = 0"), "new", "n"))
    store.compact(2)
    return store


@query(f"""
WITH {_RECORDS}
SELECT publication_key, repeat('t', CAST(max(length(title)) AS INTEGER)) AS title, CAST(bool_or(flag) AS VARCHAR) AS is_oa, CAST(count(DISTINCT source) AS INTEGER) AS source_count,
  string_agg('r' || ord, '; ' ORDER BY 'r' || ord) AS source_record_keys FROM r GROUP BY publication_key""")
def harvested_snapshots(table):
    """Source records that come in two batches, each merged into the stored works."""
    records = _source_records(table)
    spark = records.sparkSession
    store = cache.Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", buckets=16)
    for batch in (records.where("_ord % 3 <> 0"), records.where("_ord % 3 = 0")):
        upsert.upsert(store, batch)
    return store.read("works").select("publication_key", "title", F.col("is_oa").cast("string").alias("is_oa"), "source_count", "source_record_keys")


def provider(url: str, headers: dict | None = None) -> str:
    """A stand-in for the abstract and search services."""
    if "/DOI:" in url:
        return json.dumps({"abstract": f"found <b>{url.rsplit('/', 1)[-1].split('?')[0]}</b> &amp; more"})
    title = parse_qs(urlparse(url).query)["q"][0].rsplit(" ", 1)[0]
    wrong, right = {"title": title, "snippet": "another year", "year": "1999"}, {"title": title.upper() + "!", "snippet": f"told of {title}", "publication_info": {"summary": "Z - 2020"}}
    return json.dumps({"organic_results": [{"title": "something else"}, wrong, right] if title.startswith("search ") else []})


def classifier(url: str, headers: dict, body: str, before=lambda: None) -> str:
    """A stand-in for the classifier: a goal by the length of the text."""
    before()
    return json.dumps({"predictions": [{"prediction": 0.5, "sdg": {"code": str(len(json.loads(body)["text"]) % 17 + 1), "name": ""}}]})


def _enriched(table) -> enrich.Enriched:
    part, blank = table("part"), F.lit("")
    words = F.concat("p_type", F.lit(" own "), F.col("p_partkey").cast("string"))
    pubs = part.select(
        _key("p_partkey").alias("publication_key"),
        _every("p_partkey", 3, "openalex; d", "d").alias("source"),
        blank.alias("source_record_keys"),
        _every("p_partkey", 4, F.col("p_name"), F.col("p_name"), F.concat(F.lit("search "), _key("p_partkey", "no")), F.concat(F.lit("Nothing "), _key("p_partkey", "no"))).alias("title"),
        F.lit("Z").alias("authors"),
        _every("p_partkey", 4, "", F.concat(F.lit("https://doi.org/10.1234/p"), F.col("p_partkey").cast("string")), "").alias("doi"),
        F.lit("2020-01").alias("publication_date"),
        _every("p_partkey", 4, F.concat(F.lit("<p>"), words, F.lit("</p>")), "").alias("abstract"),
    )
    cached = pubs.sparkSession.createDataFrame([], "publication_key string, abstract string, source_record_keys string")
    fresh = F.when(F.col("p_partkey") % 8 == 0, F.sha2(words.cast("binary"), 256)).otherwise("stale")
    stored = part.where("p_partkey % 4 = 0").select(_key("p_partkey").alias("publication_key"), F.lit("m").alias("model"), F.lit("{}").alias("sdg_response"), F.lit("old").alias("sdg_formatted"), F.lit("kept").alias("sdg_note"), fresh.alias("text_hash"))
    return enrich.enrich(pubs, cached, stored, "m", enrich.classifier_client(classifier, "https://c.org", "m", spaced=lambda: enrich.Spaced(0)), enrich.abstract_client(provider), enrich.search_client(provider, "key"))


_ENRICHED = """
a AS (SELECT p_partkey AS i, CASE p_partkey % 4 WHEN 0 THEN p_type || ' own ' || p_partkey WHEN 1 THEN 'found p' || p_partkey || ' & more' WHEN 2 THEN 'told of search no' || p_partkey ELSE '' END AS abstract, 'Nothing no' || p_partkey AS title FROM part)"""


@query(f"""
WITH {_ENRICHED}
SELECT 'k' || i AS publication_key, abstract, CASE WHEN i % 8 = 0 THEN 'old' ELSE '50% SDG ' || (length(CASE WHEN abstract = '' THEN title ELSE abstract END) % 17 + 1) END AS sdg_formatted,
  CASE WHEN i % 8 = 0 THEN 'kept' WHEN abstract = '' THEN 'low_confidence:title_only_no_abstract' ELSE '' END AS sdg_note FROM a""")
def classified_publications(table):
    return _enriched(table).rows.select("publication_key", "abstract", "sdg_formatted", "sdg_note")


@query(f"""
WITH {_ENRICHED}
SELECT count(*) AS rows, count(*) FILTER (i % 4 <> 0) AS source_abstract_missing, count(*) FILTER (i % 4 <> 0 AND i % 3 = 0) AS openalex_abstract_missing, count(*) FILTER (i % 4 = 1) AS ss_abstract_retrieved,
  count(*) FILTER (i % 4 = 2) AS gs_abstract_retrieved, count(*) FILTER (abstract <> '') AS total_abstracts_available FROM a""")
def enrichment_stats(table):
    return _enriched(table).stats


def _raw(rows: DataFrame, payload: Column, key: str) -> DataFrame:
    return rows.select(F.lit("rep").alias("source"), F.lit("Rep").alias("label"), payload.alias("payload"), F.col(key).alias("_ord"))


@query("""
SELECT 'doi:10.1234/x' || p_partkey AS publication_key, 'openalex:W' || p_partkey AS source_record_key, p_name AS title, CAST(p_partkey % 2 = 0 AS VARCHAR) AS is_oa, CASE WHEN p_partkey % 2 = 0 THEN 'gold' ELSE 'closed' END AS oa_status,
  'A; A' AS authors, p_brand AS institutions, 'PL' AS institution_countries, 'hello world hello ' || p_type AS abstract FROM part WHERE p_partkey % 10 <> 0""")
def normalized_works(table):
    number = F.col("p_partkey").cast("string")
    place = F.struct(F.lit("https://openalex.org/I1").alias("id"), F.col("p_brand").alias("display_name"), F.lit("pl").alias("country_code"))
    author = F.struct(F.struct(F.lit(" A ").alias("display_name")).alias("author"), F.array(place).alias("institutions"))
    work = F.struct(
        _every("p_partkey", 10, " ", F.concat(F.lit("https://openalex.org/W"), number, F.lit("/"))).alias("id"),
        F.col("p_name").alias("display_name"),
        F.concat(F.lit("https://doi.org/10.1234/X"), number).alias("doi"),
        F.struct((F.col("p_partkey") % 2 == 0).alias("is_oa"), F.lit("gold").alias("oa_status")).alias("open_access"),
        F.array(author, author).alias("authorships"),
        F.map_from_arrays(F.array(F.lit("hello"), F.lit("world"), F.col("p_type")), F.array(F.array(F.lit(2), F.lit(0)), F.array(F.lit(1)), F.array(F.lit(3)))).alias("abstract_inverted_index"),
    )
    made = normalize.works(_raw(table("part"), F.to_json(work), "p_partkey"))
    return made.select("publication_key", "source_record_key", "title", F.col("is_oa").cast("string").alias("is_oa"), "oa_status", "authors", "institutions", "institution_countries", "abstract")


@query("""
SELECT 'dspace:rep:u' || p_partkey AS source_record_key, 'https://rep.org/handle/20.5/' || p_partkey AS record_url, p_name AS title, CASE WHEN p_size % 3 = 0 THEN 'book-chapter' ELSE 'book' END AS type,
  CAST(2000 + p_size AS VARCHAR) AS publication_date, 1000000000 + CAST(p_partkey // 2 AS BIGINT) AS arrival FROM part WHERE p_partkey % 2 = 0""")
def repository_pages(table):
    """A search of two entity types, recorded page by page; the filter leaves one to ask for, whose pages are dealt to tasks."""
    search = "https://rep.org/server/api/discover/search/objects"
    source = config.Source("dspace", "rep", "Rep", "https://rep.org/server/api", ("Article", "Book"))
    number = F.col("p_partkey").cast("string")
    item = F.struct(
        F.concat(F.lit("u"), number).alias("uuid"), F.col("p_name").alias("name"), F.concat(F.lit("20.5/"), number).alias("handle"), F.col("entity").alias("entityType"),
        F.struct(F.array(F.struct(F.when(F.col("p_size") % 3 == 0, "Book chapter").otherwise("Monograph").alias("value"))).alias("dc.type"), F.array(F.struct((F.col("p_size") + 2000).cast("string").alias("value"))).alias("dc.date.issued")).alias("metadata"),
    )
    part = table("part").withColumn("entity", _every("p_partkey", 2, "Book", "Article")).withColumn("page", F.floor(F.col("p_partkey") / 200))
    objects = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.struct(item.alias("indexableObject")).alias("_embedded")))), lambda x: F.struct(x["_embedded"].alias("_embedded")))
    pages = part.groupBy("entity", "page").agg(objects.alias("objects"))
    last = part.agg(F.max("page").alias("last"))
    body = F.struct(F.struct(F.struct(F.struct((F.col("last") + 1).alias("totalPages")).alias("page"), F.struct("objects").alias("_embedded")).alias("searchResult")).alias("_embedded"))
    asked = {"configuration": "default", "dsoType": "item", "f.entityType": "<e>,equals", "page": "<p>", "size": 100, "sort": "dc.date.issued,DESC"}
    before, between, after = re.split("%3C[ep]%3E", harvest.with_query(search, **asked))
    url = F.concat(F.lit(before), F.col("entity"), F.lit(between), F.col("page").cast("string"), F.lit(after))
    recorded = harvest.record(pages.crossJoin(F.broadcast(last)).select(url.alias("url"), F.to_json(body).alias("body")))  # last: one row
    harvest.register(recorded.sparkSession)
    options = {"url": search, "id": "rep", "label": "Rep", "home": source.home, "configuration": "default", "entities": ",".join(source.types), "pagesperpartition": "3", "transport": "table", "folder": recorded.written_to}
    raw = shared.written(recorded.sparkSession.read.format("repository_search").options(**options).load().where("entity = 'Book'"), "answers")
    shared.discard(recorded)
    return normalize.items(raw).select("source_record_key", "record_url", "title", "type", "publication_date", F.col("_ord").alias("arrival"))


@query("""
SELECT 'doi:10.5555/q' || p_partkey AS publication_key, 'dspace:rep:u' || p_partkey AS source_record_key, p_name AS title, 'article' AS type, CASE WHEN p_partkey % 2 = 0 THEN 'closed' ELSE 'open' END AS oa_status, 'A; B & C' AS authors,
  '2020-05' AS publication_date, CASE WHEN p_partkey % 3 = 0 THEN 'po polsku' ELSE 'on ' || p_type END AS abstract, 'Uni ' || p_brand AS institutions,
  'dspace-affiliation:rep:' || left(sha256('uni ' || lower(replace(p_brand, '#', ' '))), 16) AS institution_ids FROM part""")
def normalized_items(table):
    """Metadata values as lists of objects, lists of texts, single objects and single texts."""
    number = F.col("p_partkey").cast("string")
    rights = _every("p_partkey", 2, '"closed  access"', '[{"value": "Licence <b>CC-BY</b> 4.0"}]')
    spoken = _every("p_partkey", 3, '"dc.language": "PL", ', "")
    metadata = F.concat(
        F.lit('{"dc.type": [{"value": " Journal <i>Article</i>"}], "dc.rights": '), rights, F.lit(', "dc.contributor.author": ["A", {"value": null}, "B &amp; C"], "dc.date.issued": {"value": "2020-05"}, "dc.empty": 0, '), spoken,
        F.lit('"dc.abstract.pl": [{"value": "po polsku"}], "dc.abstract.en": [{"value": "on <b>'), F.col("p_type"), F.lit('</b>"}], "dc.identifier.doi": [{"value": "doi:10.5555/Q'), number, F.lit('"}], "dc.affiliation": [{"value": "Uni  '), F.col("p_brand"), F.lit('"}]}'),
    )
    payload = F.concat(F.lit('{"_embedded": {"indexableObject": {"uuid": "u'), number, F.lit('", "name": "'), F.col("p_name"), F.lit('", "entityType": "Artistic", "metadata": '), metadata, F.lit("}}}"))
    return normalize.items(_raw(table("part"), payload, "p_partkey")).select("publication_key", "source_record_key", "title", "type", "oa_status", "authors", "publication_date", "abstract", "institutions", "institution_ids")


@query("""
SELECT 'doi:10.5555/ab' || p_partkey AS publication_key, 'oai:rep:oai:x:' || p_partkey AS source_record_key, 'https://r.org/frontdoor/' || p_partkey AS record_url, 'T ' || p_name AS title, 'book-chapter' AS type,
  CASE WHEN p_partkey % 2 = 0 THEN 'open' ELSE 'closed' END AS oa_status, 'Doe, Jo; Roe, Al' AS authors, CASE WHEN p_partkey % 3 = 0 THEN 'ein viel laengerer Text' ELSE 'short ' || p_type END AS abstract, '2023-05' AS publication_date
FROM part WHERE p_partkey % 10 > 1""")
def normalized_oai(table):
    """Harvested records; deleted ones and those with a document type go."""
    number = F.col("p_partkey").cast("string")
    english = _every("p_partkey", 3, "", F.concat(F.lit('<description xml:lang="en">short '), F.col("p_type"), F.lit("</description>")))
    rights = _every("p_partkey", 2, "https://creativecommons.org/licenses/by/4.0", "info:eu-repo/semantics/restrictedAccess")
    payload = F.concat(
        _every("p_partkey", 10, "", "<!DOCTYPE x>", ""), F.lit("<record><header"), _every("p_partkey", 10, ' status="deleted"', ""), F.lit("><identifier>oai:x:"), number,
        F.lit("</identifier><setSpec>doc-type:bookPart</setSpec></header><metadata><dc><title>T <![CDATA[<i>]]>"), F.col("p_name"), F.lit("</title><creator>Doe, Jo; https://orcid.org/0000-0001-2345-6789</creator><creator>Roe,  Al</creator>"),
        F.lit('<description xml:lang="de">ein viel laengerer Text</description>'), english, F.lit("<date>2023-05</date><type>unknown kind</type><identifier>https://doi.org/10.5555/AB"), number,
        F.lit("</identifier><identifier>https://r.org/files/1</identifier><identifier>https://r.org/frontdoor/"), number, F.lit("</identifier><rights>"), rights, F.lit("</rights></dc></metadata></record>"),
    )
    return normalize.oai(_raw(table("part"), payload, "p_partkey")).select("publication_key", "source_record_key", "record_url", "title", "type", "oa_status", "authors", "abstract", "publication_date")


@query("""
WITH t AS (SELECT o_orderkey, left(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS d FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
b AS (SELECT o_orderkey, CAST(d || CASE length(d) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS DATE) AS lo, d FROM t)
SELECT o_orderkey FROM b ORDER BY CASE length(d) WHEN 4 THEN make_date(year(lo), 12, 31) WHEN 7 THEN last_day(lo) ELSE lo END DESC, o_orderkey LIMIT 100""")
def newest_of_types(table):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    rows = table("orders").select("o_orderkey", F.col("o_orderpriority").alias("type"), F.left(day, F.when(k % 3 == 0, 4).when(k % 3 == 1, 7).otherwise(10)).alias("publication_date"), k.alias("_ord"))
    return fetch.newest_per_source(fetch.of_types(rows, ("1-URGENT", "2-HIGH")), 100).select("o_orderkey")


@query("""
SELECT c_custkey, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS changed FROM customer""")
def changed_rows(table):
    keys = _every("c_custkey", 2, "a; b; c", "b; a")
    return table("customer").select("c_custkey", cache.cache_changed(keys, F.lit("a; b"), _every("c_custkey", 3, "longer", "text"), F.lit("text")).alias("changed"))


@query("""
SELECT 'k' || p_partkey AS publication_key, 'say "' || p_name || '", twice' || chr(10) || 'next' AS title, ' ' || p_type || ' ' AS type, '' AS sdg_note FROM part""")
def exported_rows(table):
    """A CSV written and read again."""
    part = table("part")
    path = f"{shared_dir(part.sparkSession)}/export-{uuid.uuid4().hex}"
    rows = part.select(_key("p_partkey").alias("publication_key"), F.concat(F.lit('say "'), "p_name", F.lit('", twice\nnext')).alias("title"), F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("type"), F.lit(1).alias("junk"))
    export.write_csv(rows, path)
    return export.read_csv(part.sparkSession, path).select("publication_key", "title", "type", "sdg_note")


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-10' AND DATE '1996-04-20'""")
def raw_day_window(table):
    """Dated rows in a window on the day itself; reversed bounds hold nothing, undated rows go by year only where all are undated."""
    rows = table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("d"), F.lit("1996").alias("y"))
    begin, end = F.lit(date(1996, 3, 10)), F.lit(date(1996, 4, 20))
    one = analytics.with_days(rows, "d", "y", "day")
    undated = analytics.with_days(rows.withColumn("d", F.lit("")), "d", "y", "day").where(F.col("day") != date(1996, 1, 1))
    return one.where(dates.day_in(F.col("day"), begin, end) | dates.day_in(F.col("day"), end, begin)).unionByName(undated).select("o_orderkey", "day")


def _shipments(table) -> DataFrame:
    """Orders as publications of their suppliers' nations."""
    places = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.struct(_key("s_suppkey", "I").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("country")).alias("x"))
    items = table("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    rows = analytics.spread(items.join(places, "l_suppkey"), "l_orderkey", size=items.count()).groupBy("l_orderkey").agg(F.collect_list("x").alias("xs"), F.min("l_shipdate").cast("date").cast("string").alias("publication_date"))
    packed = [text.joined(F.col(f"xs.{f}")).alias(c) for f, c in (("id", "institution_ids"), ("name", "institution_names_raw"), ("country", "institution_countries"))]
    return rows.select(_key("l_orderkey").alias("publication_key"), "publication_date", F.when(F.col("l_orderkey") % 2 == 0, F.to_json("xs")).otherwise("").alias("institution_affiliations_json"), *packed)


_NETWORK = """
d AS (SELECT l_orderkey AS k FROM lineitem GROUP BY 1 HAVING min(l_shipdate)::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'),
s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS id FROM lineitem JOIN d ON k = l_orderkey),
e AS (SELECT x.id AS a, y.id AS b, count(*) AS w FROM s x JOIN s y ON x.k = y.k AND x.id < y.id GROUP BY 1, 2),
n AS (SELECT s_suppkey AS id, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, CAST(sum(w) AS BIGINT) AS w FROM e JOIN n p ON p.id = e.a JOIN n q ON q.id = e.b WHERE p.label <> q.label GROUP BY 1, 2),
o AS (SELECT n_name AS x FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_suppkey = 0),
p AS (SELECT * FROM g WHERE a IN (FROM o) OR b IN (FROM o)),
h AS (SELECT DISTINCT x FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p) WHERE x NOT IN (SELECT x FROM o)),
z AS (SELECT * FROM g WHERE a IN (FROM h) AND b IN (FROM h) AND w >= 2 ORDER BY w DESC, a, b LIMIT 20),
u AS (SELECT a, b, w, 'primary' AS kind FROM p UNION ALL SELECT a, b, w, 'secondary' FROM z),
v AS (SELECT label, CAST(sum(w) AS BIGINT) AS degree FROM (SELECT a AS label, w FROM u UNION ALL SELECT b, w FROM u) GROUP BY 1),
t AS (SELECT label, degree FROM (SELECT * FROM v WHERE contains(lower(label), '1') OR label IN (FROM o) ORDER BY degree DESC, label LIMIT 6) UNION SELECT label, degree FROM v WHERE label IN (FROM o))"""


def _network(table) -> tuple[DataFrame, DataFrame]:
    return network.institution_network(_shipments(table), date(1996, 1, 1), date(1997, 6, 30), origins(table, 0), "1", 6)


@query(f"WITH {_NETWORK} SELECT a, b, w, kind, round(least(10.0, 4.0 + 2.0 * log2(greatest(w, 1))), 6) AS width, round(least(0.96, 0.82 + 0.05 * log2(greatest(w, 1))), 6) AS alpha FROM u WHERE a IN (SELECT label FROM t) AND b IN (SELECT label FROM t)")
def network_edges(table):
    return _network(table)[1].select("a", "b", "w", "kind", F.round("width", 6).alias("width"), F.round("alpha", 6).alias("alpha"))


@query(f"WITH {_NETWORK} SELECT label, degree, label IN (SELECT x FROM o) AS origin FROM t")
def network_nodes(table):
    return _network(table)[0].select("label", "degree", "origin")
