"""Missing abstracts from providers, then goal predictions, for canonical publications.

Calls go out only for the rows that need them, at most ``PARALLEL`` tasks at a time, and their
answers are written once in the shared folder, so no later action calls again. Clients are
injected: a client maker gives each task one function of a row. All tasks of a run share one
clock for the classifier's starts and a breaker per provider (``pacing``): once a provider has
refused, no task asks it again.
"""

from __future__ import annotations

import json
import urllib.error
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlencode

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, goals, text
from . import cache, classify, pacing
from .pacing import Spaced
from .shared import written

# Provider addresses, pacing.
ABSTRACT_URL = "https://api.semanticscholar.org/graph/v1/paper/DOI:{doi}?fields=abstract"
SEARCH_URL = "https://serpapi.com/search"
CANDIDATES, INTERVAL_S, PARALLEL = 5, 0.12, 8
SKIPPED_NOTE = "skipped: user selected 'skip'"
SHORT_NOTE = "skipped: {model} requires >={least} words"
# End of the fixed values.
CANDIDATE = "array<struct<title:string,doi:string,link:string,snippet:string,year:string,publication_year:string,publication_info:struct<doi:string,year:string,summary:string>,resources:array<struct<doi:string,link:string>>>>"
Ask = Callable[[dict], str | None]
#: Providers as the lease service knows them, and their intervals.
ABSTRACTS, CLASSIFIER = "abstracts", "classifier"
INTERVALS = {CLASSIFIER: INTERVAL_S}


def tasks(rows: DataFrame) -> int:
    """Calling tasks that can run at once."""
    return max(1, min(PARALLEL, rows.sparkSession.sparkContext.defaultParallelism))


def abstract_client(get: Callable[..., str], api_key: str | None = None, gated: Callable[[], pacing.Gate | Spaced] = lambda: pacing.gate(ABSTRACTS)) -> Callable[[], Ask]:
    """Abstract by DOI. A refusal (401, 403) ends the asking of all tasks; other failures give nothing."""

    def client() -> Ask:
        gate = gated()

        def ask(row: dict) -> str | None:
            if not row["doi"]:
                return None
            try:
                gate.wait()
                body = get(ABSTRACT_URL.format(doi=quote(row["doi"].replace("https://doi.org/", ""), safe="/")), {"Accept": "application/json"} | ({"x-api-key": api_key} if api_key else {}))
                found = json.loads(body)
                return found.get("abstract") if isinstance(found, dict) else None
            except urllib.error.HTTPError as e:
                if e.code in (401, 403):
                    gate.refuse()
            except pacing.Lost:
                raise
            except (pacing.Refused, OSError, ValueError):
                pass
            return None

        return ask

    return client


def search_client(get: Callable[..., str], api_key: str) -> Callable[[], Ask]:
    """JSON list of scholarly search results for title and authors."""

    def ask(row: dict) -> str | None:
        try:
            query = {"engine": "google_scholar", "q": f"{row['title']} {row['authors']}".strip(), "api_key": api_key, "hl": "en", "num": CANDIDATES}
            found = json.loads(get(f"{SEARCH_URL}?{urlencode(query)}"))
            return json.dumps((found.get("organic_results") if isinstance(found, dict) else None) or [])
        except (OSError, ValueError):
            return None

    return lambda: ask


def classifier_client(post: Callable[..., str], base_url: str | None, model: str, agent: str = "", spaced: Callable[[], pacing.Gate | Spaced] = lambda: pacing.gate(CLASSIFIER, INTERVAL_S)) -> Callable[[], Callable[[str], tuple[str | None, str]]]:
    """(response, note) of a text; starts are spaced, retries included."""

    def client():
        pace = spaced()

        def ask(words: str) -> tuple[str | None, str]:
            if not words:
                return None, "no text"
            if not base_url:
                return None, "configuration_error:missing_classifier_url"
            try:
                body = post(f"{base_url.rstrip('/')}/{model}", {"User-Agent": agent, "Content-Type": "application/json; charset=utf-8"}, json.dumps({"text": words}), pace.wait)
                return (body, "") if json.loads(body) else (None, "empty json")
            except urllib.error.HTTPError as e:
                return None, f"http_error:{e.code}"
            except pacing.Lost:
                raise
            except (OSError, ValueError):
                return None, "http_error:None"

        return ask

    return client


def answers(rows: DataFrame, client: Callable[[], Ask], columns: list[str], tag: str) -> DataFrame:
    """publication_key, answer of the rows, asked once each (a written table)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for f in frames:
            got = [ask(r) for r in f[columns].fillna("").to_dict("records")]
            yield pd.DataFrame({"publication_key": f["publication_key"], "answer": got})

    asked = rows.select("publication_key", *columns).repartition(tasks(rows)).mapInPandas(run, "publication_key string, answer string")
    return written(asked, tag)


def matching_snippet(rows: DataFrame) -> DataFrame:
    """publication_key, snippet of the first candidate that matches: like title, no other DOI, no other year.

    rows: publication_key, title, doi, publication_date, answer (JSON list of candidates). A candidate's
    side is compared where it tells one; a row without DOI or year does not match one that tells it.
    """
    one = rows.select("publication_key", "title", "doi", "publication_date", F.posexplode(F.slice(F.from_json("answer", CANDIDATE), 1, CANDIDATES)).alias("_i", "c"))
    c = F.col("c")
    told = F.concat(F.array(c["doi"], c["link"], c["publication_info"]["doi"], c["publication_info"]["summary"]), F.flatten(F.transform(F.coalesce(c["resources"], F.array()), lambda r: F.array(r["doi"], r["link"]))))
    doi = F.coalesce(F.get(F.filter(F.transform(told, text.strict_doi), lambda x: x != ""), F.lit(0)), F.lit(""))
    years = F.transform(F.array(c["year"], c["publication_year"], c["publication_info"]["year"], c["publication_info"]["summary"]), dates.year_anywhere)
    year = F.coalesce(F.get(F.filter(years, lambda x: x != ""), F.lit(0)), F.lit(""))
    free = ((doi == "") | (doi == text.strict_doi(F.col("doi")))) & ((year == "") | (year == dates.year_anywhere(F.col("publication_date")))) & (F.coalesce(c["snippet"], F.lit("")) != "")
    near = text.with_similar(one.where(free), "_near", text.compact_key(F.col("title")), text.compact_key(F.col("c.title"))).where("_near")
    return near.groupBy("publication_key").agg(F.min_by("c.snippet", "_i").alias("snippet"))


@dataclass
class Enriched:
    """``rows`` are the results; ``works`` and ``results`` go into the cache; ``stats`` is one row."""

    rows: DataFrame
    works: DataFrame
    results: DataFrame
    stats: DataFrame


def fill_abstracts(pubs: DataFrame, cached: DataFrame, by_doi: Callable[[], Ask] | None = None, by_title: Callable[[], Ask] | None = None) -> DataFrame:
    """pubs with ``abstract`` filled, and cached_abstract, source_missing, api_missing, by_doi, by_title, changed.

    The longer of source and cached abstract counts; providers are asked, one after the other, only
    for rows that have none.
    """
    known = cached.select("publication_key", text.clean_html(F.col("abstract")).alias("cached_abstract"), F.col("source_record_keys").alias("_keys"), F.lit(True).alias("_known"))
    rows = pubs.withColumn("_own", text.clean_html(F.col("abstract"))).join(known, "publication_key", "left").withColumn("cached_abstract", F.coalesce("cached_abstract", F.lit("")))
    best = F.when(F.length("cached_abstract") > F.length("_own"), F.col("cached_abstract")).otherwise(F.col("_own"))
    missing = F.col("_own") == ""
    rows = rows.withColumns({"abstract": best, "source_missing": missing, "api_missing": missing & F.array_contains(F.split("source", "; "), "openalex"), "by_doi": F.lit(False), "by_title": F.lit(False)}).drop("_own")
    for flag, client, needed in (("by_doi", by_doi, F.col("source_missing") & (F.coalesce("doi", F.lit("")) != "")), ("by_title", by_title, F.coalesce("title", F.lit("")) != "")):
        if client is None:
            continue
        rows = written(rows, "rows")
        empty = rows.where(needed & (F.col("abstract") == ""))
        got = answers(empty, client, ["doi", "title", "authors"], flag)
        if flag == "by_title":
            got = matching_snippet(empty.select("publication_key", "title", "doi", "publication_date").join(got, "publication_key")).withColumnRenamed("snippet", "answer")
        found = got.select("publication_key", text.clean_html(F.col("answer")).alias("_found")).where("_found <> ''")
        rows = rows.join(found, "publication_key", "left").withColumns({"abstract": F.coalesce("_found", "abstract"), flag: F.col("_found").isNotNull()}).drop("_found")
    fresh = F.col("_known").isNull() | cache.cache_changed(F.col("source_record_keys"), F.col("_keys"), F.col("abstract"), F.col("cached_abstract"))
    return rows.withColumn("changed", fresh).drop("_known", "_keys")


def classified(rows: DataFrame, stored: DataFrame, model: str, client: Callable[[], Callable[[str], tuple[str | None, str]]] | None) -> DataFrame:
    """rows of ``fill_abstracts`` with decision, text_hash, sdg_model, sdg_response, sdg_formatted, sdg_note.

    stored: publication_key, model, sdg_response, sdg_formatted, sdg_note, text_hash of earlier runs.
    """
    old = stored.where(F.col("model") == model).select("publication_key", *[F.col(c).alias(f"_old_{c}") for c in ("sdg_response", "sdg_formatted", "sdg_note", "text_hash")])
    words = classify.input_text(F.col("abstract"), F.col("title"))
    updated = (F.col("abstract") != "") & (F.col("abstract") != F.col("cached_abstract"))
    rows = rows.join(old, "publication_key", "left").withColumns({"_text": words, "text_hash": text.text_hash(words)})
    rows = rows.withColumn("decision", classify.decision(model, text.word_count(F.col("_text")), F.col("text_hash"), F.col("_old_text_hash"), F.col("_old_sdg_response"), updated))
    rows = written(rows, "decided")
    if model == classify.SKIP or client is None:
        got = rows.sparkSession.createDataFrame([], "publication_key string, response string, note string")
    else:
        calls = rows.where("decision = 'call'").select(F.col("publication_key").alias("key"), "_text")
        got = written(classify.call_rows(calls, client, "_text", tasks(rows)), "calls").withColumnRenamed("key", "publication_key")
    rows = rows.join(got, "publication_key", "left")
    reuse, short = F.col("decision") == "reuse", F.col("decision") == "too_short"
    response = F.coalesce(F.when(reuse, F.col("_old_sdg_response")).otherwise(F.col("response")), F.lit(""))
    made = goals.ranked_text(response)
    note = F.coalesce(F.when(F.col("decision") == classify.SKIP, SKIPPED_NOTE).when(short, SHORT_NOTE.format(model=model, least=classify.LEAST_WORDS.get(model, 0))).when(reuse, F.col("_old_sdg_note")).otherwise(F.col("note")), F.lit(""))
    titled = (response != "") & (F.col("abstract") == "")
    rows = rows.withColumns({"sdg_model": F.lit(model), "sdg_response": response, "sdg_formatted": F.when(reuse, F.coalesce(text.nullify(F.col("_old_sdg_formatted")), made)).otherwise(made), "_note": note})
    rows = rows.withColumn("sdg_note", F.when(titled, text.with_flag(F.col("_note"), F.lit(classify.TITLE_ONLY))).otherwise(F.col("_note")))
    return rows.drop("_text", "_note", "response", "note", *[c for c in rows.columns if c.startswith("_old_")])


def enrich(pubs: DataFrame, cached: DataFrame, stored: DataFrame, model: str, client=None, by_doi=None, by_title=None) -> Enriched:
    """The whole step for canonical publications (unique publication_key)."""
    with pacing.leased(pubs.sparkSession, INTERVALS):
        full = written(classified(fill_abstracts(pubs, cached, by_doi, by_title), stored, model, client), "enriched")
    called = F.col("decision") == "call"
    flags = {"source_abstract_missing": "source_missing", "openalex_abstract_missing": "api_missing", "ss_abstract_retrieved": "by_doi", "gs_abstract_retrieved": "by_title"}
    stats = full.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()], F.count_if(F.col("abstract") != "").alias("total_abstracts_available"))
    new = full.where(called & (F.col("sdg_response") != "")).select("publication_key", F.col("sdg_model").alias("model"), "sdg_response", "sdg_formatted", "sdg_note", "text_hash")
    return Enriched(full.select(*pubs.columns, "sdg_model", "sdg_response", "sdg_formatted", "sdg_note"), full.where(called | F.col("changed")).select(*pubs.columns), new, stats)
