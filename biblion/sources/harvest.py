"""Python Data Sources that page through HTTP APIs, or through recorded pages.

``transport`` names how a URL becomes text: ``http``, ``files`` (a folder with one file per URL,
named by the URL's SHA-256) or ``table`` (a Parquet folder of url, body, best one that ``record`` wrote), which
tests and re-runs use.

* Where pages follow tokens (works by cursor, OAI-PMH), a partition is one chain. Pages that
  have addresses (repository search) are planned: the first page of each entity type tells how
  many there are, and ranges of them become partitions, the last one open at its end. Ordinals
  are those of one chain, whatever the ranges.
* Filters on ``entity`` or ``type`` and on ``issued`` narrow the request (``pushFilters``) and are
  handed back for Spark to check, so a service that filters loosely changes no result. An OAI-PMH
  harvest takes none: its dates are those of metadata changes.
* With ``isolate``, a source whose answers stay unavailable (a status worth a retry, retries used up)
  gives a row that names the ``failure`` and no more rows of that partition;
  ``plans.fetch`` leaves such a source out whole. Other statuses, and connections that fail, raise.
"""

from __future__ import annotations

import hashlib
import html
import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime
from http.client import HTTPException
from itertools import islice
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

from ..operators.shared import written
from ..schemas import DSPACE_TYPES, ENTITY_KINDS, WORK_FIELDS

# Statuses worth another try, and the limits of waiting.
RETRYABLE = (429, 500, 502, 503, 504)
ATTEMPTS, SOURCE_ATTEMPTS, BASE_S, CAP_S = 4, 3, 0.5, 15.0
PAGE_SIZE, PAUSE_S = 200, 0.2
MAX_BYTES = 25 << 20
# End of the fixed values.
#: Failures of the connection rather than answers.
UNREACHABLE = (urllib.error.URLError, TimeoutError, ConnectionError, HTTPException)
SCHEMA = "source string, label string, payload string, home string, _ord long, failure string"
#: Arrival ordinals of a chain lie in a range of its own.
CHAIN_SPAN = 1_000_000_000
#: Pages of one partition of a repository search (option ``pagesperpartition``).
PAGES_PER_PARTITION = 20
#: Pages of one batch of a harvest stream (option ``pagesperbatch``).
PAGES_PER_BATCH = 10
#: Pages of one folder of a recorded table, about.
PAGES_PER_FOLDER = 64


def backoff(attempt: int, retry_after: str | None = None, draw: Callable[[float, float], float] = random.uniform) -> float:
    """Seconds to wait before a further attempt: what the server says, or full jitter, capped."""
    if retry_after and retry_after.strip().isdigit():
        return min(float(retry_after), CAP_S)
    if retry_after:
        try:
            return min(max(0.0, parsedate_to_datetime(retry_after).timestamp() - time.time()), CAP_S)
        except ValueError:
            pass
    return draw(0, min(CAP_S, BASE_S * 2 ** (attempt - 1)))


def http(
    url: str, headers: dict[str, str] | None = None, body: str | None = None, before: Callable[[], None] = lambda: None, timeout: float = 60, sleep: Callable[[float], None] = time.sleep,
    attempts: int = ATTEMPTS, connect: Callable = urllib.request.urlopen,
) -> str:
    """Text of a URL (of a POST where there is a body). Statuses worth it and failures of the connection are
    tried again; ``before`` runs ahead of every attempt."""
    if attempts < 1:
        raise ValueError("at least one attempt")
    request = urllib.request.Request(url, body.encode() if body is not None else None, headers or {})
    for attempt in range(1, attempts + 1):
        before()
        try:
            with connect(request, timeout=timeout) as r:
                return r.read(MAX_BYTES + 1).decode("utf-8", "replace")
        except UNREACHABLE as e:
            told = e if isinstance(e, urllib.error.HTTPError) else None
            if attempt == attempts or (told and told.code not in RETRYABLE):
                raise
            sleep(backoff(attempt, told.headers.get("Retry-After") if told and told.headers else None))
    raise AssertionError("unreachable")


def json_object(text: str) -> dict:
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("the response is not a JSON object")
    return found


def replayed(url: str, body: str) -> str:
    """A recorded answer; ``HTTP <status>`` by itself stands for an answer of that status."""
    if m := re.fullmatch(r"HTTP (\d{3})", body):
        raise urllib.error.HTTPError(url, int(m[1]), "recorded", None, None)
    return body


def recorded(folder: str) -> Callable[[str], str]:
    return lambda url: replayed(url, (Path(folder) / hashlib.sha256(url.encode()).hexdigest()).read_text(encoding="utf-8"))


def record(pages: DataFrame) -> DataFrame:
    """Pages (url, body) written to be asked for: dealt by a hash of the URL to as many folders as there are pages
    for, so that an answer reads some ``PAGES_PER_FOLDER`` of them, however many there are."""
    folders = -(-pages.count() // PAGES_PER_FOLDER)
    if not folders:
        return written(pages.select("url", "body"), "pages")
    dealt = pages.select("url", "body", F.lit(folders).alias("folders"), F.pmod(F.crc32(F.encode("url", "utf-8")), F.lit(folders)).alias("folder"))
    return written(dealt.repartition("folder"), "pages", ("folders", "folder"))


def recorded_table(folder: str) -> Callable[[str], str]:
    root = Path(folder.removeprefix("file:"))
    dealt = next(root.glob("folders=*"), None)

    def get(url: str) -> str:
        where = dealt / f"folder={zlib.crc32(url.encode()) % int(dealt.name.partition('=')[2])}" if dealt else root
        if not where.exists():
            raise FileNotFoundError(url)
        found = pq.read_table(where, columns=["body"], filters=[("url", "=", url)], partitioning=None)
        if not found.num_rows:
            raise FileNotFoundError(url)
        return replayed(url, found.column("body")[0].as_py())

    return get


def transport(options: dict[str, str]) -> Callable[[str], str]:
    if options.get("transport") == "files":
        return recorded(options["folder"])
    if options.get("transport") == "table":
        return recorded_table(options["folder"])
    agent = {"User-Agent": options["useragent"]} if options.get("useragent") else {}
    return lambda url: http(url, agent, attempts=SOURCE_ATTEMPTS)


def with_query(base: str, **query: object) -> str:
    return f"{base}?{urllib.parse.urlencode({k: v for k, v in query.items() if v not in (None, '')})}"


class Chain(InputPartition):
    def __init__(self, number: int, **values: str):
        self.number, self.values = number, values


class _Reader(DataSourceReader):
    """Rows of ``SCHEMA``, then ``extra`` values that a reader tells of each payload."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def chains(self) -> list[dict[str, str]]:
        return [{}]

    def pages(self, get: Callable[[str], str], chain: dict[str, str]) -> Iterator[str]:
        """Payloads of a chain, in order."""
        raise NotImplementedError

    def numbered(self, get: Callable[[str], str], chain: dict[str, str]) -> Iterator[tuple[int, str]]:
        """(place in the chain, payload)."""
        return enumerate(self.pages(get, chain))

    def extra(self, payload: str | None, chain: dict[str, str]) -> tuple:
        return ()

    def partitions(self) -> list[Chain]:
        return [Chain(i, **c) for i, c in enumerate(self.chains())]

    def unavailable(self, error: Exception) -> bool:
        """The error is an answer that tells of a source that is down for now, and the reader may go on without it."""
        return self.options.get("isolate") == "true" and isinstance(error, urllib.error.HTTPError) and error.code in RETRYABLE

    def read(self, partition: Chain) -> Iterator[tuple]:
        source, label = self.options.get("id", ""), self.options.get("label", self.options.get("id", ""))
        home, base = self.options.get("home", ""), partition.number * CHAIN_SPAN
        try:
            for i, payload in self.numbered(transport(self.options), partition.values):
                yield source, label, payload, home, base + i, None, *self.extra(payload, partition.values)
        except urllib.error.HTTPError as e:
            if not self.unavailable(e):
                raise
            yield source, label, None, home, base + CHAIN_SPAN - 1, f"HTTP {e.code}", *self.extra(None, partition.values)


def _full_date(value: object) -> str | None:
    """A literal that the services take as a date."""
    return value if isinstance(value, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) else None


class _Filtered(_Reader):
    """A reader whose request takes sets of one column's values (``of``) and a range of ``issued``."""

    of = ""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.wanted: frozenset[str] | None = None
        self.begin, self.end = self.options.get("issuedfrom"), self.options.get("issuedto")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == (self.of,) and isinstance(f, (EqualTo, In)):
                values = frozenset(v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None)
                self.wanted = values if self.wanted is None else self.wanted & values
            elif f.attribute == ("issued",) and (day := _full_date(getattr(f, "value", None))):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.begin = max(self.begin or day, day)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end or day, day)
            yield f  # the request is wider than the filter at times: Spark checks it, too


class _Works(_Filtered):
    """Works by cursor; one chain per group of identifiers (option ``filters``, separated by ;;)."""

    of = "type"

    def request(self, given: str) -> str:
        """A chain's filter, with what was pushed and the filter does not name itself."""
        named = {part.split(":")[0] for part in given.split(",")}
        told = {"from_publication_date": self.begin, "to_publication_date": self.end, "type": None if self.wanted is None else "|".join(sorted(self.wanted))}
        return ",".join([given, *(f"{k}:{v}" for k, v in told.items() if v and k not in named)])

    def chains(self) -> list[dict[str, str]]:
        if self.wanted is not None and not self.wanted:
            return []
        return [{"filter": self.request(f)} for f in self.options.get("filters", "").split(";;") if f]

    def extra(self, payload, chain):
        found = json.loads(payload) if payload else {}
        return found.get("type"), found.get("publication_date")

    def pages(self, get, chain):
        cursor, kept, limit = "*", 0, int(self.options.get("rowlimit", 0))
        while cursor:
            page = json_object(get(with_query(self.options["url"], filter=chain["filter"], select=self.options.get("fields", ",".join(WORK_FIELDS)), cursor=cursor, **{"per-page": PAGE_SIZE})))
            for work in page.get("results", []):
                yield json.dumps(work, ensure_ascii=False)
                kept += bool(str(work.get("id") or "").strip())
                if limit and kept >= limit:
                    return
            cursor = (page.get("meta") or {}).get("next_cursor") if page.get("results") else None
            if cursor and self.options.get("transport", "http") == "http":
                time.sleep(PAUSE_S)


def metadata_texts(item: dict, key: str) -> list[str]:
    """Non-empty values of a metadata key of a search object, whatever their shape."""
    found = ((item.get("metadata") or {}) if isinstance(item.get("metadata"), dict) else {}).get(key)
    entries = found if isinstance(found, list) else [found] if found else []
    told = (e.get("value") if isinstance(e, dict) else e for e in entries)
    return [t for t in (re.sub(r"<[^>]+>", " ", html.unescape("" if v is None else str(v))).strip() for v in told) if t]


def item_type(item: dict) -> str:
    """The publication type that normalisation gives a search object."""
    compact = re.sub("[^a-z0-9]", "", (metadata_texts(item, "dc.type") or [""])[0].lower())
    entity = str(item.get("entityType") or "").strip().lower()
    return DSPACE_TYPES.get(compact) or ENTITY_KINDS.get(entity) or re.sub("[^a-z0-9]+", "-", entity).strip("-") or "other"


class _Items(_Filtered):
    """Repository search by page. Without a limit the pages of an entity type are dealt to partitions; with one
    (``rowlimit``, per entity type, of items of ``types``) each type is one chain that ends once it is met."""

    of = "entity"

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.size = min(100, max(1, int(self.options.get("pagesize", 100))))
        self.limit = int(self.options.get("rowlimit", 0))
        self.types = frozenset(t for t in self.options.get("types", "").split(",") if t)

    def entities(self) -> list[tuple[int, str]]:
        """(place, entity type) of those to ask for; a filter moves no place."""
        listed = [e for e in dict.fromkeys(self.options.get("entities", "").split(",")) if e]
        return [(i, e) for i, e in enumerate(listed) if self.wanted is None or e in self.wanted]

    def page(self, get: Callable[[str], str], entity: str, number: int) -> tuple[list[dict], int]:
        """(objects, number of pages that there are)."""
        dates = f"[{self.begin or '*'} TO {self.end or '*'}],equals" if self.begin or self.end else None
        q = {"configuration": self.options.get("configuration"), "dsoType": "item", "scope": self.options.get("scope"), "f.entityType": f"{entity},equals", "f.dateIssued": dates, "page": number, "size": self.size, "sort": "dc.date.issued,DESC"}
        found = (json_object(get(with_query(self.options["url"], **q))).get("_embedded") or {}).get("searchResult") or {}
        return (found.get("_embedded") or {}).get("objects") or [], int((found.get("page") or {}).get("totalPages") or 0)

    def partitions(self) -> list[Chain]:
        get, step = transport(self.options), max(1, int(self.options.get("pagesperpartition", PAGES_PER_PARTITION)))
        planned = []
        for place, entity in self.entities():
            total = 1
            if not self.limit:
                try:
                    total = self.page(get, entity, 0)[1]
                except urllib.error.HTTPError as e:
                    if not self.unavailable(e):
                        raise  # else the task asks again, and tells of the failure
            firsts = range(0, max(1, total), step)
            planned += [Chain(place, entity=entity, first=str(f), last="" if f == firsts[-1] else str(f + step - 1)) for f in firsts]
        return planned

    def extra(self, payload, chain):
        item = ((json.loads(payload).get("_embedded") or {}).get("indexableObject") or {}) if payload else {}
        return chain["entity"], next(iter(metadata_texts(item, "dc.date.issued")), None)

    def keeps(self, found: dict) -> bool:
        """The object counts towards the limit: it has an id and a wanted type."""
        item = (found.get("_embedded") or {}).get("indexableObject") or {}
        return bool(str(item.get("uuid") or item.get("id") or "").strip()) and (not self.types or item_type(item) in self.types)

    def numbered(self, get, chain):
        number, last, kept = int(chain["first"]), int(chain["last"] or -1), 0
        while True:
            objects, total = self.page(get, chain["entity"], number)
            for i, found in enumerate(objects):
                yield number * self.size + i, json.dumps(found, ensure_ascii=False)
                kept += self.limit > 0 and self.keeps(found)
                if self.limit and kept >= self.limit:
                    return
            if not objects or number == last or (last < 0 and number + 1 >= total):
                return
            number += 1


class TokenExpired(ValueError):
    """The repository does not know a resumption token any more."""


class _Oai(_Reader):
    """OAI-PMH records by resumption token. Dates mean changes of metadata there, so a query of
    publication dates sends none; a stream's chain has those of its batch."""

    def address(self, token: str = "", **dates: str) -> str:
        if token:
            return with_query(self.options["url"], verb="ListRecords", resumptionToken=token)
        return with_query(self.options["url"], verb="ListRecords", metadataPrefix=self.options.get("prefix", "oai_dc"), set=self.options.get("set"), **dates)

    def page(self, get: Callable[[str], str], at: str) -> tuple[list[str], str]:
        """Records of a page and the token of the one after it, empty after the last."""
        body = get(at)
        if len(body.encode()) > MAX_BYTES or re.search("<!DOCTYPE|<!ENTITY", body, re.I):
            raise ValueError("response too large, or with a document type")
        if m := re.search(r'<error[^>]*code="(\w+)"', body):
            if m[1] == "noRecordsMatch":
                return [], ""
            raise (TokenExpired if m[1] == "badResumptionToken" else ValueError)(f"harvest error {m[1]}")
        token = re.search(r"<resumptionToken[^>]*>([^<]*)</resumptionToken>", body)
        return re.findall(r"(?s)<record[ >].*?</record>", body), html.unescape(token[1]).strip() if token else ""

    def pages(self, get, chain):
        at, seen = self.address(**{k: chain[k] for k in ("from", "until") if k in chain}), set()
        while at:
            records, token = self.page(get, at)
            yield from records
            if token in seen:
                raise ValueError("resumption token repeats")
            seen.add(token)
            at = self.address(token) if token else None


class _Source(DataSource):
    kind: type[_Reader]
    extra = ""

    def schema(self) -> str:
        return SCHEMA + self.extra

    def reader(self, schema) -> DataSourceReader:
        return self.kind({k.lower(): v for k, v in self.options.items()})


class WorksSource(_Source):
    kind, extra = _Works, ", type string, issued string"

    @classmethod
    def name(cls) -> str:
        return "works_api"


class ItemsSource(_Source):
    kind, extra = _Items, ", entity string, issued string"

    @classmethod
    def name(cls) -> str:
        return "repository_search"


class _OaiStream(SimpleDataSourceStreamReader):
    """Offsets are days of metadata change and, within the harvest of some days, the token of the page to ask next.

    A harvest covers the days from the offset's to yesterday (the granularity is a day: a day is read once
    it is over). A batch is at most ``pagesperbatch`` pages of it, as tokens make one chain and no page can be
    asked before the one ahead of it; they are what the driver holds. A stream that ends in mid-harvest
    goes on at its page. If its token has expired by then, the harvest's pages are asked from the first
    one again and those before it are left out. Records that change again come again, and the sink's
    upsert makes that harmless.
    """

    def __init__(self, options: dict[str, str]):
        self.inner, self.options = _Oai(options), options
        self.batch = int(options.get("pagesperbatch", PAGES_PER_BATCH))
        if self.batch < 1:
            raise ValueError("at least one page per batch")

    def today(self) -> str:
        return self.options.get("today") or datetime.now(timezone.utc).date().isoformat()

    def initialOffset(self) -> dict:
        return {"day": date.fromisoformat(self.options.get("start", "1970-01-01")).isoformat()}

    def steps(self, get: Callable[[str], str], at: dict, until: str) -> Iterator[tuple[list[tuple], dict]]:
        """(rows, offset behind them) of each page from ``at`` on. ``mark`` is the token of a page whose number is
        a power of two; a chain of tokens that runs in a circle comes back to one of them."""
        source, label, home = self.options.get("id", ""), self.options.get("label", self.options.get("id", "")), self.options.get("home", "")
        while True:
            number, seen, token = at.get("page", 0), at.get("seen", 0), at.get("token", "")
            last = (date.fromisoformat(until) - timedelta(days=1)).isoformat()
            records, following = self.inner.page(get, self.inner.address(token, **{"from": at["day"], "until": last}))
            rows = [(source, label, payload, home, seen + i, None) for i, payload in enumerate(records)]
            if not following:
                yield rows, {"day": until}
                return
            if following == at.get("mark") or following == token:
                raise ValueError("resumption token repeats")
            mark = following if number & (number + 1) == 0 else at.get("mark")
            at = {"day": at["day"], "until": until, "token": following, "page": number + 1, "seen": seen + len(records), "mark": mark}
            yield rows, at

    def onward(self, start: dict, until: str) -> Iterator[tuple[list[tuple], dict]]:
        """``steps`` from a stored offset, whose token may have expired since."""
        get = transport(self.options)
        steps = self.steps(get, start, until)
        try:
            head = next(steps)
        except TokenExpired:
            if "token" not in start:
                raise
            steps = (x for x in self.steps(get, {"day": start["day"]}, until) if x[1].get("page", start["page"] + 1) > start["page"])
            head = next(steps)
        yield head
        yield from steps

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        until = start.get("until") or self.today()
        if start["day"] >= until:
            return iter(()), start
        rows, at = [], start
        for found, at in islice(self.onward(start, until), self.batch):
            rows += found
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The rows of a batch that was planned before a failure."""
        if start == end:
            return
        for rows, at in self.onward(start, end.get("until") or end["day"]):
            yield from rows
            if at == end or at.get("page", 0) >= end.get("page", float("inf")):
                return


class OaiSource(_Source):
    kind = _Oai

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _OaiStream({k.lower(): v for k, v in self.options.items()})

    @classmethod
    def name(cls) -> str:
        return "oai_pmh"


def register(spark) -> None:
    """Make the sources known to the session, and let it push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WorksSource, ItemsSource, OaiSource):
        spark.dataSource.register(source)


