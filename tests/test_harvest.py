"""Readers: planned pages, pushed filters, limits, failures as data, and the statistics of a run."""

import json
import re
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from biblion.plans import fetch
from biblion.schemas import DSPACE_TYPES
from biblion.sources import config, harvest, normalize
from pyspark.sql import functions as F
from test_fetch import CONTACT, page
from test_publications import RECORD, WORK, record_page

API = "https://rep.org/server/api"
SEARCH = f"{API}/discover/search/objects"


def item(i, entity="Article", issued="2024", kind="journal article", **more):
    return {"_embedded": {"indexableObject": {"uuid": i, "name": f"Title {i}", "entityType": entity, "metadata": {"dc.type": [{"value": kind}], "dc.date.issued": [{"value": issued}]}, **more}}}


def answer(objects, total):
    return json.dumps({"_embedded": {"searchResult": {"page": {"totalPages": total}, "_embedded": {"objects": objects}}}})


def search_url(entity, number, size, dates=None):
    q = {"configuration": "default", "dsoType": "item", "f.entityType": f"{entity},equals", "f.dateIssued": dates, "page": number, "size": size, "sort": "dc.date.issued,DESC"}
    return harvest.with_query(SEARCH, **q)


def record_items(folder, entity, items, size, dates=None, only=None):
    pages = [items[i : i + size] for i in range(0, len(items), size)] or [[]]
    for n, objects in enumerate(pages):
        if only is None or n in only:
            record_page(folder, search_url(entity, n, size, dates), answer(objects, len(pages)))


def raw(spark, folder, **more):
    harvest.register(spark)
    options = {"url": SEARCH, "id": "rep", "label": "Rep", "configuration": "default", "entities": "Article,Book", "transport": "files", "folder": str(folder)}
    return spark.read.format("repository_search").options(**options | {k: str(v) for k, v in more.items()}).load()


def test_pages_are_dealt_to_partitions(spark, tmp_path):
    record_items(tmp_path, "Article", [item(f"a{i}") for i in range(13)], 2)
    record_items(tmp_path, "Book", [item(f"b{i}", "Book") for i in range(3)], 2)
    record_items(tmp_path, "Empty", [], 2)
    one, many = (raw(spark, tmp_path, pagesize=2, pagesperpartition=n, entities="Article,Empty,Book") for n in (100, 2))
    assert (one.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (3, 6)
    rows = [sorted(map(tuple, x.collect())) for x in (one, many)]
    assert rows[0] == rows[1] and len(rows[0]) == 16
    ordinals = [r["_ord"] for r in many.orderBy("_ord").collect()]
    assert ordinals == [*range(13), *(2 * harvest.CHAIN_SPAN + i for i in range(3))]
    assert [r["source_record_id"] for r in normalize.items(many).orderBy("_ord").collect()] == [f"a{i}" for i in range(13)] + [f"b{i}" for i in range(3)]


def test_last_partition_reads_what_came_since(spark, tmp_path):
    for n in range(5):  # the first page told of three pages, then two more came
        record_page(tmp_path, search_url("Article", n, 1), answer([item(f"a{n}")], 3 if n == 0 else 5))
    assert raw(spark, tmp_path, pagesize=1, pagesperpartition=2, entities="Article").count() == 5


def test_paging_stops_at_the_limit(spark, tmp_path):
    articles = [item(f"a{i}", kind="journal article" if i % 2 else "unknown kind") for i in range(12)]
    articles[3]["_embedded"]["indexableObject"]["uuid"] = " "  # no id, no record
    chapters = [item(f"b{i}", "Book", kind="book chapter" if i in (1, 4) else "monograph") for i in range(8)]
    record_items(tmp_path, "Article", articles, 2, only={0, 1})  # a further page is not there to read
    record_items(tmp_path, "Book", chapters, 2, only={0, 1, 2})
    ids = lambda df: [r["source_record_id"] for r in normalize.items(df).orderBy("_ord").collect()]
    assert ids(raw(spark, tmp_path, pagesize=2, rowlimit=3, entities="Article")) == ["a0", "a1", "a2"]
    found = raw(spark, tmp_path, pagesize=2, rowlimit=2, types="book-chapter", entities="Book")
    assert found.rdd.getNumPartitions() == 1
    assert [r["source_record_id"] for r in fetch.of_types(normalize.items(found), ("book-chapter",)).orderBy("_ord").collect()] == ["b1", "b4"]


def test_types_are_those_of_normalisation(spark):
    kinds = [*DSPACE_TYPES, "Journal <i>Article</i>", "journal-article ", "other thing", "", " &amp; ", "MONOGRAPHY chapter"]
    entities = ["Article", "Book", "ARTISTIC", "Some Thing", "", None]
    shapes = [lambda v: [{"value": v}], lambda v: {"value": v}, lambda v: [v], lambda v: v, lambda v: [{"value": None}, {"value": ""}, {"value": v}]]
    objects = [{"uuid": "u", "entityType": e, "metadata": {"dc.type": shape(k)}} for k in kinds for e in entities for shape in shapes] + [{"uuid": "u"}, {"uuid": "u", "metadata": "text"}]
    rows = [("s", "S", json.dumps({"_embedded": {"indexableObject": o}}), i) for i, o in enumerate(objects)]
    made = normalize.items(spark.createDataFrame(rows, "source string, label string, payload string, _ord long")).orderBy("_ord").collect()
    assert [r["type"] for r in made] == [harvest.item_type(o) for o in objects]


def test_filters_reach_the_request(spark, tmp_path):
    dated = [item(f"b{y}{m}", "Book", f"{y}-{m:02d}-15") for y in (2022, 2023, 2024) for m in (1, 7)]
    (tmp_path / "all").mkdir()
    (tmp_path / "narrow").mkdir()
    record_items(tmp_path / "all", "Article", [item("a")], 100)
    record_items(tmp_path / "all", "Book", dated, 100)
    loose = [*dated[2:], item("undated", "Book", "")]  # the service may give more than was asked for
    record_items(tmp_path / "narrow", "Book", loose, 100, "[2023-01-01 TO 2024-06-30],equals")
    where = (F.col("entity") == "Book") & (F.col("issued") >= "2023-01-01") & (F.col("issued") <= "2024-06-30")
    pushed = raw(spark, tmp_path / "narrow").where(where)
    whole = raw(spark, tmp_path / "all")
    unpushed = spark.createDataFrame(whole.collect(), whole.schema).where(where)
    assert sorted(map(tuple, pushed.drop("_ord").collect())) == sorted(map(tuple, unpushed.drop("_ord").collect())) and pushed.count() == 3
    (tmp_path / "other").mkdir()
    record_items(tmp_path / "other", "Article", [item("a")], 100)  # nothing else is asked for
    assert raw(spark, tmp_path / "other").where("entity in ('Article', 'None')").count() == 1
    assert raw(spark, tmp_path / "other").where("entity = 'Article' and entity = 'Book'").count() == 0
    odd = raw(spark, tmp_path / "all").where("issued >= '2023' and length(issued) > 4 and issued is not null")  # not a date that services take
    assert odd.count() == 4


def test_filters_of_the_works_request(spark, tmp_path):
    ask = lambda f: harvest.with_query(fetch.WORKS_URL, filter=f, select=",".join(harvest.WORK_FIELDS), cursor="*", **{"per-page": 200})
    works = [WORK | {"id": f"https://api.org/W{i}", "type": t, "publication_date": d} for i, (t, d) in enumerate([("article", "2024-05-01"), ("book", "2024-05-01"), ("article", "2020-01-01")])]
    record_page(tmp_path, ask("institutions.id:I1,from_publication_date:2024-01-01,type:article|report"), json.dumps({"results": works}))
    record_page(tmp_path, ask("institutions.id:I2,type:book"), json.dumps({"results": works[1:2]}))
    harvest.register(spark)
    load = lambda f: spark.read.format("works_api").options(url=fetch.WORKS_URL, filters=f, transport="files", folder=str(tmp_path)).load()
    assert [r["issued"] for r in load("institutions.id:I1").where("type in ('report', 'article') and issued >= '2024-01-01'").collect()] == ["2024-05-01"]
    assert load("institutions.id:I2,type:book").where("type = 'article'").count() == 0  # the filter names its types itself


def oai_source(folder, ident, body):
    base = f"https://{ident}.org/oai"
    record_page(folder, f"{base}?verb=ListRecords&metadataPrefix=oai_dc", body)
    return {"id": ident, "label": ident.upper(), "base_url": base}


def test_failures_are_told_and_left_out(spark, tmp_path):
    record_items(tmp_path, "Article", [item(f"a{i}") for i in range(5)], 100, "[* TO 2030-01-01],equals")
    record_page(tmp_path, search_url("Book", 0, 100, "[* TO 2030-01-01],equals"), "HTTP 503")
    good = oai_source(tmp_path, "good", page(RECORD))
    late = oai_source(tmp_path, "late", page(RECORD.replace("oai:x:1", "oai:x:9"), "t1"))
    record_page(tmp_path, "https://late.org/oai?verb=ListRecords&resumptionToken=t1", "HTTP 429")
    dspace = config.parse_sources("dspace", [{"id": "rep", "label": "Rep", "base_url": API, "entity_types": ["Article", "Book"]}])
    chosen = config.Selection(works_api=False, to_date="2030-01-01", sources=(*dspace, *config.parse_sources("oai", [good, late])), options={"transport": "files", "folder": str(tmp_path)})
    found = fetch.harvested(spark, chosen)
    assert found.failures == ("Rep (HTTP 503)", "LATE (HTTP 429)") and found.asked == ("Rep", "GOOD", "LATE")
    assert {r["source"] for r in found.records.collect()} == {"good"}
    rows, stats = fetch.run(spark, chosen)
    assert rows.count() == 1
    assert stats.first().asDict() == {"sources_queried": ["Rep", "GOOD", "LATE"], "source_failures": ["Rep (HTTP 503)", "LATE (HTTP 429)"], "total_source_records": 1, "duplicates_removed": 0, "total_expected": 1}
    record_page(tmp_path, search_url("Book", 0, 100, "[* TO 2030-01-01],equals"), "HTTP 404")
    with pytest.raises(Exception, match="404"):
        fetch.harvested(spark, chosen)
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="No such file"):
        fetch.harvested(spark, config.Selection(works_api=False, sources=chosen.sources, options={"transport": "files", "folder": str(tmp_path / "none")}))


def test_statistics_of_a_run(spark, tmp_path):
    same = [oai_source(tmp_path, n, page(RECORD + RECORD.replace("oai:x:1", "oai:x:2").replace("10.5555/AB", f"10.5555/{n}"))) for n in ("one", "two")]
    chosen = config.Selection(works_api=False, sources=tuple(config.parse_sources("oai", same)), limit=2, options={"transport": "files", "folder": str(tmp_path)})
    rows, stats = fetch.run(spark, chosen)
    assert rows.count() == 2
    assert stats.first()[2:] == (4, 1, 2)
    none = fetch.run(spark, config.Selection(works_api=False))
    assert none[0].count() == 0 and none[1].first()[:] == ([], [], 0, 0, 0)


def test_links_lead_to_the_repository_itself(spark, tmp_path):
    record_items(tmp_path, "Article", [item("a", handle="20.500/1"), item("b", handle="20.500/2", metadata={"dc.identifier.uri": ["https://hdl.org/2"]})], 100)
    for base in (API, API + "/", "https://rep.org"):
        assert config.Source("dspace", "rep", "Rep", base, ()).home == "https://rep.org"
    sources = tuple(config.parse_sources("dspace", [{"id": "rep", "base_url": API, "entity_types": ["Article"]}]))
    got = fetch.source_records(spark, config.Selection(works_api=False, sources=sources, options={"transport": "files", "folder": str(tmp_path)})).orderBy("_ord").collect()
    assert [r["record_url"] for r in got] == ["https://rep.org/handle/20.500/1", "https://hdl.org/2"]


class _Server(BaseHTTPRequestHandler):
    def do_GET(self):
        asked = parse_qs(urlsplit(self.path).query)
        self.server.asked.append(asked)
        number, entity = int(asked["page"][0]), asked["f.entityType"][0].split(",")[0]
        busy = entity == "Down" or (entity == "Shaky" and self.server.asked.count(asked) == 1)
        body = b"" if busy else answer([item(f"{entity}{number}", entity)], 3).encode()
        self.send_response(503 if busy else 200)
        if busy:
            self.send_header("Retry-After", "0")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_over_http(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    server.asked = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/search"
        harvest.register(spark)
        load = lambda **o: spark.read.format("repository_search").options(url=url, id="r", label="R", pagesperpartition="1", **o).load()
        assert load(entities="Shaky").count() == 3  # each first answer was busy
        told = load(entities="Down,Fine", isolate="true").collect()
        assert sorted(r["failure"] or r["entity"] for r in told) == ["Fine", "Fine", "Fine", "HTTP 503"]
        with pytest.raises(Exception, match="503"):
            load(entities="Down").count()
        assert all(a["dsoType"] == ["item"] for a in server.asked)
    finally:
        server.shutdown()
        server.server_close()
    closed = harvest._Items({"url": url, "entities": "Fine", "isolate": "true"})
    harvest_sleep, harvest.time.sleep = harvest.time.sleep, lambda s: None
    try:
        with pytest.raises(urllib.error.URLError) as e:
            closed.partitions()
        assert not isinstance(e.value, urllib.error.HTTPError) and re.search("refused", str(e.value), re.I)
    finally:
        harvest.time.sleep = harvest_sleep


def test_records_are_parsed_as_they_are(spark):
    header = '<header{}><identifier> oai:x:{} </identifier><identifier>second</identifier><setSpec>open_access</setSpec><setSpec> </setSpec></header>'
    odd = [
        ("1", "", '<oai_dc:dc xmlns:dc="u"><dc:title>A <b>bold</b> &amp;amp; <![CDATA[<i>plain</i>]]></dc:title><dc:description xml:lang="EN">short</dc:description><dc:description>much longer text</dc:description><dc:Creator>B, C</dc:Creator><dc:creator/></oai_dc:dc>'),
        ("2", "", "<other:first><title>of the first container</title></other:first><more><title>no</title></more>"),
        ("3", "", "<x><title>no</title></x><dc><title>of dc</title><nested><title>deeper</title></nested></dc>"),
        ("4", ' status="deleted"', "<dc><title>gone</title></dc>"),
        ("5", "", ""),
    ]
    rows = [("s", "S", f"<record>{header.format(status, i)}<metadata>{dc}</metadata><about><identifier>9</identifier></about></record>", int(i)) for i, status, dc in odd]
    rows += [("s", "S", "<record><header><identifier> </identifier></header></record>", 6), ("s", "S", None, 7), ("s", "S", "<!doctype x><record/>", 8)]
    raw_ = spark.createDataFrame(rows, "source string, label string, payload string, _ord long")
    got = {r["_ord"]: r for r in normalize.oai(raw_).collect()}
    assert {i: r["title"] for i, r in got.items()} == {1: "A bold & plain", 2: "of the first container", 3: "of dc", 5: ""}
    assert (got[1]["abstract"], got[1]["authors"], got[1]["source_record_id"], got[1]["is_oa"]) == ("short", "B, C", "oai:x:1", True)
    with pytest.raises(Exception, match="not XML"):
        normalize.oai(spark.createDataFrame([("s", "S", "<record><open></record>", 1)], raw_.schema)).collect()
