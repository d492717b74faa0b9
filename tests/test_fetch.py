"""Settings, enrichment, fetching, the stream, network geometry and XLSX on small literal inputs."""

import difflib
import json
import math
import os
import random
import urllib.error
import zipfile
import zlib
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pytest
from biblion.functions import network, records, text
from biblion.operators import analytics, cache, enrich, merge
from biblion.plans import fetch
from biblion.sources import config, export, harvest, normalize
from biblion.streaming import upsert
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_publications import RECORD, WORK, record_page

CONTACT = "tool (mailto:a@uni.edu)"


def test_sources_and_settings(tmp_path):
    raw = [{"id": "A1", "base_url": "https://r.org/api/"}, {"id": "a1", "base_url": "https://other.org"}, {"id": "b", "base_url": "ftp://x"}, {"id": "c d", "base_url": "https://x.org"}, {"id": "e", "base_url": "https://x.org", "enabled": False}, 7]
    (s,) = config.parse_sources("dspace", raw)
    assert (s.id, s.base_url, s.types, s.configuration) == ("a1", "https://r.org/api", ("Article", "Book", "Artistic"), "default")
    (o,) = config.parse_sources("oai", {"id": "o", "base_url": "https://o.org", "publication_types": ["Book Chapter", "book-chapter"], "ror_id": "https://ror.org/bad", "openalex_institution_id": "I12"})
    assert o.types == ("book-chapter",) and o.ror_id is None and o.openalex_institution_id == "I12"
    (tmp_path / "s.toml").write_text('[[sources]]\nid="a"\nbase_url="https://a.org"\n[[sources]]\nid="b"\nbase_url="https://b.org"\n')
    both = config.registry("oai", str(tmp_path / "s.toml"), "sources", [{"id": "a", "base_url": "https://new.org"}])
    assert [(x.id, x.base_url) for x in both] == [("a", "https://new.org"), ("b", "https://b.org")]
    settings = {"x": {"k": " v "}, "on": "Yes", "none": "None"}
    assert (config.setting(settings, "x.k"), config.flag(settings, "on"), config.setting(settings, "none"), config.flag(settings, "gone")) == ("v", True, None, None)
    assert config.has_contact(CONTACT) and not config.has_contact("mailto:a@example.com") and not config.has_contact("x")


def test_selection_and_filters():
    assert config.works_filter(["https://openalex.org/I1", "I1", "https://ror.org/012345678"], ["article", "article"], "2024-01-01") == "institutions.id:I1,is_paratext:false,from_publication_date:2024-01-01,type:article"
    with pytest.raises(ValueError):
        config.works_filter(["x"])
    chosen = config.Selection(institutions=("I1", "https://ror.org/012345678"), types=("article", "preprint"), user_agent=CONTACT)
    assert config.works_filters(chosen) == ["institutions.id:I1,is_paratext:false,type:article", "institutions.ror:https://ror.org/012345678,is_paratext:false,type:article"]
    assert config.works_filters(config.Selection(institutions=("I1",), types=("preprint",))) == []
    assert chosen.errors() == [] and len(config.Selection(model="m").errors()) == 2
    assert chosen.identity()["sources"] == ["openalex"] and "user_agent" not in chosen.identity()
    (s,) = config.parse_sources("dspace", [{"id": "d", "base_url": "https://d.org"}])
    assert config.entity_types(s, ["book", "book-chapter"]) == ["Book"] and config.entity_types(s, []) == ["Article", "Book", "Artistic"]


def test_json_lists():
    a, b = '[{"id":"1","v":1},{"v":2},"x"]', '[{"id":"1","v":3},{"v":4}]'
    assert records.last_per_key([a, b, None, "{"], lambda x: x.get("id", "")) == [{"id": "1", "v": 3}, {"v": 2}, {"v": 4}]
    assert records.first_per_key([a, b], lambda x: x.get("id", "")) == [{"id": "1", "v": 1}]
    assert records.affiliation_key({"name": "Uniwersytet  ŁÓDZKI É"}) == "uniwersytet odzki e"


def pubs(spark):
    cols = "publication_key string, source string, source_record_keys string, title string, authors string, doi string, publication_date string, abstract string"
    return spark.createDataFrame([
        ("a", "openalex", "k1", "First title", "X", "https://doi.org/10.1234/a", "2024", ""),
        ("b", "d", "k2", "Second title here", "Y", "", "2023-02", ""),
        ("c", "d", "k3", "Third", "Z", "", "2023", "<b>own</b> words"),
        ("d", "d", "k4", "Fourth", "Z", "", "2023", "kept"),
        ("e", "d", "k5", "Only a title", "Z", "", "", None),
    ], cols)


def test_enrich_end_to_end(spark):
    def get(url, headers=None):
        if "10.1234/a" in url:
            return json.dumps({"abstract": "found &amp; good"})
        if "Second" in url:
            return json.dumps({"organic_results": [{"title": "Second title here", "snippet": "wrong year", "year": "1999"}, {"title": "Other", "snippet": "no"}, {"title": "Second title  Here!", "snippet": "right", "publication_info": {"summary": "Y - 2023"}}]})
        raise urllib.error.HTTPError(url, 500, "x", None, None)

    def post(url, headers, body, before):
        before()
        return json.dumps({"predictions": [{"prediction": 0.5, "sdg": {"code": "4", "name": "Education"}}]}) if "Only" not in body else "{}"

    cached = spark.createDataFrame([("d", "kept", "k4")], "publication_key string, abstract string, source_record_keys string")
    from hashlib import sha256

    stored = spark.createDataFrame([("d", "m", '{"predictions":[]}', "old text", "", sha256(b"kept").hexdigest()), ("c", "other", "{}", "", "", "")], "publication_key string, model string, sdg_response string, sdg_formatted string, sdg_note string, text_hash string")
    out = enrich.enrich(pubs(spark), cached, stored, "m", enrich.classifier_client(post, "https://c.org", "m", spaced=lambda: enrich.Spaced(0)), enrich.abstract_client(get), enrich.search_client(get, "key"))
    got = {r["publication_key"]: r for r in out.rows.collect()}
    assert {k: r["abstract"] for k, r in got.items()} == {"a": "found & good", "b": "right", "c": "own words", "d": "kept", "e": ""}
    assert got["a"]["sdg_formatted"] == "50% SDG 4 (Education)" and got["d"]["sdg_formatted"] == "old text" and got["e"]["sdg_note"] == "empty json"
    assert out.stats.first().asDict() == {"rows": 5, "source_abstract_missing": 3, "openalex_abstract_missing": 1, "ss_abstract_retrieved": 1, "gs_abstract_retrieved": 1, "total_abstracts_available": 4}
    assert {r["publication_key"] for r in out.results.collect()} == {"a", "b", "c"} and {r["publication_key"] for r in out.works.collect()} == {"a", "b", "c", "e"}
    none = enrich.enrich(pubs(spark), cached, stored, "skip")
    assert {r["sdg_note"] for r in none.rows.collect()} == {"skipped: user selected 'skip'"} and none.results.count() == 0
    titles = enrich.enrich(pubs(spark), cached, stored, "m", lambda: lambda t: ('{"predictions":[]}', ""))
    assert {r["sdg_note"] for r in titles.rows.where("abstract = ''").collect()} == {"low_confidence:title_only_no_abstract"}


def test_clients_stop_and_pace():
    calls = []

    def get(url, headers=None):
        calls.append(url)
        raise urllib.error.HTTPError(url, 403, "x", None, None)

    ask = enrich.abstract_client(get)()
    assert ask({"doi": "10.1/a"}) is None and ask({"doi": "10.1/b"}) is None and len(calls) == 1
    now, slept = [0.0], []
    pace = enrich.Spaced(0.1, 2, lambda: now[0], slept.append)
    pace.wait()
    pace.wait()
    assert slept == [0.2]
    ask = enrich.classifier_client(lambda *a: "{}", None, "m")()
    assert ask("") == (None, "no text") and ask("x")[1].startswith("configuration_error")


def page(records_, token=""):
    return f"<OAI-PMH><ListRecords>{records_}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"


def test_fetch_merges_sources_in_order(spark, tmp_path):
    works = harvest.with_query(fetch.WORKS_URL, filter="institutions.id:I1,is_paratext:false,from_publication_date:2020-01-01,to_publication_date:2025-01-01", select=",".join(harvest.WORK_FIELDS), cursor="*", **{"per-page": 200})
    record_page(tmp_path, works, json.dumps({"results": [WORK | {"doi": "https://doi.org/10.5555/AB"}], "meta": {}}))
    oai = "https://o.org/oai"
    record_page(tmp_path, f"{oai}?verb=ListRecords&metadataPrefix=oai_dc", page(RECORD + RECORD.replace("oai:x:1", "oai:x:3").replace("10.5555/AB", "10.5555/CD").replace("2023-05", "2019")))
    sources = tuple(config.parse_sources("oai", [{"id": "o", "base_url": oai}]))
    chosen = config.Selection(("I1",), from_date="2020-01-01", to_date="2025-01-01", limit=5, sources=sources, user_agent=CONTACT, options={"transport": "files", "folder": str(tmp_path)})
    (r,) = fetch.publications(spark, chosen).collect()
    assert (r["publication_key"], r["source"], r["source_count"], r["source_label"], r["type"]) == ("doi:10.5555/ab", "openalex; o", 2, "OpenAlex", "book-chapter")
    assert [x["source"] for x in json.loads(r["source_provenance_json"])] == ["openalex", "o"] and json.loads(r["institution_affiliations_json"])[0]["country"] == "PL"
    with pytest.raises(ValueError):
        fetch.publications(spark, config.Selection(("I1",)))
    assert fetch.source_records(spark, config.Selection(works_api=False)).count() == 0


def test_lookups():
    assert fetch.lineage("https://openalex.org/I1", lambda url: '{"lineage": ["https://openalex.org/I1", "https://openalex.org/I9"]}') == ["I1", "I9"]
    assert fetch.lineage("I1", lambda url: "{") == [] and fetch.search_institutions("x", lambda url: '{"results": [{"id": "I1"}]}') == [{"id": "I1"}]
    assert fetch.with_lineage(["I1"], lambda url: '{"lineage": ["I1", "I9"]}') == ["I1", "I9"]


def test_stream_into_snapshots(spark, tmp_path):
    oai = "https://o.org/oai"
    folder, store = tmp_path / "pages", cache.Snapshots(spark, str(tmp_path / "s"))
    folder.mkdir()
    record_page(folder, f"{oai}?verb=ListRecords&metadataPrefix=oai_dc&from=2024-01-01&until=2024-01-02", page(RECORD))
    record_page(folder, f"{oai}?verb=ListRecords&metadataPrefix=oai_dc&from=2024-01-03&until=2024-01-03", page(RECORD.replace("10.5555/AB", "10.5555/CD")))
    options = {"url": oai, "id": "o", "label": "O", "transport": "files", "folder": str(folder), "start": "2024-01-01"}
    for day, version in (("2024-01-03", 1), ("2024-01-04", 2)):
        upsert.harvest_stream(spark, options | {"today": day}, store, str(tmp_path / "c"), once=True).awaitTermination()
        assert store.version() == version
    assert {r["publication_key"]: r["source_record_keys"] for r in store.read("works").collect()}["doi:10.5555/cd"] == "oai:o:oai:x:1"
    assert [r["publication_key"] for r in store.read("records").collect()] == ["doi:10.5555/cd"]


def test_stream_resumes_in_mid_harvest(spark, tmp_path):
    """A harvest of five pages that breaks on page 3 goes on there; a token that has expired by then does not matter."""
    oai, folder = "https://o.org/oai", tmp_path / "pages"
    folder.mkdir()
    store = cache.Snapshots(spark, str(tmp_path / "s"))
    options = {"url": oai, "id": "o", "transport": "files", "folder": str(folder), "start": "2024-01-01", "today": "2024-01-03", "pagesperbatch": "1"}
    first = f"{oai}?verb=ListRecords&metadataPrefix=oai_dc&from=2024-01-01&until=2024-01-02"
    asked = lambda n: first if n == 1 else f"{oai}?verb=ListRecords&resumptionToken=t%26{n}"
    following = lambda n: f"<resumptionToken>{'t&amp;' + str(n + 1) if n < 5 else ''}</resumptionToken>"
    body = lambda n: f"<OAI-PMH><ListRecords>{RECORD.replace('oai:x:1', f'oai:x:{n}').replace('10.5555/AB', f'10.5555/{n}')}{following(n)}</ListRecords></OAI-PMH>"
    for n in (1, 2, 4, 5):
        record_page(folder, asked(n), body(n))
    record_page(folder, asked(3), "HTTP 503")
    with pytest.raises(StreamingQueryException):
        upsert.harvest_stream(spark, options, store, str(tmp_path / "c"), once=True)
    keys = lambda: sorted(r["source_record_id"] for r in store.read("records").collect())
    assert keys() == ["oai:x:1", "oai:x:2"]
    record_page(folder, asked(3), body(3))
    record_page(folder, first, "HTTP 503")  # nothing of the first pages is asked again
    record_page(folder, asked(2), "HTTP 503")
    upsert.harvest_stream(spark, options, store, str(tmp_path / "c"), once=True)
    assert keys() == [f"oai:x:{n}" for n in range(1, 6)]
    # offsets by themselves: rows once, expiry, replay of a batch, circles
    for n in (1, 2):
        record_page(folder, asked(n), body(n))
    reader = harvest._OaiStream(options | {"pagesperbatch": "2"})
    rows, at = reader.read(reader.initialOffset())
    assert [r[4] for r in rows] == [0, 1] and (at["page"], at["token"], at["until"]) == (2, "t&3", "2024-01-03")
    record_page(folder, asked(3), '<OAI-PMH><error code="badResumptionToken">gone</error></OAI-PMH>')
    record_page(folder, asked(2), body(2).replace("t&amp;3", "u"))
    record_page(folder, f"{oai}?verb=ListRecords&resumptionToken=u", body(3))
    rows, then = reader.read(at)
    assert [r[4] for r in rows] == [2, 3] and then["page"] == 4
    assert [r[4] for r in reader.readBetweenOffsets(at, then)] == [2, 3]
    rows, end = reader.read(then)
    assert [r[4] for r in rows] == [4] and end == {"day": "2024-01-03"} and reader.read(end)[1] == end
    record_page(folder, asked(4), body(2).replace("t&amp;3", "t&amp;2"))
    record_page(folder, asked(2), body(2).replace("t&amp;3", "t&amp;4"))
    with pytest.raises(ValueError, match="repeats"):
        harvest._OaiStream(options | {"pagesperbatch": "99"}).read(reader.initialOffset())


def test_cache_keeps_json_lists(spark):
    a = merge.merge_publications(normalize.works(spark.createDataFrame([("s", "S", json.dumps(WORK), 0)], "source string, label string, payload string, _ord long")))
    b = merge.merge_publications(normalize.works(spark.createDataFrame([("t", "T", json.dumps(WORK | {"id": "https://api.org/W2"}), 0)], "source string, label string, payload string, _ord long")))
    r = cache.merge_canonical(a, b).first()
    assert len(json.loads(r["source_provenance_json"])) == 2 and len(json.loads(r["institution_affiliations_json"])) == 1 and r["source"] == "s; t"


def test_network(spark):
    e = spark.createDataFrame([("a", "b", 8), ("b", "c", 1), ("c", "d", 1)], "a string, b string, w long")
    top = analytics.top_nodes(e, 2, "C", ["a"])
    assert {r["label"] for r in top.collect()} == {"a", "c"} and analytics.between(e, analytics.top_nodes(e, 2)).count() == 1
    assert e.select(network.edge_width(F.col("w")), network.edge_alpha(F.col("w"))).first()[:] == (10.0, 0.96)
    weights = {("a", "b"): 8, ("b", "c"): 1, ("c", "d"): 1}
    places = network.spring_layout("abcd", weights, ["a"])
    assert places == network.spring_layout("dcba", weights, ["a"]) and places["a"] == (0, 0, 0) and network.spring_layout([], {}) == {}
    assert network.spring_layout(["a"], {}) == {"a": (0, 0, 0)}
    start = network.spring_layout("abcd", weights, rounds=0)  # first numbers of seed 42, moved to the middle and scaled
    drawn = np.array([0.3745401188, 0.9507143064, 0.7319939418, 0.5986584842, 0.1560186404, 0.1559945203, 0.0580836122, 0.8661761458, 0.6011150117, 0.7080725778, 0.0205844943, 0.9699098522]).reshape(4, 3)
    drawn -= drawn.mean(0)
    assert np.abs(np.array([start[v] for v in "abcd"]) - drawn / np.abs(drawn).max()).max() < 1e-8
    radii = network.node_radii(places, {"a": 8, "b": 9, "c": 2, "d": 1}, list(weights))
    assert all(0 < r <= 0.105 for r in radii.values())
    assert network.clipped((0, 0, 0), (1, 0, 0), 0.5, 0.1) == ((0.35, 0, 0), (0.9, 0, 0)) and network.clipped((1, 1, 1), (1, 1, 1), 1, 1) == ((1, 1, 1), (1, 1, 1))
    points, faces = network.sphere((0, 0, 0), 2.0)
    assert points.shape == (17 * 32, 3) and faces.shape == (16 * 32 * 2, 3) and abs((points**2).sum(1) - 4).max() < 1e-9
    rows = spark.createDataFrame([(["x", "y"],), (["x", "x"],), ([],)], "ids array<string>")
    assert analytics.coverage(rows, "ids").first()[:] == (1, 3)


def plain_layout(names, weights, rounds=50):
    """The layout step by step, with Python floats."""
    n, draw = len(names), np.random.RandomState(42)
    at = [[draw.random_sample() for _ in range(3)] for _ in names]
    k = n ** -0.5
    t = 0.1 * max(max(p[d] for p in at) - min(p[d] for p in at) for d in (0, 1))
    cool = t / (rounds + 1)
    for _ in range(rounds):
        steps = []
        for i in range(n):
            force = [0.0] * 3
            for j in range(n):
                gap = [at[i][d] - at[j][d] for d in range(3)]
                far = max(math.hypot(*gap), 0.01)
                w = weights.get((names[i], names[j]), weights.get((names[j], names[i]), 0))
                force = [f + g * (k * k / far**2 - w * far / k) for f, g in zip(force, gap, strict=True)]
            steps.append([f * t / max(math.hypot(*force), 0.01) for f in force])
        at = [[p + s for p, s in zip(a, b, strict=True)] for a, b in zip(at, steps, strict=True)]
        t -= cool
        if math.sqrt(sum(s * s for step in steps for s in step)) / n < 1e-4:
            break
    mean = [sum(p[d] for p in at) / n for d in range(3)]
    at = [[p[d] - mean[d] for d in range(3)] for p in at]
    size = max(abs(c) for p in at for c in p)
    return {v: [c / size for c in p] for v, p in zip(names, at, strict=True)}


def test_layout_by_plain_steps():
    names = [f"n{i:02}" for i in range(12)]
    weights = {(names[i], names[j]): 1 + (i * j) % 5 for i in range(12) for j in range(i + 1, 12) if (i + j) % 3 == 0}
    got, expected = network.spring_layout(names[::-1], weights), plain_layout(names, weights)
    assert all(abs(g - e) < 1e-6 for v in names for g, e in zip(got[v], expected[v], strict=True))


def test_similarity_bound(spark):
    """The bound never says less than the matcher, and the matcher runs only above it."""
    draw = random.Random(5)
    words = ["", None, "a", "\U0001d538bc", "a.*\\\n(b", "łódź"] + ["".join(draw.choice("abcdeł\U0001d538") for _ in range(draw.randrange(1, 40))) for _ in range(30)]
    pairs = [(x, y) for x in words for y in words] + [(w, w[:-1] + "q") for w in words if w and len(w) > 10] + [("ab" * 150, "ab" * 149 + "ba")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    got = {r["i"]: r for r in text.with_similar(rows.withColumn("bound", text.ratio_bound(F.col("x"), F.col("y"))), "alike", F.col("x"), F.col("y")).collect()}
    for i, (x, y) in enumerate(pairs):
        ratio = difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        assert got[i]["alike"] == bool(x and y and (x == y or ratio >= 0.9)) and (not (x and y) or got[i]["bound"] >= ratio), (x, y)
    assert got[0].asDict().keys() == {"i", "x", "y", "bound", "alike"}


def test_sheet_by_tasks(spark, tmp_path):
    """Rows of many partitions in their order, a long text in further columns; what fails leaves nothing."""
    rows = spark.range(0, 5000, 1, 7).select(F.col("id").cast("string").alias("title"), F.when(F.col("id") == 4321, F.repeat(F.lit("é&"), 20_000)).alias("abstract"))
    at = str(tmp_path / "t.xlsx")
    assert export.write_xlsx(rows, at, ["title", "abstract"]) == 5000 and os.listdir(tmp_path) == ["t.xlsx"]
    with zipfile.ZipFile(at) as z:
        assert z.testzip() is None
        tree = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    cells = [["".join(t.text or "" for t in c.iter(f"{space}t")) for c in r] for r in tree.iter(f"{space}row")]
    assert cells[0] == ["title", "abstract", "abstract 2"] and [c[0] for c in cells[1:]] == [str(i) for i in range(5000)]
    assert "".join(cells[4322][1:]) == "é&" * 20_000
    # an empty table is a sheet of its header; a second run replaces the sheet
    assert export.write_xlsx(rows.where("false"), at, ["title"]) == 0
    with zipfile.ZipFile(at) as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 1
    broken = rows.withColumn("title", F.when(F.col("title") == "4000", F.raise_error(F.lit("broken"))).otherwise(F.col("title")))
    spark.dataSource.register(export.SheetSink)
    with pytest.raises(Exception, match="broken"):
        broken.write.format("sheet").mode("append").save(str(tmp_path / "b.xlsx"))
    assert os.listdir(tmp_path) == ["t.xlsx"]
    # a fragment of an attempt that does not count is not in the sheet, and too many rows are none
    writer = export.SheetWriter(str(tmp_path / "w.xlsx"), ["a"])
    for name, body in (("0-1", b"<row>no</row>"), ("0-2", b"<row>yes</row>")):
        Path(writer.parts, name).write_bytes(zlib.compress(body))
    writer.commit([export.Fragment(0, f"{writer.parts}/0-2", 1), None])
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert z.read("xl/worksheets/sheet1.xml").endswith(b"<row>yes</row></sheetData></worksheet>")
    with pytest.raises(ValueError, match="too many"):
        export.SheetWriter(str(tmp_path / "x.xlsx"), ["a"]).commit([export.Fragment(0, "", export.SHEET_ROWS)])
    assert sorted(os.listdir(tmp_path)) == ["t.xlsx", "w.xlsx"]


def test_xlsx_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([("k", "=1+1 <b>\x01", "line\nbreak")], "publication_key string, title string, abstract string")
    assert export.write_xlsx(rows, str(tmp_path / "t.xlsx"), ["title"]) == 1
    with zipfile.ZipFile(tmp_path / "t.xlsx") as z:
        body = z.read("xl/worksheets/sheet1.xml").decode()
    assert "=1+1 &lt;b&gt;<" in body and "<f>" not in body and body.count("<row>") == 2
    export.write_csv(rows, str(tmp_path / "c"), files=1)
    back = export.read_csv(spark, str(tmp_path / "c")).first()
    assert back["abstract"] == "line\nbreak" and back["sdg_note"] == "" and back["title"] == "=1+1 <b>\x01"
