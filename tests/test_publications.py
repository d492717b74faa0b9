"""Normalisation, merge, snapshots and sources on small literal inputs."""

import hashlib
import json

import pytest
from biblion.functions import access, dates, goals, text
from biblion.operators import cache, classify, merge
from biblion.sources import export, harvest, normalize
from pyspark.sql import functions as F

RAW = "source string, label string, payload string, _ord long"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_text_functions(spark):
    r = one(spark, text.doi(F.lit("https://doi.org/10.1234/AbC.5.,")), text.first_doi(F.array(F.lit("x"), F.lit("DOI: 10.1000/Q"))), text.without_orcid(F.lit("Doe, Jo; https://orcid.org/0000-0001-2345-678X")), text.slug(F.lit("  A & b! ")), text.merged(F.lit("b; a"), F.lit("a; c;")), text.abbreviated(F.lit("A B; C D")))
    assert list(r) == ["10.1234/abc.5", "10.1000/q", "Doe, Jo", "a-b", "b; a; c", "A B et al."]
    r = one(spark, text.match_key(F.lit("Éa  — ß!")), text.compact_key(F.lit("Żó łć")), text.similar(F.lit("abcdefghij"), F.lit("abcdefghix")), text.clean_html(F.lit("a &amp; <b>b</b>")), text.too_short(F.lit("a b"), 3), text.institution_id(F.lit(" https://openalex.org/I12")))
    assert list(r) == ["ea", "zołc", True, "a & b", True, "I12"]


def test_dates(spark):
    r = one(spark, *[f(F.lit(x)).cast("string") for x in ("2024", "2024-02", "2024-02-05", "0000", "x", "2024-13") for f in (dates.lower_bound, dates.upper_bound)], dates.year_anywhere(F.lit("no 12024 but 1999")))
    assert list(r) == ["2024-01-01", "2024-12-31", "2024-02-01", "2024-02-29", "2024-02-05", "2024-02-05", *[None] * 6, "1999"]


def test_access_and_goals(spark):
    r = one(spark, access.reconciled(F.lit(None).cast("boolean"), F.lit("Gold")), access.reconciled(F.lit(False), F.lit("gold")), access.flag_label(F.lit(" TRUE ")), access.item_rights(F.lit("openAccess, closed access")), access.oai_rights(F.lit("openAccess, restrictedAccess"), F.array(F.lit("x"))), access.oai_rights(F.lit(""), F.array(F.lit("open_access"))))
    assert tuple(r[0]) == (True, "gold") and tuple(r[1]) == (False, "closed") and list(r)[2:] == ["Open access", False, True, True]
    body = json.dumps({"predictions": [{"prediction": 0.845, "sdg": {"code": "4", "name": "Q (x)"}}, None, {"prediction": "bad", "sdg": {"code": "1"}}, {"prediction": 0.9, "sdg": {"code": "2", "name": ""}}]})
    r = one(spark, goals.ranked_text(F.lit(body)), goals.lines(F.lit("84% SDG 4 (Quality)\nnoise")), goals.ranked_text(F.lit("[]")))
    assert r[0].split("\n") == ["90% SDG 2", "84% SDG 4 (Q (x))"] and [tuple(x) for x in r[1]] == [(84.0, "4", "Quality")] and r[2] == ""


WORK = {"id": "https://api.org/W1", "display_name": "A <i>title</i>", "publication_date": "2024-01-02", "doi": "https://doi.org/10.1234/X", "type": "article", "language": "en", "open_access": {"is_oa": True, "oa_status": "gold"}, "abstract_inverted_index": {"b": [1], "a": [0, 2], "bad": "x", "c": [1]}, "authorships": [{"author": {"display_name": "Jo Doe"}, "institutions": [{"id": "I1", "display_name": "U", "country_code": "PL"}]}]}
RECORD = """<record><header><identifier>oai:x:1</identifier><setSpec>doc-type:bookPart</setSpec></header><metadata><dc><title xml:lang="de">Titel</title><creator>Doe, Jo; https://orcid.org/0000-0001-2345-6789</creator>
<description xml:lang="de">ein langer Text hier</description><description xml:lang="en">short text</description><date>2023-05</date><identifier>https://doi.org/10.5555/AB</identifier><identifier>https://r.org/frontdoor/1</identifier><rights>info:eu-repo/semantics/openAccess</rights></dc></metadata></record>"""


def test_normalize_works(spark):
    r = normalize.works(spark.createDataFrame([("api", "API", json.dumps(WORK), 0), ("api", "API", "{}", 1)], RAW)).collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["abstract"], r[0]["publication_key"], r[0]["is_oa"], r[0]["oa_status"]) == ("A <i>title</i>", "a b c a", "doi:10.1234/x", True, "gold")
    assert r[0]["source_record_key"] == "openalex:W1" and r[0]["authors"] == "Jo Doe" and r[0]["institution_countries"] == "PL"


def test_normalize_oai(spark):
    gone = RECORD.replace("<header>", '<header status="deleted">')
    r = normalize.oai(spark.createDataFrame([("o", "O", RECORD, 0), ("o", "O", gone, 1), ("o", "O", "<!DOCTYPE x>" + RECORD, 2)], RAW)).collect()
    assert len(r) == 1
    got = r[0].asDict()
    assert (got["doi"], got["record_url"], got["authors"], got["abstract"], got["type"], got["is_oa"], got["publication_key"]) == ("https://doi.org/10.5555/ab", "https://r.org/frontdoor/1", "Doe, Jo", "short text", "book-chapter", True, "doi:10.5555/ab")


def test_normalize_items(spark):
    meta = {"dc.abstract.pl": [{"value": "dlugi opis tekstu"}], "dc.abstract.en": [{"value": "an abstract"}], "dc.type": [{"value": "JournalArticle"}], "dc.rights": [{"value": "closed access"}], "dc.affiliation": [{"value": "Uni Łódź"}], "dc.identifier.uri": [{"value": "https://doi.org/10.7777/Z"}], "dc.contributor.author": [{"value": "A"}, {"value": "A"}, {"value": "B"}], "dc.date.issued": [{"value": "2022"}]}
    body = json.dumps({"_embedded": {"indexableObject": {"uuid": "u1", "name": "N", "metadata": meta}}})
    r = normalize.items(spark.createDataFrame([("d", "D", body, 0)], RAW)).first()
    assert (r["abstract"], r["type"], r["doi"], r["authors"], r["is_oa"], r["source_record_key"]) == ("an abstract", "article", "https://doi.org/10.7777/z", "A; A; B", False, "dspace:d:u1")
    assert r["institution_ids"] == "dspace-affiliation:d:" + hashlib.sha256(b"uni odz").hexdigest()[:16] and r["institutions"] == "Uni Łódź" and r["title"] == "N"


def test_merge_ignores_partitioning(spark):
    rows = normalize.works(spark.createDataFrame([("api", "API", json.dumps(WORK | {"id": f"https://api.org/W{i}", "doi": "10.1234/k", "display_name": "t" * (i % 5), "open_access": {"is_oa": bool(i % 2), "oa_status": "closed"}}), i) for i in range(20)], RAW))
    a, b = merge.merge_publications(rows).collect(), merge.merge_publications(rows.repartition(7)).collect()
    assert a == b and len(a) == 1 and a[0]["title"] == "tttt" and a[0]["is_oa"] is True and a[0]["source_count"] == 1 and len(json.loads(a[0]["source_provenance_json"])) == 20
    assert merge.duplicates_removed(rows).first()[0] == 19


def test_snapshots_never_shrink(spark, tmp_path):
    ddl = "publication_key string, record_url string, openalex_id string, publication_date string, doi string, type string, language string, title string, abstract string, authors string, institutions string, institution_ids string, institution_countries string, institution_names_raw string, is_oa boolean, oa_status string, source_count int"
    rich = spark.createDataFrame([("k", "u", "w", "2024", "10.1/a", "article", "en", "long title", "long abstract", "A; B", "U", "I1", "PL", "", True, "gold", 2)], ddl)
    poor = spark.createDataFrame([("k", "", "", "", "", "book", "", "t", "", "A", "V", "", "", "", False, "closed", 1), ("n", "", "", "", "", "", "", "x", "", "", "", "", "", "", None, "unknown", 1)], ddl)
    store = cache.Snapshots(spark, str(tmp_path / "s"))
    assert store.read("works") is None
    store.publish({"works": rich})
    store.publish({"works": cache.merge_canonical(store.read("works"), poor)})
    got = {r["publication_key"]: r for r in store.read("works").collect()}
    k = got["k"]
    assert store.version() == 2 and len(got) == 2
    assert (k["doi"], k["type"], k["title"], k["abstract"], k["institutions"], k["is_oa"], k["oa_status"], k["source_count"]) == ("10.1/a", "book", "long title", "long abstract", "U; V", True, "gold", 2)


def test_decisions_and_calls(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x y"), ("b", "z")], "key string, t string")
    got = classify.call_rows(rows, lambda: lambda t: (t.upper(), ""), "t").collect()
    assert {r["key"]: r["response"] for r in got} == {"a": "X Y", "b": "Z"}
    d = [one(spark, classify.decision(m, F.lit(w), F.lit("h"), F.lit(ch), F.lit(resp), F.lit(up)))[0] for m, w, ch, resp, up in (("skip", 9, "h", "{}", False), ("osdg", 9, "h", "{}", False), ("m", 9, "h", "{}", True), ("m", 9, "", "{}", False), ("m", 9, "", "{}", True), ("m", 9, "h", " ", False))]
    assert d == ["skip", "too_short", "reuse", "reuse", "call", "call"]


def record_page(folder, url, body):
    (folder / hashlib.sha256(url.encode()).hexdigest()).write_text(body, encoding="utf-8")


def test_oai_source_follows_tokens(spark, tmp_path):
    base = "https://r.org/oai"
    record_page(tmp_path, f"{base}?verb=ListRecords&metadataPrefix=oai_dc", f"<OAI-PMH><ListRecords>{RECORD}<resumptionToken>t1</resumptionToken></ListRecords></OAI-PMH>")
    record_page(tmp_path, f"{base}?verb=ListRecords&resumptionToken=t1", f"<OAI-PMH><ListRecords>{RECORD.replace('oai:x:1', 'oai:x:2')}<resumptionToken/></ListRecords></OAI-PMH>")
    harvest.register(spark)
    raw = spark.read.format("oai_pmh").options(url=base, id="r", label="R", transport="files", folder=str(tmp_path)).load()
    assert sorted(r["source_record_key"] for r in normalize.oai(raw).collect()) == ["oai:r:oai:x:1", "oai:r:oai:x:2"]


def test_readers_and_backoff():
    pages = {"c=*": {"results": [WORK], "meta": {"next_cursor": "n"}}, "n": {"results": [], "meta": {}}}
    reader = harvest._Works({"url": "u", "filters": "f"})
    assert len(list(reader.pages(lambda url: json.dumps(pages["n" if "cursor=n" in url else "c=*"]), {"filter": "f"}))) == 1
    twice = harvest._Oai({"url": "u"})
    with pytest.raises(ValueError, match="repeats"):
        list(twice.pages(lambda url: "<x><resumptionToken>t</resumptionToken></x>", {}))
    assert harvest.backoff(3, "99") == 15.0 and harvest.backoff(2, draw=lambda a, b: b) == 1.0


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("k", 'say "hi"', None)], "publication_key string, title string, junk string")
    export.write_csv(rows, str(tmp_path / "out"), files=1)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.first()["title"] == 'say "hi"' and "junk" not in back.columns
    assert export.file_name("Łódź é", "2024-01") == "Łodz_e_2024-01.csv"
