"""Raw payloads (JSON or XML text) -> source records, as DataFrame transformations."""

from __future__ import annotations

import hashlib
import json
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructField, StructType

from ..functions import access, records, text
from ..operators.merge import publication_key
from ..schemas import DSPACE_TYPES, ENTITY_KINDS, OAI_TYPES, SOURCE_FIELDS

WORK = """id string, display_name string, title string, publication_date string, doi string, type string, language string,
open_access struct<is_oa:boolean,oa_status:string>,
authorships array<struct<author:struct<display_name:string>,institutions:array<struct<id:string,display_name:string,country_code:string>>>>"""
ITEM = "_embedded struct<indexableObject:struct<id:string,uuid:string,name:string,handle:string,entityType:string,metadata:string>>"
MAX_XML_BYTES = 25 << 20


@F.pandas_udf(StringType())
def abstract_of_index(s: pd.Series) -> pd.Series:
    """Text of an inverted index (JSON object of token -> positions): tokens by position, those of
    one position joined in the object's order; members of a wrong shape are left out."""

    def one(raw: str | None) -> str:
        try:
            index = json.loads(raw or "null")
        except ValueError:
            return ""
        if not isinstance(index, dict):
            return ""
        at: dict[int, str] = {}
        for token, places in index.items():
            if token and isinstance(places, list):
                for p in places:
                    if isinstance(p, int) and not isinstance(p, bool) and p >= 0:
                        at[p] = f"{at[p]} {token}" if p in at else token
        return " ".join(at[p] for p in sorted(at))

    return s.map(one)


def dealt(raw: DataFrame) -> DataFrame:
    """Payloads dealt to as many tasks as a shuffle has. They cost far more to parse than to read: a file
    small enough for one task may hold millions of them."""
    return raw.repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_ord")


def _words(a: Column) -> Column:
    """Cleaned, non-empty, first-seen-distinct texts of an array, packed."""
    cleaned = F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: text.collapse(F.coalesce(x, F.lit(""))))
    return text.joined(F.array_distinct(F.filter(cleaned, lambda x: x != "")))


def _packed(a: Column) -> Column:
    """Trimmed, non-empty texts of an array, repeats included, as a semicolon list."""
    return text.joined(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _mapped(values: Column, table: dict[str, str]) -> Column:
    """The first of the values that the table knows, compared without marks and case; null if none."""
    found = F.transform(values, lambda x: _lookup(table, F.regexp_replace(F.lower(x), "[^a-z0-9]", "")))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _doi_link(token: Column) -> Column:
    return F.when(token != "", F.concat(F.lit("https://doi.org/"), token)).otherwise("")


AFFILIATIONS = "array<struct<id:string,name:string,country:string>>"


def _records(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows (source, label, _ord) with the given columns as full source records."""
    filled = {f: F.lit(None if f == "is_oa" else "").cast("boolean" if f == "is_oa" else "string") for f in SOURCE_FIELDS} | values
    made = rows.select("_ord", F.col("source").alias("source"), F.col("label").alias("source_label"), *[c.alias(n) for n, c in filled.items() if n not in ("source", "source_label", "publication_key", "is_oa", "oa_status")], access.reconciled(filled["is_oa"], filled["oa_status"]).alias("_oa"))
    made = made.withColumns({"is_oa": F.col("_oa.is_oa"), "oa_status": F.col("_oa.oa_status")})
    key = publication_key(F.col("doi"), F.col("title"), F.col("publication_date"), F.col("authors"), F.col("source_record_key"))
    return made.withColumn("publication_key", key).select(*SOURCE_FIELDS, "_ord")


def works(raw: DataFrame) -> DataFrame:
    """raw (source, label, payload, _ord) of works as JSON; those without an id go."""
    rows = dealt(raw).withColumn("w", F.from_json("payload", WORK)).where("trim(w.id) <> ''")
    w = F.col("w")
    tail = F.element_at(F.split(F.regexp_replace(F.trim(w["id"]), "/+$", ""), "/"), -1)
    places = F.flatten(F.transform(F.coalesce(w["authorships"], F.array()), lambda a: F.coalesce(a["institutions"], F.array())))
    told = F.transform(places, lambda p: F.struct(*[F.trim(F.coalesce(c, F.lit(""))).alias(n) for n, c in (("id", p["id"]), ("name", p["display_name"]), ("country", F.upper(p["country_code"])))]))
    rows = rows.withColumn("_aff", records.united_affiliations(F.array(F.coalesce(F.to_json(told), F.lit("[]")))))
    seen = F.from_json("_aff", AFFILIATIONS)
    index = F.get_json_object("payload", "$.abstract_inverted_index")
    return _records(rows, {
        "source_record_id": tail,
        "source_record_key": F.concat(F.lit("openalex:"), tail),
        "record_url": w["id"],
        "openalex_id": w["id"],
        "title": F.coalesce(text.nullify(w["display_name"]), w["title"], F.lit("")),
        "publication_date": F.coalesce(w["publication_date"], F.lit("")),
        "doi": _doi_link(text.doi(w["doi"])),
        "type": F.coalesce(w["type"], F.lit("")),
        "language": F.coalesce(w["language"], F.lit("")),
        "is_oa": w["open_access"]["is_oa"],
        "oa_status": w["open_access"]["oa_status"],
        "authors": _packed(F.transform(w["authorships"], lambda a: a["author"]["display_name"])),
        "institutions": text.joined(F.array_distinct(F.filter(seen["name"], lambda x: x != ""))),
        "institution_ids": text.joined(F.filter(seen["id"], lambda x: x != "")),
        "institution_countries": text.joined(seen["country"]),
        "institution_names_raw": text.joined(seen["name"]),
        "institution_affiliations_json": F.col("_aff"),
        "abstract": abstract_of_index(index),
    })


@F.pandas_udf(MapType(StringType(), ArrayType(StringType())))
def metadata_values(s: pd.Series) -> pd.Series:
    """Cleaned, non-empty values of each key of a metadata object (JSON text). A key may have a list or one
    value, a value may be an object that holds it or stand by itself."""

    def values(found: object) -> list[str]:
        entries = found if isinstance(found, list) else [found] if found else []
        told = (e.get("value") if isinstance(e, dict) else e for e in entries)
        return [t for t in (text.cleaned("" if v is None else str(v)) for v in told) if t]

    def one(raw: str | None) -> dict[str, list[str]]:
        try:
            found = json.loads(raw or "{}")
        except ValueError:
            return {}
        return {k: values(v) for k, v in found.items()} if isinstance(found, dict) else {}

    return s.map(one)


def _values(m: Column, *keys: str) -> Column:
    """Values of the keys of a metadata multimap, in the keys' order."""
    return F.flatten(F.array(*[_of(m, F.lit(k)) for k in keys]))


def _of(m: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), F.array().cast("array<string>"))


def _first(a: Column) -> Column:
    return F.coalesce(F.get(F.filter(a, lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))


def _longest(a: Column) -> Column:
    return F.aggregate(a, F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))


@F.pandas_udf(StringType())
def stable_affiliations(source: pd.Series, names: pd.Series) -> pd.Series:
    """JSON list of affiliations of a source's institution names; ids come from the folded names."""

    def one(s: str, found) -> str:
        ids = [hashlib.sha256(text.fold_key(n).encode()).hexdigest()[:16] for n in found]
        return json.dumps([{"id": f"dspace-affiliation:{s}:{i}", "name": n, "country": ""} for i, n in zip(ids, found, strict=True)], ensure_ascii=False)

    return pd.Series([one(s, [] if n is None else n) for s, n in zip(source, names, strict=True)], dtype=object)


def items(raw: DataFrame) -> DataFrame:
    """raw (source, label, payload, _ord) of repository search objects as JSON; those without an id go."""
    o = F.col("o")
    rows = dealt(raw).withColumn("o", F.from_json("payload", ITEM)["_embedded"]["indexableObject"]).withColumn("rid", F.coalesce(text.nullify(o["uuid"]), text.nullify(o["id"])))
    # not deterministic, as Spark takes it: else the filter would go below and parse every payload anew for each field it names
    rows, m = rows.withColumn("_m", metadata_values.asNondeterministic()(F.col("o.metadata"))).where("rid is not null"), F.col("_m")
    spoken = _first(_values(m, "dc.language"))
    prefixes = ("dc.abstract", "dc.description.abstract")
    found = [_longest(_values(m, f"{p}.{k}")) for k in ("en", "pl", "author") for p in prefixes]
    own = [_longest(_of(m, F.concat(F.lit(f"{p}."), F.lower(spoken)))) for p in prefixes]
    bare = [_longest(_values(m, p)) for p in prefixes]
    other = F.filter(F.array_sort(F.map_keys(m)), lambda k: F.startswith(k, F.lit(f"{prefixes[0]}.")) | F.startswith(k, F.lit(f"{prefixes[1]}.")))
    rest = F.get(F.filter(F.transform(other, lambda k: _longest(_of(m, k))), lambda x: x != ""), F.lit(0))
    rights = F.array_join(_values(m, "dc.rights"), " ")
    entity = F.trim(F.coalesce(o["entityType"], F.lit("")))
    kind = F.coalesce(_mapped(F.slice(F.filter(_values(m, "dc.type"), lambda x: F.trim(x) != ""), 1, 1), DSPACE_TYPES), _lookup(ENTITY_KINDS, F.lower(entity)), text.nullify(text.slug(entity)), F.lit("other"))
    places = F.array_distinct(F.filter(F.transform(_values(m, "dc.affiliation"), text.collapse), lambda x: x != ""))
    known = [c for c in ("home",) if c in raw.columns]  # public address of the repository, where the reader gives it
    handle = F.when((F.trim(F.coalesce(o["handle"], F.lit(""))) != "") & (F.col("home") != ""), F.concat(*[F.col(c) for c in known], F.lit("/handle/"), F.trim(o["handle"]))) if known else F.lit(None).cast("string")
    rows = rows.withColumn("_aff", stable_affiliations(F.col("source"), places))
    named = F.from_json("_aff", AFFILIATIONS)
    return _records(rows, {
        "source_record_id": F.col("rid"),
        "source_record_key": F.concat(F.lit("dspace:"), F.col("source"), F.lit(":"), F.col("rid")),
        "record_url": F.coalesce(text.nullify(_first(_values(m, "dc.identifier.uri"))), handle, F.lit("")),
        "title": text.clean_html(F.coalesce(text.nullify(F.trim(o["name"])), _first(_values(m, "dc.title")))),
        "publication_date": _first(_values(m, "dc.date.issued")),
        "doi": _doi_link(text.first_doi(_values(m, "dc.identifier.doi", "dc.identifier.uri", "dc.identifier.weblink"))),
        "type": kind,
        "language": spoken,
        "is_oa": access.item_rights(rights),
        "authors": _packed(_values(m, "dc.contributor.author")),
        "institutions": text.joined(named["name"]),
        "institution_ids": text.joined(named["id"]),
        "institution_countries": text.joined(named["country"]),
        "institution_names_raw": text.joined(named["name"]),
        "institution_affiliations_json": F.col("_aff"),
        "abstract": text.clean_html(F.coalesce(*[text.nullify(c) for c in (*own, *found, *bare)], rest, F.lit(""))),
    })


DUBLIN_CORE = StructType([
    StructField("id", StringType()), StructField("deleted", BooleanType()), StructField("sets", ArrayType(StringType())),
    *[StructField(n, ArrayType(StringType())) for n in ("names", "texts", "languages")],
])


class _Record:
    """One pass over a record's XML: header, and the cleaned elements of its Dublin Core container.

    Names are compared without their prefixes, so fragments of a page need no declarations.
    """

    def __init__(self):
        self.path: list[str] = []
        self.id, self.deleted, self.sets = "", False, []
        self.containers: list[tuple[str, list[tuple[str, str, str]]]] = []
        self.words: list[str] | None = None
        self.language = ""

    def parse(self, payload: str) -> _Record:
        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.data
        parser.buffer_text = True
        try:
            parser.Parse(payload, True)
        except expat.ExpatError as e:
            raise ValueError(f"the record is not XML: {e}") from e
        return self

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self.path.append(tag.rpartition(":")[2])
        where = self.path[1:]
        if where == ["header"]:
            self.deleted = attributes.get("status") == "deleted"
        elif len(where) == 2 and where[0] == "metadata":
            self.containers.append((where[1], []))
        elif (len(where) == 2 and where[0] == "header") or (len(where) == 3 and where[0] == "metadata"):
            self.words, self.language = [], attributes.get("xml:lang", "").lower()

    def data(self, words: str) -> None:
        if self.words is not None:
            self.words.append(words)

    def end(self, tag: str) -> None:
        where = self.path[1:]
        if self.words is not None and len(where) == (2 if where[0] == "header" else 3):
            told, self.words = text.cleaned("".join(self.words)), None
            if where[0] == "metadata":
                if told:
                    self.containers[-1][1].append((where[2].lower(), told, self.language))
            elif where[1] == "identifier":
                self.id = self.id or told
            elif where[1] == "setSpec" and told:
                self.sets.append(told)
        self.path.pop()

    def row(self) -> tuple:
        found = next((e for name, e in self.containers if name == "dc"), self.containers[0][1] if self.containers else [])
        names, texts, languages = ([e[k] for e in found] for k in range(3))
        return self.id, self.deleted, self.sets, names, texts, languages


@F.pandas_udf(DUBLIN_CORE)
def dublin_core(s: pd.Series) -> pd.DataFrame:
    """Each record's XML, parsed once."""
    return pd.DataFrame([_Record().parse(x).row() for x in s], columns=DUBLIN_CORE.names)


def _without_cdata(xml: Column) -> Column:
    """The same document with CDATA sections as escaped text, so that an element's text is one node."""

    def plain(part: Column, i: Column) -> Column:
        inner = F.substring_index(part, "]]>", 1)
        told = F.replace(F.replace(F.replace(inner, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(i == 0, part).otherwise(F.concat(told, F.substr(part, F.length(inner) + 4)))

    return F.when(F.contains(xml, F.lit("<![CDATA[")), F.array_join(F.transform(F.split(xml, r"<!\[CDATA\["), plain), "")).otherwise(xml)


def guarded(rows: DataFrame) -> DataFrame:
    """Payloads over the size limit, or with a document type or entities, go before any parser sees them."""
    return rows.where((F.octet_length("payload") <= MAX_XML_BYTES) & ~F.upper("payload").rlike("<!DOCTYPE|<!ENTITY"))


def oai(raw: DataFrame) -> DataFrame:
    """raw (source, label, payload, _ord) of single OAI-PMH records as XML; deleted ones and those without an id go."""
    # not deterministic, as Spark takes it: else the filter below would have every record parsed twice
    rows = dealt(guarded(raw)).withColumn("r", dublin_core.asNondeterministic()("payload")).withColumn("rid", F.col("r.id")).where("rid <> '' and not r.deleted")
    entries = F.arrays_zip(F.col("r.names").alias("name"), F.col("r.texts").alias("text"), F.col("r.languages").alias("language"))

    def values(key: str, *languages: str) -> Column:
        kept = F.filter(entries, lambda e: (e["name"] == key) & (e["language"].isin(*languages) if languages else F.lit(True)))
        return F.transform(kept, lambda e: e["text"])

    ids, sets, rights = values("identifier"), F.col("r.sets"), F.array_join(values("rights"), " ")
    links = F.filter(ids, lambda x: x.rlike("(?i)^https?://"))
    plain = F.filter(links, lambda x: ~x.rlike("(?i)doi\\.org/|nbn-resolving\\.org/|/files/"))
    url = F.coalesce(F.get(F.filter(links, lambda x: F.contains(F.lower(x), F.lit("/frontdoor/"))), F.lit(0)), F.get(plain, F.lit(0)), F.get(links, F.lit(0)), F.lit(""))
    english = values("description", "en", "eng")
    kinds = F.concat(values("type"), F.transform(F.filter(sets, lambda x: x.startswith("doc-type:")), lambda x: F.regexp_replace(x, "^doc-type:", "")))
    return _records(rows, {
        "source_record_id": F.col("rid"),
        "source_record_key": F.concat(F.lit("oai:"), F.col("source"), F.lit(":"), F.col("rid")),
        "record_url": url,
        "title": _first(values("title")),
        "publication_date": _first(values("date")),
        "doi": _doi_link(text.first_doi(ids)),
        "type": F.coalesce(_mapped(F.transform(kinds, lambda x: F.regexp_replace(F.lower(x), "^doc-type:", "")), OAI_TYPES), F.lit("other")),
        "language": _first(values("language")),
        "is_oa": access.oai_rights(rights, sets),
        "authors": _words(F.transform(values("creator"), text.without_orcid)),
        "institution_affiliations_json": F.lit("[]"),
        "abstract": F.when(F.size(english) > 0, _longest(english)).otherwise(_longest(values("description"))),
    })


def split_records(pages: DataFrame) -> DataFrame:
    """OAI-PMH response pages (source, label, payload, _ord) -> one row per record, by pattern (no parser state crosses pages)."""
    one = guarded(pages).withColumn("payload", _without_cdata(F.col("payload"))).select("source", "label", "_ord", F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?s)(<record[ >].*?</record>)"), F.lit(1))).alias("_i", "payload"))
    return one.select("source", "label", "payload", (F.col("_ord") * 1_000_000 + F.col("_i")).alias("_ord"))


