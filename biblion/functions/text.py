"""Text functions as Column expressions; Arrow UDFs only where Spark has no equivalent."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

SPACE = r"(?U)\s+"
# Shapes of DOIs (lenient and registered), of a DOI's prefixes, of ORCID, ROR and institution links.
DOI, STRICT_DOI = r"(10\.\d{4,9}/\S+)", r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
ORCID_TAIL = r"(?i)\s*;\s*https?://orcid\.org/[0-9X-]+\s*$"
ROR = r"(?i)^https?://ror\.org/[0-9a-z]{9}$"
INSTITUTION = r"(?i)^https?://openalex\.org/(I[A-Z0-9]+)$"
# End of the fixed values.


def nullify(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White-space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip_tags(c: Column) -> Column:
    """Markup tags become spaces, white space is collapsed (entities stay)."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def cleaned(text: str) -> str:
    """``clean_html`` of one Python text."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = re.sub(r"<[^>]+>", " ", text)
    return " ".join(text.split())


def clean_html(c: Column) -> Column:
    """Entities are decoded, then tags go."""
    return strip_tags(unescape(F.coalesce(c, F.lit(""))))


def _fold(text: str) -> str:
    return text if text.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def fold_key(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", _fold(text).lower()).strip()


#: Texts of a batch that are Python objects at once.
FOLDED_AT_ONCE = 64


@F.arrow_udf(StringType())
def match_key(s: pa.Array) -> pa.Array:
    """Comparison form: accents off, lower case, other than a-z and 0-9 one space. Texts may be long and a batch has thousands:
    some at a time leave Arrow."""
    slices = (s.slice(i, FOLDED_AT_ONCE).to_pylist() for i in range(0, len(s), FOLDED_AT_ONCE))
    return pa.chunked_array([pa.array([fold_key(x or "") for x in some], pa.string()) for some in slices], pa.string()).combine_chunks()


@F.pandas_udf(StringType())
def compact_key(s: pd.Series) -> pd.Series:
    """Comparison form that keeps every script: accents, punctuation and white space off, lower case."""
    return s.fillna("").map(lambda x: re.sub(r"\s+", "", re.sub(r"[^\w\s]", " ", _fold(x)).lower()))


@F.pandas_udf(StringType())
def word_fold(s: pd.Series) -> pd.Series:
    """Accents off, lower case, punctuation and white space as single spaces."""
    return s.fillna("").map(lambda x: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", _fold(x)).lower()))


#: Least ratio of matching blocks of texts that count as alike.
ALIKE = 0.9


def ratio_bound(a: Column, b: Column) -> Column:
    """No less than the matching-blocks ratio of two texts: twice the characters that they share, in any order,
    over all characters. ``a`` and ``b`` are columns without Python functions."""
    n = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    letters = F.array_distinct(F.regexp_extract_all(a, F.lit("(?s)."), F.lit(0)))
    shared = F.aggregate(letters, F.lit(0), lambda total, c: total + F.least(n(a, c), n(b, c)))
    return F.lit(2.0) * shared / F.greatest(F.length(a) + F.length(b), F.lit(1))


@F.pandas_udf(BooleanType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equal compact forms, or a matching-blocks ratio of ``ALIKE``; the length bound comes first."""

    def one(x: str | None, y: str | None) -> bool:
        if not x or not y:
            return False
        return x == y or (2 * min(len(x), len(y)) >= ALIKE * (len(x) + len(y)) and difflib.SequenceMatcher(None, x, y).ratio() >= ALIKE)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def with_similar(rows: DataFrame, name: str, a: Column, b: Column) -> DataFrame:
    """rows and a column ``name``, which is ``similar`` of both (never if one is empty or null). Lengths, then shared characters bound the ratio, so that the
    matcher sees only pairs that may reach it."""
    x, y = F.col("_x"), F.col("_y")
    sizes = F.lit(2.0) * F.least(F.length(x), F.length(y)) / F.greatest(F.length(x) + F.length(y), F.lit(1))
    full = (x != "") & (y != "")
    rows = rows.withColumns({"_x": F.coalesce(a, F.lit("")), "_y": F.coalesce(b, F.lit(""))})
    rows = rows.withColumn("_open", F.when(full & (x != y) & (sizes >= ALIKE), ratio_bound(x, y) >= ALIKE).otherwise(F.lit(False)))
    return rows.withColumn(name, (full & (x == y)) | similar(F.when(F.col("_open"), x), F.when(F.col("_open"), y))).drop("_x", "_y", "_open")


def doi(c: Column) -> Column:
    """A DOI in its lower-case bare form, or the empty string."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), DOI_PREFIX, "")
    return F.lower(F.regexp_replace(F.regexp_extract(bare, DOI, 1), r"[.,;)]+$", ""))


def strict_doi(c: Column) -> Column:
    """As ``doi`` with the registered character set and more trailing marks cut."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), STRICT_DOI, 1)
    return F.lower(F.regexp_replace(found, r"[.,;:)\]}]+$", ""))


def first_doi(candidates: Column) -> Column:
    """The first DOI among an array of texts, or the empty string."""
    return F.coalesce(F.get(F.filter(F.transform(candidates, doi), lambda x: x != ""), F.lit(0)), F.lit(""))


def parts(c: Column) -> Column:
    """Trimmed, non-empty, first-seen-distinct parts of a semicolon list."""
    return F.array_except(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), F.array(F.lit("")))


def joined(a: Column) -> Column:
    return F.array_join(a, "; ")


def merged(*lists: Column) -> Column:
    """Ordered union of semicolon lists, as one."""
    return joined(parts(F.concat_ws(";", *lists)))


def first_author(authors: Column) -> Column:
    """Surname of the first author: before a comma, or else the last word."""
    one = F.trim(F.split_part(F.coalesce(authors, F.lit("")), F.lit(";"), F.lit(1)))
    return F.when(F.contains(one, F.lit(",")), F.trim(F.split_part(one, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(one, SPACE), -1))


def abbreviated(authors: Column) -> Column:
    names = parts(authors)
    return F.when(F.size(names) > 1, F.concat(names[0], F.lit(" et al."))).otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit("")))


def without_orcid(c: Column) -> Column:
    """A trailing ORCID link after a semicolon goes."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), ORCID_TAIL, ""))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), F.lit("-"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda x: x != ""))


def too_short(c: Column, least: int) -> Column:
    return word_count(c) < least


def is_ror(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(ROR), F.lit(False))


def institution_id(c: Column) -> Column:
    """The bare identifier of an institution's link; other texts as they are, trimmed."""
    return F.regexp_replace(F.trim(c), INSTITUTION, "$1")


def author_token(name: Column) -> Column:
    """Folded surname of one author: the first word of a comma form, or else the last."""
    words = F.split(F.trim(word_fold(name)), " +")
    return F.when(F.contains(name, F.lit(",")), F.get(words, F.lit(0))).otherwise(F.element_at(words, -1))


def text_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def with_flag(note: Column, flag: Column) -> Column:
    """A semicolon note with one more flag, if it isn't there."""
    flags = parts(note)
    return joined(F.when(F.array_contains(flags, flag), flags).otherwise(F.array_append(flags, flag)))


def institution_label(name: Column, identifier: Column, country: Column) -> Column:
    tail = nullify(F.element_at(F.split(identifier, "/"), -1))
    label = F.coalesce(nullify(F.trim(name)), tail, identifier)
    return F.when(F.coalesce(country, F.lit("")) != "", F.concat(label, F.lit(" ("), country, F.lit(")"))).otherwise(label)


def shortened(c: Column, limit: int = 120) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)
