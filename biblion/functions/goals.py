"""Goal predictions: response envelope -> ranked text -> rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENVELOPE = "struct<predictions:array<struct<prediction:string,sdg:struct<code:string,name:string>>>>"


def _line(e: Column) -> Column:
    """A name that is missing, or says the goal itself, stands alone; others follow in brackets."""
    code = F.trim(e["code"])
    name = F.trim(F.coalesce(F.nullif(e["name"], F.lit("")), F.concat(F.lit("SDG "), code)))
    label = F.when(F.startswith(F.lower(name), F.lit("sdg ")), name).otherwise(F.concat(F.lit("SDG "), code, F.lit(" ("), name, F.lit(")")))
    return F.concat(F.bround(e["p"] * 100, 0).cast("bigint").cast("string"), F.lit("% "), label)


def ranked_text(response: Column) -> Column:
    """Lines ``84% SDG 4 (Quality Education)``, best first; malformed entries are left out.

    Percentages round half to even. Ties keep their order.
    """
    entries = F.from_json(response, ENVELOPE)["predictions"]
    scored = F.transform(F.coalesce(entries, F.array()), lambda e, i: F.struct((-e["prediction"].try_cast("double")).alias("rank"), i.alias("i"), e["prediction"].try_cast("double").alias("p"), e["sdg"]["code"].alias("code"), e["sdg"]["name"].alias("name")))
    good = F.sort_array(F.filter(scored, lambda e: e["p"].isNotNull() & e["code"].isNotNull()))
    return F.array_join(F.transform(good, _line), "\n")


def lines(formatted: Column) -> Column:
    """Array of struct(pct, code, name) of a ranked text; lines that hold no prediction go."""
    pattern = r"(?i)(\d+(?:\.\d+)?)%\s*(?:SDG\s*)?(\d+)(?:\s*\(([^)]+)\))?"
    rows = F.transform(F.split(F.coalesce(formatted, F.lit("")), "\n"), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("pct"), F.regexp_extract(x, pattern, 2).alias("code"), F.regexp_extract(x, pattern, 3).alias("name")))
    return F.transform(F.filter(rows, lambda r: r["code"] != ""), lambda r: F.struct(r["pct"].cast("double").alias("pct"), r["code"].alias("code"), r["name"].alias("name")))
