"""JSON lists of objects, united by key. Spark has no keyed, order-keeping union of free-form
objects, so these are Arrow UDFs; each works on one row's lists."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import fold_key


def objects(raw: str | None) -> list[dict]:
    """The objects of a JSON list; anything else gives none."""
    if raw == "[]":
        return []
    try:
        found = json.loads(raw or "[]")
    except ValueError:
        return []
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def first_per_key(lists: Iterable[str | None], key: Callable[[dict], str]) -> list[dict]:
    """Objects in order, the first of each key; those without a key go."""
    kept: dict[str, dict] = {}
    for raw in lists:
        for x in objects(raw):
            if k := key(x):
                kept.setdefault(k, x)
    return list(kept.values())


def last_per_key(lists: Iterable[str | None], key: Callable[[dict], str]) -> list[dict]:
    """Objects in order of first sight, the last of each key in its place; those without a key all stay."""
    kept: dict[object, dict] = {}
    for i, raw in enumerate(lists):
        for j, x in enumerate(objects(raw)):
            kept[key(x) or (i, j)] = x
    return list(kept.values())


def affiliation_key(x: dict) -> str:
    return str(x.get("id") or "").strip() or fold_key(str(x.get("name") or ""))


_text: Callable[[list[dict]], str] = json.JSONEncoder(ensure_ascii=False).encode


@F.pandas_udf(StringType())
def united_affiliations(lists: pd.Series) -> pd.Series:
    """One JSON list of an array of them: affiliations distinct by id, or else by folded name."""
    return lists.map(lambda a: _text(first_per_key([] if a is None else a, affiliation_key)))


@F.pandas_udf(StringType())
def updated_affiliations(old: pd.Series, new: pd.Series) -> pd.Series:
    """Stored affiliations with the new ones; an equal id (or name, where there is none) is replaced in place."""
    key = lambda x: str(next((x[f] for f in ("id", "name") if x.get(f)), "")).strip()
    return pd.Series([_text(last_per_key(pair, key)) for pair in zip(old, new, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def updated_provenance(old: pd.Series, new: pd.Series) -> pd.Series:
    """Stored source records with the new ones; an equal source_record_key is replaced in place."""
    key = lambda x: str(x.get("source_record_key") or "").strip()
    return pd.Series([_text(last_per_key(pair, key)) for pair in zip(old, new, strict=True)], dtype=object)
