"""Enrichment and classification: which rows need a call, and calls through injected clients."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Least words by model.
LEAST_WORDS = {"osdg": 50}
SKIP = "skip"
# End of the fixed values.
TITLE_ONLY = "low_confidence:title_only_no_abstract"


def input_text(abstract: Column, title: Column) -> Column:
    return F.coalesce(text.nullify(F.trim(abstract)), title, F.lit(""))


def decision(model: str, words: Column, hash_: Column, cached_hash: Column, cached_response: Column, updated: Column) -> Column:
    """skip, too_short, reuse or call: the first that holds."""
    if model == SKIP:
        return F.lit(SKIP)
    same = (cached_hash == hash_) | ((F.coalesce(cached_hash, F.lit("")) == "") & ~updated)
    reuse = (F.trim(F.coalesce(cached_response, F.lit(""))) != "") & F.coalesce(same, F.lit(False))
    return F.when(words < LEAST_WORDS.get(model, 0), "too_short").when(reuse, "reuse").otherwise("call")


def call_rows(rows: DataFrame, client: Callable[[], Callable[[str], tuple[str | None, str]]], column: str, parallel: int = 8) -> DataFrame:
    """key, response, note of the rows' texts. ``client`` makes one callable per task, which
    returns (response or None, note). Materialise the result: every action calls again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for f in frames:
            got = [ask(t) for t in f[column]]
            yield pd.DataFrame({"key": f["key"], "response": [r for r, _ in got], "note": [n for _, n in got]})

    return rows.select("key", column).repartition(parallel).mapInPandas(run, "key string, response string, note string")
