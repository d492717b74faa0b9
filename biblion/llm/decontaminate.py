"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

Words are runs of a-z, 0-9 and non-ASCII characters of the lower-cased (A-Z) text. A
window is ``n`` consecutive words of a benchmark item; an item with fewer words, but
some, is one window. Each document's token windows are looked up in the hash set, every
hit is verified word by word, and the words inside verified windows are hit.

The set that is broadcast never exceeds ``max_windows`` windows nor ``max_bytes`` (16 bytes a
window and the items' words): a larger benchmark is cut into slices of that size, each slice
scans the documents as given, and the hit word spans of all slices are merged per row, by a
row number written with the documents. A slice is freed before the next one is read.

Defined cases: null or wordless texts have no words and are clean; items that are null
or wordless have no window; repeated items count by their item_id; an item without item_id
hits words, but is neither listed nor counted; empty tables give empty results; extra columns
of either input are ignored or kept untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, WordBatch, bytes_of, chunks, fold_windows, materialize, tidied

WINDOW_WORDS = 10
MAX_WINDOWS = 2_000_000
MAX_BYTES = 64 << 20

#: The row number that keeps rows of one doc_id, or of none, apart while slices are merged.
ROW = "__decontaminate_row"

_SPANS = "doc_id long, n_words long, span_lo array<long>, span_hi array<long>, items array<string>"


@dataclass
class NgramSet:
    """Hashes of the windows by window length, and where each window's words stand."""

    n: int
    last: bool = False  # no slice follows
    windows: int = 0
    size: int = 0  # bytes
    names: list[str | None] = field(default_factory=list)  # by piece of an item
    words: list[bytes] = field(default_factory=list)  # joined by spaces
    ends: list[np.ndarray] = field(default_factory=list)  # where each word ends in them
    parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def add(self, name: str | None, batch: WordBatch, lo: int, hi: int) -> None:
        """The windows of words lo to hi, a piece of an item."""
        words = [batch.word(i) for i in range(lo, hi)]
        length = min(hi - lo, self.n)
        hashes = fold_windows(batch.hashes[lo:hi], length)
        piece = len(self.names)
        self.names.append(name)
        self.words.append(b" ".join(words))
        self.ends.append(np.cumsum([len(w) + 1 for w in words]).astype(np.int32) - 1)
        self.parts.setdefault(length, []).append((hashes, np.full(len(hashes), piece, np.int32), np.arange(len(hashes), dtype=np.int32)))
        self.windows += len(hashes)
        self.size += 16 * len(hashes) + len(self.words[-1]) + 4 * len(words)

    def close(self) -> NgramSet:
        for length, parts in self.parts.items():
            hashes, piece, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(hashes, kind="stable")
            self.tables[length] = hashes[by], piece[by], at[by]
        self.parts = {}
        return self

    def items(self, length: int, h: np.uint64, words: bytes) -> set[str | None]:
        """Names of the items of which a window of this hash has these very words."""
        hashes, piece, at = self.tables[length]
        found = set()
        for k in range(int(np.searchsorted(hashes, h, "left")), int(np.searchsorted(hashes, h, "right"))):
            p, i = int(piece[k]), int(at[k])
            begin = int(self.ends[p][i - 1]) + 1 if i else 0
            if self.words[p][begin : int(self.ends[p][i + length - 1])] == words:
                found.add(self.names[p])
        return found


def ngram_sets(benchmark: DataFrame, n: int, max_windows: int, max_bytes: int) -> Iterator[NgramSet]:
    """Slices of the benchmark; an item larger than what a slice may hold is cut into overlapping pieces."""
    current = NgramSet(n)
    for row in benchmark.select("item_id", "text").toLocalIterator():
        batch = WordBatch([(row["text"] or "").encode()], ALNUM)
        total = len(batch.hashes)
        name = None if row["item_id"] is None else str(row["item_id"])
        step = max(1, min(max_windows, max_bytes // 256))
        for lo in range(0, max(total - n + 1, min(total, 1)), step):
            if current.windows >= max_windows or current.size >= max_bytes:
                yield current.close()
                current = NgramSet(n)
            current.add(name, batch, lo, min(lo + step + n - 1, total))
    current.last = True
    yield current.close()


def hit_spans(texts: list[bytes], grams: NgramSet) -> Iterator[tuple[int, list[tuple[int, int]], set[str | None], WordBatch, int]]:
    """For each text: its word count, merged hit word ranges, hit items, and its words."""
    for lo, hi in chunks(texts):
        batch = WordBatch(texts[lo:hi], ALNUM)
        owner_end = batch.first[1:]
        hits: dict[int, list[tuple[int, int, set[str | None]]]] = {}
        for length, (known, _, _) in grams.tables.items():
            seen = fold_windows(batch.hashes, length)
            if not len(seen):
                continue
            slot = np.searchsorted(known, seen)
            slot[slot == len(known)] = 0
            for i in np.flatnonzero(known[slot] == seen).tolist():
                doc = int(np.searchsorted(owner_end, i, side="right"))
                if i + length > owner_end[doc]:
                    continue
                words = b" ".join(batch.word(j) for j in range(i, i + length))
                if items := grams.items(length, seen[i], words):
                    hits.setdefault(doc, []).append((i, i + length, items))
        for doc in range(hi - lo):
            first = int(batch.first[doc])
            spans: list[tuple[int, int]] = []
            items: set[str | None] = set()
            for a, b, names in sorted(hits.get(doc, ()), key=lambda x: x[:2]):
                items |= names
                if spans and a - first <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], b - first))
                else:
                    spans.append((a - first, b - first))
            yield int(batch.first[doc + 1]) - first, spans, items, batch, doc


def scan(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, n_words, hit word ranges (merged, ascending) and hit items of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = [(n, s, sorted(items - {None})) for n, s, items, _, _ in hit_spans(bytes_of(rb.column("text")), shared.value)]
            yield pa.RecordBatch.from_arrays(
                [
                    rb.column("doc_id"),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[a for a, _ in s] for _, s, _ in found], pa.list_(pa.int64())),
                    pa.array([[b for _, b in s] for _, s, _ in found], pa.list_(pa.int64())),
                    pa.array([i for _, _, i in found], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "span_lo", "span_hi", "items"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), _SPANS)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hit spans (word ranges) and the items that occur."""
    slices = ngram_sets(benchmark, n, max_windows, max_bytes)
    grams = next(slices)
    if grams.last:
        return scan(docs, docs.sparkSession.sparkContext.broadcast(grams))
    return scan_slices(docs.select("doc_id", "text"), chain([grams], slices))[1].select("doc_id", "n_words", "span_lo", "span_hi", "items")


def scan_slices(docs: DataFrame, slices: Iterator[NgramSet]) -> tuple[DataFrame, DataFrame]:
    """``docs`` written with a row number, and what ``scan`` finds in each row with all slices.

    One slice is held at a time; of all but the first only rows with a hit are kept.
    """
    rows = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "decontaminate-rows")
    numbers = rows.select(F.col(ROW).alias("doc_id"), "text")
    parts = []
    for grams in slices:
        shared = docs.sparkSession.sparkContext.broadcast(grams)
        found = scan(numbers, shared)
        parts.append(materialize(found.where(F.size("span_lo") > 0) if parts else found, "decontaminate-slice"))
        shared.destroy()
        del grams
    together = reduce(DataFrame.unionByName, parts)
    spans = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("span_lo", "span_hi"))))
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<span_lo:bigint,span_hi:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["span_hi"] >= s["span_lo"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["span_lo"].alias("span_lo"), F.greatest(F.element_at(acc, -1)["span_hi"], s["span_hi"]).alias("span_hi"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    by_row = together.groupBy(F.col("doc_id").alias(ROW)).agg(F.max("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = by_row.select(ROW, "n_words", F.col("spans.span_lo").alias("span_lo"), F.col("spans.span_hi").alias("span_hi"), "items")
    return rows, found.join(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")), ROW)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, max_hit_share: float = 0.5, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Documents without the hit spans; a document of which more than ``max_hit_share`` of
    the words is hit goes as a whole. Columns of ``docs`` are kept; n_chars follows the text.
    With several slices the spans of all are found on the texts as given, then cut at once.
    """
    schema, names = docs.schema, docs.columns

    def cut(rb: pa.RecordBatch, texts: list[bytes], found: Iterator[tuple[int, list[tuple[int, int]], WordBatch, int]]) -> pa.RecordBatch:
        keep, new = [], []
        for i, (total, spans, batch, doc) in enumerate(found):
            hit = sum(b - a for a, b in spans)
            if hit > max_hit_share * total:
                continue
            keep.append(i)
            if not spans:
                new.append(rb.column("text")[i].as_py())
                continue
            first, base = int(batch.first[doc]), int(batch.text_at[doc])
            text, out, at = texts[i], [], 0
            for a, b in spans:
                out.append(text[at : int(batch.starts[first + a]) - base])
                at = int(batch.ends[first + b - 1]) - base
            new.append(b"".join([*out, text[at:]]).decode("utf-8", "ignore"))
        kept = rb.take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(new, rb.schema.field("text").type) if c == "text" else kept.column(c) for c in names], names=names)

    slices = ngram_sets(benchmark, n, max_windows, max_bytes)
    grams = next(slices)
    if grams.last:
        shared = docs.sparkSession.sparkContext.broadcast(grams)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                texts = bytes_of(rb.column("text"))
                yield cut(rb, texts, ((total, spans, batch, doc) for total, spans, _, batch, doc in hit_spans(texts, shared.value)))

        out = docs.mapInArrow(tidied(run), schema)
    else:
        rows, found = scan_slices(docs, chain([grams], slices))

        def run_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                texts = bytes_of(rb.column("text"))
                spans = [list(zip(a or (), b or (), strict=True)) for a, b in zip(rb.column("__lo").to_pylist(), rb.column("__hi").to_pylist(), strict=True)]
                yield cut(rb, texts, _with_words(texts, spans))

        hits = found.where(F.size("span_lo") > 0).select(ROW, F.col("span_lo").alias("__lo"), F.col("span_hi").alias("__hi"))
        out = rows.join(hits, ROW, "left").select(*[rows[c] for c in names], "__lo", "__hi").mapInArrow(tidied(run_found), schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def _with_words(texts: list[bytes], spans: list[list[tuple[int, int]]]) -> Iterator[tuple[int, list[tuple[int, int]], WordBatch, int]]:
    """For each text: its word count, the given word ranges, and its words."""
    for lo, hi in chunks(texts):
        batch = WordBatch(texts[lo:hi], ALNUM)
        for doc in range(hi - lo):
            yield int(batch.first[doc + 1] - batch.first[doc]), spans[lo + doc], batch, doc


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination``."""
    n_hit = F.aggregate(F.zip_with("span_hi", "span_lo", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS g
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, lens WHERE len(ws) >= m)),
hit AS (SELECT doc_id, m, i, item_id FROM dw JOIN bw USING (m, g)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit),
h1 AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
h2 AS (SELECT doc_id, count(x) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h1 USING (doc_id) LEFT JOIN h2 USING (doc_id)
"""
