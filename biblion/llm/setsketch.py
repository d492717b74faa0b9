"""SetSketch near-dedup: banded registers find candidates, a joint likelihood estimates
their similarity, full shingle sets confirm it.

Words are runs of non-white-space characters of the text with A-Z lower-cased. A document's
set holds its distinct shingles of ``n`` words (three by default); a text of fewer words is one shingle;
without words the set is empty and linked with nothing. Documents are linked if
100 * |A and B| >= ``percent`` * |A or B|; near-duplicate groups are the connected components.

* Register i of a SetSketch is floor(1 - log_b(min x_i)) of exponential variables x_i, cut
  to 0..q+1. Sketches merge by maximum. With b = 1.001 two registers agree with about the
  Jaccard similarity; ``bands`` of ``rows`` registers miss a pair at 0.85 with
  (1 - 0.85**3)**24, 1e-10, at the defaults. ``keep_one`` takes five words at 0.8, and 32
  bands, which miss as few: (1 - 0.8**3)**32, 1e-10.
* Documents of equal sets (a 128-bit digest of two independent hashes) form one class: one
  sketch, one candidate; copies are never paired.
* A band bucket is first linked through its least member only (a star, linear in its size).
  A link can hide only between members of different components after that: small buckets
  compare those pair by pair; members of large ones meet by more stars with other centres
  while that helps, then in blocks that share prefix shingles (``_block_links``). So no
  link is lost, and neither copies nor texts around a common passage make all their pairs.
* Verification reads the texts of candidates again and intersects their full sets of
  shingles, word by word, no hashes.

Defined cases: null, empty and wordless texts give n_shingles 0, component_id = doc_id,
kept; rows without doc_id are linked with nothing (component_id null, kept). Rows count
by their text: rows of one doc_id with different texts are linked by their own texts only,
rows repeated whole are copies of each other with one component_id. ``keep_one`` keeps one
row of each group, the least by doc_id, then by a hash of the text; wordless rows and rows
without doc_id stay. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, WordBatch, bytes_of, chunks, distinct, fold_windows, likely_rows, materialize, mix64, ranges, record_batch, scratch, signed, tidied, tidied_group
from .components import components

BANDS, ROWS = 24, 3
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
SHINGLE_WORDS = 3
PERCENT = 85
#: The rule of the pipeline's stage.
STAGE_WORDS, STAGE_PERCENT, STAGE_BANDS = 5, 80, 32
#: Candidates whose likely similarity is lower than the threshold by this much (over five
#: standard errors of 72 registers) are not verified.
SLACK = 0.25
#: Buckets of up to so many classes are compared pair by pair where components differ.
SMALL_BUCKET = 24
#: Members of large buckets (about) up to which blocks compare them at once; of more, stars thin them out first.
FEW_HOT = 16_384
#: Sets that a task compares with as many others.
BLOCK = 1024
#: Counters of the shingle frequencies that order prefixes.
SLOTS = 1 << 18

_rng = np.random.default_rng(4)
_XOR = _rng.integers(0, 1 << 63, (512, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 1 << 63, (512, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], n: int = SHINGLE_WORDS) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """Sorted distinct shingle hashes of each text, and the set's digest (none if it is empty)."""
    for lo, hi in chunks(texts):
        batch = WordBatch(texts[lo:hi], SPACED)
        both = batch.hashes, batch.other_hashes()
        whole = [fold_windows(h, n) for h in both]
        for a, b in zip(batch.first[:-1].tolist(), batch.first[1:].tolist(), strict=True):
            if b - a >= n:
                one, two = (distinct(w[a : b - n + 1]) for w in whole)
            elif b > a:
                one, two = (fold_windows(h[a:b], b - a) for h in both)
            else:
                yield np.zeros(0, np.uint64), None
                continue
            yield one, hashlib.blake2b(one.tobytes() + two.tobytes(), digest_size=16).digest()


def word_shingles(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    """The set itself: ASCII letters folded, split at ASCII white space."""
    words = text.lower().split()
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else {tuple(words)} - {()}


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` registers (uint16) of a non-empty set of hashes."""
    least = np.full(m, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        block = hashes[None, i : i + 2048] ^ _XOR[:m]
        block *= _MUL[:m]
        np.minimum(least, block.min(axis=1), out=least)
    x = -np.log1p(-np.clip(least.astype(np.float64) * 2.0**-64, 2.0**-65, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 101) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of register rows ``a`` and ``b`` whose set sizes are known."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, grid)[None, :] * most

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    fit = more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))
    best = np.argmax(fit, axis=1)
    return j[np.arange(len(best)), best]


_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64())), ("registers", pa.binary())])


def text_key() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key, n_shingles, set_hash, band keys and registers; nulls where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(bands, dtype=np.uint64)
        for rb in batches:
            out: dict[str, list] = {"n_shingles": [], "set_hash": [], "bands": [], "registers": []}
            for s, digest in shingle_sets(bytes_of(rb.column("text")), n):
                out["n_shingles"].append(len(s))
                out["set_hash"].append(digest)
                if not len(s):
                    for k in ("bands", "registers"):
                        out[k].append(None)
                    continue
                r = registers(s, bands * rows)
                wide = r.reshape(bands, rows).astype(np.uint64)
                out["bands"].append(signed(mix64(fold_rows(wide) + salt * np.uint64(0x9E3779B97F4A7C15))))
                out["registers"].append(r.tobytes())
            yield record_batch({"doc_id": rb.column("doc_id"), "text_key": rb.column("text_key"), **out}, _SKETCH)

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(tidied(run), "doc_id long, text_key long, n_shingles long, set_hash binary, bands array<long>, registers binary")


def fold_rows(wide: np.ndarray) -> np.ndarray:
    out = np.zeros(len(wide), np.uint64)
    for k in range(wide.shape[1]):
        out = out * np.uint64(0xA0761D6478BD642F) + wide[:, k] + np.uint64(1)
    return mix64(out)


def _likely(pairs: DataFrame, classes: DataFrame, m: int, least: float) -> DataFrame:
    """Candidate pairs (a, b) that may be links by set sizes and the registers' likelihood."""
    one = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            r_a, r_b = (np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in ("r_a", "r_b"))
            n_a, n_b = (rb.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = np.zeros(rb.num_rows, bool)
            for i in range(0, rb.num_rows, 4096):
                k = slice(i, i + 4096)
                keep[k] = likely_jaccard(r_a[k], r_b[k], n_a[k], n_b[k]) >= least
            yield rb.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(one, "a").join(two, "b").mapInArrow(tidied(run), "a long, b long")


def _members(docs: DataFrame, classes: DataFrame, reps: DataFrame, n: int, texts: bool) -> DataFrame:
    """(rep, value) of the classes ``reps`` (rep): the text of the class's first document, or
    its sorted shingle hashes. Documents are found through a bitmap of fixed size."""
    wanted = classes.join(reps, "rep", "left_semi").select("rep", "set_hash", F.col("first.doc_id").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data = bytes_of(rb.column("text"))
            found = list(shingle_sets(data, n))
            values = data if texts else [s.tobytes() for s, _ in found]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array([d for _, d in found], pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "set_hash", "value"])

    read = likely_rows(docs, wanted.select("doc_id")).mapInArrow(tidied(run), "doc_id long, set_hash binary, value binary")
    return read.join(wanted, ["doc_id", "set_hash"]).select("rep", "value").dropDuplicates(["rep"])


#: Words whose sets a verifying task keeps for the next pairs.
KEPT_WORDS = 1 << 21


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs whose full sets of word shingles reach the threshold."""
    full = materialize(_members(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("rep")), n, True), "candidate-texts")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, set] = {}
        size = 0
        for rb in batches:
            keep = []
            for a, b, x, y in zip(rb.column("a").to_pylist(), rb.column("b").to_pylist(), rb.column("t_a"), rb.column("t_b"), strict=True):
                if size > KEPT_WORDS:
                    sets, size = {}, 0
                for rep, t in ((a, x), (b, y)):
                    if rep not in sets:
                        sets[rep] = word_shingles(t.as_py(), n)
                        size += len(sets[rep])
                common = len(sets[a] & sets[b])
                keep.append(100 * common >= percent * (len(sets[a]) + len(sets[b]) - common))
            yield rb.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = full.select(F.col("rep").alias("a"), F.col("value").alias("t_a"))
    two = full.select(F.col("rep").alias("b"), F.col("value").alias("t_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(tidied(confirm), "a long, b long")


def _cross(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs of rows of one key that are in different components."""
    one = rows.select(key, F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    two = rows.select(key, F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    similar = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    return one.join(two, (one[key] == two[key]) & (F.col("c_a") < F.col("c_b")) & similar).select("a", "b", "n_a", "n_b")


def _block_links(docs: DataFrame, classes: DataFrame, hot: DataFrame, percent: int, n: int) -> DataFrame:
    """Links between different components among members of large buckets, found in blocks.

    Members that large buckets connect are laid out in blocks of about ``BLOCK`` sets, those
    of one bucket together; a bucket beyond that is dealt to several blocks. Two blocks
    are compared if a set of one shares a prefix shingle with a set of the other: in any
    common order of all shingles, sets with 100 * |A and B| >= percent * |A or B| share
    one of their first n - ceil(n * percent / 100) + 1, and here rare ones come first, so
    a passage that many texts hold brings none of them together. A task holds two blocks
    and returns links that join all components it can join, none between ones it has joined:
    less than one per component, however large a group of copies is.
    """
    stars = hot.join(hot.groupBy("key").agg(F.min("rep").alias("u")), "key").select("u", F.col("rep").alias("v"))
    cluster = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = materialize(hot.groupBy("rep", "component").agg(F.min("key").alias("key")).join(cluster, "rep"), "hot-clusters")
    by_key = members.groupBy("cluster", "key").agg(F.count("*").alias("of_key"))
    by_cluster = by_key.groupBy("cluster").agg(F.sum("of_key").alias("of_cluster"))

    def part(value: Column, size: str) -> Column:
        return F.pmod(value, F.ceil(F.col(size) / BLOCK).cast("long"))

    sizes = by_key.join(by_cluster, "cluster")
    block = F.when(F.col("of_key") > BLOCK, F.xxhash64("cluster", "key", part(F.xxhash64("rep"), "of_key"))).otherwise(F.xxhash64("cluster", part(F.xxhash64("key"), "of_cluster")))
    members = materialize(members.join(sizes, ["cluster", "key"]).select("rep", "component", block.alias("block")), "hot-members")
    sets = _members(docs, classes, members.select("rep"), n, False).withColumnRenamed("value", "shingles")
    sets = materialize(members.join(sets, "rep"), "hot-sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for rb in batches:
            for x in rb.column("shingles"):
                np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    often = np.zeros(SLOTS, np.int64)  # of fixed size, whatever the input
    used = sets.mapInArrow(tidied(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often[used.column("slot").to_numpy()] = used.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            parts = []
            for x in rb.column("shingles"):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                keep = len(s) + (-len(s) * percent // 100) + 1
                parts.append(s[np.lexsort((s, shared.value[(s % np.uint64(SLOTS)).astype(np.int64)]))[:keep]])
            if parts:
                blocks = np.repeat(rb.column("block").to_numpy(), np.array([len(k) for k in parts], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(parts))), pa.array(blocks)], names=["shingle", "block"])

    in_block = sets.select("block", "shingles").mapInArrow(tidied(prefixes), "shingle long, block long").distinct()
    one, two = in_block.select("shingle", F.col("block").alias("i")), in_block.select("shingle", F.col("block").alias("j"))
    tasks = one.join(two, (one["shingle"] == two["shingle"]) & (F.col("i") <= F.col("j"))).select("i", "j").distinct()
    left = sets.join(tasks, sets["block"] == tasks["i"]).withColumn("side", F.lit(0))
    right = sets.join(tasks.where("i < j"), F.col("block") == F.col("j")).withColumn("side", F.lit(1))

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep, component = table.column("rep").to_numpy(), table.column("component").to_numpy()
        values = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(v) for v in values])
        ours = np.flatnonzero(side == 0)
        theirs = np.flatnonzero(side == 1) if (side == 1).any() else ours
        owner = np.repeat(np.arange(len(theirs)), sizes[theirs])
        flat = np.concatenate([values[i] for i in theirs])
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        links: list[tuple[int, int]] = []
        _, part = np.unique(component, return_inverse=True)  # parts become one as links are found
        for i in ours.tolist():
            lo = np.searchsorted(flat, values[i], "left")
            hits = np.bincount(owner[ranges(lo, np.searchsorted(flat, values[i], "right") - lo)], minlength=len(theirs))
            reached = theirs[(100 * hits >= percent * (sizes[i] + sizes[theirs] - hits)) & (part[theirs] != part[i])]
            others, first = np.unique(part[reached], return_index=True)
            links += [(int(rep[i]), int(r)) for r in rep[reached[first]]]
            part[np.isin(part, others)] = part[i]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    columns = ("i", "j", "side", "rep", "component", "shingles")
    return left.select(*columns).unionByName(right.select(*columns)).groupBy("i", "j").applyInArrow(tidied_group(compare), "a long, b long")


def _grouped(docs: DataFrame, percent: int, bands: int, rows: int, n: int) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles and ``chosen``, the (doc_id, text_key) that stands for its
    group; null where the row is linked with nothing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch() as keep:
        sketched = keep(materialize(sketches(docs, bands, rows, n), "sketches"))
        full = sketched.where("n_shingles > 0 and doc_id is not null")
        size_ok = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
        made = full.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
        classes = keep(materialize(made.withColumn("rep", F.monotonically_increasing_id()), "classes"))
        row = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
        hubs = row.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
        shared = materialize(row.join(hubs, "key"), "buckets")  # rows of buckets with several classes

        def links(pairs: DataFrame) -> DataFrame:
            with scratch() as hold:
                likely = materialize(_likely(pairs, classes, bands * rows, percent / 100 - SLACK), "likely")
                return hold(materialize(_verified(likely, docs, classes, percent, n), "links"))

        edges = [links(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())]
        turn, before, label = 0, None, None
        while True:
            # what earlier links have joined goes on as labels; only new links are added to them
            new = [e.select(F.col("a").alias("u"), F.col("b").alias("v")) for e in edges]
            joined = new if label is None else [*new, label.select(F.col("node").alias("u"), F.col("component").alias("v"))]
            label = components(reduce(DataFrame.unionByName, joined))
            if turn < 0:
                break
            labelled = shared.drop("hub").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
            mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
            still = materialize(labelled.join(mixed, "key"), "mixed")
            hot = still.where(F.col("size") > SMALL_BUCKET)
            n_hot, members = hot.agg(F.count("*"), F.approx_count_distinct("rep")).first()
            edges = []
            if members > FEW_HOT and (before is None or n_hot * 2 < before):
                centre = hot.groupBy("key").agg(F.min_by(F.struct("rep", "component", "n"), F.xxhash64("rep", F.lit(turn))).alias("h"))
                pairs = hot.join(centre, "key").where(F.col("component") != F.col("h.component")).select(F.col("h.rep").alias("a"), F.col("rep").alias("b"), F.col("h.n").alias("n_a"), F.col("n").alias("n_b"))
                turn, before = turn + 1, n_hot
            else:
                pairs = _cross(still.where(F.col("size") <= SMALL_BUCKET), "key", percent)
                if n_hot:
                    found = materialize(_block_links(docs, classes, hot, percent, n).distinct(), "block-links")
                    edges.append(materialize(_verified(found, docs, classes, percent, n), "links"))
                turn = -1
            edges.append(links(pairs.where(size_ok).select("a", "b").distinct()))
        keep(label)
    least = label.join(classes.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    chosen = label.join(least, "component").select(F.col("node").alias("rep"), "least")
    groups = classes.select("set_hash", "rep", "first").join(chosen, "rep", "left").select("set_hash", F.coalesce("least", "first").alias("chosen"))
    found = sketched.select("doc_id", "text_key", "n_shingles", "set_hash").join(groups, "set_hash", "left")
    return found.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("chosen")).alias("chosen"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE_WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    least = F.coalesce("chosen.doc_id", "doc_id")
    return _grouped(docs, percent, bands, rows, n).select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = STAGE_PERCENT, bands: int = STAGE_BANDS, n: int = STAGE_WORDS) -> DataFrame:
    """The rows that stay: one of each near-duplicate group."""
    ident = {"__near_doc_id": F.col("doc_id").cast("long"), "__near_text_key": text_key()}
    grouped = _grouped(docs, percent, bands, ROWS, n).where("chosen is not null")
    own = (F.col("doc_id") == F.col("chosen.doc_id")) & (F.col("text_key") == F.col("chosen.text_key"))
    by_row = grouped.groupBy(*[F.col(c).alias(k) for c, k in zip(("doc_id", "text_key"), ident, strict=True)]).agg(F.bool_and(own).alias("stays"), F.count("*").alias("n"))
    marked = materialize(by_row.where("not stays or n > 1"), "near-decisions")
    keys = list(ident)
    rows = docs.withColumns(ident).join(marked.where("not stays").select(*keys), keys, "left_anti")
    if not (again := marked.where("stays").select(*keys)).isEmpty():  # rows repeated whole
        rows = rows.join(again, keys, "left_anti").unionByName(rows.join(again, keys, "left_semi").dropDuplicates(keys))
    return rows.select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.node WHERE r.c < e.y),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""
