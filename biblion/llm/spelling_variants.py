"""Spelling variant grouping by full neighbourhood generation.

Vocabulary: runs of letters of all texts, A-Z lower-cased, of at least ``MIN_CHARS`` code points
and ``MIN_COUNT`` occurrences. Every word emits all its distinct neighbours: one code point
deleted, replaced or inserted, over the alphabet that the vocabulary shows. Neighbours are
joined with the vocabulary by the word itself, so what joins is near by construction and no
distance is computed.

A word of eight letters has about 900 neighbours and few of them are words. A task therefore
makes them as numbers first: the hash of a word is a sum over its places, so the hash of a
neighbour follows from sums of the word's head and tail in a few vector operations. Hashes
are looked up in a broadcast filter of two bits a word (``FILTER_BITS`` at most, 128 MB;
beyond some 10**8 words it lets more neighbours pass, never fewer); only neighbours that it
lets pass become strings and go to the join, which decides. Each distinct neighbour of a word is made
once: of equal deletions and insertions in a run of one letter, only the first.

A word's form is its most frequent neighbour (ties: least in code-point order) if that has at
least ``RATIO`` times its count. Counts grow along forms, so a chain of forms has at most
log2(largest count) links; roots are found by doubling them, a table each round.

Defined cases: null texts have no words; a null doc_id counts as the empty string; rows
repeated whole count as often as they come; empty tables give empty results; other columns
are ignored. Every ``THIN``-th run (by crc32 of doc_id and run) loses a letter, as ``words`` states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, scratch, tidied, tidied_group

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THIN, MIN_CHARS, MIN_COUNT, RATIO = 97, 5, 3, 2
#: Bits of the filter: 64 a word, between these bounds. It is made in parts of ``PART_BITS``.
LEAST_BITS, FILTER_BITS, PART_BITS = 1 << 20, 1 << 30, 1 << 20
#: Neighbours that one numpy pass makes.
PASS = 1 << 20

_PLACE = 0xA0761D6478BD642F | 1
_BACK = np.uint64(pow(_PLACE, -1, 1 << 64))


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the vocabulary with its counts.

    A run whose crc32 of "<doc_id>:<run>" ``THIN`` divides is counted without its code point
    number crc32 modulo its length.
    """
    run = F.col("run")
    low = F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= MIN_CHARS).select("doc_id", low.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc_id", "run")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    made = runs.select(F.when(F.pmod("h", F.lit(THIN)) == 0, cut).otherwise(run).alias("word")).where(F.char_length("word") >= MIN_CHARS)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _values(codes: np.ndarray) -> np.ndarray:
    """A hash of each code point."""
    return mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_PLACE, i, 1 << 64) for i in range(n)], np.uint64)


def _by_length(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points as a matrix) of the words of each length."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, np.frombuffer("".join(found[i] for i in at.tolist()).encode("utf-32-le"), np.uint32).reshape(len(at), n)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length: sums of code points' hashes times a power of their place."""
    return (_values(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def neighbour_hashes(codes: np.ndarray, alphabet: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """(hashes, which of them are distinct neighbours) of deletions (words, places), replacements and
    insertions (words, places, letters) of words of one length."""
    n_words, n = codes.shape
    power, value, letter = _powers(n + 1), _values(codes), _values(alphabet)
    term = value * power[:n]
    head = np.concatenate((np.zeros((n_words, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)), axis=1)
    whole = head[:, -1:]
    tail = whole - head
    again = codes[:, 1:] == codes[:, :-1]
    deleted = head[:, :n] + tail[:, 1:] * _BACK
    first = np.concatenate((np.ones((n_words, 1), bool), ~again), axis=1)
    replaced = (whole - term)[:, :, None] + (letter[None, :] * power[:n, None])[None]
    other = codes[:, :, None] != alphabet
    inserted = (head + tail * np.uint64(_PLACE))[:, :, None] + (letter[None, :] * power[:, None])[None]
    new = np.concatenate((np.ones((n_words, 1, len(alphabet)), bool), other), axis=1)
    return (deleted, first), (replaced, other), (inserted, new)


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for a hash."""
    mixed = mix64(hashes)
    return mixed & np.uint64(bits - 1), (mixed >> np.uint64(32)) & np.uint64(bits - 1)


def _filter(vocabulary: DataFrame, n_words: int) -> np.ndarray:
    """The bytes of the filter of all words; at most ``FILTER_BITS`` bits come to the driver."""
    bits = min(FILTER_BITS, max(LEAST_BITS, 1 << (64 * n_words - 1).bit_length()))
    schema = "part int, bytes binary"

    def packed(slots: np.ndarray) -> Iterator[tuple[int, bytes]]:
        part = (slots // np.uint64(PART_BITS)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for p, at in zip(*np.unique(part[order], return_index=True), strict=True):
            on = np.zeros(PART_BITS, bool)
            on[(slots[order[at : at + np.count_nonzero(part == p)]] % np.uint64(PART_BITS)).astype(np.int64)] = True
            yield int(p), np.packbits(on, bitorder="little").tobytes()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                slots = np.concatenate([s for _, codes in _by_length(rb.column("word").to_pylist()) for s in _slots(word_hashes(codes), bits)])
                for p, blob in packed(slots):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], names=["part", "bytes"])

    def united(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bytes")])
        return pa.table({"part": table.column("part")[:1], "bytes": pa.array([out.tobytes()], pa.binary())})

    made = vocabulary.select("word").mapInArrow(tidied(mark), schema).groupBy("part").applyInArrow(tidied_group(united), schema).toArrow()
    whole = np.zeros((bits // PART_BITS, PART_BITS // 8), np.uint8)
    for p, blob in zip(made.column("part").to_pylist(), made.column("bytes"), strict=True):
        whole[p] = np.frombuffer(blob.as_buffer(), np.uint8)
    return whole.reshape(-1)


def candidates(vocabulary: DataFrame, n_words: int, alphabet: str) -> DataFrame:
    """(word, near): every distinct neighbour of every word, but for those that the filter shows to be no word."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(_filter(vocabulary, n_words))
    letters = np.array([ord(c) for c in alphabet], np.uint32)

    def lit(slot: np.ndarray) -> np.ndarray:
        return (shared.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def passing(hashes: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` of neighbours whose two bits are on."""
        at = np.flatnonzero(ok)
        one, two = _slots(hashes.reshape(-1)[at], 8 * len(shared.value))
        on = lit(one)
        at, two = at[on], two[on]
        return at[lit(two)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            listed = rb.column("word").to_pylist()
            for at, codes in _by_length(listed):
                n = codes.shape[1]
                step = max(1, PASS // ((n + 1) * (len(letters) + 1)))
                for i in range(0, len(at), step):
                    own, near = [], []
                    ways = neighbour_hashes(codes[i : i + step], letters)
                    for kind, (hashes, ok) in enumerate(ways):
                        where = np.unravel_index(passing(hashes, ok), hashes.shape)
                        for w, p, *a in zip(*(x.tolist() for x in where), strict=True):
                            word = listed[at[i + w]]
                            own.append(word)
                            near.append(word[:p] + (alphabet[a[0]] if a else "") + word[p + (kind < 2) :])
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(near, pa.string())], names=["word", "near"])

    return vocabulary.select("word").mapInArrow(tidied(run), "word string, near string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to."""
    way = materialize(forms.select("word", F.col("form").alias("root")), "forms-0")
    turn = 0
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        turn += 1
        longer = way.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = materialize(longer, f"forms-{turn}")
        if not longer.where("moved").limit(1).count():
            return longer
        way = longer.drop("moved")


def group_variants(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    with scratch() as keep:
        vocabulary = materialize(words(docs), "vocabulary")
        n_words = vocabulary.count()
        letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
        alphabet = "".join(sorted(r["c"] for r in letters.collect()))  # of the letters that ``RUN`` allows
        known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
        near = candidates(vocabulary, n_words, alphabet).join(known, "near")
        best = near.select("word", F.struct((-F.col("near_n")).alias("less"), "near").alias("best"), F.lit(None).cast("long").alias("n"), F.lit(1).cast("long").alias("one"))
        own = vocabulary.select("word", F.lit(None).cast(best.schema["best"].dataType).alias("best"), "n", F.lit(0).cast("long").alias("one"))
        found = best.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.sum("one").alias("n_near"), F.min("best").alias("best"))
        enough: Column = -F.col("best.less") >= RATIO * F.col("n")
        found = keep(materialize(found.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "variants"))
        roots = keep(_roots(found.where("form is not null"))).drop("moved")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = rf"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS m, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM r WHERE length(run) >= {MIN_CHARS} GROUP BY 1, 2),
b AS (SELECT run, m, [4294967295] || list_transform(range(0, octet_length(encode(s))), lambda j: CAST('0x' || substr(hex(s), 2 * j + 1, 2) AS BIGINT)) AS bytes FROM k),
h AS (SELECT run, m, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % {THIN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= {MIN_CHARS} GROUP BY 1 HAVING sum(m) >= {MIN_COUNT}),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM g a JOIN g b USING (i, rest) WHERE a.word <> b.word
      UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.rest
      UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.rest),
q AS (SELECT x, count(*) AS n_near, first(y ORDER BY m DESC, y) AS y, max(m) AS m FROM p GROUP BY x),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN y END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM v LEFT JOIN q ON x = word),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f e ON e.word = c.at AND e.form IS NULL"""
