"""Language-model scoring by deleted interpolation.

Tokens: runs of non-white-space characters with A-Z lower-cased, then one end token. The
model interpolates maximum-likelihood estimates from the top down: a trigram estimate with
what bigram, unigram and uniform estimates make together,

    p = t * c(u v w) / c(u v) + (1 - t) * (b * c(v w) / c(v) + a * c(w) / N + (1 - a - b) / (V + 1)).

t depends on the frequency bucket of the context u v, a and b on that of v. All are learned
by expectation maximisation on held-out counts: each training token is scored with its own
occurrence deleted from all counts (leave one out), over the whole training part; first the
lower part, then t given that. A text's first token has no trigram beyond its bigram.

How it scales. Texts are packed into blocks of a few MB. A block asks for the corpus counts
of its n-grams and learns them in its own order (``tally``): no table of counts is ever
broadcast, no row per token is shuffled, and a frequent n-gram never brings all blocks to
one task. Trigrams are asked for in a second turn, and only where both of their bigrams stand
twice or more in all texts; any other trigram is the only one of its kind. For the weights,
tokens fall into a fixed grid of cells (context bucket by quantised probabilities), whose
totals are all that the driver sees.

Defined cases: null text is empty (one end token); tokens never seen in training have count
0; without any training text all counts are 0 and the model is uniform; repeated rows
count as often as they occur; rows without doc_id are not trained on and are held out; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tally
from .common import SPACED, WordBatch, bytes_of, chunks, materialize, mix64, record_batch, scratch, tidied

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Arrow batches of blocks with their answers, some MB a row: a task holds about one block at a time.
BATCH_BYTES = 4 << 20
#: Context frequencies have a bucket each up to this, then one for each doubling.
SINGLE_COUNTS = 8
CONTEXT_BUCKETS = 40
EM_ROUNDS = 60
#: Quantisation of probabilities for EM: half octaves down to 2**-20 and 2**-32, and zero.
CELLS_2, CELLS_1 = 42, 66

_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_FOLD = np.uint64(0xA0761D6478BD642F)
_codec = pa.Codec("zstd", compression_level=5)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _expand(blob: bytes) -> bytes:
    return _codec.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)


def _numbers(x: np.ndarray) -> bytes:
    return _squeeze(tally.planes(np.asarray(x, np.int64)))


def _read_numbers(blob: bytes) -> np.ndarray:
    return tally.from_planes(_expand(blob)).view(np.int64)


def _blocks(docs: DataFrame, training: Column) -> DataFrame:
    """Rows of many documents each: block_id, ids, flags (1: training, 2: no doc_id), text sizes, texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, texts, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            own = [t for t, f in zip(texts, flags, strict=True) if f & 1]
            words = sum(len(t.split()) for t in own)  # bytes split at ASCII white space, as SPACED does
            columns = (sum(map(len, texts)), len(own), words, np.array(ids, np.int64).tobytes(), np.array(flags, np.uint8).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), _squeeze(b"".join(texts)))
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()] * 4, strict=True)], names=["n_bytes", "n_training", "n_words", "ids", "flags", "sizes", "texts"])

        for rb in batches:
            for i, f, t in zip(rb.column("doc_id").to_pylist(), rb.column("training").to_pylist(), bytes_of(rb.column("text")), strict=True):
                ids.append(i or 0)
                flags.append(bool(f) + 2 * (i is None))
                texts.append(t)
                size += len(t) + 8
                if size >= BLOCK_BYTES:
                    yield row()
                    ids, flags, texts, size = [], [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    return rows.mapInArrow(tidied(run), "n_bytes long, n_training long, n_words long, ids binary, flags binary, sizes binary, texts binary").withColumn("block_id", F.monotonically_increasing_id())


class Tokens:
    """Token hashes of a block: n-gram keys per token, and each text's first token."""

    def __init__(self, sizes: bytes, texts: bytes):
        raw, n = _expand(texts), np.frombuffer(sizes, np.int64)
        ends = np.cumsum(n)
        items = [raw[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        words, counts = [], []
        for lo, hi in chunks(items):
            batch = WordBatch(items[lo:hi], SPACED)
            words.append(batch.hashes)
            counts.append(np.diff(batch.first))
        count = np.concatenate(counts)
        self.first = np.concatenate(([0], np.cumsum(count + 1)))
        token = np.full(self.first[-1], _END)
        inside = np.ones(len(token), bool)
        inside[self.first[1:] - 1] = False
        token[inside] = np.concatenate(words)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first[:-1]] = _START
        self.unigram = token | tally.TYPE_BIT
        self.bigram = mix64(before * _FOLD + token) & ~tally.TYPE_BIT
        self.text_of = np.repeat(np.arange(len(count)), count + 1)
        self.inner = np.ones(len(token), bool)  # not the first of its text
        self.inner[self.first[:-1]] = False

    def trigrams(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token numbers, keys) of the trigrams whose two bigrams stand several times."""
        at = np.flatnonzero(self.inner & often & np.roll(often, 1))
        return at, mix64(self.bigram[at - 1] * _FOLD + self.unigram[at]) & ~tally.TYPE_BIT

    def training(self, flags: bytes) -> np.ndarray:
        return (np.frombuffer(flags, np.uint8) & 1)[self.text_of] > 0

    def contexts(self, counts: np.ndarray, first: int) -> np.ndarray:
        """Counts of what stands before each token; ``first`` at the begin of a text."""
        out = np.empty_like(counts)
        out[1:] = counts[:-1]
        out[self.first[:-1]] = first
        return out


def _ask_pairs(blocks: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Requests for unigrams and bigrams: how often they stand in training texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for block_id, flags, sizes, texts in zip(*(rb.column(c).to_pylist() for c in ("block_id", "flags", "sizes", "texts")), strict=True):
                t = Tokens(sizes, texts)
                keys = tally.Keys(np.concatenate((t.unigram, t.bigram)), buckets)
                own = np.tile(t.training(flags), 2)
                yield tally.request_batch(keys.requests(block_id, [np.bincount(keys.place[own], minlength=len(keys)), np.bincount(keys.place, minlength=len(keys))], parts))

    return blocks.select("block_id", "flags", "sizes", "texts").mapInArrow(tidied(run), tally.REQUEST)


def _ask_trigrams(paired: DataFrame, buckets: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for block_id, flags, sizes, texts, often in zip(*(rb.column(c).to_pylist() for c in ("block_id", "flags", "sizes", "texts", "often")), strict=True):
                t = Tokens(sizes, texts)
                at, key = t.trigrams(np.unpackbits(np.frombuffer(often, np.uint8), count=len(t.unigram)) > 0)
                keys = tally.Keys(key, buckets)
                yield tally.request_batch(keys.requests(block_id, [np.bincount(keys.place[t.training(flags)[at]], minlength=len(keys))], parts))

    return paired.select("block_id", "flags", "sizes", "texts", "often").mapInArrow(tidied(run), tally.REQUEST)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: small counts have their own, larger ones share octaves."""
    context = np.maximum(context, 0)
    octave = np.log2(np.maximum(context, SINGLE_COUNTS) / SINGLE_COUNTS).astype(np.int64)
    return np.minimum(np.where(context < SINGLE_COUNTS, context, SINGLE_COUNTS + octave), CONTEXT_BUCKETS - 1).astype(np.int64)


def _cell(context: np.ndarray, count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Cell of (context bucket, estimate count / context, lower-order probability)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        high = np.where((count > 0) & (context > 0), np.clip(np.round(-2 * np.log2(count / np.maximum(context, 1))), 0, CELLS_2 - 2), CELLS_2 - 1)
        low = np.where(lower > 0, np.clip(np.round(-2 * np.log2(lower)), 0, CELLS_1 - 2), CELLS_1 - 1)
    return ((bucket_of(context) * CELLS_2 + high) * CELLS_1 + low).astype(np.int64)


def learn_weights(cells: dict[int, float], floor: float | None, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights of each bucket by EM over cell totals: of the estimate, the lower-order
    probability and, where ``floor`` is given, a constant probability."""
    index = np.fromiter(cells, np.int64, len(cells))
    mass = np.fromiter(cells.values(), float, len(cells))
    bucket, high, low = index // (CELLS_1 * CELLS_2), index // CELLS_1 % CELLS_2, index % CELLS_1
    parts = [np.where(high < CELLS_2 - 1, 2.0 ** (-high / 2), 0), np.where(low < CELLS_1 - 1, 2.0 ** (-low / 2), 0)]
    if floor is not None:
        parts.append(np.full(len(index), floor))
    p = np.stack(parts, 1)
    prior = np.array([0.1, 0.2, 0.2][: p.shape[1]])  # keeps each part alive where a bucket has next to no data
    weights = np.tile(prior / prior.sum(), (CONTEXT_BUCKETS, 1))
    for _ in range(rounds if len(index) else 0):
        share = weights[bucket] * p
        share *= (mass / np.maximum(share.sum(1), 1e-300))[:, None]
        total = np.stack([np.bincount(bucket, weights=share[:, k], minlength=CONTEXT_BUCKETS) for k in range(p.shape[1])], 1) + prior
        weights = total / total.sum(1, keepdims=True)
    weights[0, 1:] /= weights[0, 1:].sum()  # an unseen context has no estimate
    weights[0, 0] = 0
    return weights


def lower_order(weights: np.ndarray, context: np.ndarray, pair: np.ndarray, word: np.ndarray, n: float, types: int) -> np.ndarray:
    """Probability by bigram, unigram and uniform estimates."""
    w = weights[bucket_of(context)]
    return w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (word / max(n, 1)) + w[:, 2] / (types + 1)


def _paired(joined: DataFrame, n: int, ends: int, buckets: int) -> DataFrame:
    """Blocks with the corpus counts of their tokens and bigrams, which bigrams stand several times, and EM cells."""
    names = ["block_id", "ids", "flags", "sizes", "texts", "words", "pairs", "often", "cells", "mass"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for block_id, ids, flags, sizes, texts, answers in zip(*(rb.column(c).to_pylist() for c in ("block_id", "ids", "flags", "sizes", "texts", "answers")), strict=True):
                t = Tokens(sizes, texts)
                keys = tally.Keys(np.concatenate((t.unigram, t.bigram)), buckets)
                total, everywhere = keys.totals(answers, 2)
                size = len(t.unigram)
                word, pair, often = total[keys.place[:size]], total[keys.place[size:]], everywhere[keys.place[size:]] > 1
                context, own = t.contexts(word, ends), t.training(flags)
                cell, mass = np.unique(_cell(context[own] - 1, pair[own] - 1, (word[own] - 1) / max(n - 1, 1)), return_counts=True)
                columns = (block_id, ids, flags, sizes, texts, _numbers(word), _numbers(pair), np.packbits(often).tobytes(), cell.tolist(), mass.tolist())
                yield pa.RecordBatch.from_arrays([pa.array([c], x) for c, x in zip(columns, (pa.int64(), *[pa.binary()] * 7, pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=names)

    return joined.mapInArrow(tidied(run), "block_id long, ids binary, flags binary, sizes binary, texts binary, words binary, pairs binary, often binary, cells array<long>, mass array<long>")


def _counted(joined: DataFrame, weights: np.ndarray, n: int, types: int, ends: int, buckets: int) -> DataFrame:
    """Blocks with all counts that scoring needs, and EM cells of the trigram estimate against the lower orders."""
    names = ["ids", "flags", "first", "words", "pairs", "triples", "cells", "mass"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for ids, flags, sizes, texts, words, pairs, often, answers in zip(*(rb.column(c).to_pylist() for c in ("ids", "flags", "sizes", "texts", "words", "pairs", "often", "answers")), strict=True):
                t = Tokens(sizes, texts)
                word, pair, own = _read_numbers(words), _read_numbers(pairs), t.training(flags)
                at, key = t.trigrams(np.unpackbits(np.frombuffer(often, np.uint8), count=len(word)) > 0)
                keys = tally.Keys(key, buckets)
                triple = own.astype(np.int64)  # one that no other token has
                triple[at] = keys.totals(answers or [], 1)[0][keys.place]
                triple[~t.inner] = pair[~t.inner]
                context, wide = t.contexts(word, ends), t.contexts(pair, ends)
                low = lower_order(weights, context[own] - 1, pair[own] - 1, word[own] - 1, n - 1, types)
                cell, mass = np.unique(_cell(wide[own] - 1, triple[own] - 1, low), return_counts=True)
                columns = (ids, flags, t.first.tobytes(), words, pairs, _numbers(triple), cell.tolist(), mass.tolist())
                yield pa.RecordBatch.from_arrays([pa.array([c], x) for c, x in zip(columns, (*[pa.binary()] * 6, pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=names)

    return joined.mapInArrow(tidied(run), "ids binary, flags binary, first binary, words binary, pairs binary, triples binary, cells array<long>, mass array<long>")


def _grid(counted: DataFrame) -> dict[int, float]:
    """Totals of the cells: at most buckets * cells rows, whatever the input."""
    grid = counted.select(F.explode(F.arrays_zip("cells", "mass")).alias("x")).groupBy(F.col("x.cells").alias("cell")).agg(F.sum("x.mass").alias("mass"))
    return {r["cell"]: float(r["mass"]) for r in sorted(grid.collect())}


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, training: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: doc_id, held_out (not training), n_tokens, n_known, train_tokens,
    base_score (add-half unigrams) and score (log10 probability under the interpolated model)."""

    def by_block(answers: DataFrame) -> DataFrame:
        return answers.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "totals")).alias("answers"))

    with scratch() as keep:
        with scratch() as hold:
            blocks = materialize(_blocks(docs, training), "lm-blocks")
            sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_bytes", "n_training", "n_words")]
            size = blocks.agg(F.count("*").alias("blocks"), *sums).first()
            buckets, parts = max(12, -(-size["n_bytes"] // bucket_bytes)), tally.parts_for(size["blocks"])
            ends = size["n_training"]  # each training text has one end token, and one start
            answers = materialize(tally.totals(_ask_pairs(blocks, buckets, parts), buckets, parts, 2), "lm-pairs", BATCH_BYTES)
            v = answers.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()["v"]
            n = ends + size["n_words"]
            paired = hold(materialize(_paired(blocks.join(by_block(answers), "block_id"), n, ends, buckets), "lm-paired", BATCH_BYTES))
        weights = learn_weights(_grid(paired), 1 / (v + 1))
        answers = materialize(tally.totals(_ask_trigrams(paired, buckets, parts), buckets, parts, 1), "lm-triples", BATCH_BYTES)
        joined = paired.drop("cells", "mass").join(by_block(answers), "block_id", "left")
        counted = keep(materialize(_counted(joined, weights, n, v, ends, buckets), "lm-counted", BATCH_BYTES))
    top = learn_weights(_grid(counted), None)[:, 0]
    floor = n + 0.5 * (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for ids, flags, first, words, pairs, triples in zip(*(rb.column(c).to_pylist() for c in ("ids", "flags", "first", "words", "pairs", "triples")), strict=True):
                at = np.frombuffer(first, np.int64)
                begin = at[:-1]
                word, pair, triple = map(_read_numbers, (words, pairs, triples))
                context, wide = np.empty_like(word), np.empty_like(word)
                context[1:], wide[1:] = word[:-1], pair[:-1]
                context[begin] = wide[begin] = ends
                t = top[bucket_of(wide)]
                p = t * (triple / np.maximum(wide, 1)) + (1 - t) * lower_order(weights, context, pair, word, n, v)
                columns = {
                    "doc_id": pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(flags, np.uint8) > 1),
                    "held_out": np.frombuffer(flags, np.uint8) & 1 == 0,
                    "n_tokens": np.diff(at),
                    "n_known": np.add.reduceat((word > 0).astype(np.int64), begin),
                    "train_tokens": np.full(len(begin), n),
                    "base_score": np.add.reduceat(np.log10((word + 0.5) / floor), begin),
                    "score": np.add.reduceat(np.log10(p), begin),
                }
                yield record_batch(columns, _SCORED)

    return counted.select("ids", "flags", "first", "words", "pairs", "triples").mapInArrow(tidied(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
