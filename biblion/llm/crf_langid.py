"""Language identification by a linear-chain conditional random field over words.

Words are letter runs of the lower-cased text, wrapped in boundary marks. Emission features
are hashed byte n-grams of 1 to 4 (with a mark they are prefixes and suffixes) and the word
itself (a lexicon); transitions between word labels are learned. Forward-backward gives
each word's label posteriors, so words of code-switched text are labelled one by one; a
document's language is the label with the largest mean posterior, its score that mean.

Training uses a bounded sample (``sample_rows``, chosen by a hash of doc_id, and ``SAMPLE_BYTES``)
of the rows given, chains of ``CHAIN`` words, some spliced from two languages so that switches
are seen. Prediction reads whole texts, chain by chain, vectorised over all chains of a batch.

Defined cases: null text, or text without a letter (Unicode category L): ``und``, score 0; no
training rows: ``und`` for all; rows without doc_id are never learned from, and count as held
out; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LETTERS, WordBatch, chunks, folded_bytes, mix64, record_batch, tidied

SAMPLE_ROWS = 1500
#: Bytes of text in the sample, shared evenly between languages, and of one row, unless a
#: language has no shorter one: then one of its rows is taken whatever its size.
SAMPLE_BYTES, ROW_BYTES = 32 << 20, 1 << 20
CHAIN = 48
SLOT_BITS = 18
ORDERS = (1, 2, 3, 4)
EPOCHS = 30
SPLICED = 0.3
UNDETERMINED = "und"
#: Chains of one training pass at most (or one per sampled row, if those are more); more are
#: thinned at random, long documents of languages with many chains first.
MAX_CHAINS = 20_000
#: Potentials that forward-backward of a training pass holds at once; bounds its temporaries.
BLOCK_CELLS = 1 << 20
#: Words whose feature slots are made at once in training.
BLOCK_WORDS = 1 << 14

_LETTER = regex.compile(r"\p{L}")


def word_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of the words, flat, and where each word's begin. Slot 2**SLOT_BITS is void."""
    flat = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    starts = ends - size
    end_of = np.repeat(ends, size)
    shift = np.uint64(64 - SLOT_BITS)
    out = np.full((len(flat), len(ORDERS) + 1), 1 << SLOT_BITS, np.int64)
    h = np.zeros(len(flat), np.uint64)
    at = np.arange(len(flat))
    for column, n in enumerate(ORDERS):
        h = h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        inside = at[: len(h)] + n <= end_of[: len(h)]
        out[: len(h), column][inside] = (mix64(h[inside] + np.uint64(n << 56)) >> shift).astype(np.int64)
    whole = np.array([hash_word(w) for w in words], np.uint64) if len(words) else np.zeros(0, np.uint64)
    out[starts, len(ORDERS)] = (mix64(whole) >> shift).astype(np.int64)
    return out.reshape(-1), starts * (len(ORDERS) + 1)


def hash_word(word: bytes) -> int:
    h = 0xCBF29CE484222325
    for k in range(0, len(word), 8):
        h = ((h ^ int.from_bytes(word[k : k + 8], "little")) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return h


def forward_backward(psi: np.ndarray, step: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (T, N, L) of potentials psi under transitions ``step`` (L, L), and the summed
    pair posteriors (L, L). ``mask`` (T, N) is false on padding, which is at the ends."""
    t_max, n, labels = psi.shape
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    alpha[0] = psi[0] / psi[0].sum(1, keepdims=True)
    for t in range(1, t_max):
        a = (alpha[t - 1] @ step) * psi[t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = np.where(mask[t][:, None], a, alpha[t - 1])
    pairs = np.zeros((labels, labels))
    for t in range(t_max - 1, 0, -1):
        right = psi[t] * beta[t]
        b = right @ step.T
        z = (alpha[t - 1] * b).sum(1, keepdims=True)
        on = mask[t][:, None]
        pairs += step * (alpha[t - 1].T @ np.where(on, right / z, 0))
        beta[t - 1] = np.where(on, b / b.sum(1, keepdims=True), 1)
    post = alpha * beta
    return post / post.sum(2, keepdims=True), pairs


def lay_chains(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (T, chains), mask, and the text of each chain, for texts of ``count`` words."""
    per = -(-count // CHAIN)
    text = np.repeat(np.arange(len(count)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[text] + k * CHAIN
    size = np.minimum(count[text] - k * CHAIN, CHAIN)
    at = np.arange(CHAIN)[:, None]
    mask = at < size[None, :]
    return np.where(mask, begin[None, :] + at, 0), mask, text


def fair_shares(sizes: np.ndarray, total: int) -> np.ndarray:
    """``sizes`` cut to one common level so that their sum is ``total`` at most; where even ones exceed it, ones."""
    if sizes.sum() <= total:
        return sizes
    low, high = 1, int(sizes.max())
    while low < high:  # the largest level that fits
        level = (low + high + 1) // 2
        if np.minimum(sizes, level).sum() <= total:
            low = level
        else:
            high = level - 1
    return np.minimum(sizes, low)


def chains_kept(chains: np.ndarray, code: np.ndarray, total: int) -> np.ndarray:
    """How many of its chains each row keeps: ``total`` shared between languages, then between
    a language's rows; one at least where a row has any."""
    kept = chains.copy()
    quota = fair_shares(np.bincount(code, weights=chains).astype(np.int64), total)
    for k, most in enumerate(quota.tolist()):
        kept[code == k] = fair_shares(chains[code == k], most)
    return kept


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # (slots + 1, labels); the last row is void
    step: np.ndarray  # exp of the transition weights

    def emissions(self, words: list[bytes]) -> np.ndarray:
        slots, starts = word_slots(words)
        return np.add.reduceat(self.weights[slots], starts, axis=0)

    def label(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
        """(mean posterior per language, words) of each lower-cased text."""
        labels = len(self.languages)
        for lo, hi in chunks(texts):
            batch = WordBatch(texts[lo:hi], LETTERS)
            count = np.diff(batch.first)
            total = np.zeros((hi - lo, labels))
            if len(batch.hashes):
                _, one, place = np.unique(batch.hashes, return_index=True, return_inverse=True)
                scores = self.emissions([batch.word(i) for i in one.tolist()])
                psi = np.exp(scores - scores.max(1, keepdims=True))
                word, mask, text = lay_chains(count, batch.first[:-1])
                post, _ = forward_backward(psi[place[word]], self.step, mask)
                post = (post * mask[:, :, None]).sum(0)
                for k in range(labels):
                    total[:, k] = np.bincount(text, weights=post[:, k], minlength=hi - lo)
            yield from zip(total / np.maximum(count, 1)[:, None], count.tolist(), strict=True)


def sample(rows: DataFrame, limit: int) -> list[tuple[str, str]]:
    """At most ``limit`` (lang, text) of the rows, all languages alike where there are enough.

    Each language has a row at least; only beyond ``limit`` languages the rarest have none.
    """
    known = rows.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(limit).collect()}
    if not sizes:
        return []
    each = max(1, limit // len(sizes))
    # by hash more than are needed of each language, then the first of these
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, (4 * each + 64) / n)) for lang, n in sizes.items()], "lang string, _share double")
    spread = F.xxhash64(F.col("doc_id"), F.lit(1))
    sized = known.select("doc_id", "lang", F.octet_length("text").cast("long").alias("_bytes"))
    near = sized.join(F.broadcast(shares), "lang").where(F.pmod(spread, F.lit(1 << 30)) < F.col("_share") * (1 << 30)).groupBy("doc_id", "lang").agg(F.max("_bytes").alias("_bytes"))
    order = W.partitionBy("lang").orderBy(F.col("_bytes") > ROW_BYTES, spread, "doc_id")
    ranked = near.withColumns({"_rank": F.row_number().over(order), "_sum": F.sum("_bytes").over(order.rowsBetween(W.unboundedPreceding, 0))})
    fits = (F.col("_bytes") <= ROW_BYTES) & (F.col("_sum") <= SAMPLE_BYTES // len(sizes))
    chosen = ranked.where((F.col("_rank") == 1) | (F.col("_rank") <= each) & fits).select("doc_id", "lang")
    found = known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return [(r["lang"], r["text"]) for r in found.orderBy(spread, "doc_id", "lang").limit(limit).select("lang", "text").collect()]


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7) -> Crf:
    languages = sorted({lang for lang, _ in rows})
    labels = len(languages)
    weights = np.zeros(((1 << SLOT_BITS) + 1, labels), np.float32)
    if labels < 2:
        return Crf(languages, weights, np.ones((labels, labels)))
    rng = np.random.default_rng(seed)
    code = {lang: i for i, lang in enumerate(languages)}
    chains: list[np.ndarray] = []
    tags: list[np.ndarray] = []
    vocabulary: dict[bytes, int] = {}
    size = np.array([-(-len(WordBatch([text.lower().encode()], LETTERS).hashes) // CHAIN) for _, text in rows], np.int64)
    keep = chains_kept(size, np.array([code[lang] for lang, _ in rows]), MAX_CHAINS)
    for (lang, text), have, take in zip(rows, size.tolist(), keep.tolist(), strict=True):
        batch = WordBatch([text.lower().encode()], LETTERS)
        for k in (np.sort(rng.choice(have, take, replace=False)) * CHAIN).tolist() if take < have else range(0, have * CHAIN, CHAIN):
            words = [batch.word(i) for i in range(k, min(k + CHAIN, len(batch.hashes)))]
            chains.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
            tags.append(np.full(len(words), code[lang], np.int16))
    if not chains:
        return Crf(languages, weights, np.ones((labels, labels)))
    for i in np.flatnonzero(rng.random(len(chains)) < SPLICED).tolist():
        j = int(rng.integers(len(chains)))
        cut = int(rng.integers(1, max(2, min(len(chains[i]), len(chains[j])))))
        chains[i], tags[i] = np.concatenate((chains[i][:cut], chains[j][cut:])), np.concatenate((tags[i][:cut], tags[j][cut:]))
    n = len(chains)
    word, gold, mask = np.zeros((CHAIN, n), np.int32), np.zeros((CHAIN, n), np.int16), np.zeros((CHAIN, n), bool)
    for i, (c, g) in enumerate(zip(chains, tags, strict=True)):
        word[: len(c), i], gold[: len(c), i], mask[: len(c), i] = c, g, True
    del chains, tags
    spelled = list(vocabulary)
    pieces, lengths = [], []
    for k in range(0, len(spelled), BLOCK_WORDS):
        part, starts = word_slots(spelled[k : k + BLOCK_WORDS])
        lengths.append(np.diff(np.concatenate((starts, [len(part)]))))
        pieces.append(part.astype(np.int32))
    slots, per_word = np.concatenate(pieces), np.concatenate(lengths)
    del pieces, lengths, spelled
    seen = np.zeros((1 << SLOT_BITS) + 1, bool)
    seen[slots] = True
    used = np.flatnonzero(seen[:-1])
    compact = np.full((1 << SLOT_BITS) + 1, len(used), np.int32)
    compact[used] = np.arange(len(used))
    slots = compact[slots]
    keep = slots < len(used)
    owner = np.repeat(np.arange(len(vocabulary), dtype=np.int32), per_word)[keep]
    slots = slots[keep]
    del compact, keep, per_word, seen
    w, trans = np.zeros((len(used), labels)), np.eye(labels)
    squares = [np.full_like(w, 1e-2), np.full_like(trans, 1.0)]
    pair_gold = np.zeros((labels, labels))
    both = mask[1:]
    np.add.at(pair_gold, (gold[:-1][both], gold[1:][both]), 1)
    one_hot = np.eye(labels, dtype=np.float32)
    step = max(1, BLOCK_CELLS // (CHAIN * labels))  # chains are independent: a block at a time
    total = mask.sum()
    for _ in range(epochs):
        scores = np.stack([np.bincount(owner, weights=w[slots, k], minlength=len(vocabulary)) for k in range(labels)], 1)
        psi = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32)
        psi = np.maximum(psi, 1e-30)
        by_word, pairs = np.zeros((len(vocabulary), labels)), np.zeros((labels, labels))
        for i in range(0, n, step):
            at, on = word[:, i : i + step], mask[:, i : i + step]
            post, joint = forward_backward(psi[at], np.exp(trans), on)
            miss = (one_hot[gold[:, i : i + step]] - post)[on]
            for k in range(labels):
                by_word[:, k] += np.bincount(at[on], weights=miss[:, k], minlength=len(vocabulary))
            pairs += joint
        grads = [np.stack([np.bincount(slots, weights=by_word[owner, k], minlength=len(used)) for k in range(labels)], 1) / total * 1e3 - 1e-3 * w, (pair_gold - pairs) / total * 10 - 1e-3 * trans]
        for x, g, s, rate in zip((w, trans), grads, squares, (0.25, 0.3), strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    weights[used] = w
    return Crf(languages, weights, np.exp(trans))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64())])
_ASCII_LETTER = regex.compile(rb"[a-z]")


def decide(texts: list[bytes], crf: Crf) -> Iterator[tuple[str, float, int]]:
    """(language, score, words) of each lower-cased text."""
    for text, (mean, n) in zip(texts, crf.label(texts) if crf.languages else ((None, 0) for _ in texts), strict=True):
        if n and (_ASCII_LETTER.search(text) or _LETTER.search(text.decode("utf-8", "ignore"))):
            best = int(np.argmax(mean))
            yield crf.languages[best], min(1.0, float(mean[best])), n
        else:
            yield UNDETERMINED, 0.0, n


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """Per document: doc_id, lang_pred, score, n_words. Reads doc_id and text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = list(decide(folded_bytes(rb.column("text")), shared.value))
            yield record_batch({"doc_id": rb.column("doc_id"), "lang_pred": [x for x, _, _ in found], "score": [x for _, x, _ in found], "n_words": [x for _, _, x in found]}, _SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, lang_pred string, score double, n_words long")


def identify(docs: DataFrame, training: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``predict`` with a model trained on a bounded sample of ``training`` (doc_id, text, lang)."""
    return predict(docs, train(sample(training, sample_rows)))


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, least: float = 0.3) -> DataFrame:
    """Documents whose language can be told: neither ``und`` nor scored below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(sample(docs, sample_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = decide(folded_bytes(rb.column("text")), shared.value)
            yield rb.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
