"""Toxicity by a weighted finite-state pattern grammar.

Texts are read clause by clause. A clause is a string over word classes (insult, threat,
target, negation, report) and the composition of five weighted transducers scores it:
insults emit their learned weight, threats emit when a target follows, a target beside
an insult raises it, negation before it and reported speech around it lower it. Matched
clauses, not isolated words, make a document's features; a logistic layer turns them into
a score.

The insult lexicon (words and word beginnings, with log-odds weights) and the logistic
layer are learned from a bounded sample of labelled rows (``sample_rows`` and half of
``SAMPLE_BYTES`` per label, chosen by a hash of doc_id; texts over ``ROW_BYTES`` are not
learned from). The other classes are fixed values. Scoring reads whole texts; the
automata run on the clauses that hold an insult or a threat only, as others score zero.

Defined cases: null and empty texts get the score of a text without matches; without
labelled rows of both kinds the score is 0 for all; a doc_id with both labels is toxic; rows
without doc_id are never learned from, and count as held out; repeated rows get equal scores;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LETTERS, WordBatch, chunks, folded_bytes, record_batch, tidied

SAMPLE_ROWS = 3000
SAMPLE_BYTES, ROW_BYTES = 48 << 20, 256 << 10
#: A term needs so many toxic documents, so large a share of them, and log-odds of so much, to enter the lexicon.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 5, 0.02, 3.0
PREFIX_BYTES = (4, 5, 6, 7, 8)

# Cue words of the grammar's closed classes in English, German, French and Spanish.
THREATS = "kill hurt destroy beat attack burn shoot töten vernichten schlagen tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your he him she her they them du dich dir ihr euch sie tu te toi vous il ils elle tú te usted ustedes él ellos ella".split()
NEGATIONS = "not never no without nicht nie kein keine ohne pas jamais sans ni nunca jamás sin".split()
REPORTS = "said says quoted reported called claims sagte sagt nannte berichtet dit disait cite appelé dijo dice cita llamó".split()
# End of the fixed values.

INSULT, THREAT, TARGET, NEGATION, REPORT = "itgnr"
_CLAUSE = re.compile(rb"[.!?;:\n|]")
_WORD = re.compile(rb"[a-z\x80-\xff]+")


class Transducer:
    """Deterministic weighted transducer: ``step(state, symbol, value) -> (state, value)``.

    ``value`` is what the transducer before it emitted for the symbol (0: nothing).
    """

    start: object = 0

    def step(self, state: object, symbol: str, value: float) -> tuple[object, float]:
        return state, value


class Insult(Transducer):
    """Emits the lexicon weight of an insult."""


class Threat(Transducer):
    """A threat and a target emit where at most two words stand between them, in either order."""

    start = (0, 0)

    def step(self, state, symbol, value):
        threat, target = (max(0, k - 1) for k in state)
        if symbol == THREAT:
            return (4, target), (2.0 if target else 0.0)
        if symbol == TARGET:
            return (threat, 4), (2.0 if threat else value)
        return (threat, target), value


class Target(Transducer):
    """An insult after a target, with at most one word between, weighs a quarter more."""

    def step(self, state, symbol, value):
        near = max(0, state - 1)
        return (3 if symbol == TARGET else near), (value * 1.25 if symbol == INSULT and near else value)


class Negation(Transducer):
    """What follows a negation, with at most one word between, weighs a third."""

    def step(self, state, symbol, value):
        near = max(0, state - 1)
        return (3 if symbol == NEGATION else near), (value / 3 if value and near else value)


class Report(Transducer):
    """What follows a verb of speech in its clause weighs half."""

    def step(self, state, symbol, value):
        return (1 if symbol == REPORT else state), (value / 2 if value and state else value)


class Composition(Transducer):
    """Transducers run in step, each reading what the one before emitted."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.start = tuple(p.start for p in parts)

    def step(self, state, symbol, value):
        out = []
        for part, s in zip(self.parts, state, strict=True):
            s, value = part.step(s, symbol, value)
            out.append(s)
        return tuple(out), value


GRAMMAR = Composition(Insult(), Threat(), Target(), Negation(), Report())
_CUES = {w.encode(): c for words, c in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words}


@dataclass
class Lexicon:
    words: dict[bytes, float] = field(default_factory=dict)
    prefixes: dict[bytes, float] = field(default_factory=dict)

    def weight(self, word: bytes) -> float:
        if word in self.words:
            return self.words[word]
        return max((self.prefixes[word[:n]] for n in PREFIX_BYTES if len(word) >= n and word[:n] in self.prefixes), default=0.0)

    def hashes(self) -> dict[int, np.ndarray]:
        """Sorted hashes of the words that begin a match: whole words at 0, prefixes by length."""
        groups: dict[int, list[bytes]] = {0: [*self.words, *(w.encode() for w in THREATS)]}
        for p in self.prefixes:
            groups.setdefault(len(p), []).append(p)
        return {n: np.sort(WordBatch(list(g), LETTERS).hashes) for n, g in groups.items() if g}


def clause_score(clause: bytes, lexicon: Lexicon) -> float:
    """Sum of what the composed grammar emits over a clause."""
    state, total = GRAMMAR.start, 0.0
    for m in _WORD.finditer(clause):
        word = m[0]
        weight = lexicon.weight(word)
        symbol = INSULT if weight else _CUES.get(word, "")
        state, value = GRAMMAR.step(state, symbol, weight)
        total += value
    return total


def clause_scores(texts: list[bytes], lexicon: Lexicon, known: dict[int, np.ndarray]) -> Iterator[tuple[list[float], int]]:
    """(scores of the matched clauses, words) of each lower-cased text."""
    for lo, hi in chunks(texts):
        batch = WordBatch(texts[lo:hi], LETTERS)
        hits = [np.flatnonzero(_among(batch.hashes, known[0]))] if 0 in known else []
        for n, table in known.items():
            if n:
                long, h = batch.prefix_hashes(n)
                hits.append(long[_among(h, table)])
        where = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        owner = np.searchsorted(batch.first[1:], where, side="right")
        found: dict[int, list[float]] = {}
        done: dict[int, int] = {}
        for word, doc in zip(where.tolist(), owner.tolist(), strict=True):
            text, at = texts[lo + doc], int(batch.starts[word] - batch.text_at[doc])
            if at < done.get(doc, 0):
                continue
            begin = max(text.rfind(c, 0, at) for c in (b".", b"!", b"?", b";", b":", b"\n", b"|")) + 1
            end = m.start() if (m := _CLAUSE.search(text, at)) else len(text)
            done[doc] = end
            if score := clause_score(text[begin:end], lexicon):
                found.setdefault(doc, []).append(score)
        for doc, n in enumerate(np.diff(batch.first).tolist()):
            yield found.get(doc, []), n


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def features(scores: list[float], n_words: int) -> tuple[float, ...]:
    total = sum(scores)
    return 1.0, float(bool(scores)), math.log1p(total), math.log1p(max(scores, default=0.0)), math.log1p(100 * total / max(n_words, 1))


def learn_lexicon(rows: list[tuple[str, int]], least_docs: int = LEAST_DOCS, least_odds: float = LEAST_ODDS) -> Lexicon:
    """Words, and beginnings of words where many forms share one, that mark toxic documents."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    total = Counter()
    for text, toxic in rows:
        words = set(_WORD.findall(text.lower().encode()))
        terms = words | {w[:n] + b"*" for w in words for n in PREFIX_BYTES if len(w) > n}
        seen[toxic].update(terms)
        total[toxic] += 1
    if not total[0] or not total[1]:
        return Lexicon()

    least_docs = max(least_docs, LEAST_SHARE * total[1])

    def odds(term: bytes) -> float:
        return math.log((seen[1][term] + 0.5) / (total[1] + 1)) - math.log((seen[0][term] + 0.5) / (total[0] + 1))

    good = {t: odds(t) for t, n in seen[1].items() if n >= least_docs and odds(t) >= least_odds}
    # copies of one text are one piece of evidence: a term must stand between different neighbours
    around: dict[bytes, set[tuple[bytes, bytes]]] = {t: set() for t in good}
    for text, toxic in rows:
        if toxic:
            words = [b"", *_WORD.findall(text.lower().encode()), b""]
            for before, word, after in zip(words, words[1:], words[2:], strict=False):
                for term in (word, *(word[:n] + b"*" for n in PREFIX_BYTES if len(word) > n)):
                    if term in good:
                        around[term].add((before, after))
    good = {t: w for t, w in good.items() if len(around[t]) >= max(least_docs, seen[1][t] // 3)}
    out = Lexicon()
    for term in sorted((t for t in good if t.endswith(b"*")), key=len):
        stem = term[:-1]
        if not any(stem[:n] in out.prefixes for n in PREFIX_BYTES if n < len(stem)):
            forms = sum(1 for t in seen[1] if t.startswith(stem) and not t.endswith(b"*"))
            if forms > 2:
                out.prefixes[stem] = min(good[term], 6.0)
    for term, w in good.items():
        if not term.endswith(b"*") and not any(term[:n] in out.prefixes for n in PREFIX_BYTES):
            out.words[term] = min(w, 6.0)
    return out


@dataclass
class Model:
    lexicon: Lexicon
    known: dict[int, np.ndarray]
    weights: np.ndarray | None

    def scores(self, texts: list[bytes]) -> list[float]:
        if self.weights is None:
            return [0.0] * len(texts)
        x = np.array([features(s, n) for s, n in clause_scores(texts, self.lexicon, self.known)]).reshape(-1, 5)
        return (1 / (1 + np.exp(-x @ self.weights))).tolist()


def train(rows: list[tuple[str, int]]) -> Model:
    """Logistic layer from one half of the rows under the lexicon of the other half, whose own
    evidence would flatter it; then the lexicon of all rows takes its place."""
    lexicon = learn_lexicon(rows[0::2])
    known = lexicon.hashes()
    rest = rows[1::2]
    if len({t for _, t in rest}) < 2 or not (lexicon.words or lexicon.prefixes):
        return Model(lexicon, known, None)
    x = np.array([features(s, n) for s, n in clause_scores([t.lower().encode() for t, _ in rest], lexicon, known)])
    y = np.array([t for _, t in rest], float)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    lexicon = learn_lexicon(rows)
    known = lexicon.hashes()
    return Model(lexicon, known, w)


def sample(docs: DataFrame, labels: DataFrame, limit: int) -> list[tuple[str, int]]:
    """At most ``limit`` labelled texts of each label, by a hash of doc_id."""
    spread = F.xxhash64(F.col("doc_id"), F.lit(5))
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for toxic in (0, 1):
        part = marked.where(F.col("toxic") == toxic).withColumn("h", spread).orderBy("h", "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("bytes")).where(F.col("bytes") <= ROW_BYTES)
    so_far = F.sum("bytes").over(W.partitionBy("toxic").orderBy("h", "doc_id", "text").rowsBetween(W.unboundedPreceding, 0))
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES // 2)  # ``chosen``: 2 * limit rows
    return [(r["text"], r["toxic"]) for r in rows.orderBy("h", "doc_id", "text").limit(2 * limit).select("text", "toxic").collect()]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, score, predicted. Reads doc_id and text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            s = shared.value.scores(folded_bytes(rb.column("text")))
            yield record_batch({"doc_id": rb.column("doc_id"), "score": s, "predicted": [int(x >= 0.5) for x in s]}, _SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``score_texts`` with a model learned from a bounded sample of ``labels`` (doc_id, toxic)."""
    return score_texts(docs, train(sample(docs, labels, sample_rows)))
