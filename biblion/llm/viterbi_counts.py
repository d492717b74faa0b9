"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming carries,
for each end, the best score and its piece count, no back pointers. Tie rules are the
tokenizer's: a later candidate replaces an earlier one only if its score is strictly
greater, candidates of one end coming by ascending start; a character that no
single-character piece matches costs the least score less 10 and counts one piece per
UTF-8 byte (byte fallback), or one for each run without it.

White space becomes the word mark and a mark is put before the text. No piece has a mark
after another character (checked when the vocabulary loads), so the best path of a text is
the best paths of its words; a worker keeps counts of words it has met, in bounded memory.

Defined cases: null and empty texts count 0; repeated rows get equal counts; extra columns
are ignored. The vocabulary file's path is a parameter; every node must have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, tidied

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker keeps.
CACHED_WORDS = 600_000

_counters: dict[str, UnigramCounter] = {}
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of a sentencepiece model's ordinary pieces, and whether it has byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return pieces, any(sp.is_byte(i) for i in range(n))


class UnigramCounter(dict):
    """word -> piece count, computed on first use."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        super().__init__()
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.singles = {p for p, _ in pieces if len(p) == 1}
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece has a word mark inside: words are not independent")

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        n = self[word] = self.viterbi(word)
        return n

    def viterbi(self, word: str) -> int:
        n = len(word)
        lowest = float("-inf")
        best, count = [lowest] * (n + 1), [0] * (n + 1)
        in_run = [False] * (n + 1)  # the best path ends in an unknown character
        best[0] = 0.0
        at = 1
        singles, unknown = self.singles, self.unknown

        def settle(upto: int) -> None:
            nonlocal at
            while at <= upto:
                c = word[at - 1]
                if c not in singles:
                    score = best[at - 1] + unknown
                    if score > best[at]:
                        best[at] = score
                        count[at] = count[at - 1] + (len(c.encode("utf-8", "replace")) if self.byte_fallback else not in_run[at - 1])
                        in_run[at] = True
                at += 1

        for end, (size, score) in self.automaton.iter(word):
            end += 1
            settle(end - 1)  # every earlier end is final: matches come by end, then by ascending start
            score += best[end - size]
            if score > best[end]:
                best[end], count[end] = score, count[end - size] + 1
        settle(n)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return sum(map(self.__getitem__, _SEGMENT.findall(MARK + text.replace(" ", MARK))))
        return sum(map(self.__getitem__, [MARK + w for w in text.split(" ")]))


def counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(*read_vocabulary(path))
    return _counters[path]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for rb in batches:
            yield record_batch({"doc_id": rb.column("doc_id"), "n_tokens": [counts.count(t.as_py() or "") for t in rb.column("text")]}, _SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, n_tokens long")
