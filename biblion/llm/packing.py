"""Best-fit packing by swap-based local search.

Each document becomes its tokens and one end token; only documents over ``capacity`` tokens
are cut, the first piece taking the remainder. Pieces are packed whole.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the input) goes
to the driver. Packing works on *bin groups*: a multiset of lengths and how many bins look
like it. A best-fit-decreasing start is improved by local search between underfull groups:
moves, one-for-one and two-for-one exchanges that raise the sum of squared fills, until bins
empty and no exchange helps, or the bound ceil(tokens / capacity) is reached. The resulting
plan gives, per length, which bins take pieces number i to j of that length; pieces are
numbered within their length by salted windows (a common length never meets in one task).

Defined cases: null text is empty and packs as the end token alone; repeated rows each get
their places; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, record_batch, tidied

CAPACITY = 2048
END_ID = 0
ROWS_PER_SALT = 50_000

_tokenizers: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class ByteBpe:
    """Ids of a byte-level BPE given as a tokenizers JSON file.

    Ordinary text is encoded by tiktoken from the same vocabulary and merges (a merge's rank
    is its id), which gives the same ids several times faster; a text that holds one of the
    file's special strings goes through tokenizers itself.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = special
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(letter[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            if self.exact is None:  # rarely needed, and large
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenizer(path: str) -> ByteBpe:
    if path not in _tokenizers:
        _tokenizers[path] = ByteBpe(path)
    return _tokenizers[path]


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked) of every piece."""
    path = vocabulary or default_vocabulary()
    schema = _PIECE.append(pa.field("ids", pa.list_(pa.int32()))) if keep_ids else _PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for rb in batches:
            rows: dict[str, list] = {f: [] for f in schema.names}
            for doc_id, text in zip(rb.column("doc_id").to_pylist(), rb.column("text"), strict=True):
                tokens = bpe.ids(text.as_py() or "")
                tokens.append(end_id)
                ids = np.array(tokens, "<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(k)
                    rows["start"].append(a)
                    rows["length"].append(b - a)
                    rows["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        rows["ids"].append(ids[a:b].astype(np.int32))
            yield record_batch(rows, schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), ddl)


Pattern = tuple[int, ...]


class Bins:
    """Bin groups: how many bins hold each multiset of lengths."""

    def __init__(self, capacity: int):
        self.capacity, self.groups = capacity, Counter()

    def fill_best_fit(self, histogram: dict[int, int]) -> None:
        room: dict[int, dict[Pattern, int]] = {}

        def put(pattern: Pattern, count: int) -> None:
            if count:
                at = room.setdefault(self.capacity - sum(pattern), {})
                at[pattern] = at.get(pattern, 0) + count

        for length in sorted(histogram, reverse=True):
            left = histogram[length]
            while left:
                fits = min((r for r in room if r >= length), default=None)
                if fits is None:
                    per = self.capacity // length
                    put((length,) * per, left // per)
                    put((length,) * (left % per), 1 if left % per else 0)
                    break
                pattern, count = next(iter(room[fits].items()))
                used = min(count, left)
                if used == count:
                    del room[fits][pattern]
                    if not room[fits]:
                        del room[fits]
                else:
                    room[fits][pattern] -= used
                put((*pattern, length), used)
                left -= used
        for at in room.values():
            for pattern, count in at.items():
                self._add(pattern, count)

    def _add(self, pattern: Pattern, count: int) -> None:
        if pattern and count:
            self.groups[tuple(sorted(pattern, reverse=True))] += count

    def count(self) -> int:
        return sum(self.groups.values())

    def least(self) -> int:
        return -(-sum(sum(p) * c for p, c in self.groups.items()) // self.capacity)

    def _exchange(self, a: Pattern, b: Pattern) -> tuple[Pattern, Pattern] | None:
        """The exchange from ``b`` (emptier) to ``a`` that fills ``a`` most, if any raises the squared fill."""
        room = self.capacity - sum(a)
        best: tuple[int, Pattern, Pattern] | None = None
        singles = sorted(set(b))
        gives: list[Pattern] = [(y,) for y in singles]
        if len(b) > 1:
            many = Counter(b)
            gives += [(y, z) for i, y in enumerate(singles) for z in singles[i:] if y != z or many[y] > 1]
        for give in gives:
            got = sum(give)
            for take in [(), *((x,) for x in set(a))]:
                if len(give) == 2 and not take and len(b) > 2 and got > room:
                    continue
                gain = got - sum(take)
                if 0 < gain <= room and (best is None or gain > best[0]):
                    best = (gain, take, give)
        if best is None:
            return None
        x, y = Counter(a), Counter(b)
        x.subtract(best[1])
        x.update(best[2])
        y.subtract(best[2])
        y.update(best[1])
        return tuple(x.elements()), tuple(y.elements())

    def improve(self) -> None:
        """Local search over underfull groups; every exchange raises the sum of squared fills."""
        while self.count() > self.least():
            under = sorted((p for p in self.groups if sum(p) < self.capacity), key=lambda p: (sum(p), p))
            if not self._round(under):
                break

    def _round(self, under: list[Pattern]) -> bool:
        for i, donor in enumerate(under):
            for other in reversed(under[i:]):
                if other == donor and self.groups[donor] < 2:
                    continue
                if found := self._exchange(other, donor):
                    n = self.groups[donor] // 2 if other == donor else min(self.groups[donor], self.groups[other])
                    for p in (donor, other):
                        self.groups[p] -= n
                        if not self.groups[p]:
                            del self.groups[p]
                    for p in found:
                        self._add(p, n)
                    return True
        return False


@dataclass
class Plan:
    """Per interval of piece numbers of a length: where its bins begin, and the places in them."""

    key: np.ndarray  # length << 40 | first number
    first: np.ndarray
    per_bin: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    bins = Bins(capacity)
    bins.fill_best_fit(histogram)
    bins.improve()
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, count in sorted(bins.groups.items(), reverse=True):
        offset = 0
        for length, per in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length << 40 | used[length], used[length], per, sequence, offset))
            used[length] += per * count
            offset += per * length
        sequence += count
    rows.sort()
    return Plan(*np.array(rows, np.int64).reshape(-1, 5).T)


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Adds sequence_id and offset to rows of ``pieces`` (a materialised table)."""
    histogram = {r["length"]: r["n"] for r in piece_rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    shared = piece_rows.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    salts = max(1, -(-sum(histogram.values()) // rows_per_salt))
    salted = piece_rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    numbered = salted.withColumn("_n", number).join(starts, ["length", "_salt"]).withColumn("_n", F.col("_n") + F.col("_before")).drop("_salt", "_before")
    columns = piece_rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for rb in batches:
            length, n = rb.column("length").to_numpy(), rb.column("_n").to_numpy()
            at = np.searchsorted(p.key, length << 40 | n, side="right") - 1
            bin_, slot = np.divmod(n - p.first[at], p.per_bin[at]) if len(n) else (n, n)
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in columns), pa.array(p.sequence[at] + bin_), pa.array(p.offset[at] + slot * length)], names=[*columns, "sequence_id", "offset"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in piece_rows.schema.fields)
    return numbered.mapInArrow(tidied(run), f"{ddl}, sequence_id long, offset long")


def best_fit(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Packed pieces of all documents: the columns of ``pieces`` with sequence_id and offset."""
    return pack(materialize(pieces(docs, capacity, vocabulary, keep_ids=keep_ids), "pieces"), capacity)
