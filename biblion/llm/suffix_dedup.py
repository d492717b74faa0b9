"""Suffix-array dedup: remove bytes covered by a long string that also starts earlier.

Semantics: a byte goes if some ``length``-byte string that covers it starts earlier too, in
a document with a smaller doc_id or further left in the same one. Strings are judged on
the input. Matches never cross documents.

How it scales. No global suffix array is built. Each text yields *anchors*: positions
whose ``kmer``-byte hash is the least in some window of ``length`` bytes. The choice
depends on the window alone, so equal windows hold equal anchors at equal places, and
every repeated string has an anchor in common with its earlier occurrence.

1. Texts are written once as blocks of a few MB. A block asks for the corpus counts of its
   anchors' k-mers (``tally``); anchors of unique k-mers (most) are done.
2. Of the others, the block sends the bytes around them (168: all windows that hold the
   anchor) to the k-mer's bucket. Of byte-equal contexts of a block only the first is sent.
3. A bucket puts the right and left contexts of each k-mer in suffix order by deep-shallow
   sorting (``deepshallow``). For every split of a window into a left and a right part, the
   LCP arrays give classes of equal parts, hence exact classes of equal windows; all but the
   first of a class are covered. Hashes only bring strings together, bytes decide.
4. A k-mer with more than ``hot_over`` different contexts is not sent. The splits of its
   windows are halved: all windows with d to e bytes before the anchor share the bytes that
   lie in each of them, a longer string than the k-mer, which is counted anew. In the end
   that string is one whole window, of which a block sends one occurrence.

Defined cases: null text counts as empty; texts under ``length`` bytes lose nothing. Rows
count by themselves: those of one doc_id follow one another in the order of a hash of
their texts, so of a row repeated whole only one keeps its bytes, and spans of one text never
cut another. Rows without doc_id are not searched and lose nothing; empty tables give empty
results; extra columns are ignored by ``repeated_spans`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tally
from .common import CHUNK_BYTES, bytes_of, hash_ranges, materialize, mix64, record_batch, scratch, tidied, tidied_group
from .deepshallow import classes, order_with_lcp

LENGTH = 100
KMER = 32
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: Different contexts of one k-mer beyond which its windows are told apart before they are sent.
HOT_OVER = 20_000
#: Rows of one batch on the way to the buckets.
SEND_ROWS = 4096
#: Contexts that are compared at once in a bucket, where one k-mer has no more.
COMPARE = 4096

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, 8, dtype=np.uint64)]


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + width] for every i that has so many."""
    reach, out = 1, x
    while reach * 2 <= width:
        out = f(out[:-reach], out[reach:])
        reach *= 2
    return f(out[: len(x) - width + 1], out[width - reach : width - reach + len(x) - width + 1]) if reach < width else out


def _segments(texts: list[bytes], length: int, margin: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text index, first and last + 1 start of windows), each of about CHUNK_BYTES; a long
    text is cut into several ranges of window starts."""
    batch: list[tuple[int, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for lo in range(0, len(t) - length + 1, CHUNK_BYTES):
            hi = min(lo + CHUNK_BYTES, len(t) - length + 1)
            if batch and size + hi - lo + length + 2 * margin > CHUNK_BYTES:
                yield batch
                batch, size = [], 0
            batch.append((i, lo, hi))
            size += hi - lo + length + 2 * margin
    if batch:
        yield batch


def anchors(texts: list[bytes], length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position, k-mer hash, context hash) of the anchors of each text, in order."""
    margin = length - kmer
    found = [_anchors(texts, batch, length, kmer) for batch in _segments(texts, length, margin)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    doc, pos, key, context = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1])))  # ranges of one text may share anchors
    if not new.all():
        by = np.lexsort((pos, doc))
        by = by[np.concatenate(([True], (doc[by[1:]] != doc[by[:-1]]) | (pos[by[1:]] != pos[by[:-1]])))]
        return doc[by], pos[by], key[by], context[by]
    return doc, pos, key, context


def _anchors(texts: list[bytes], batch: list[tuple[int, int, int]], length: int, kmer: int) -> tuple[np.ndarray, ...]:
    margin = length - kmer
    gap = b"\xff" * margin  # bytes that no UTF-8 has
    shift = [max(0, lo - margin) for _, lo, _ in batch]
    parts = [texts[i][a : hi + length - 1 + margin] for (i, _, hi), a in zip(batch, shift, strict=True)]
    flat = np.frombuffer(gap + gap.join(parts) + gap, np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = margin + np.concatenate(([0], np.cumsum(sizes + margin)[:-1]))
    base = np.array(shift, np.int64)
    n = len(flat)
    h, reach, level = _BYTE[flat], 1, 0
    while reach < kmer:
        h = h[:-reach] * _STEP[level] + h[reach:]
        h ^= h >> np.uint64(29)
        reach, level = reach * 2, level + 1
    assert reach == kmer, "kmer must be a power of two"
    low = _slide(h, margin + 1, np.minimum)
    flag = np.zeros(n + 1, np.int8)  # window starts that count
    flag[starts + np.array([lo for _, lo, _ in batch]) - base] = 1
    np.add.at(flag, starts + np.array([hi for _, _, hi in batch]) - base, -1)
    low[np.cumsum(flag[: len(low)], dtype=np.int8) == 0] = 0
    top = np.zeros(len(low) + margin, np.uint64)
    top[margin:] = low
    top = _slide(top, margin + 1, np.maximum)  # top[i]: over windows that start in [i - margin, i]
    at = np.flatnonzero((top == h[: len(top)]) & (top != 0))  # the margin after the last text holds none
    half = h
    while reach * 2 <= length + margin:
        half = half[:-reach] * _STEP[level] + half[reach:]
        half ^= half >> np.uint64(29)
        reach, level = reach * 2, level + 1
    left, right = half[at - margin], half[at + length - reach]
    context = mix64(left * _STEP[6] + right * _STEP[7] + mix64(right))
    part = np.searchsorted(starts, at, side="right") - 1
    return np.array([i for i, _, _ in batch], np.int64)[part], at - starts[part] + base[part], mix64(h[at]), context


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, ascending and disjoint (touching ones join)."""
    if not len(lo):
        return lo, hi
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hi) - 1]))]


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of many documents each: block_id, n_bytes, payload (an Arrow stream of all their columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for x in held:
                    w.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n_bytes", "payload"])

        for rb in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(rb.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
            at = 0
            while at < rb.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES - size, side="right")))
                held.append(rb.slice(at, to - at))
                size += int(ends[to - 1]) - done
                at = to
                if size >= BLOCK_BYTES or at < rb.num_rows:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return docs.mapInArrow(tidied(run), "n_bytes long, payload binary").withColumn("block_id", F.monotonically_increasing_id())


@dataclass
class Node:
    """Windows with ``lo`` to ``hi`` bytes before an anchor."""

    lo: int
    hi: int

    def halves(self) -> list[Node]:
        mid = (self.lo + self.hi) // 2
        return [Node(self.lo, mid), Node(mid + 1, self.hi)]


_codec = pa.Codec("zstd", compression_level=1)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _expand(blob: bytes) -> bytes:
    return _codec.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)


class Texts:
    """The texts of a block and their order in the corpus: by doc_id, then by a hash of the text."""

    def __init__(self, payload: bytes, length: int, kmer: int):
        self.length, self.margin = length, length - kmer
        self.table = pa.ipc.open_stream(payload).read_all()
        self.texts = bytes_of(self.table.column("text"))
        ids = pc.cast(self.table.column("doc_id"), pa.int64())
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.searched = [t if k else b"" for t, k in zip(self.texts, self.known.tolist(), strict=True)]

    def ties(self) -> np.ndarray:
        return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in self.texts], np.uint64)


#: What an anchor is known by: text index, position, size of the text, doc_id and tie of the text.
_PLACE = (("docs", np.int32), ("pos", np.int32), ("sizes", np.int64), ("ids", np.int64), ("ties", np.uint64))


@dataclass
class Open:
    """Anchors of a block whose windows in ``node`` are not settled yet."""

    node: Node
    key: np.ndarray  # hash of the bytes that all windows of the node share
    context: np.ndarray  # hash of the bytes of all windows
    place: dict[str, np.ndarray]
    around: Callable[[np.ndarray], np.ndarray]  # rows of bytes of all windows, of some anchors

    def pack(self, rows: np.ndarray, around: np.ndarray) -> bytes:
        head = np.array([self.node.lo, self.node.hi, len(rows)], np.int64).tobytes()
        return _squeeze(head + b"".join(self.place[n][rows].astype(t).tobytes() for n, t in _PLACE) + around.tobytes())


def _anchored(texts: Texts) -> Open:
    """All anchors of a block's texts."""
    length, margin = texts.length, texts.margin
    doc, pos, key, context = anchors(texts.searched, length, length - margin)
    sizes = np.fromiter(map(len, texts.searched), np.int64, len(texts.searched))

    def around(rows: np.ndarray) -> np.ndarray:
        gap = b"\xff" * margin
        flat = np.frombuffer(gap + gap.join(texts.searched) + gap, np.uint8)
        starts = margin + np.concatenate(([0], np.cumsum(sizes + margin)[:-1]))
        return np.lib.stride_tricks.sliding_window_view(flat, length + margin)[starts[doc[rows]] + pos[rows] - margin]

    return Open(Node(0, margin), key, context, {"docs": doc, "pos": pos, "sizes": sizes[doc], "ids": texts.ids[doc], "ties": texts.ties()[doc]}, around)


def _pending(payloads: list[bytes], length: int) -> list[Open]:
    """Anchors of hot keys, whose bytes came along; those go that have no window in the text."""
    out = []
    for blob in payloads:
        raw = _expand(blob)
        lo, hi, n = np.frombuffer(raw, np.int64, 3).tolist()
        at, place = 24, {}
        for name, t in _PLACE:
            place[name] = np.frombuffer(raw, t, n, at)
            at += place[name].nbytes
        width = length + hi - lo
        around = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        room = (place["pos"] >= lo) & (place["pos"] + length - hi <= place["sizes"])
        place, around = {k: v[room] for k, v in place.items()}, np.ascontiguousarray(around[room])
        flat = np.concatenate((around.reshape(-1), np.zeros(8, np.uint8)))
        begin = np.arange(len(around)) * width
        key = hash_ranges(flat, begin + hi - lo, np.full(len(around), length - hi + lo)) ^ mix64(np.array([lo << 8 | hi], np.uint64))
        out.append(Open(Node(lo, hi), key, hash_ranges(flat, begin, np.full(len(around), width)), place, around.__getitem__))
    return out


def _opened(payload: bytes | None, pending: list[bytes] | None, length: int, kmer: int) -> list[Open]:
    return _pending(pending, length) if payload is None else [_anchored(Texts(payload, length, kmer))]


def _requests(blocks: DataFrame, buckets: int, parts: int, length: int, kmer: int) -> DataFrame:
    """Counts of each key: how often it stands, and in how many different contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for block_id, payload, pending in zip(*(rb.column(c).to_pylist() for c in ("block_id", "payload", "pending")), strict=True):
                opened = _opened(payload, pending, length, kmer)
                key, context = (np.concatenate([getattr(o, k) for o in opened]) for k in ("key", "context"))
                keys = tally.Keys(key, buckets)
                often = np.bincount(keys.place, minlength=len(keys))
                by = np.lexsort((context, keys.place))
                new = np.ones(len(by), bool)
                new[1:] = (keys.place[by[1:]] != keys.place[by[:-1]]) | (context[by[1:]] != context[by[:-1]])
                several = np.bincount(keys.place[by[new]], minlength=len(keys))
                yield tally.request_batch(keys.requests(block_id, [often, several], parts))

    return blocks.mapInArrow(tidied(run), tally.REQUEST)


_SENT = "bucket int, kind int, block_id long, lo int, hi int, keys binary, docs binary, pos binary, sizes binary, ids binary, ties binary, contexts binary"
_FOUND = "block_id long, kind int, payload binary"
CONTEXTS, COVERED, PENDING = 0, 1, 2


def _span_payload(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Spans merged within each text, as (text index, lo, hi) numbers."""
    if not len(doc):
        return b""
    by = np.lexsort((lo, doc))
    doc, lo, hi = doc[by], lo[by], hi[by]
    ids = np.unique(doc)
    shift = np.searchsorted(ids, doc) * (int(hi.max()) + 2)  # each text beyond the one before
    a, b = merge_spans(lo + shift, hi + shift)
    first = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1))
    rank = np.searchsorted(shift[first], a, side="right") - 1
    back = shift[first][rank]
    return np.stack((ids[rank], a - back, b - back), 1).astype(np.int32).tobytes()


def _send(blocks: DataFrame, buckets: int, length: int, kmer: int, hot_over: int) -> DataFrame:
    """Contexts of repeated keys by bucket, spans settled within the block, and anchors of hot keys."""
    names = [f.split(" ")[0] for f in _SENT.split(", ")]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for block_id, payload, pending, answers in zip(*(rb.column(c).to_pylist() for c in ("block_id", "payload", "pending", "answers")), strict=True):
                opened = _opened(payload, pending, length, kmer)
                keys = tally.Keys(np.concatenate([o.key for o in opened]), buckets)
                if not len(keys):
                    continue
                often, several = keys.totals(answers or [], 2)[:, keys.place]
                rows, covered, done = [], [], 0
                home = block_id % buckets
                for o in opened:
                    mine = slice(done, done + len(o.key))
                    done += len(o.key)
                    again = np.flatnonzero(often[mine] > 1)
                    if not len(again):
                        continue
                    order = [o.place[n][again] for n in ("pos", "docs", "ties", "ids")]
                    again = again[np.lexsort((*order, o.context[again]))]
                    around, context = o.around(again), o.context[again]
                    new = np.concatenate(([True], context[1:] != context[:-1]))
                    head = np.flatnonzero(new)[np.cumsum(new) - 1]
                    new |= (around != around[head]).any(axis=1)  # equal hashes of unlike bytes
                    doc, pos, size = (o.place[n][again].astype(np.int64) for n in ("docs", "pos", "sizes"))
                    covered.append(tuple(x[~new] for x in (doc, np.maximum(pos - o.node.hi, 0), np.minimum(pos + length - o.node.lo, size))))
                    hot = new & (several[mine][again] > hot_over) & (o.node.hi > o.node.lo)
                    if hot.any():
                        for half in o.node.halves():
                            cut = slice(o.node.hi - half.hi, o.node.hi - half.lo + length)
                            rows.append((home, PENDING, block_id, 0, 0, replace(o, node=half).pack(again[hot], around[hot][:, cut]), *[None] * 6))
                    sent = np.flatnonzero(new & ~hot)
                    if not len(sent):
                        continue
                    at = (o.key[again[sent]] % np.uint64(buckets)).astype(np.int64)
                    by = np.argsort(at, kind="stable")
                    own, begin = np.unique(at[by], return_index=True)
                    for b, x in zip(own.tolist(), np.split(sent[by], begin[1:]), strict=True):
                        place = [o.place[n][again[x]].astype(t).tobytes() for n, t in _PLACE]
                        rows.append((b, CONTEXTS, block_id, o.node.lo, o.node.hi, o.key[again[x]].tobytes(), *place, _squeeze(around[x].tobytes())))
                if covered and (spans := _span_payload(*(np.concatenate(x) for x in zip(*covered, strict=True)))):
                    rows.append((home, COVERED, block_id, 0, 0, spans, *[None] * 6))
                for i in range(0, len(rows), SEND_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + SEND_ROWS], strict=True), types, strict=True)], names=names)

    return blocks.mapInArrow(tidied(run), _SENT)


def repeated_windows(contexts: np.ndarray, room: np.ndarray, length: int, node: Node, group: np.ndarray) -> np.ndarray:
    """covered[i, d]: the window with node.lo + d bytes before anchor i also occurs at an earlier row of its group.

    ``contexts`` rows are ordered by group (ascending numbers), then as their documents are; ``room`` is the
    (left, right) bytes that a row's document has around the anchor, which bound its windows.
    """
    n = len(contexts)
    right_order, right_lcp = order_with_lcp(np.ascontiguousarray(contexts[:, node.hi :]), group=group)
    left_order, left_lcp = order_with_lcp(np.ascontiguousarray(contexts[:, : node.hi][:, ::-1]), shallow=16, group=group)
    covered = np.zeros((n, node.hi - node.lo + 1), bool)
    for d in range(node.lo, node.hi + 1):
        inside = np.flatnonzero((room[:, 0] >= d) & (room[:, 1] >= length - d))
        if len(inside) < 2:
            continue
        both = (classes(right_order, right_lcp, length - d) * (n + 1) + classes(left_order, left_lcp, d))[inside]
        by = np.argsort(both, kind="stable")
        again = np.zeros(len(by), bool)
        again[by[1:]] = both[by[1:]] == both[by[:-1]]
        covered[inside[again], d - node.lo] = True
    return covered


def _settle(length: int):
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        through = table.filter(pa.array(kind != CONTEXTS))
        out = list(zip(*(through.column(c).to_pylist() for c in ("block_id", "kind", "keys")), strict=True))
        sent = table.filter(pa.array(kind == CONTEXTS))
        nodes = np.stack([sent.column(c).to_numpy() for c in ("lo", "hi")], 1) if sent.num_rows else np.zeros((0, 2), int)
        for lo, hi in sorted(set(map(tuple, nodes.tolist()))):
            out += _settle_node(sent.filter(pa.array((nodes == (lo, hi)).all(axis=1))), length, Node(lo, hi))
        return pa.table({"block_id": pa.array([b for b, _, _ in out], pa.int64()), "kind": pa.array([k for _, k, _ in out], pa.int32()), "payload": pa.array([p for _, _, p in out], pa.binary())})

    return run


def _settle_node(table: pa.Table, length: int, node: Node) -> list[tuple[int, int, bytes]]:
    blobs = {c: table.column(c).to_pylist() for c in ("keys", "ids", "ties", "docs", "pos", "sizes", "contexts")}
    key, ids, ties, doc, pos, size = (np.concatenate([np.frombuffer(x, t) for x in blobs[c]]) for c, t in (("keys", np.uint64), ("ids", np.int64), ("ties", np.uint64), ("docs", np.int32), ("pos", np.int32), ("sizes", np.int64)))
    block = np.repeat(table.column("block_id").to_numpy(), [len(x) // 8 for x in blobs["keys"]])
    contexts = np.concatenate([np.frombuffer(_expand(x), np.uint8).reshape(-1, length + node.hi - node.lo) for x in blobs["contexts"]])
    del blobs
    by = np.lexsort((pos, doc, block, ties, ids, key))
    key, doc, pos, size, block, contexts = key[by], doc[by].astype(np.int64), pos[by].astype(np.int64), size[by], block[by], contexts[by]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    found: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo < len(cuts) - 1:  # whole groups, as many as make a block
        hi = lo + 1
        while hi < len(cuts) - 1 and cuts[hi + 1] - cuts[lo] <= COMPARE:
            hi += 1
        x = slice(int(cuts[lo]), int(cuts[hi]))
        room = np.stack((pos[x], size[x] - pos[x]), 1)
        i, d = np.nonzero(repeated_windows(contexts[x], room, length, node, group[x]))
        i, d = i + x.start, d + node.lo
        found.append((block[i], doc[i], pos[i] - d, pos[i] - d + length))
        lo = hi
    block, doc, lo_, hi_ = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(block, kind="stable")
    own, begin = np.unique(block[by], return_index=True)
    return [(int(b), COVERED, _span_payload(doc[x], lo_[x], hi_[x])) for b, x in zip(own, np.split(by, begin[1:]), strict=True)] if len(own) else []


def _searched(docs: DataFrame, length: int, kmer: int, bucket_bytes: int, hot_over: int) -> DataFrame:
    """Blocks of the rows of ``docs`` with ``found``, the spans to remove."""
    with scratch() as keep:
        blocks = keep(materialize(_blocks(docs), "repeats-blocks"))
        size = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
        buckets, parts = max(12, -(-size["b"] // bucket_bytes)), tally.parts_for(size["n"])
        open_ = blocks.select("block_id", "payload", F.lit(None).cast("array<binary>").alias("pending"))
        covered = None
        while True:
            answers = materialize(tally.totals(_requests(open_, buckets, parts, length, kmer), buckets, parts, 2), "repeats-counts")
            per_block = answers.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "totals")).alias("answers"))
            sent = _send(open_.join(per_block, "block_id"), buckets, length, kmer, hot_over)
            settled = keep(materialize(sent.groupBy("bucket").applyInArrow(tidied_group(_settle(length)), _FOUND), "repeats-settled"))
            spans = settled.where(F.col("kind") == COVERED)
            covered = spans if covered is None else covered.unionByName(spans)
            pending = settled.where(F.col("kind") == PENDING)
            if pending.isEmpty():  # the windows of a node halve in each turn, so there are few
                break
            # the bytes of hot anchors came along: blocks are not read again
            open_ = pending.groupBy("block_id").agg(F.collect_list("payload").alias("pending")).select("block_id", F.lit(None).cast("binary").alias("payload"), "pending")
    found = covered.groupBy("block_id").agg(F.collect_list("payload").alias("found"))
    return blocks.join(found, "block_id", "left").select("payload", "found")


def _spans(texts: Texts, found: list[bytes] | None) -> list[np.ndarray]:
    """Flat lo, hi of the merged spans of each text."""
    out = [np.zeros(0, np.int64)] * len(texts.texts)
    if found:
        rows = np.concatenate([np.frombuffer(p, np.int32).reshape(-1, 3) for p in found]).astype(np.int64)
        rows = np.frombuffer(_span_payload(*rows.T), np.int32).reshape(-1, 3).astype(np.int64)
        own, begin = np.unique(rows[:, 0], return_index=True)
        for i, part in zip(own.tolist(), np.split(rows[:, 1:], begin[1:]), strict=True):
            out[i] = part.reshape(-1)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, bucket_bytes: int = BUCKET_BYTES, hot_over: int = HOT_OVER) -> DataFrame:
    """Per row: doc_id, text, n_bytes, spans (flat lo, hi byte offsets of the bytes to remove)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for payload, found in zip(rb.column("payload").to_pylist(), rb.column("found").to_pylist(), strict=True):
                texts = Texts(payload, length, kmer)
                spans = pa.array(_spans(texts, found), pa.list_(pa.int64()))
                n_bytes = pa.array([len(t) for t in texts.texts], pa.int64())
                columns = [texts.table.column(c).combine_chunks() for c in ("doc_id", "text")]
                yield pa.RecordBatch.from_arrays([*columns, n_bytes, spans], names=["doc_id", "text", "n_bytes", "spans"])

    return _searched(docs, length, kmer, bucket_bytes, hot_over).mapInArrow(tidied(run), "doc_id long, text string, n_bytes long, spans array<long>")


def _cut(text: bytes, flat: np.ndarray) -> tuple[bytes, int, int]:
    at, out = 0, []
    for a, b in flat.reshape(-1, 2).tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), int((flat[1::2] - flat[0::2]).sum()), len(flat) // 2


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from ``repeated_spans``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = [_cut(t, s.values.to_numpy()) for t, s in zip(bytes_of(rb.column("text")), rb.column("spans"), strict=True)]
            yield record_batch(
                {"doc_id": rb.column("doc_id"), "n_bytes": rb.column("n_bytes"), "n_removed": [r for _, r, _ in rows], "n_spans": [s for _, _, s in rows], "kept_sha256": [hashlib.sha256(k).hexdigest() for k, _, _ in rows]},
                schema,
            )

    return spans.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, hot_over: int = HOT_OVER) -> DataFrame:
    """Documents without their repeated bytes (a split character goes whole); texts that lose
    every byte are dropped. Other columns stay; n_chars follows the text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for payload, found in zip(rb.column("payload").to_pylist(), rb.column("found").to_pylist(), strict=True):
                texts = Texts(payload, length, kmer)
                old, keep, new = texts.table.column("text").to_pylist(), [], []
                for i, spans in enumerate(_spans(texts, found)):
                    text = old[i]
                    if len(spans):
                        text = _cut(texts.texts[i], spans)[0].decode("utf-8", "ignore")
                        if not text:
                            continue
                    keep.append(i)
                    new.append(text)
                kept = texts.table.take(pa.array(keep, pa.int64())).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(new, kept.schema.field("text").type) if c == "text" else kept.column(c).combine_chunks() for c in names], names=names)

    out = _searched(docs, length, kmer, BUCKET_BYTES, hot_over).mapInArrow(tidied(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM w),
c AS (SELECT doc_id, p AS lo, p + 100 AS hi, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE again),
g AS (SELECT doc_id, lo, hi, sum(CASE WHEN before >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM c),
s AS (SELECT doc_id, run, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS since FROM s),
t AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS kept, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
