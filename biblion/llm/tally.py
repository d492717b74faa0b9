"""Exact corpus counts of 64-bit keys, answered to the blocks of texts that asked.

A block sends its distinct keys with local counts, a row for each bucket it has keys for (a
frequent key is one entry per block). A bucket adds them up and answers each block in the
block's own order, so no table of counts is ever broadcast and no row per token is shuffled.
A key that every block has would bring all blocks to one bucket: beyond ``BLOCKS_PER_PART``
blocks a bucket is split into parts by block, parts add up on their own, and only their sums
meet before the parts answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, tidied_group

BLOCKS_PER_PART = 4096
REQUEST = "bucket int, part int, block_id long, keys binary, counts binary"
ANSWER = "block_id long, bucket int, totals binary, types long"
#: Keys with this bit are counted as types.
TYPE_BIT = np.uint64(1 << 63)


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers as byte planes: the upper ones are mostly zero, which compression drops."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def packed(arrays: Iterable[np.ndarray]) -> bytes:
    """The arrays' planes, compressed by entropy, which the shuffle's own codec does not do."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes(x) for x in arrays))


def unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


class Keys:
    """Distinct keys ordered by bucket, each key's place among them, and where each bucket lies."""

    def __init__(self, keys: np.ndarray, buckets: int):
        by = np.argsort(keys, kind="stable")
        new = np.concatenate((np.ones(min(len(by), 1), bool), keys[by[1:]] != keys[by[:-1]]))
        values = keys[by[new]]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new) - 1
        at = (values % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.values, self.place, self.buckets = values[order], back[rank], buckets
        self.own, begin = np.unique(at[order], return_index=True)
        self.bounds = [*begin.tolist(), len(order)]

    def __len__(self) -> int:
        return len(self.values)

    def requests(self, block_id: int, counts: list[np.ndarray], parts: int) -> list[tuple]:
        """Rows of ``REQUEST``; each of ``counts`` follows ``values``."""
        part = int(mix64(np.array([block_id], np.int64).view(np.uint64))[0] % np.uint64(parts))
        counts = [np.asarray(c, np.int64) for c in counts]
        rows = []
        for b, lo, hi in zip(self.own.tolist(), self.bounds, self.bounds[1:], strict=False):
            gaps = np.diff(self.values[lo:hi] // np.uint64(self.buckets), prepend=np.uint64(0))
            rows.append((b, part, block_id, packed([gaps]), packed(c[lo:hi] for c in counts)))
        return rows

    def totals(self, answers: list[dict], width: int) -> np.ndarray:
        """(width, keys): corpus counts in the order of ``place``, from the block's answers."""
        if not answers:
            return np.zeros((width, 0), np.int64)
        answers = sorted(answers, key=lambda a: a["bucket"])
        return np.concatenate([_counts(a["totals"], width) for a in answers], axis=1)


def request_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "part", "block_id", "keys", "counts"])


def _counts(blob: bytes, width: int) -> np.ndarray:
    blob = unpacked(blob)
    size = len(blob) // width
    return np.stack([from_planes(blob[k * size : (k + 1) * size]).view(np.int64) for k in range(width)])


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(unpacked(blob)), dtype=np.uint64)


def _read(table: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys (divided by the bucket count) of each row, and all rows' counts."""
    keys = [_keys(x) for x in table.column("keys").to_pylist()]
    return keys, np.concatenate([_counts(x, width) for x in table.column("counts").to_pylist()], axis=1)


def _add(keys: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their total counts, and each entry's place."""
    flat = np.concatenate(keys)
    by = np.argsort(flat, kind="stable")  # runs of ascending keys are merged
    new = np.concatenate((np.ones(min(len(by), 1), bool), flat[by[1:]] != flat[by[:-1]]))
    first = np.flatnonzero(new)
    totals = np.add.reduceat(counts[:, by], first, axis=1) if len(first) else counts
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1
    return flat[by[new]], totals, place


def _types(keys: np.ndarray, totals: np.ndarray, bucket: int, buckets: int) -> int:
    full = keys * np.uint64(buckets) + np.uint64(bucket)
    return int(((full >= TYPE_BIT) & (totals[0] > 0)).sum())


def _answers(buckets: int, width: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _read(table, width)
        distinct, totals, place = _add(keys, counts)
        ends = np.cumsum([len(k) for k in keys]).tolist()
        found = [packed(t[place[e - len(k) : e]] for t in totals) for k, e in zip(keys, ends, strict=True)]
        types = [_types(distinct, totals, table.column("bucket")[0].as_py(), buckets), *[0] * (len(keys) - 1)]
        return pa.table({"block_id": table.column("block_id"), "bucket": table.column("bucket"), "totals": pa.array(found, pa.binary()), "types": pa.array(types, pa.int64())})

    return run


def _fold(width: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        distinct, totals, _ = _add(*_read(table, width))
        return pa.table({"bucket": table.column("bucket")[:1], "part": table.column("part")[:1], "keys": pa.array([packed([np.diff(distinct, prepend=np.uint64(0))])], pa.binary()), "counts": pa.array([packed(totals)], pa.binary())})

    return run


def _look_up(width: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        whole = table.column("whole").to_pylist()
        at = whole.index(True)
        keys, counts = _read(table.slice(at, 1), width)
        out = []
        for i, k in enumerate(table.column("keys").to_pylist()):
            if not whole[i]:
                out.append(packed(counts[:, np.searchsorted(keys[0], _keys(k))]))
        rest = table.filter(pa.array([not w for w in whole]))
        types = [table.column("types")[at].as_py(), *[0] * (len(out) - 1)]
        return pa.table({"block_id": rest.column("block_id"), "bucket": rest.column("bucket"), "totals": pa.array(out, pa.binary()), "types": pa.array(types, pa.int64())})

    return run


def parts_for(blocks: int) -> int:
    return max(1, -(-blocks // BLOCKS_PER_PART))


def totals(requests: DataFrame, buckets: int, parts: int, width: int) -> DataFrame:
    """``ANSWER`` rows: for each request, the total counts of its keys; ``types`` sums to the number of
    distinct keys with ``TYPE_BIT`` whose first count is not zero."""
    if parts == 1:
        return requests.groupBy("bucket").applyInArrow(tidied_group(_answers(buckets, width)), ANSWER)
    asked = materialize(requests, "tally-requests")
    folded = asked.groupBy("bucket", "part").applyInArrow(tidied_group(_fold(width)), "bucket int, part int, keys binary, counts binary")
    folded = materialize(folded, "tally-folded")
    added = folded.withColumn("block_id", F.col("part").cast("long")).groupBy("bucket").applyInArrow(tidied_group(_answers(buckets, width)), ANSWER)
    added = added.select("bucket", F.col("block_id").cast("int").alias("part"), F.col("totals").alias("counts"), "types")
    whole = folded.drop("counts").join(added, ["bucket", "part"]).select("bucket", "part", F.lit(0).cast("long").alias("block_id"), "keys", "counts", "types", F.lit(True).alias("whole"))
    both = asked.select("bucket", "part", "block_id", "keys", "counts", F.lit(0).cast("long").alias("types"), F.lit(False).alias("whole")).unionByName(whole)
    return both.groupBy("bucket", "part").applyInArrow(tidied_group(_look_up(width)), ANSWER)
