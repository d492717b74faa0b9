"""Shared plumbing of the training-data operators.

* ``materialize`` cuts lineage by writing a table below ``spark.checkpoint.dir``
  (set here only where the session has none), so a lost executor costs a re-read.
* ``word_batch`` turns a list of UTF-8 byte strings into one flat array of 64-bit
  word hashes with numpy, without a Python loop over words.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds the temporaries of a task.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash.

    Without ``spark.checkpoint.dir`` a local session gets a temporary one; a cluster has no
    folder that would serve, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="biblion-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark then drops a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize(df: DataFrame, tag: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with the same schema.

    The shuffle files behind it go at once: the table, not they, is what later steps read.
    ``batch_bytes`` bounds the Arrow batches that its Python steps get (a row is never split).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    if scopes := _scopes.get():
        scopes[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        jvm, path = table.sparkSession.sparkContext._jvm, table.written_to
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Open blocks of this thread (a thread that starts within one has none of its own).
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("_scopes", default=())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within the block, tables of ``materialize`` are temporary: they go at its end, but for
    those that were given to the yielded function."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    outer = _scopes.get()
    _scopes.set((*outer, made))
    try:
        yield keep
    finally:
        _scopes.set(outer)
        stay = {t.written_to for t in kept}
        discard(*(t for t in made if t.written_to not in stay))
        if outer:
            outer[-1].extend(kept)


#: Bits of the filter that ``likely_rows`` broadcasts, and how many one row of it holds.
FILTER_BITS, WORD_BITS = 1 << 23, 64


def likely_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (doc_id), and a few others.

    A bitmap of fixed size (2**17 rows of 64 bits) is broadcast; where the ids fill it, it
    lets more rows pass. The caller's own join on doc_id decides.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    word, bit = F.floor(slot / WORD_BITS).cast("int"), F.pmod(slot, F.lit(WORD_BITS)).cast("int")
    bits = ids.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("_word").agg(F.bit_or("b").alias("_bits"))
    return docs.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.call_function("getbit", F.col("_bits"), bit) == 1).select(*docs.columns)


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of a column's text form, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string")) % F.lit(mod)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes in a text column, which the bucket counts follow."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def tidy() -> None:
    """Give freed memory back to the system, so that an idle worker holds none of a task's peak."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run: Callable) -> Callable:
    """``run`` for mapInArrow, tidying up after its last batch."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return whole


def tidied_group(run: Callable) -> Callable:
    """``run`` for applyInArrow, tidying up after each group."""

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        del table
        tidy()
        return out

    return group


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def folded_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of the lower-cased (all of Unicode) string column; null becomes empty."""
    return bytes_of(pc.utf8_lower(column))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes each; one longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Words longer than this are hashed one by one.
LONG_WORD = 256
_KEYS = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_ranges(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the byte ranges of ``flat``, which has eight bytes more than any range needs.

    Eight bytes at a time are mixed into the state by a step that is one-to-one in them (an
    odd factor, then ``mix64``), so ranges of up to eight bytes never collide with one of
    their length, and of longer ones two that differ in one such part never do; ranges over
    ``LONG_WORD`` go through BLAKE2b.
    """
    words = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    key = _KEYS[seed]
    state = mix64(sizes.astype(np.uint64) + key)
    active = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    done = 0
    while len(active):
        left = sizes[active] - done
        part = words[starts[active] + done] & _LOW_BYTES[np.minimum(left, 8)]
        state[active] = mix64((state[active] ^ part) * key)
        active, done = active[left > 8], done + 8
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(flat[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest()
        state[i] = int.from_bytes(digest, "little")
    return state


def byte_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is-word per byte, folded byte); A-Z are lower-cased if asked."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    folded = np.arange(256)
    if lower:
        folded[65:91] += 32
    return word, folded.astype(np.uint8)


#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of a-z, 0-9 and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


#: Runs of a-z and everything beyond ASCII, of lower-cased text
LETTERS = byte_table(bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class WordBatch:
    """Words of some texts: hashes, byte ranges in ``flat`` (folded), and each text's word range."""

    __slots__ = ("flat", "hashes", "starts", "ends", "first", "text_at")

    def __init__(self, texts: list[bytes], table: tuple[np.ndarray, np.ndarray]):
        is_word, value = table
        flat = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(lengths + 1)))
        inside = is_word[flat]
        edge = np.empty(len(flat), bool)
        edge[0] = inside[0]
        np.greater(inside[1:], inside[:-1], out=edge[1:])
        starts = np.flatnonzero(edge)
        edge[0] = False
        np.less(inside[1:], inside[:-1], out=edge[1:])
        ends = np.flatnonzero(edge)
        self.flat, self.starts, self.ends, self.text_at = value[flat], starts, ends, at
        self.hashes = hash_ranges(self.flat, starts, ends - starts)
        self.first = np.searchsorted(starts, at)

    def other_hashes(self) -> np.ndarray:
        """Hashes that are independent of ``hashes``."""
        return hash_ranges(self.flat, self.starts, self.ends - self.starts, 1)

    def prefix_hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, hashes) of the first ``n`` bytes of words that have as many."""
        long = np.flatnonzero(self.ends - self.starts >= n)
        return long, hash_ranges(self.flat, self.starts[long], np.full(len(long), n))

    def word(self, i: int) -> bytes:
        """The folded word."""
        return self.flat[self.starts[i] : self.ends[i]].tobytes()


def fold_windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (runs may cross texts; the caller picks)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total *= np.uint64(0xA0761D6478BD642F)
        total += hashes[k : k + m]
    return mix64(total)


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; by sorting, which is faster than ``np.unique``'s hash table."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + c)`` of each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    s, c = starts[keep].astype(np.int64), counts[keep].astype(np.int64)
    out[0] = s[0]
    at = np.cumsum(c)[:-1]
    out[at] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    made = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)
