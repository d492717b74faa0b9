"""Versioned tables of the cache: bases and deltas by bucket, with an index of their files.

A table with keys is dealt to buckets by a hash of its keys. A version is a manifest (JSON) that
names, for each bucket of each table, a base folder and the deltas since; it is created with
overwriting off, never changed, and readers use the newest whole one, so a failed job leaves the
version before and of two writers one fails. An upsert writes its own rows only, as one delta in
the buckets they fall in; reading takes, of rows of one key, those of the newest folder: rows of a
bucket's last folder as they are, of those before it the rows whose keys no later one has. ``compact`` makes one base of buckets with many deltas.

Rows carry the hash of their keys and lie in its order. For each file an index row has the
least and greatest hash and a Bloom filter of the hashes: ``look_up`` opens only files that may
hold the key. ``current`` gets the rows of many keys from their buckets alone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..schemas import CACHE_TABLES

#: Keys of the tables that have some; their buckets, the deltas of a bucket before it is compacted.
KEYS = {"works": ("publication_key",), "records": ("source_record_key",), "results": ("publication_key", "model"), "meta": ("key",)}
BUCKETS, DELTAS, ROWS_PER_FILE = 64, 8, 1_000_000
#: Parts of a bucket that tasks may write apart, where there are enough rows for it.
SLICES = 8
#: Bits a key and probes of the Bloom filters, and the most bits that one has.
KEY_BITS, PROBES, MOST_BITS = 12, 4, 1 << 24
#: Seconds that a half-written manifest may take before its writer counts as dead.
PATIENCE_S = 5.0
_INDEX = "bucket int, file string, lo long, hi long, n long, bits binary"


def _hash(keys: tuple[str, ...]) -> Column:
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """(probes, hashes): bits of a filter of ``size`` bits that stand for each hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low + high * np.arange(PROBES, dtype=np.uint64)[:, None]) & np.uint64(size - 1)


def may_hold(bits: bytes, value: int) -> bool:
    """The filter has the hash, or looks as if it had."""
    packed = np.frombuffer(bits, np.uint8)
    at = _places(np.array([value], np.int64), 8 * len(packed))[:, 0]
    return bool((packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all())


class Snapshots:
    """Tables below one folder, on any file system that Hadoop reads."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.root, self.buckets, self.deltas = spark, root.rstrip("/"), buckets, deltas

    # --- versions ---

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _numbers(self) -> list[int]:
        pattern, fs = self._path("manifest-*")
        return sorted(int(f.getPath().getName().split("-")[1]) for f in fs.globStatus(pattern) or [])

    def _manifest(self, version: int) -> dict | None:
        """The tables of a version; None while it is being written, or if its writer died."""
        text = self.spark.read.text(f"{self.root}/manifest-{version:08d}", wholetext=True).first()
        try:
            return json.loads(text[0]) if text else None
        except ValueError:
            return None

    def version(self) -> int:
        """The newest whole version, 0 if there is none."""
        return next((n for n in reversed(self._numbers()) if self._manifest(n) is not None), 0)

    def tables(self, version: int | None = None) -> dict[str, dict]:
        """What the manifest tells of each table of a version (the newest)."""
        n = self.version() if version is None else version
        return (self._manifest(n) or {}) if n else {}

    def _commit(self, base: int, tables: dict[str, dict]) -> int:
        """The manifest of the next version; fails if another writer has made one since ``base``."""
        found = self._numbers()
        if found and found[-1] > base:
            begun = time.monotonic()
            while self._manifest(found[-1]) is None and time.monotonic() - begun < PATIENCE_S:
                time.sleep(0.2)
            if self._manifest(found[-1]) is not None:
                raise RuntimeError(f"version {found[-1]} has been published by someone else")
        n = (found[-1] if found else 0) + 1
        path, fs = self._path(f"manifest-{n:08d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise RuntimeError(f"version {n} has been published by someone else") from e
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        return n

    # --- writing ---

    def _store(self, name: str, rows: DataFrame, keys: tuple[str, ...], buckets: int, version: int) -> tuple[str, list[int]]:
        """(folder, buckets that have rows in it) of rows written with their index."""
        folder = f"{name}/v{version:08d}-{uuid.uuid4().hex}"
        if not keys:
            rows.withColumn("bucket_no", F.lit(0)).write.partitionBy("bucket_no").parquet(f"{self.root}/{folder}/rows")
        else:
            dealt = rows.withColumn("key_hash", _hash(keys)).withColumn("bucket_no", F.pmod("key_hash", F.lit(buckets)).cast("int"))
            dealt = dealt.withColumn("slice_no", F.pmod(F.shiftright("key_hash", 32), F.lit(SLICES))).hint("rebalance", "bucket_no", "slice_no").drop("slice_no")
            dealt.sortWithinPartitions("bucket_no", "key_hash").write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("bucket_no").parquet(f"{self.root}/{folder}/rows")
        pattern, fs = self._path(f"{folder}/rows/bucket_no=*")
        used = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.globStatus(pattern) or [])
        if keys and used:
            self._index(folder)
        return folder, used

    def _index(self, folder: str) -> None:
        """An index row for each file of a folder; a file's keys are read in batches, never as one group, and a task gives
        one filter for the rows of a file that it reads."""
        files = self.spark.read.parquet(f"{self.root}/{folder}/rows").select(F.col("bucket_no").alias("bucket"), F.col("_metadata.file_path").alias("file"), "key_hash")
        known = files.groupBy("bucket", "file").agg(F.min("key_hash").alias("lo"), F.max("key_hash").alias("hi"), F.count("*").alias("n"))
        most = known.agg(F.max("n")).first()[0]
        size = min(MOST_BITS, max(1 << 10, 1 << (KEY_BITS * most - 1).bit_length()))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, on = None, np.zeros(size, bool)

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["file", "bits"])

            for rb in batches:
                names, hashes = rb.column("file").dictionary_encode(), rb.column("key_hash").to_numpy()
                number = names.indices.to_numpy()
                for i, file in enumerate(names.dictionary.to_pylist()):
                    if at not in (None, file):
                        yield told()
                        on[:] = False
                    at = file
                    on[_places(hashes[number == i], size).reshape(-1).astype(np.int64)] = True
            if at is not None:
                yield told()

        def united(table: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")])
            return pa.table({"file": table.column("file")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

        marked = files.select("file", "key_hash").mapInArrow(mark, "file string, bits binary").groupBy("file").applyInArrow(united, "file string, bits binary")
        known.join(marked, "file").select("bucket", "file", "lo", "hi", "n", "bits").sort("bucket").write.parquet(f"{self.root}/{folder}/index")

    def _entry(self, name: str, rows: DataFrame, version: int, keys: tuple[str, ...] | None = None) -> dict:
        keys = KEYS.get(name, ()) if keys is None else keys
        buckets = self.buckets if keys else 1
        folder, used = self._store(name, rows, keys, buckets, version)
        return {"keys": list(keys), "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": {str(b): [folder] for b in used}}

    def _aligned(self, rows: DataFrame, schema: StructType) -> DataFrame:
        """Rows with exactly the table's columns; those they lack are null."""
        own = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """The next version: these tables as given, all others as they were."""
        n = self.version()
        told = self.tables(n)
        return self._commit(n, told | {name: self._entry(name, rows, n + 1) for name, rows in tables.items()})

    def upsert(self, tables: dict[str, DataFrame], declared: bool = False) -> int:
        """The next version: rows (one for a key) replace those of their keys, all others stay. Writes these rows only.

        A table that is new takes its columns from the rows, or from its declaration if ``declared``.
        """
        n = self.version()
        told = self.tables(n)
        for name, rows in tables.items():
            if name not in told:
                told[name] = self._entry(name, self._aligned(rows, self.declared(name).schema) if declared else rows, n + 1)
                continue
            table = told[name]
            if not table["keys"]:
                raise ValueError(f"{name} has no keys")
            folder, used = self._store(name, self._aligned(rows, StructType.fromJson(table["schema"])), tuple(table["keys"]), table["buckets"], n + 1)
            for b in map(str, used):
                table["folders"][b] = [*table["folders"].get(b, []), folder]
        return self._commit(n, told)

    def compact(self, most: int | None = None) -> int:
        """One base for every bucket with more than ``most`` deltas; the version after, or the same if there is none."""
        most, n = self.deltas if most is None else most, self.version()
        told, changed = self.tables(n), False
        for name, table in told.items():
            full = [int(b) for b, folders in table["folders"].items() if len(folders) > most + 1]
            if full:
                folder, used = self._store(name, self._read(table, full), tuple(table["keys"]), table["buckets"], n + 1)
                table["folders"] |= {str(b): [folder] for b in used}
                changed = True
        return self._commit(n, told) if changed else n

    def declared(self, name: str) -> DataFrame:
        """A declared table without rows."""
        return self._empty(StructType.fromDDL(CACHE_TABLES[name]))

    def _empty(self, schema: StructType) -> DataFrame:
        """No rows, and no task to make them."""
        return self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).where(F.lit(False))

    def bootstrap(self) -> int:
        """The declared tables, empty, where they are not there yet."""
        n = self.version()
        told = self.tables(n)
        missing = {name: self.declared(name) for name in CACHE_TABLES if name not in told}
        return self.publish(missing) if missing else n

    # --- reading ---

    def _rows(self, table: dict, paths: list[str]) -> DataFrame:
        """Rows of folders or files, with the version that wrote them."""
        schema = StructType.fromJson(table["schema"])
        stored = StructType([*schema.fields, StructField("key_hash", LongType())]) if table["keys"] else schema
        return self.spark.read.schema(stored).parquet(*paths).withColumn("_of", F.regexp_extract("_metadata.file_path", r"/v(\d{8})-[0-9a-f]{32}/", 1))

    def _newest(self, table: dict, rows: DataFrame) -> DataFrame:
        """Of rows of one key, the one written last."""
        columns = StructType.fromJson(table["schema"]).names
        rest = [c for c in columns if c not in table["keys"]]
        if not rest:
            return rows.select(*columns).distinct()
        return rows.groupBy(*table["keys"]).agg(F.max_by(F.struct(*rest), "_of").alias("_r")).select(*table["keys"], "_r.*").select(*columns)

    def _uncovered(self, table: dict, older: list[str], newer: list[str]) -> DataFrame:
        """Rows of older folders whose keys no folder after theirs has. Only keys of newer rows meet them, and only columns in use are read."""
        o, n = self._rows(table, older).alias("o"), self._rows(table, newer).select(*table["keys"], "_of").alias("n")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in table["keys"]]
        return o.join(n, reduce(Column.__and__, same, F.col("o._of") < F.col("n._of")), "left_anti").select(*StructType.fromJson(table["schema"]).names)

    def _read(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = {b: f for b, f in table["folders"].items() if buckets is None or int(b) in set(buckets)}
        columns = StructType.fromJson(table["schema"]).names
        paths = {b: [f"{self.root}/{x}/rows/bucket_no={b}" for x in f] for b, f in wanted.items()}
        if not paths:
            return self._empty(StructType.fromJson(table["schema"]))
        last = self._rows(table, [p[-1] for p in paths.values()]).select(*columns)
        older, newer = ([x for p in paths.values() for x in p[part]] for part in (slice(None, -1), slice(1, None)))
        return last.unionByName(self._uncovered(table, older, newer)) if older else last

    def read(self, table: str) -> DataFrame | None:
        """All rows of a table, None if there is none of the name."""
        told = self.tables().get(table)
        return self._read(told) if told else None

    def current(self, table: str, keys: DataFrame) -> DataFrame | None:
        """The rows whose keys are in ``keys`` (the table's key columns), read from their buckets alone."""
        told = self.tables().get(table)
        if not told:
            return None
        bucket = F.pmod(_hash(tuple(told["keys"])), F.lit(told["buckets"])).cast("int")
        used = [r["b"] for r in keys.select(bucket.alias("b")).distinct().collect()]  # no more than there are buckets
        return self._read(told, used).join(keys.select(*told["keys"]), told["keys"], "left_semi")

    def files_for(self, table: str, *key: object) -> list[str]:
        """Files that may hold a key: by its bucket, then by least and greatest hash and Bloom filter of each."""
        told = self.tables()[table]
        values = ", ".join(f"CAST(:k{i} AS STRING)" for i in range(len(key)))
        value = self.spark.sql(f"SELECT xxhash64({values}) AS h", args={f"k{i}": k for i, k in enumerate(key)}).first()["h"]
        bucket = value % told["buckets"]
        folders = told["folders"].get(str(bucket), [])
        if not folders:
            return []
        index = self.spark.read.schema(_INDEX).parquet(*[f"{self.root}/{f}/index" for f in folders])
        near = index.where((F.col("bucket") == bucket) & (F.col("lo") <= value) & (F.col("hi") >= value)).collect()  # files of one bucket
        return sorted(r["file"] for r in near if may_hold(r["bits"], value))

    def look_up(self, table: str, *key: object) -> DataFrame | None:
        """The row of one key (none if there is none), from the files that may hold it."""
        told = self.tables().get(table)
        if not told:
            return None
        files = self.files_for(table, *key)
        if not files:
            return self._empty(StructType.fromJson(told["schema"]))
        same = [F.col(k).cast("string") == F.lit(v).cast("string") for k, v in zip(told["keys"], key, strict=True)]
        rows = self._rows(told, files).where(F.col("key_hash") == F.xxhash64(*[F.lit(v).cast("string") for v in key]))
        for x in same:
            rows = rows.where(x)
        return self._newest(told, rows)

    def publish_results(self, results: DataFrame) -> int:
        """Classification results (publication_key, model, …) into the table ``results``; equal keys are replaced."""
        return self.upsert({"results": results})
