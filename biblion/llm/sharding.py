"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a
step, both from its name). The shards take turns; each claims the first free slot of its
permutation until the table is full, so shares differ by one slot at most and few slots
move when a shard comes or goes. The table is filled on the driver (its size is a
parameter, not a function of the data) and broadcast; a row's slot is its key's hash
modulo the table size, its shard one look-up.

Defined cases: a null key has the slot of the empty string; equal keys share a shard, so
repeated rows stay together; empty tables give empty results; other columns are kept, and
the added column replaces one of its name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> list[int]:
    """slot -> number of its shard. ``size`` must be a prime above the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and at least one")
    if size <= len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime above the number of shards")
    offset = [_hash(f"offset:{s}") % size for s in shards]
    step = [_hash(f"step:{s}") % (size - 1) + 1 for s in shards]
    tried = [0] * len(shards)
    table, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while table[slot := (offset[i] + tried[i] * step[i]) % size] >= 0:
                tried[i] += 1
            table[slot] = i
            tried[i] += 1
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot: the first 15 hex digits of its MD5 modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, column: str = "shard") -> DataFrame:
    """``rows`` with the name of each row's shard in ``column``."""
    table = lookup_table(shards, size)
    spark = rows.sparkSession
    taken = {c.lower() for c in rows.columns}
    slot, shard = (next(n for k in range(len(taken) + 1) if (n := f"_{name}{k}") not in taken) for name in ("slot", "shard"))
    slots = spark.createDataFrame(list(enumerate(table)), f"{slot} int, {shard} int")
    names = F.array(*[F.lit(s) for s in shards])
    found = rows.withColumn(slot, slot_of(F.col(key), size)).join(F.broadcast(slots), slot, "left")  # ``size`` rows of two numbers
    return found.withColumn(column, F.element_at(names, F.col(shard) + 1)).drop(slot, shard)


def oracle_sql(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> str:
    """Slots and shards of ``documents``; the table itself comes in as a list (tests fill it by brute force)."""
    table = ", ".join(map(str, lookup_table(shards, size)))
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
WITH s AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {size} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, list_extract([{names}], list_extract([{table}], slot + 1) + 1) AS shard FROM s"""
