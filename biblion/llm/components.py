"""Connected components of an edge table, distributed, without collecting any of it.

Edges are first contracted within tasks: each takes ``CONTRACT_BYTES`` of them and leaves a star
per component that it sees, at most an edge per node. What few tasks cannot settle goes on by
alternating large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum
and a join; a hub's edges are pre-aggregated for the minimum and the join splits skewed
keys. Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidied

#: Stored bytes of edges for one contracting task, and edges that it holds at once.
CONTRACT_BYTES, CONTRACT_EDGES = 8 << 20, 2_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes but these least ones."""
    ids, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        least = np.minimum(x, y)
        np.minimum.at(label, np.concatenate((x, y)), np.concatenate((least, least)))
        while not np.array_equal(label, short := label[label]):
            label = short
    low = np.flatnonzero(label != np.arange(len(ids)))
    return ids[low], ids[label[low]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges of the same components, at most one per node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for rb in batches:
            held.append(np.stack([rb.column(c).to_numpy() for c in ("u", "v")]))
            size += rb.num_rows
            if size > CONTRACT_EDGES:
                held = [np.stack(stars(*np.concatenate(held, axis=1)))]
                if held[0].shape[1] > CONTRACT_EDGES // 2:  # nothing much to gain in this task
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["u", "v"])
                    held = []
                size = sum(h.shape[1] for h in held)
        if held:
            u, v = stars(*np.concatenate(held, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    size = int(str(edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, no job
    return edges.coalesce(max(1, min(1 << 20, -(-size // CONTRACT_BYTES)))).mapInArrow(tidied(run), "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> a table (node, component) with a row for each node that has an edge; component is
    the least node reachable. Loops and repeated edges are harmless, no edges give no rows."""
    edges = materialize(_contracted(edges.select("u", "v").where("u <> v")), "edges")
    while not _settled(edges):
        old, edges = edges, materialize(_small_star(_large_star(edges)), "edges")
        discard(old)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = materialize(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "labels")
    discard(edges)
    return labels
