"""Connected components of a graph given as an edge table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Links that are contracted together in one task.
PART_LINKS = 1_000_000
#: Keys whose value is broadcast, at most.
HOT_KEYS = 1 << 14


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (node, root) for each node that isn't its component's least: roots hook to lesser ones, then paths halve."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def done():
        u, v = contract(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held, size = [], 0
    for b in batches:
        if held and size + len(b) > most:
            yield done()
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield done()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of non-null longs -> (node, root) for each node that has an edge; root is the least node it reaches.

    First, parts of at most PART_LINKS links are contracted, each in a task of its own, to a star for each component of
    the part. One part is then the whole answer. Several parts' stars are joined by rounds, each of which halves the
    remaining depth and more, so that the rounds grow with the logarithm of the longest chain; there, a node's neighbours are
    only reduced by min(), never gathered. Each round is written to the shared folder. No edges: no rows.
    """
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    parts = -(-edges.count() // PART_LINKS)
    edges = materialise(edges.coalesce(max(1, parts)).mapInArrow(lambda it: _contracted(it, PART_LINKS), "u long, v long"), "edges")
    before = _state(edges) if parts > 1 else (0, None)
    while before[0]:
        edges = materialise(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def looked_up(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows with the values of their key, by an inner join that no frequent key makes lopsided.

    values has a row for each key and how many rows have it (n). Keys with over a HOT_KEYS-th of all rows are fewer than HOT_KEYS: their values are
    broadcast, and their rows stay where they are. The others are joined by a shuffle.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(values.where(F.col("n") * HOT_KEYS > total).drop("n"))
    cold = values.where(F.col("n") * HOT_KEYS <= total).drop("n").hint("merge")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
