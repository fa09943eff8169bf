"""Connected components with DataFrame operations: large-star and small-star steps until nothing changes.

Every step is a partial aggregation and a join, so a hub with a third of all edges is pre-aggregated before its
shuffle and its join partition can be split; results of a step are written to the shared folder.  At the end of a step
each task ties the nodes of its own edges to the least one that these reach, which changes no component: few edges lie in
one task and are done at once, and many need fewer steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, lean, prepare, stored

#: Edges that a task holds before it ties their nodes.
HELD = 1 << 20

EDGES = "a long, b long, task long"


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Edges hold (a, b) with b < a.  Neighbours are tied to the least of them, the larger or the smaller ones."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return tied.where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each node but the least of its component to that one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(nodes)), np.split(ends, 2)
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars, with a number that differs between tasks and between parts of one that were not tied together."""
    none = np.zeros(0, np.int64)
    a, b, fresh, size, part = none, none, [], 0, TaskContext.get().partitionId()

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), part, np.int64))], names=["a", "b", "task"])

    for batch in batches:
        fresh.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= HELD:
            a, b = stars(*(np.concatenate(x) for x in zip((a, b), *fresh, strict=True)))
            fresh, size = [], 0
            if len(a) >= HELD:
                yield row()
                a, b, part = none, none, part + (1 << 32)
    a, b = stars(*(np.concatenate(x) for x in zip((a, b), *fresh, strict=True)))
    yield row()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), (F.min("task") == F.max("task")).alias("one")).collect()[0]
    return row.n, row.h, row.one


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Nulls link nothing, loops and repeated edges change nothing, no edges give no rows.
    """
    prepare(edges.sparkSession)
    tied = lambda rows: stored(rows.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(lean(_tied), EDGES), "edges")
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = tied(pairs.where("a <> b").distinct())  # of a null and a node both are the node
    state = _state(now)
    while state[0] and not state[2]:  # edges that one task has tied are stars already
        before, old = state, now
        now = tied(_step(_step(now.select("a", "b"), large=True), large=False))
        state = _state(now)
        drop_stored(old)
        if state[:2] == before[:2]:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
