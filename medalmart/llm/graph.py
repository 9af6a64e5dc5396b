"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Minima are made before the shuffle, so a node with very many neighbours is no burden."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


#: Edges up to which one task joins them in memory, at some 200 bytes each.
FEW_EDGES = 50_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components by union and find, the smallest node at the root."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    kind = batch.schema.field(0).type if nodes else pa.binary()
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (``u, v``).

    Every round leaves a table in the shared folder. Rounds grow with the logarithm of the longest path.
    Few edges are one task's work.
    """
    edges = stored(edges.where("u != v").select("u", "v").distinct(), "edges")
    if edges.rows <= FEW_EDGES:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    while edges.rows:
        before, edges = edges, stored(_star(_star(edges, True), False), "edges")
        discard(before)
        # Edges lead from a larger to a smaller node; if none leads on from where another ends, all are stars.
        if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    # Stars now: every node points at the smallest of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
