"""Connected components of a distributed edge list by contraction.

Each round points every node at its smallest neighbour, if that is smaller
than itself, follows the pointer once more, and replaces both ends of every
edge by where they point; edges inside one node go. At least half of a
component's remaining nodes vanish each round, so the number of rounds grows
with the logarithm of the largest component. When few enough edges are left for one
task (``FINISH``), a task joins them in memory. Nothing is collected; minima
are taken before each shuffle, so a node with very many neighbours doesn't
gather.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import staged


FINISH = 200_000
_UP = "node long, up long"


def joined(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest node that each node can reach."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges: list[tuple[int, int]] = []
    for batch in batches:
        edges += zip(*(batch.column(i).to_pylist() for i in (0, 1)))
    found = joined(edges)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["node", "up"])


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (a, b)."""
    edges = staged(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "cc-edges")
    labels = None
    while n := edges.count():
        if n <= finish:
            up = staged(edges.coalesce(1).mapInArrow(_finished, _UP), "cc-up")
            return _moved(labels, up)
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("up"))
        up = staged(up, "cc-up")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        up = staged(up.join(over, "up").select("node", F.col("upper").alias("up")), "cc-upper")
        a, b = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}2")) for c in ("a", "b"))
        edges = staged(edges.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct(), "cc-edges")
        labels = _moved(labels, up)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _moved(labels: DataFrame | None, up: DataFrame) -> DataFrame:
    """Labels after the nodes that they name have moved up."""
    if labels is None:
        return up.withColumnRenamed("up", "component")
    moved = labels.join(up.withColumnRenamed("node", "component"), "component", "left")
    return staged(moved.select("node", F.coalesce("up", "component").alias("component")), "cc-labels")
