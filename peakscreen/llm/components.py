"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps: each step is a grouped minimum and
a join on the node, so nothing of the graph is collected and a node with very
many neighbours is pre-aggregated before the shuffle (its join partition is
split by adaptive execution). Every round is cut with ``checkpoint()`` in the
shared folder; the number of rounds grows with the logarithm of the diameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakscreen.session import ensure_checkpoint_dir, ship_package

MAX_ROUNDS = 200


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang nodes on the smallest neighbour: larger neighbours (large star, with
    edges seen from both ends) or all smaller neighbours and the node itself (small star)."""
    if both_ways:
        seen = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = seen.groupBy("u").agg(F.min("v").alias("_low"))
    joined = seen.join(low, "u")
    if both_ways:
        hung = joined.where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("u", "_low").alias("v"))
    else:
        hung = (joined.where(F.col("v") != F.col("_low")).select(F.col("v").alias("u"), F.col("_low").alias("v"))
                .union(low.select("u", F.col("_low").alias("v"))))
    return hung.where(F.col("u") != F.col("v")).distinct()


#: Edges that one task contracts at a time.
PART_EDGES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest node it reaches there."""
    up: dict = {}

    def root(x):
        path = []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    kind = None
    for b in batches:
        kind = b.schema.field("u").type
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    found = [(x, r) for x in list(up) if (r := root(x)) != x]
    for lo in range(0, len(found), 10_000):
        part = found[lo:lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], kind), pa.array([r for _, r in part], kind)], names=["u", "v"])


def contracted(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """``edges(u, v)`` contracted to stars within parts of about ``part_edges``: the same components,
    fewer and shorter paths, so that the rounds of :func:`connected_components` are few."""
    ship_package(edges.sparkSession)
    now = edges.where(F.col("u") != F.col("v")).select("u", "v").distinct().checkpoint()
    parts = -(-now.count() // part_edges)
    return now.repartition(max(1, parts)).mapInArrow(_forest, now.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``; the component is its smallest node.

    Self edges and repeated edges are harmless; nodes that occur in no edge
    between different nodes are not returned (each is its own component).
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.where(F.col("u") != F.col("v")).select("u", "v").distinct().checkpoint()
    state = None
    for _ in range(MAX_ROUNDS):
        now = _stars(_stars(now, True), False).checkpoint()
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                       F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(seen)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
