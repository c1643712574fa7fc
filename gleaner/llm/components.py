"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps: each node and its larger
neighbours are hooked to the smallest node it sees, then its smaller
neighbours, until every tree is a star. Minima are partial aggregations and
the hooks are plain joins, so a node with a third of all edges is no group that
any task must hold. Every step is written to the shared folder.

A graph that has no more edges than one task may hold is done in that task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v")).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    down = edges.groupBy("u").agg(F.count("*").alias("n"))
    if down.where("n > 1").limit(1).count():
        return False
    return edges.join(down.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Union-find over all edges."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                u, v = find(u), find(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([find(x) for x in nodes], arrow)], names=["node", "root"])

    kind = edges.schema["u"].dataType.simpleString()
    arrow = pa.binary() if kind == "binary" else pa.int64()
    return edges.coalesce(1).mapInArrow(join, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, a: str, b: str, max_steps: int = 60, one_task: int = 50_000) -> DataFrame:
    """node, root: root is the smallest node reachable; a row for each node that isn't its own root.

    Nodes are longs or binaries. Edges with a null end and loops are left out; repeated edges count once. An
    empty table gives an empty result.
    """
    e = stash(_oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    if e.count() <= one_task:
        return _in_one_task(e)
    for _ in range(max_steps):
        if _is_stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))).where(F.col("u") > F.col("v")).distinct()
        large = stash(large, "edges")
        drop(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        e = stash(_oriented(small.unionByName(low.select("u", F.col("m").alias("v")))), "edges")
        drop(large)
    raise RuntimeError(f"no stars after {max_steps} steps")
