"""Connected components of an edge table: alternating large-star and small-star rounds.

Every round is a few joins and map-side combined minima, written to the shared folder;
neither edges nor components reach the driver. A hub of any degree is spread over tasks
by Spark's skew join, as its edges are only joined with its minimum. Tables of at most FEW
edges, counted first, take one task instead of rounds, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwell.llm.runtime import discard, written

FEW = 1 << 16


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(batches):
    """Edges (u, v), u > v, a million bytes at most -> (node, component)."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[above]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    ``edges``: (u, v), 64-bit integers. Self-loops and repeated edges do no harm.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    edges = written(edges.distinct(), "edges")
    mark = _mark(edges)
    if mark[0] <= FEW:
        found = written(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
        discard(edges)
        return found
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        done, edges = edges, written(small.where("u <> v").distinct(), "small-star")
        discard(done, large)
        previous, mark = mark, _mark(edges)
        if mark == previous:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    found = written(found, "components")
    discard(edges)
    return found
