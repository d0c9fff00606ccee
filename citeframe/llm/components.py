"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; no neighbourhood, component or edge list is
ever gathered in a task or on the driver. Large-star hangs every larger neighbour of a
node on the smallest one, small-star does the same for the smaller ones; the number of
rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _store(df: DataFrame) -> DataFrame:
    """A table in as many files as the cluster has cores: edges are few and small."""
    return cut_lineage(df.coalesce(df.sparkSession.sparkContext.defaultParallelism))


def _marks(edges: DataFrame) -> tuple:
    """Count and order-free checksum, to see whether a round changed anything."""
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def _minima(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each left end, as a table: a join with it can then be
    split by adaptive execution when one node has a large part of all edges."""
    return _store(edges.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _minima(both)
    moved = both.join(low, both.a == low.node).filter(F.col("b") > F.col("a"))
    return moved.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Here every edge leads from the larger to the smaller node."""
    low = _minima(edges)
    joined = edges.join(low, edges.a == low.node)
    hung = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = low.select(F.col("node").alias("a"), F.col("low").alias("b"))
    return hung.union(own).filter("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, component) rows, the component being its smallest node.

    Loops, repeated and reversed edges are allowed; edges with a null end are ignored.
    Nodes without an edge to another node have no row.
    """
    valid = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = _store(valid)
    marks = _marks(current)
    while marks[0]:
        current = _store(_small_star(_store(_large_star(current))))
        before, marks = marks, _marks(current)
        if marks == before:
            break
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return _store(leaves.union(roots))
