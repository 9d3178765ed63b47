"""Connected components by alternating large-star and small-star rounds.

Every round is an aggregate and an equi-join on a node, so a hub with many
neighbours is a partial minimum and a join that adaptive execution can split. Edges
never leave the executors. The number of rounds grows with the logarithm of the
longest chain; each round's edges are written, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_stored, forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, stored, with their number and a sum of their hashes, taken as they are
    written (counted twice by a task that ran twice, which costs one more round)."""
    seen = Observation()
    after = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
    return after, seen.get


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), its component the smallest
    node reachable; a node without an edge has no row."""
    now, check = _written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        after, found = _written(_small_star(_large_star(now)))
        drop_stored(now)
        now = after
        forget(edges.sparkSession)
        if found == check:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        check = found
