"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, materialise


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of it and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    down = edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    moved = down.join(least, "x").select(F.col("m").alias("a"), F.col("y").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("x").alias("b"))).filter("a < b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of its component, for each node that has an edge to another node.

    Rounds end when a round changes nothing: every node then hangs on its root. Each round is a written table.
    """
    now = materialise(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct())
    mark = None
    while True:
        after = materialise(_small(_large(now)))
        discard(now)
        now = after
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
