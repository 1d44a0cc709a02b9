"""Connected components of an undirected graph in Spark."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import materialise


def _moved(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every edge's ``a`` replaced by the least node beside it."""
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    """Larger neighbours move to the least node beside the one they share.

    The least nodes are written first: the join is then one of two plain shuffles, so that adaptive execution can split
    the edges of a node that has many. The same holds for small stars.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _moved(both.filter("b > a"), materialise(least, name))


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), name)
    return _moved(edges, least).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes, which takes a number of rounds that grows with the
    logarithm of the component's size. Every step is written to the shared folder; the driver sees two numbers a round.
    Loops and repeated edges do no harm; null ends are ignored.
    """
    down = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialise(down(edges), f"{name}-edges"), None
    for k in count():
        large = materialise(down(_large_star(now, f"{name}-{k}-least")), f"{name}-{k}-large")
        now = materialise(down(_small_star(large, f"{name}-{k}-next")), f"{name}-{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
