"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _once(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the least node that can be reached.

    Alternating stars: first every node hands its larger neighbours to the least
    one, then its smaller neighbours, until each component is one star. Every
    step is a minimum by key and a join with it, so a node with very many edges
    is summed up before the shuffle and its rows can be split between tasks.
    """
    e = cut(_once(edges))
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = _once(large)
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = cut(_once(small))
        roots = e.select(F.col("b").alias("a")).distinct()
        # A node below two others, or one that is both above and below, is left to do.
        if e.groupBy("a").count().filter("count > 1").isEmpty() and e.join(roots, "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
    raise RuntimeError("the components didn't settle")
