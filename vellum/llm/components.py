"""Connected components of a large graph by alternating star contractions.

Each round links every vertex to the smallest it knows of (large star, then small star);
the number of rounds grows with the logarithm of the longest path.  A vertex with very
many links is only ever aggregated and joined, never gathered: what is aggregated is a table
in the shared folder before the join, which is a broadcast where it is counted to be small,
else one whose hot keys the engine can split.  Each round is cut off by such a table too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import sendable, stage

#: Vertices that are sent to every executor in a round; there are several rounds.
FEW = 100_000


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b) from each vertex a to the least vertex b that it has a link with, or is, for all its larger neighbours too."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.join(sendable(least, FEW), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """The same with smaller neighbours; ``edges`` go from larger to smaller vertices."""
    least = stage(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(sendable(least, FEW), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex with a link; the root is the least vertex of its component.

    ``edges`` has long columns a and b; loops, repeats and either direction are fine.
    """
    held = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        # Stars are found when no vertex has two links to smaller ones and none is both an end and a root.
        state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        held = stage(_small(_stars(held)), "edges")
    roots = held.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return held.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)
