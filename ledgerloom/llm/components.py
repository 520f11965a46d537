"""Connected components of an edge table by alternating star contraction.

Every round joins each edge with the least neighbour of its end, so no group is collected:
the least neighbour is an aggregate that tasks combine before the shuffle, and the join can
be split where one node has very many edges. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, keep: str) -> DataFrame:
    """Link the neighbours that ``keep`` selects with the least neighbour of their node."""
    least = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return (edges.join(least, "a").where(keep)
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .where("a <> b").distinct())


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (least node of its component) for every node of ``a``, ``b`` edges.

    Loops are ignored; an empty table has no nodes; rows may repeat.
    """
    edges = stored(edges.where("a <> b").distinct(), "edges")
    before = None
    while (now := _signature(edges)) != before:
        before = now
        large = stored(_star(_both(edges), "b > a"), "large-star")
        # to smaller neighbours only: every edge points from the larger to the smaller node
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _star(down, "true")
        own = down.groupBy("a").agg(F.min("b").alias("b"))
        edges = stored(small.unionByName(own).where("a <> b").distinct(), "small-star")
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
            .groupBy("node").agg(F.min("root").alias("root")))
