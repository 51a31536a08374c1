"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is one minimum by node (combined before its shuffle) and one join,
so a node with very many neighbours is never gathered in one place, and the
number of rounds grows with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node that a node reaches; only nodes of edges between different nodes appear."""
    now = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    state = None
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours are linked to its smallest one.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest.
        least = _least(large)
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        before, now = now, durable(small)
        discard(before)
        # Done when no node is both a root and below another: every edge then leads to a root.
        row = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(row) == state or row[0] == 0:
            break
        state = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
