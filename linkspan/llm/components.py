"""Connected components of a table of links by large and small stars.

Both sides of each join are exchanged as they are, the smallest neighbours from a written table, so that adaptive execution can
split the links of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "star-low")
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = materialize(down.groupBy("a").agg(F.min("b").alias("low")), "star-low")
    return down.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in ``links`` (a, b), self-links left out.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain and go on until
    nothing changes, which stars always reach. The driver sees two numbers a round and no links.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if not state["n"] or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        edges = materialize(_small(_large(edges)), "star")
