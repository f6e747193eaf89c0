"""Connected components of a graph in a DataFrame, by alternating large-star and small-star (Kiveris et al., 2014).

Every round is a grouped minimum and a join, so no neighbourhood is gathered in one place; rounds are written to the
shared folder, which cuts lineage and lets the job go on when executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One round: each node's (larger, if both) neighbours are linked to the least node around it."""
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = edges.join(least, "u").where("v > u")
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u")
        out = out.select("u", "v", "m").unionByName(least.select("u", F.col("u").alias("v"), "m"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links, both ways or one, to (node, root): every node with a link and the least node of its component."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    before = None
    while (now := _digest(edges)) != before:
        before = now
        edges = written(_star(_star(edges, both=True), both=False), "links")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
