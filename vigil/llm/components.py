"""Connected components of links between nodes of 64-bit ids, without gathering them anywhere.

Large-star and small-star steps on the edge table until nothing changes. A step is two aggregations, each joined back to the edges; it is
written to the shared folder. A node of very many links is joined by broadcast of the few such nodes, never as one task's load or a list in one row.

Defined results: links of a node to itself and links with a null end are none; repeated and reversed links count once; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (node, root): the least node of each component, for every node with a link to a lesser one (not for the least)."""
    edges = common.materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, now = None, _state(edges)
    while now[0] and now != before:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every greater neighbour, and the node itself, points to the least of the neighbourhood
        least = common.materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("k")))
        large = common.join_hot(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.materialise(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct())
        # small star: every lesser neighbour, and the node itself, points to the least of them
        lower = common.materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")))
        small = common.join_hot(large, lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = common.materialise(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        common.discard(edges, least, large, lower)
        edges, before, now = new, now, _state(new)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """The count of the rows and a sum over their hashes: equal if the edges are the same again."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
