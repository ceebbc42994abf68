"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two aggregations and two joins over the edges; no neighbour list
is ever gathered in one task, so a hub with any number of neighbours is only a
skewed join, which adaptive execution splits. The edges of each round are
written to the shared scratch folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one root and no root is a node; ``edges`` are distinct and lead from larger to smaller."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select("node", one, none).union(edges.select("root", none, one)).toDF("id", "up", "down")
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has two long columns, in this order. Returns (node, root).

    root is the smallest node reachable. Nodes that are their own root, and
    nodes without edges, are not listed. Self loops, repeated edges and rows
    with a null are ignored; an empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    now = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("node"), F.least(a, b).alias("root")
    )
    now = stored(now.distinct(), "edges")
    while not _only_stars(now):  # every round shortens the longest way to a root; about the logarithm of a component's size
        both = now.select("node", "root").union(now.select("root", "node")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), "m").union(least)
        now = stored(small.distinct().toDF("node", "root"), "edges")
    return now
