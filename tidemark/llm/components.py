"""Connected components over an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, root for every node of an edge; root is the smallest node reachable.

    Each star step turns a node's edges into edges to the smallest node around it. Minima
    are partial sums before the shuffle and the joins are plain shuffle joins, so AQE splits
    a hub's rows; no node's neighbours are ever gathered. Ends when the edges are stars
    around their smallest nodes, after about log(nodes) rounds. The driver keeps something of
    every stage, so a round has few: rows repeated by the large star stay for the small one,
    and no round is made to see that nothing changes.
    """
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(own.filter("u != v").distinct(), "edges")
    for _ in range(max_rounds):
        if settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours of u point to the smallest around u.
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large, "large-star")
        # Small star: u and its smaller neighbours point to the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def settled(e: DataFrame) -> bool:
    """Whether the distinct edges u > v are stars: each u has one v, and no v is a u."""
    ends = e.selectExpr("stack(2, u, 1, 0, v, 0, 1) as (node, low, top)")
    return not ends.groupBy("node").agg(F.sum("low").alias("n"), F.max("top").alias("top")).filter("n > 1 or n = 1 and top = 1").limit(1).count()
