"""Parent chains and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ancestors(edges: DataFrame, node: str, parent: str, most: int = 10) -> DataFrame:
    """(node, ancestor, distance) up to ``most`` hops; cycles end at the bound.

    A row carries its chain as an array and each hop is one join of the chain's top with
    the edges, so the plan grows with the hops and reads each side once a hop."""
    own = edges.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("top")).distinct()
    up = own.select(F.col("node").alias("top"), F.col("top").alias("next"))
    reach = own.withColumn("chain", F.array("top"))
    for _ in range(most - 1):
        reach = reach.join(up, "top", "left").select("node", F.col("next").alias("top"), F.when(F.col("next").isNotNull(), F.array_append("chain", F.col("next"))).otherwise(F.col("chain")).alias("chain"))
    hops = reach.select("node", F.posexplode("chain").alias("at", "ancestor"))
    return hops.groupBy("node", "ancestor").agg((F.min("at") + 1).alias("distance"))


def tree(nodes: DataFrame, node: str, parent: str, seeds: DataFrame, most: int = 10) -> DataFrame:
    """Seeds, their ancestors, and one level of children of both: (node, parent, role)."""
    edges = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    own = seeds.select(F.col(node).alias("node")).distinct().withColumn("role", F.lit(0))
    above = with_ancestors(edges, "node", "parent", most).join(own.select("node"), "node", "left_semi").select(F.col("ancestor").alias("node")).distinct().withColumn("role", F.lit(1))
    spine = own.union(above).groupBy("node").agg(F.min("role").alias("role"))
    below = edges.join(spine.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.lit(2).alias("role"))
    picked = spine.union(below).groupBy("node").agg(F.min("role").alias("role"))
    named = F.element_at(F.array(F.lit("seed"), F.lit("ancestor"), F.lit("child")), F.col("role") + 1)
    return picked.join(edges, "node", "left").select("node", "parent", named.alias("role"))


def cross_rows(left: DataFrame, matrix: DataFrame, *linked) -> DataFrame:
    """Every left row with every row of a small fixed matrix, as one row for each linked struct.

    The matrix is a literal list of the caller; its rows go into one array, so nothing is joined."""
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in matrix.collect()]
    out = left.withColumn("m", F.explode(F.array(*rows)))
    return out.withColumn("part", F.explode(F.array(*linked))) if linked else out
