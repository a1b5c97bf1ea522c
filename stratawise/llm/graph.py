"""Connected components by alternating large and small stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawise.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node.

    Each round links neighbours to the least node of a neighbourhood; hubs are
    reduced by partial aggregation before any shuffle and the join side that repeats
    them is one that adaptive execution can split.  Rounds grow with the logarithm
    of the longest chain.  The edge table is checkpointed between rounds; only its
    size and a checksum come to the driver.
    """
    star = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        star = checkpointed(small)
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select("b", "b").distinct())
