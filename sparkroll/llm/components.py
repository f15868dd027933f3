"""Connected components of a graph given by its edges, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroll.llm.common import stored


#: Nodes meet their minimum under another name, so that both sides of the join are shuffled anew: between two plain
#: shuffles adaptive execution splits a hub, and it cannot where the minimum was grouped by the join key in the same stage.
MASK = 0x5555555555555555


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _hung(pairs: DataFrame, keep_above: bool) -> DataFrame:
    """For each u: hang its neighbours above it (or itself and those below) on the least of them and u. A merge at every size: Spark expects too little of edges that came out of lists."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(MASK)).alias("w"), F.least("u", "m").alias("m")).hint("merge")
    hung = pairs.withColumn("w", F.col("u").bitwiseXOR(F.lit(MASK))).join(least, "w")
    hung = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if keep_above else hung.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b): root is the least node that can be reached.

    Alternates the large star and the small star, each a grouped minimum and a
    join, until every node hangs on its root: about the logarithm of the
    longest path many rounds. A round is stored before the next one, so the plan stays short.
    """
    current, seen = stored(edges.where("a <> b").select("a", "b").distinct()), None
    while True:
        large = _hung(_both_ways(current), keep_above=True)
        # every pair now points down, so the small star groups by the upper end
        small = _hung(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), keep_above=False)
        current = stored(small)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
