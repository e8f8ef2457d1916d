"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed, discard, for_one_action


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't its component's smallest node.

    Alternating large-star and small-star steps: each links a node's neighbours to the smallest of them, so
    that the number of rounds grows with the logarithm of a component's size and no neighbourhood is ever
    gathered. Minima are taken by partial aggregation; the rows of a hub are spread by the skew join. Only
    the number of edges and a sum of their hashes come to the driver, to see that a round changed nothing.
    A round's edges go from disk once the next round's are there.
    An empty graph gives an empty result. Loops, repeated edges and edges with a null end are left out.
    """
    # What gives the edges is run once, not in each of the plans that read them.
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a != b").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, e = e, checkpointed(small.select("e.*").where("u != v").distinct())
        discard(last)
        with for_one_action(e.sparkSession):
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
