"""Connected components of edge tables too large for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of the edges ``a, b`` and the smallest node it is connected with.

    Alternating large-star and small-star rounds; the edges never grow and a hub costs
    one row a neighbour.  Each round is stored in the shared folder, and the one before is deleted.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        least = stored(least, "least")  # a table, so that the join can split a hub
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "links")
        # every edge now points down: a > b
        nearest = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(nearest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, links = links, stored(small.unionByName(nearest.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        forget(last, least, large)
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
