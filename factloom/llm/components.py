"""Connected components of a graph that is only ever a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, is_even, join_counted, written


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from every node that has a link: id, root.

    ``links`` has the long columns a and b; rows that repeat or link a node with itself
    don't matter.  Alternating large-star and small-star steps (each joins every link
    with the least neighbour of its node) until nothing changes; each step is written
    to the shared folder.  A node may have a large share of all links: such nodes'
    neighbours are broadcast (``join_counted``).  No links: no rows.
    """
    spark = links.sparkSession
    edges = written(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        most, total = least.agg(F.max("n"), F.sum("n")).first()
        least = least.select("a", F.least("a", "m").alias("m"), "n")
        stars = both.join(least, "a") if is_even(most, total) else join_counted(both, least, ["a"], "n", total)
        large = stars.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smaller = large.groupBy("a").agg(F.min("b").alias("m"))  # here a hub is only ever b
        small = large.join(smaller, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        last, edges = edges, written(spark, small, "links")
        discard(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        seen = tuple(state)
