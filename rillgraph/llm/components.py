"""Connected components by alternating large-star and small-star steps over written tables.

Nothing is collected: each step is two aggregations (with map-side combine) and two joins, whose skewed keys
adaptive execution can split, and its result is written to the shared folder, so that lost executors cost one step.
The edges converge to stars around each component's smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import _common


def components(edges: DataFrame) -> DataFrame:
    """(node long, component long) for every node with an edge, from edges (a long, b long); component is its smallest node."""
    spark = edges.sparkSession
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, path = _common.written(ordered, "cc")
    before = None
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        after, new = _common.written(small, "cc")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        _common.remove(spark, path)
        stars, path = after, new
        if state == before:
            break
        before = state
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
