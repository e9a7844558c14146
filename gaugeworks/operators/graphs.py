"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    A step joins each node with its smallest neighbour and re-hangs its neighbours there, so hot
    nodes are pre-aggregated and their edges stay rows of a join that Spark can split. Each round is
    written to the shared folder, which cuts lineage. Rows with a null end are left out; loops
    give no node of their own.
    """
    spark = edges.sparkSession
    pair = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"{a} is not null and {b} is not null").where("hi <> lo").distinct()
    now, path = written(pair, "edges")
    while True:
        # done when every node hangs on one node that hangs on none
        ends = now.groupBy(F.col("hi").alias("end")).agg(F.count("*").alias("n"))
        if ends.where("n > 1").isEmpty() and now.join(ends, F.col("lo") == F.col("end"), "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["hi"] == least["u"]).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        large, spare = written(large, "large")
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(least, large["hi"] == least["u"]).select("hi", "lo", "m")
        small = small.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        new, new_path = written(small, "edges")
        drop(spark, spare)
        drop(spark, path)
        now, path = new, new_path
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
