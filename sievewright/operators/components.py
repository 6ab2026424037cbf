"""Connected components of links by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import written


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node that can be reached.

    Each round links the larger neighbours of every node to its least one, then the smaller ones, until nothing changes: about
    the logarithm of the longest chain. Edges never grow in number, rounds are tables in the shared folder, and each key's
    least neighbour is combined before it is shuffled. Null ends make no link; repeated links and loops are fine.
    """
    spark = edges.sparkSession
    now = written(spark, edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # every u > v here, so v are u's smaller neighbours
        starred = _least(large)
        small = starred.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).distinct()
        after = written(spark, small, "links")
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    leaves = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
