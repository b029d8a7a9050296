"""Connected components of a table of edges, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import dropped, stored


def _not_stars(edges: DataFrame) -> bool:
    """Whether a node of ``edges`` (``u`` > ``v``) has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).union(edges.select("v", F.lit(0), F.lit(1)))
    sides = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return bool(sides.where((F.col("smaller") > 1) | ((F.col("smaller") == 1) & (F.col("larger") == 1))).agg(F.count(F.lit(1))).first()[0])


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``node, label`` of every node of ``edges`` (``a``, ``b``): the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edges form stars. A node's smallest neighbour comes from an aggregation
    that sums up before the shuffle, so no list of neighbours is ever
    gathered. Each step is a table in ``folder``. Graphs of every size take the
    same steps; one whose edges form stars already takes none.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, step = stored(now, folder, f"{name}-0"), 0
    while _not_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, folder, f"{name}-{step}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        after = stored(small, folder, f"{name}-{step}")
        dropped(spark, f"{folder}/{name}-{step - 1}-large")
        dropped(spark, f"{folder}/{name}-{step - 1}")
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v")).distinct()
