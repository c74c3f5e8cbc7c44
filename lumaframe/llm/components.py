"""Connected components by alternating large and small stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import discard, materialize


def _is_forest_of_stars(edges: DataFrame) -> bool:
    n, ends = edges.agg(F.count("*"), F.countDistinct("u")).first()
    if n != ends:
        return False
    return not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node but the smallest of its component, with that smallest, for the undirected edges (u, v) of longs.

    Repeated edges and loops are harmless; nodes without edges have no row. Each round is written to the shared folder.
    """
    e = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while not _is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = materialize(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.withColumnRenamed("low", "v"))
        new = materialize(small.distinct(), "components")
        discard(e), discard(large)
        e = new
    return e
