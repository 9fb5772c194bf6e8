"""Connected components of a link table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(e: DataFrame) -> tuple:
    return tuple(e.select(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link, with the smallest node as the component.

    Each round points neighbours at the smallest node known nearby and is written to the shared
    folder, so that lineage stays short; the rounds grow with the logarithm of a component's
    width.  Joins are plain equi-joins, which Spark may split where a node has many links.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e, "links")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        # larger neighbours move to the least of the neighbourhood
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # smaller neighbours and the node itself do so too
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(low, F.col("u") == F.col("x")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(small, "links")
        now = _state(e)
        if now == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
