"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for every id of edges (u, v): component is the smallest id reachable.

    Each step groups by node with partial minima and joins them back, so a node with many neighbours
    is split like any skewed join; steps end when the edges no longer change, after about log2 of
    the longest path. No edge reaches the driver, only a count and a checksum.
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, was, turn = scratch.write(e, f"{name}0"), None, 0
    while (now := _mark(e)) != was and now[0]:
        was, turn = now, turn + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.write(small, f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
