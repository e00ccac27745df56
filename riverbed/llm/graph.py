"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b: longs); comp is the smallest node of its component.

    Each round points neighbours at the smallest one they know, first the larger ones, then the smaller ones (Kiveris
    et al. 2014); rounds grow with the logarithm of the size. Edges stay distributed, minima are pre-aggregated.
    """
    e = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = scratch.save(both.where("b > a").join(low, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct())
        low2 = scratch.save(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")))
        up = large.join(low2, F.col("b") == F.col("u"))
        small = up.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low2.select(F.col("m").alias("a"), F.col("u").alias("b")))
        new = scratch.save(small.distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(e, low, large, low2, collect=False)
        e = new
        if now == state:
            break
        state = now
    return scratch.save(e.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()))
