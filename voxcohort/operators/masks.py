"""Sparse masks (presence = 1), their profiles, geometry and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def axis_positions(mask: DataFrame, axis: str, size: int, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """(uid, axis, c, u): cumulative mask profile and position scaled to the mask's own extent.

    The profile has one row per scan and slice, so the window below never exceeds one axis length.
    """
    prof = mask.groupBy("uid", axis).agg(F.count(F.lit(1)).alias("n"))
    packed = prof.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct(axis, "n"))).alias("m"))
    dense = packed.select("uid", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(axis), "m").select(
        "uid", axis, F.coalesce(F.col("m")[F.col(axis)], F.lit(0)).alias("n")
    )
    run = Window.partitionBy("uid").orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("uid")
    c = dense.withColumn("c", F.sum("n").over(run) / F.greatest(F.sum("n").over(whole), F.lit(1)))
    b = c.withColumn("lo", F.sum((F.col("c") < lo).cast("int")).over(whole)).withColumn(
        "hi", F.sum((F.col("c") < hi).cast("int")).over(whole)
    )
    return b.select(
        "uid", axis, "c", ((F.col(axis) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(2))).cast("double").alias("u"), "lo", "hi"
    )


def union_sides(mask: DataFrame) -> DataFrame:
    return mask.select("uid", "x", "y", "z").distinct()


def missing_scans(scans: DataFrame, mask: DataFrame) -> DataFrame:
    return scans.select("uid").join(mask.select("uid").distinct(), "uid", "left_anti")
