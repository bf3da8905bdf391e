"""Ordered statistics over groups of any size.

A window over a whole group would pull that group into one task. These operators never do that:
rows are combined per distinct ordering value first, range-partitioned over (group, value), frozen on
reliable storage so slice numbers cannot change on retry, and then

    running total = totals of earlier slices (a handful of rows per group) + running total in the slice

so the largest unit of work is one range slice, whatever the group sizes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col
from ..session import cut

SLICE = "_slice"


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column],
    lowest: dict[str, Column] | None = None,
    bounds: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per distinct (keys, order) with `<name>`, `<name>_before` and `<name>_all` for sums.

    `lowest` columns get `<name>_upto`: the running minimum up to and including the row. `carry` columns
    ride along and need (keys, order) to be unique.
    """
    lowest = lowest or {}
    anchor = keys or ["_everything"]
    base = df if keys else df.withColumn("_everything", F.lit(0))
    combined = base.groupBy(*anchor, *order).agg(
        *[F.sum(c).alias(n) for n, c in totals.items()],
        *[F.min(c).alias(n) for n, c in lowest.items()],
        *[F.first(c).alias(c) for c in carry],
    )
    frozen = cut(
        combined.repartitionByRange(*[F.col(c) for c in anchor + order]).withColumn(
            SLICE, F.spark_partition_id()
        )
    )
    slices = frozen.groupBy(*anchor, SLICE).agg(
        *[F.sum(n).alias(n) for n in totals], *[F.min(n).alias(n) for n in lowest]
    )
    earlier = Window.partitionBy(*anchor).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*anchor)
    offsets = slices.select(
        *anchor,
        SLICE,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_pre_{n}") for n in totals],
        *([F.sum(n).over(whole).alias(f"{n}_all") for n in totals] if bounds else []),
        *[F.min(n).over(earlier).alias(f"_pre_{n}") for n in lowest],
    )
    inside = Window.partitionBy(*anchor, SLICE).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = frozen.join(offsets, anchor + [SLICE])
    out = out.select(
        *keys,
        *order,
        *totals,
        *[
            (F.col(f"_pre_{n}") + F.coalesce(F.sum(n).over(before), F.lit(0))).alias(f"{n}_before")
            for n in totals
        ],
        *([f"{n}_all" for n in totals] if bounds else []),
        *carry,
        *lowest,
        *[F.least(F.col(f"_pre_{n}"), F.min(n).over(upto)).alias(f"{n}_upto") for n in lowest],
    )
    return out


def auc(df: DataFrame, keys: list[str], score: str, label: str, weight=None) -> DataFrame:
    """ROC-AUC per group with ties counted one half; NULL when a class is absent."""
    w = F.lit(1) if weight is None else col(weight)
    y = F.col(label)
    ranked = running(
        df, keys, [score], {"pos": F.when(y == 1, w).otherwise(F.lit(0)), "neg": F.when(y == 0, w).otherwise(F.lit(0))}
    )
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    pairs = F.max("pos_all").cast("double") * F.max("neg_all").cast("double")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias("auc"))


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rn", carry: tuple[str, ...] = ()
) -> DataFrame:
    """1-based position within the group and the group size; `order` must be unique per group."""
    out = running(df, keys, order, {"n": F.lit(1)}, carry=carry)
    return out.select(
        *keys, *order, *carry, (F.col("n_before") + 1).cast("long").alias(name), F.col("n_all").alias("n")
    )


def midranks(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, score) -> average rank of the tie group and group size."""
    out = running(df, keys, [score], {"n": F.lit(1)})
    return out.select(
        *keys,
        score,
        (F.col("n_before") + (F.col("n") + F.lit(1)) / F.lit(2.0)).alias("midrank"),
        F.col("n_all").alias("n_rows"),
    )


def tile(position: str, size: str, k: int) -> Column:
    """ntile(k) from a 1-based position and the group size: the larger tiles come first."""
    rn, n = F.col(position), F.col(size)
    base, extra = F.floor(n / F.lit(k)), n % F.lit(k)
    edge = extra * (base + 1)
    return (
        F.when(rn <= edge, F.floor((rn - 1) / (base + 1)) + 1)
        .otherwise(extra + F.floor((rn - 1 - edge) / F.greatest(base, F.lit(1))) + 1)
        .cast("int")
    )


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation for groups of any size."""
    pos = running(df.where(F.col(value).isNotNull()), keys, [value], {"n": F.lit(1)})
    aggs = []
    for name, q in qs.items():
        at = F.lit(float(q)) * (F.col("n_all") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        pick = lambda k: F.max(
            F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col(value))
        )
        part = F.max(at - lo)
        aggs.append((pick(lo) * (F.lit(1.0) - part) + pick(hi) * part).alias(name))
    return pos.groupBy(*keys).agg(*aggs)
