"""Keyed joins over scan lists, labels, folds and predictions, with completeness made explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SMALL = 10_000


def small_list(df: DataFrame, column: str, limit: int = MAX_SMALL) -> list:
    """Distinct values of a roster-like column, refused beyond `limit` instead of filling the driver."""
    rows = df.select(column).distinct().orderBy(column).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values; it is not a roster")
    return [r[0] for r in rows]


def folds_of(scans: DataFrame, folds: DataFrame, strict: bool = False) -> DataFrame:
    """Fold per uid and partition; with `strict`, missing or duplicated uids raise and name examples."""
    joined = scans.join(folds, "uid", "left")
    if strict:
        missing = joined.where(F.col("fold").isNull()).select("uid").limit(3).collect()
        if missing:
            raise KeyError(f"uids without a fold, first: {[r.uid for r in missing]}")
        twice = folds.groupBy("uid").count().where("count > 1").select("uid").limit(3).collect()
        if twice:
            raise ValueError(f"uids with more than one fold, first: {[r.uid for r in twice]}")
    return joined


def coverage(preds: DataFrame, scans: DataFrame, members: list) -> DataFrame:
    """(uid, member, n) wherever a scan is not covered exactly once; empty when the roster is complete.

    Counts are combined per (uid, member) first and per uid second, so complete scans, normally all of
    them, never expand into scan x member rows.
    """
    cells = preds.groupBy("uid", "member").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.lit(m) for m in members])
    per_scan = cells.groupBy("uid").agg(
        F.collect_set("member").alias("have"), F.collect_list(F.when(F.col("n") > 1, F.struct("member", "n"))).alias("many")
    )
    gaps = (
        scans.select("uid").join(per_scan, "uid", "left")
        .withColumn("holes", F.array_except(wanted, F.coalesce("have", F.array().cast(f"array<{_type(preds, 'member')}>"))))
    )
    holes = gaps.where(F.size("holes") > 0).select("uid", F.explode("holes").alias("member"), F.lit(0).cast("long").alias("n"))
    many = gaps.where(F.size("many") > 0).select("uid", F.explode("many").alias("m")).select("uid", "m.member", "m.n")
    return holes.unionByName(many)


def _type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def mean_one_weights(df: DataFrame, weight: Column, name: str = "w") -> DataFrame:
    """Divide a weight by its mean; the mean is one row, joined as such."""
    raw = df.withColumn("_w", weight)
    mean = raw.agg(F.avg("_w").alias("_mean"))
    return raw.join(F.broadcast(mean)).withColumn(name, F.col("_w") / F.col("_mean")).drop("_w", "_mean")


def pair_arms(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join of two arms; `matched` is false for rows only one side has."""
    a = left.select(*keys, F.col(value).alias("arm"))
    b = right.select(*keys, F.col(value).alias("control"))
    return a.join(b, keys, "full_outer").withColumn(
        "matched", F.col("arm").isNotNull() & F.col("control").isNotNull()
    )


def alignment(folds: DataFrame, labels: DataFrame, label: str, reference: str, keys: list[str]) -> DataFrame:
    """Per keys: rows, disagreements of folds' label with labels' reference, whether there are none, uids without a reference, and whether
    there was a label to check at all: a list without that column passes unchecked."""
    checked = label in folds.columns
    j = folds.join(labels.select("uid", F.col(reference).alias("_ref")), "uid", "left")
    off = F.count_if(F.col(label) != F.col("_ref")) if checked else F.lit(0).cast("long")
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), off.alias("disagree"), (off == 0).alias("aligned"), F.count_if(F.col("_ref").isNull()).alias("missing"), F.lit(checked).alias("checked")
    )
