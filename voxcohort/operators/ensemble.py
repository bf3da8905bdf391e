"""From member predictions to ensemble logits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LOGIT_CAP
from ..functions.scalars import bce_from_logit, cap_logit, clip_prob, log_loss_term, logit, sigmoid
from .ranking import auc


def member_logits(preds: DataFrame, cap: float | None = LOGIT_CAP) -> DataFrame:
    return preds.withColumn("z", cap_logit(logit("p"), cap))


def view_mean(views: DataFrame, keys: list[str], cap: float | None) -> DataFrame:
    """Mean over views in logit space, then the cap; the order of the two matters."""
    return views.groupBy(*keys).agg(cap_logit(F.avg("z"), cap).alias("z"))


def ensemble_mean(logits: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Mean logit per scan; combined map-side, so the shuffle is one row per scan and task."""
    return logits.groupBy("uid").agg(
        *[F.max(c).alias(c) for c in carry or []],
        F.avg("z").alias("z"),
        F.count(F.lit(1)).alias("n_members"),
    )


def metrics(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Log loss, AUC and size per group."""
    ll = df.groupBy(*keys).agg(F.avg(log_loss_term(y, p)).alias("ll"), F.count(F.lit(1)).alias("n"))
    a = auc(df, keys, p, y)
    if not keys:
        return ll.join(F.broadcast(a))
    return ll.join(a, keys)


def class_centred_correlation(
    df: DataFrame, keys: list[str], a: str, b: str, y: str = "y", weight: Column | None = None
) -> DataFrame:
    """Correlation of two logits after removing each class mean, from one pass of class sums.

    Classes with fewer than 3 rows are left out; fewer than 8 rows in all gives NULL. The weighted form
    weights both the class means and the correlation.
    """
    w = F.lit(1.0) if weight is None else weight
    t = df.select(*keys, y, F.col(a).alias("a"), F.col(b).alias("b"), w.alias("w"))
    s = t.groupBy(*keys, y).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("sw"),
        F.sum(F.col("w") * F.col("a")).alias("sa"),
        F.sum(F.col("w") * F.col("b")).alias("sb"),
        F.sum(F.col("w") * F.col("a") * F.col("a")).alias("saa"),
        F.sum(F.col("w") * F.col("b") * F.col("b")).alias("sbb"),
        F.sum(F.col("w") * F.col("a") * F.col("b")).alias("sab"),
    ).where("n >= 3")
    within = s.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("sw").alias("sw"),
        F.sum(F.expr("saa - sa*sa/sw")).alias("vaa"),
        F.sum(F.expr("sbb - sb*sb/sw")).alias("vbb"),
        F.sum(F.expr("sab - sa*sb/sw")).alias("vab"),
    )
    rho = F.expr("(vab/sw) / (sqrt(vaa/sw)*sqrt(vbb/sw) + 1e-6D)")
    return within.select(*keys, "n", F.when(F.col("n") >= 8, rho).alias("rho"))


def noisy_or(sides: DataFrame) -> DataFrame:
    """Scan logit from side logits: p = 1 - prod(1 - p_s), clipped and mapped back."""
    p = clip_prob(sigmoid("z"))
    joint = sides.groupBy("uid").agg(F.exp(F.sum(F.log(F.lit(1.0) - p))).alias("_q"))
    return joint.select("uid", logit(F.lit(1.0) - F.col("_q")).alias("z"))


def group_dro(df: DataFrame, group: str, weights: DataFrame, eta: float) -> DataFrame:
    """One step: weights times exp(eta * group loss), normalised, and the weighted loss."""
    loss = df.groupBy(group).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n"))
    raw = weights.join(loss, group, "left").withColumn(
        "raw", F.col("w") * F.exp(F.lit(float(eta)) * F.coalesce("loss", F.lit(0.0)))
    )
    total = raw.agg(F.sum("raw").alias("total"))
    new = raw.join(F.broadcast(total)).select(group, "loss", "n", (F.col("raw") / F.col("total")).alias("w"))
    mixed = new.agg(
        (F.sum(F.col("w") * F.col("n") * F.col("loss")) / F.sum(F.col("w") * F.col("n"))).alias("weighted_loss")
    )
    return new.join(F.broadcast(mixed))


def loss_from_logit(df: DataFrame) -> DataFrame:
    return df.withColumn("loss", bce_from_logit("z", "y"))
