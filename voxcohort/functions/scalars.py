"""Scalar expressions over probabilities, logits and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EPS, INTENSITY_CAP


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Six decimals, with negative zero folded into zero, for order-insensitive comparison."""
    return F.round(col(c), 6) + F.lit(0.0)


def clamp(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(c)))


def clip_prob(p, eps: float = EPS) -> Column:
    return clamp(p, eps, 1.0 - eps)


def logit(p, eps: float = EPS) -> Column:
    q = clip_prob(p, eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def cap_logit(z, cap: float | None) -> Column:
    """Symmetric clamp; None means no cap."""
    return col(z) if cap is None else clamp(z, -cap, cap)


def calibrate(z, a: float, b: float, eps: float = EPS) -> Column:
    return clip_prob(sigmoid(F.lit(float(a)) * col(z) + F.lit(float(b))), eps)


def sanitise(p) -> Column:
    """NaN -> 0.5, +Inf -> 1, -Inf -> 0."""
    c = col(p)
    return (
        F.when(F.isnan(c), F.lit(0.5))
        .when(c == F.lit(float("inf")), F.lit(1.0))
        .when(c == F.lit(float("-inf")), F.lit(0.0))
        .otherwise(c)
    )


def log_loss_term(y, p, eps: float = EPS) -> Column:
    q = clip_prob(p, eps)
    yy = col(y).cast("double")
    return -(yy * F.log(q) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - q))


def softplus(z) -> Column:
    c = col(z)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def bce_from_logit(z, y) -> Column:
    """Binary cross-entropy from a logit, stable at both tails."""
    c, yy = col(z), col(y).cast("double")
    return F.greatest(c, F.lit(0.0)) - c * yy + F.log1p(F.exp(-F.abs(c)))


def half_even(c) -> Column:
    """Round half to even, as crop centres do."""
    return F.bround(col(c), 0)


def compress_input(v, cap: float = INTENSITY_CAP, log_scale: bool = False) -> Column:
    x = F.least(col(v), F.lit(float(cap)))
    return F.log1p(x) * F.lit(12.0) / F.log1p(F.lit(12.0)) if log_scale else x


def let(value, body) -> Column:
    """Evaluate `value` once and use it inside `body`, also when `body` holds a lambda.

    The optimizer may inline a column referenced once into a lambda and re-evaluate it per element; a
    lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(col(value)), body), 1)


def mean_of(arr) -> Column:
    a = col(arr)
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def sorted_quantile(arr, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array; NULL of an empty one."""
    a = col(arr)
    at = F.lit(float(q)) * (F.size(a) - F.lit(1))
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.get(a, lo) * (F.lit(1.0) - (at - lo)) + F.get(a, hi) * (at - lo)


def sorted_nearest(arr, q: float) -> Column:
    """Value at position floor(q * (n - 1)) of an ascending array; NULL of an empty one."""
    a = col(arr)
    return F.get(a, F.floor(F.lit(float(q)) * (F.size(a) - F.lit(1))).cast("int"))
