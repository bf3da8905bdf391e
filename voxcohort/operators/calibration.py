"""Slope and intercept fits as Newton steps over distributed sums.

Rows are frozen once; each step is one aggregation. Without a group a fit is a handful of numbers, and the driver takes the step. With
groups, however many, the fits are a table: every step joins it to the rows by group, sums, and takes all steps as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import EPS
from ..functions.scalars import calibrate, log_loss_term
from ..session import cut, stored

# Newton converges quadratically: a last step below this leaves an error far below it
TOL = 1e-10


def _terms(a, b) -> list:
    """Gradient and curvature terms of a row at (a, b): g*z, g, h*z*z, h*z, h."""
    z = F.col("z")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(a * z + b)))
    g, h = p - F.col("y"), p * (F.lit(1.0) - p)
    return [g * z, g, h * z * z, h * z, h]


def _sums(df: DataFrame, fits: dict, free_a: bool, free_b: bool) -> dict:
    """Sums of the terms of every named fit at its current (a, b); those a pinned parameter makes needless are not computed."""
    need = [k for k in range(5) if (free_a and k in (0, 2)) or (free_b and k in (1, 4)) or (free_a and free_b and k == 3)]
    aggs = [F.sum(x).alias(f"s{n}_{k}") for n, (a, b) in fits.items() for k, x in enumerate(_terms(F.lit(a), F.lit(b))) if k in need]
    row = df.agg(*aggs).first()
    return {n: [(row[f"s{n}_{k}"] or 0.0) if k in need else 0.0 for k in range(5)] for n in fits}


def fit(
    df: DataFrame,
    group: str | None = None,
    slopes: list[float] | None = None,
    intercept: float | None = None,
    slope_bounds: tuple[float, float] | None = None,
    intercept_bounds: tuple[float, float] | None = None,
    steps: int = 50,
    ready: bool = False,
) -> DataFrame:
    """Fit sigmoid(a*z + b) to y by log loss.

    `slopes` pins a (one fit per slope); `intercept` pins b; otherwise both are free. The loss is convex,
    so clamping the free parameter, with the other refitted, is the bounded optimum. `ready` says the
    rows are already frozen, which saves writing them again.
    Returns one row per group and slope: a, b, and whether the steps settled; classes that a fit separates have no optimum and do not.
    Groups may be as many as there are rows, and null is one.
    """
    cols = ([group] if group else []) + ["z", F.col("y").cast("double").alias("y")]
    frozen = df.select(*cols) if ready else cut(df.select(*cols))
    # every step scans the same few columns; the cached copy may be lost with an executor, the frozen one not
    frozen = frozen.persist()
    try:
        if group:
            return _fit_groups(frozen, group, slopes, intercept, slope_bounds, intercept_bounds, steps)
        return _fit(frozen, df.sparkSession, slopes, intercept, slope_bounds, intercept_bounds, steps)
    finally:
        frozen.unpersist()


def _fit(frozen, spark, slopes, intercept, slope_bounds, intercept_bounds, steps) -> DataFrame:
    start = 0.0 if intercept is None else float(intercept)
    fits = {i: (float(a), start) for i, a in enumerate(slopes or [1.0])}
    free_a, free_b = slopes is None, intercept is None
    open_ = _newton(frozen, fits, free_a, free_b, steps)
    if slope_bounds and free_a:
        a, b = fits[0]
        held = min(max(a, slope_bounds[0]), slope_bounds[1])
        if held != a:
            # fitted anew from the start: a separating slope may have carried the intercept far off
            fits[0] = (held, 0.0 if free_b else b)
            open_ = _newton(frozen, fits, False, True, steps) if free_b else set()
    if intercept_bounds and free_b:
        lo, hi = intercept_bounds
        fits = {k: (a, min(max(b, lo), hi)) for k, (a, b) in fits.items()}
    rows = [(float(slopes[n]) if slopes else None, float(a), float(b), n not in open_) for n, (a, b) in fits.items()]
    return spark.createDataFrame(rows, "slope double, a double, b double, converged boolean")


def _newton(frozen, fits: dict, free_a: bool, free_b: bool, steps: int) -> set:
    """Advance the fits in place; returns those that did not settle."""
    active, stuck = set(fits), set()
    reach, last = dict.fromkeys(active, 4.0), dict.fromkeys(active, (0.0, 0.0))
    for _ in range(steps):
        sums = _sums(frozen, {k: fits[k] for k in active}, free_a, free_b)
        moved = set()
        for k in active:
            ga, gb, haa, hab, hbb = sums[k]
            a, b = fits[k]
            if free_a and free_b:
                det = haa * hbb - hab * hab
                da, db = ((hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det) if det > 0 else (math.nan, math.nan)
            elif free_b:
                da, db = 0.0, gb / hbb if hbb > 0 else math.nan
            elif free_a:
                da, db = ga / haa if haa > 0 else math.nan, 0.0
            else:
                da = db = 0.0
            if not (math.isfinite(da) and math.isfinite(db)):
                stuck.add(k)
                continue
            size = max(abs(da), abs(db))
            if da * last[k][0] + db * last[k][1] < 0:  # turning back on a convex loss: the last step went too far
                reach[k] /= 2
            if size > reach[k]:  # damp far steps; near the optimum the full step is taken
                da, db = da * reach[k] / size, db * reach[k] / size
            last[k] = (da, db)
            fits[k] = (a - da, b - db)
            if max(abs(da), abs(db)) > TOL * (1.0 + abs(a) + abs(b)):
                moved.add(k)
        active = moved
        if not active:
            break
    return active | stuck


def _fit_groups(frozen, group, slopes, intercept, slope_bounds, intercept_bounds, steps) -> DataFrame:
    """The same steps as _newton, for all groups at once: one row of the table per group and slope."""
    pinned = F.lit(slopes is not None)
    state = frozen.select(group).distinct().withColumn("slope", F.explode(F.array(*[F.lit(float(s)) for s in slopes])) if slopes else F.lit(None).cast("double"))
    state = state.select(
        group, "slope", F.coalesce("slope", F.lit(1.0)).alias("a"), F.lit(0.0 if intercept is None else float(intercept)).alias("b"), pinned.alias("held"),
        F.lit(4.0).alias("reach"), F.lit(0.0).alias("la"), F.lit(0.0).alias("lb"), F.lit(True).alias("open"), F.lit(False).alias("stuck"),
    )
    state = _settle(frozen, stored(state), group, intercept is None, steps)
    if slope_bounds and slopes is None:
        lo, hi = slope_bounds
        outside = (F.col("a") < lo) | (F.col("a") > hi)
        # a slope at its bound is held there, and its intercept fitted anew; the others stay as they are
        state = state.select(
            group, "slope", F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col("a"))).alias("a"), F.when(outside & F.lit(intercept is None), F.lit(0.0)).otherwise(F.col("b")).alias("b"), outside.alias("held"), F.lit(4.0).alias("reach"), F.lit(0.0).alias("la"), F.lit(0.0).alias("lb"),
            (outside & F.lit(intercept is None)).alias("open"), F.lit(False).alias("stuck"), (~outside & (F.col("open") | F.col("stuck"))).alias("unsettled"),
        )
        state = _settle(frozen, stored(state), group, intercept is None, steps)
        state = state.withColumn("stuck", F.col("stuck") | F.col("unsettled"))
    b = F.col("b")
    if intercept_bounds and intercept is None:
        b = F.greatest(F.lit(float(intercept_bounds[0])), F.least(F.lit(float(intercept_bounds[1])), b))
    return state.select(group, "slope", "a", b.alias("b"), (~F.col("open") & ~F.col("stuck")).alias("converged"))


# one projection per line: the sums into steps, their finiteness and reach, the damping, and the new state
_STEP = (
    ("if(held, 0D, if({both}, if(det > 0, (hbb*ga - hab*gb)/det, null), if(haa > 0, ga/haa, null))) da", "if({both}, if(det > 0, (haa*gb - hab*ga)/det, null), if({free_b}, if(hbb > 0, gb/hbb, null), 0D)) db"),
    ("coalesce(abs(da) < double('inf') and abs(db) < double('inf'), false) ok", "if(da*la + db*lb < 0, reach/2, reach) near", "greatest(abs(da), abs(db)) size"),
    ("if(size > near, near/size, 1D) k",),
)
_NEW = {
    "a": "if(open and ok, a - da*k, a)", "b": "if(open and ok, b - db*k, b)", "la": "if(open and ok, da*k, la)", "lb": "if(open and ok, db*k, lb)", "reach": "near",
    "open": f"open and ok and greatest(abs(da*k), abs(db*k)) > {TOL!r}D*(1 + abs(a) + abs(b))", "stuck": "stuck or (open and not ok)",
}


def _settle(frozen, state: DataFrame, group: str, free_b: bool, steps: int) -> DataFrame:
    """Newton steps of the open rows of the table until none moves. Rows meet the table by group; the engine broadcasts it while it is small."""
    said = {"both": f"({str(free_b).lower()} and not held)", "free_b": str(free_b).lower()}
    columns = state.columns
    frozen = frozen.withColumnRenamed(group, "_g")
    sums = [F.sum(x).alias(n) for n, x in zip(("ga", "gb", "haa", "hab", "hbb"), _terms(F.col("a"), F.col("b")), strict=True)]
    for _ in range(steps):
        if not state.where("open").take(1):
            break
        at = state.where("open").select(F.col(group).alias("_k"), F.col("slope").alias("_slope"), "a", "b")
        s = frozen.join(at, F.expr("_g <=> _k")).groupBy("_k", "_slope").agg(*sums)
        t = state.join(s, F.expr(f"`{group}` <=> _k and slope <=> _slope"), "left").selectExpr("*", "haa*hbb - hab*hab det")
        for line in _STEP:
            t = t.selectExpr("*", *[e.format(**said) for e in line])
        state = stored(t.selectExpr(*[f"{_NEW[c]} as `{c}`" if c in _NEW else f"`{c}`" for c in columns]))
    return state


def losses(df: DataFrame, table: DataFrame, group: str | None = None) -> DataFrame:
    """Log loss of the rows under every fitted (a, b). Without a group the table is a handful of rows; by group it is joined like any table."""
    joined = df.join(table, group) if group else df.join(F.broadcast(table))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("a") * F.col("z") + F.col("b"))))
    keys = ([group] if group else []) + ["slope", "a", "b"]
    return joined.groupBy(*keys).agg(
        F.avg(log_loss_term("y", p, EPS)).alias("ll"), F.count(F.lit(1)).alias("n")
    )


def apply(df: DataFrame, a: float, b: float, z: str = "z", name: str = "p") -> DataFrame:
    return df.withColumn(name, calibrate(z, a, b))
