"""Two-dimensional maps of a volume: shape, depth, anchors and levels.

Input maps have one row per (uid, x, y) on a dense grid and are partitioned by uid; see `stencil.by_scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import MIN_ANCHOR_PIXELS, SHAPE_WINDOW, SIGMOID_SHARPNESS
from ..functions.scalars import col, sigmoid
from ..session import cut
from .stencil import by_scan, eroded, frame, line, on_grids, scan_parts, smooth

XY = ["x", "y"]


def scan():
    """Window over all pixels of one scan, bounded by the map size."""
    return Window.partitionBy("uid")


def window_flag(window: tuple[int, int, int], widen: float = 1.0) -> Column:
    """Inside the central window of half width round(h * widen)."""
    c0, c1, h = window
    h = int(round(h * widen))
    return F.col("x").between(c0 - h, c0 + h - 1) & F.col("y").between(c1 - h, c1 + h - 1)


def local_moments(img: DataFrame, value: str, k: int = SHAPE_WINDOW) -> DataFrame:
    """Adds u20, u02, u11: second moments of the k x k window about its own centre, in units of k.

    Six raw moments are box sums, two passes of row frames; frames cut at the border are zero padding.
    Offsets are taken from the pixel itself, so the subtraction stays small.
    """
    v, half = col(value), k // 2
    names = ["_s", "_sx", "_sy", "_sxx", "_syy", "_sxy"]
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    t = img
    for n, e in zip(names, (v, v * x, v * y, v * x * x, v * y * y, v * x * y)):
        t = t.withColumn(n, e)
    for axis in XY:
        w = line(XY, axis).rowsBetween(-half, half)
        keep = [c for c in t.columns if c not in names]
        t = t.select(*keep, *[F.sum(n).over(w).alias(n) for n in names])
    area, kk = float(k * k), float(k)
    m00 = F.greatest(F.col("_s") / area, F.lit(1e-4))
    dx = (F.col("_sx") - x * F.col("_s")) / (area * kk)
    dy = (F.col("_sy") - y * F.col("_s")) / (area * kk)
    dxx = (F.col("_sxx") - 2 * x * F.col("_sx") + x * x * F.col("_s")) / (area * kk * kk)
    dyy = (F.col("_syy") - 2 * y * F.col("_sy") + y * y * F.col("_s")) / (area * kk * kk)
    dxy = (F.col("_sxy") - x * F.col("_sy") - y * F.col("_sx") + x * y * F.col("_s")) / (area * kk * kk)
    cx, cy = dx / m00, dy / m00
    return t.select(
        *[c for c in t.columns if c not in names],
        F.greatest(F.lit(0.0), dxx / m00 - cx * cx).alias("u20"), F.greatest(F.lit(0.0), dyy / m00 - cy * cy).alias("u02"), (dxy / m00 - cx * cy).alias("u11"),
    )


def anisotropy() -> Column:
    """(l1 - l2) / (l1 + l2) of the local second moments."""
    half = (F.col("u20") + F.col("u02")) / 2.0
    d = F.sqrt(F.greatest(F.pow((F.col("u20") - F.col("u02")) / 2.0, 2) + F.col("u11") * F.col("u11"), F.lit(1e-12)))
    l1, l2 = half + d, F.greatest(F.lit(0.0), half - d)
    return (l1 - l2) / (l1 + l2 + F.lit(1e-6))


def orientation() -> tuple[Column, Column]:
    """Anisotropy times the cosine and sine of twice the orientation angle."""
    tr = F.col("u20") + F.col("u02") + F.lit(1e-6)
    return (F.col("u20") - F.col("u02")) / tr, 2 * F.col("u11") / tr


def anchored(img: DataFrame, value: str, region: str, window: tuple[int, int, int], least: int = MIN_ANCHOR_PIXELS, guard: bool = False) -> DataFrame:
    """Adds `anchor` (one level per scan) and the effective `region` as 0/1.

    A region with too few pixels becomes the fixed window; with `guard`, an anchor below half of the wide
    window's maximum is replaced by that maximum and the region by the whole map.
    """
    v = col(value)
    t = img.withColumn("_n", F.sum(region).over(scan()))
    t = t.withColumn(region, F.when(F.col("_n") >= least, F.col(region)).otherwise(window_flag(window).cast("int"))).drop("_n")
    t = t.withColumn("anchor", F.greatest(F.max(v * F.col(region)).over(scan()), F.lit(1e-3)))
    if guard:
        t = t.withColumn("_wide", F.greatest(F.max(F.when(window_flag(window, 1.5), v)).over(scan()), F.lit(1e-3)))
        good = F.col("anchor") >= F.lit(0.5) * F.col("_wide")
        t = t.withColumn(region, F.when(good, F.col(region)).otherwise(F.lit(1))).withColumn("anchor", F.when(good, F.col("anchor")).otherwise(F.col("_wide"))).drop("_wide")
    return t


def soft_above(value, level, sharp: float = SIGMOID_SHARPNESS) -> Column:
    return sigmoid((col(value) - col(level)) / F.greatest(col(level), F.lit(1e-3)) * F.lit(sharp))


def over_region_max(value: str, region: str | None = "region") -> Column:
    v = col(value) if region is None else col(value) * col(region)
    return col(value) / F.greatest(F.max(v).over(scan()), F.lit(1e-3))


def depth_map(img: DataFrame, value: str, level, steps: int, dims: tuple[int, int], region: str | None = "region", name: str = "depth") -> DataFrame:
    """Erosion depth of the soft level set, divided by its maximum in the region. The map is dense and partitioned by uid."""
    t = on_grids(img.withColumn("soft", soft_above(value, level)), dict(zip(XY, dims, strict=True)), "soft", lambda v: eroded(v, steps), "_d")
    return t.withColumn(name, over_region_max("_d", region)).drop("_d")


def otsu_levels(img: DataFrame, value: str, window: tuple[int, int, int] | None, widen: float = 1.5) -> DataFrame:
    """Two-class level per scan from the window values; at most one window of pixels per scan is ordered."""
    t = img.where(window_flag(window, widen)) if window else img
    w = Window.partitionBy("uid").orderBy(value)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("uid", value, F.row_number().over(w).alias("k"), F.sum(value).over(run).alias("cs"), F.sum(value).over(scan()).alias("tot"), F.count(F.lit(1)).over(scan()).alias("n"))
    k, n = F.col("k"), F.col("n")
    gap = F.col("cs") / k - (F.col("tot") - F.col("cs")) / F.greatest(n - k, F.lit(1))
    t = t.withColumn("bcv", F.when(k < n, F.round(k * (n - k) * gap * gap, 9)).otherwise(F.lit(0.0)))
    return t.groupBy("uid").agg(F.max(F.struct("bcv", (-k).alias("first"), F.col(value).alias("level"))).alias("b")).select("uid", F.col("b.level").alias("level"))


def peaks(img: DataFrame, value: str, levels: DataFrame) -> DataFrame:
    """Adds `sm` (smoothed value), `level` and `is_peak`: local maxima of the 3x3 neighbourhood above the level."""
    t = frame(img.withColumn("_top", F.col(value)), XY, "_top", F.max, 1).join(levels, "uid")
    return t.withColumn("is_peak", ((F.col(value) >= F.col("_top")) & (F.col(value) > F.greatest(F.col("level"), F.lit(1e-3)))).cast("int")).drop("_top")


def peak_distance(t: DataFrame, steps: int = 20, scale: float = 6.0) -> DataFrame:
    """exp(-d / scale) with d the Chebyshev distance to a peak, at most `steps`.

    d is the number of radii 0 .. steps-1 that contain no peak, so one pass of row frames per axis gives it.
    """
    cols = [f"_r{k}" for k in range(steps)]
    t = t.select("*", *[F.col("is_peak").alias(c) for c in cols])
    for axis in XY:
        w = line(XY, axis)
        keep = [c for c in t.columns if c not in cols]
        t = t.select(*keep, *[F.max(c).over(w.rowsBetween(-k, k)).alias(c) for k, c in enumerate(cols)])
    d: Column = F.lit(0.0)
    for c in cols:
        d = d + (F.lit(1.0) - F.col(c))
    return t.withColumn("near", F.exp(-d / F.lit(scale))).drop(*cols)


def basins(t: DataFrame, value: str, steps: int = 30, per_job: int = 5) -> DataFrame:
    """Adds `ratio`: value over the height of the peak reached by walking uphill within `steps`; 0 if none.

    Each step a pixel takes the best basin height among its 3x3 neighbours that are at least as high. The
    neighbourhood is read by lag and lead on the two axes, local to a scan.
    """
    cur = cut(t.withColumn("_b", F.when(F.col("is_peak") == 1, F.col(value)).otherwise(F.lit(0.0))))
    done, parts = 0, scan_parts(cur)
    while done < steps:
        todo = min(per_job, steps - done)
        nxt = by_scan(cur, parts).withColumn("_was", F.col("_b"))
        for _ in range(todo):
            wy, wx = line(XY, "y"), line(XY, "x")
            here = F.struct(F.col(value).alias("h"), F.col("_b").alias("b"))
            nxt = nxt.withColumn("_row", F.array(F.lag(here).over(wy), here, F.lead(here).over(wy)))
            near = F.concat(
                F.coalesce(F.lag("_row").over(wx), F.array()), F.col("_row"), F.coalesce(F.lead("_row").over(wx), F.array())
            )
            nxt = nxt.withColumn("_near", near)
            up = F.filter("_near", lambda s: s.isNotNull() & (s["h"] >= F.col(value)))
            nxt = nxt.withColumn("_b", F.greatest("_b", F.array_max(F.transform(up, lambda s: s["b"])))).drop("_row", "_near")
        nxt = cut(nxt)
        done += todo
        moved = nxt.where("_b <> _was").limit(1).count()
        cur = nxt.drop("_was")
        if not moved:
            break
    r = F.when(F.col("_b") > 0, F.least(F.lit(1.0), F.col(value) / F.greatest("_b", F.lit(1e-3)))).otherwise(F.lit(0.0))
    return cur.withColumn("ratio", r).drop("_b")


def smooth_map(img: DataFrame, value: str, sigma: float) -> DataFrame:
    return smooth(img, XY, value, sigma)
