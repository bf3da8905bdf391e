"""Whole-volume operators on the array form: one row per scan, z fastest, then y, then x.

Arrays are unfolded with the outer form on purpose: the plain form makes the optimizer infer a
size-greater-than-zero filter, which would evaluate the whole array expression a second time.

A scan is one row, so its statistics are computed inside that row: sorting, reducing and re-scaling a
volume move no data. Long form (`voxels`) is produced where neighbours or joins are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import INTENSITY_CAP, TAU_FLOOR, TAU_OFFSET, TAU_SLOPE
from ..functions.scalars import col, let, mean_of, sorted_nearest, sorted_quantile


def voxels(boxes: DataFrame, dims: tuple[int, int, int], carry: tuple[str, ...] = (), data: str = "data") -> DataFrame:
    """Long form: one row per voxel with explicit coordinates."""
    _, ny, nz = dims
    i = F.col("i")
    long = boxes.select("uid", *carry, F.posexplode_outer(data).alias("i", "v"))
    return long.select(
        "uid", *carry, "i", F.floor(i / (ny * nz)).cast("int").alias("x"), (F.floor(i / nz) % ny).cast("int").alias("y"), (i % nz).alias("z"), "v"
    )


def cells(boxes: DataFrame, dims: tuple[int, int, int], uid: str, *data: str) -> DataFrame:
    """(uid, x, y, z) and the values of several arrays of the grid, side by side."""
    _, ny, nz = dims
    i = F.col("i")
    t = boxes.select(uid, F.posexplode_outer(F.arrays_zip(*data)).alias("i", "_v"))
    return t.select(uid, F.floor(i / (ny * nz)).cast("int").alias("x"), (F.floor(i / nz) % ny).cast("int").alias("y"), (i % nz).alias("z"), *[F.col(f"_v.{c}").alias(c) for c in data])


def check_shape(boxes: DataFrame) -> DataFrame:
    """Fail at run time when a volume does not match its dims."""
    want = F.aggregate("dims", F.lit(1), lambda a, n: a * n)
    ok = F.assert_true(F.size("data") == want, F.concat(F.lit("box shape differs for "), F.col("uid").cast("string")))
    return boxes.withColumn("_ok", ok).where(F.col("_ok").isNull()).drop("_ok")


def profiles(boxes: DataFrame, dims: tuple[int, int, int], carry: tuple[str, ...] = (), axis: int = 2) -> DataFrame:
    """(uid, a, b, prof): the values along one axis for every pixel of the other two, in axis order."""
    nx, ny, nz = dims
    keep = [k for k in range(3) if k != axis]
    stride = (ny * nz, nz, 1)
    na, nb, n = dims[keep[0]], dims[keep[1]], dims[axis]
    sa, sb, s = stride[keep[0]], stride[keep[1]], stride[axis]
    if axis == 2:
        pix = F.transform(F.sequence(F.lit(0), F.lit(na * nb - 1)), lambda p: F.slice("data", p * n + 1, n))
    else:
        steps = F.sequence(F.lit(0), F.lit(n - 1))

        def gather(p: Column) -> Column:
            base = F.floor(p / nb) * sa + (p % nb) * sb
            return let(base, lambda b: F.transform(steps, lambda k: F.element_at("data", (b + k * s + 1).cast("int"))))

        pix = F.transform(F.sequence(F.lit(0), F.lit(na * nb - 1)), gather)
    names = ("x", "y", "z")
    long = boxes.select("uid", *carry, F.posexplode_outer(pix).alias("_p", "prof"))
    return long.select(
        "uid", *carry, F.floor(F.col("_p") / nb).cast("int").alias(names[keep[0]]), (F.col("_p") % nb).cast("int").alias(names[keep[1]]), "prof"
    )


def sorted_values(data) -> Column:
    """Ascending values; mapping NULL away first lets the sort work on primitive doubles."""
    return F.sort_array(F.transform(col(data), lambda v: F.coalesce(v, F.lit(0.0))))


def _reference(data: Column, top: Column, f: float, least: int) -> Column:
    """Mean above f * top, plain mean when too few voxels, plus 1e-6; scalar folds, no structs per voxel."""

    def above(cutoff: Column) -> Column:
        total = F.aggregate(data, F.lit(0.0), lambda s, v: s + F.when(v > cutoff, v).otherwise(F.lit(0.0)))
        count = F.aggregate(data, F.lit(0), lambda n, v: n + F.when(v > cutoff, F.lit(1)).otherwise(F.lit(0)))
        return let(count, lambda n: F.when(n >= least, total / n).otherwise(mean_of(data)))

    return let(top * f, above) + F.lit(1e-6)


def brain_reference(data, f: float = 0.15, q: float = 0.999, least: int = 32, nearest: bool = False) -> Column:
    """Reference level of a volume: mean above a share of its upper quantile."""
    pick = sorted_nearest if nearest else sorted_quantile
    top = let(sorted_values(data), lambda s: pick(s, q))
    return let(top, lambda t: _reference(col(data), t, f, least))


def brain_mean_normalise(data, f: float = 0.15, q: float = 0.999, least: int = 32, cap: float = INTENSITY_CAP) -> Column:
    """Clip at zero, divide by the brain reference, clip to [0, cap]; an empty volume is unchanged."""

    def divided(d: Column, top: Column) -> Column:
        return let(_reference(d, top, f, least), lambda ref: F.transform(d, lambda v: F.least(F.lit(cap), F.greatest(F.lit(0.0), v / ref))))

    def scaled(d: Column) -> Column:
        top = let(F.sort_array(d), lambda s: sorted_quantile(s, q))
        return let(top, lambda t: F.when(t <= 0, d).otherwise(divided(d, t)))

    return let(F.transform(col(data), lambda v: F.greatest(v, F.lit(0.0))), scaled)


def renormalise(data, source, cap: float = INTENSITY_CAP, f: float = 0.15, least: int = 32) -> Column:
    """Put a modified volume back on the reference of the volume it came from."""
    ratio = brain_reference(data, f, least=least, nearest=True) / brain_reference(source, f, least=least, nearest=True)
    return let(ratio, lambda k: F.transform(col(data), lambda v: F.least(F.lit(cap), F.greatest(F.lit(0.0), v / k))))


def tau(mu) -> Column:
    return F.greatest(F.lit(TAU_FLOOR), F.lit(TAU_SLOPE) * col(mu) + F.lit(TAU_OFFSET))


def soft_peak(prof, t) -> Column:
    """Smooth maximum along a profile: m + (ln sum exp(t (v - m)) - ln n) / t."""
    a, tt = col(prof), col(t)
    total = let(F.array_max(a), lambda m: m + F.log(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.exp(tt * (v - m)))) / tt)
    return total - F.log(F.size(a)) / tt


def scan_levels(boxes: DataFrame) -> DataFrame:
    """Adds mu (mean over the volume) and tau per scan."""
    return boxes.withColumn("mu", mean_of("data")).withColumn("tau", tau("mu"))


def peak_mean_maps(boxes: DataFrame, dims: tuple[int, int, int], axis: int = 2, support: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Soft-peak and mean maps along one axis; no shuffle, a pixel is reduced inside its scan's row.

    `support` leaves zeros out of the peak, of the mean and of mu; a pixel without support is zero.
    """
    if support:
        b = boxes.withColumn("_pos", F.filter("data", lambda v: v > 0))
        mu = F.aggregate("data", F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size("_pos"), F.lit(0.001) * F.size("data"))
        b = b.withColumn("mu", mu).withColumn("tau", tau("mu"))
    else:
        b = scan_levels(boxes)
    p = profiles(b, dims, ("mu", "tau", *carry), axis)
    if not support:
        return p.withColumn("peak", soft_peak("prof", "tau")).withColumn("mean", mean_of("prof"))
    p = p.withColumn("_sup", F.filter("prof", lambda v: v > 0)).withColumn("_n", F.size("_sup"))
    return p.withColumn("peak", F.when(F.col("_n") > 0, soft_peak("_sup", "tau")).otherwise(F.lit(0.0))).withColumn(
        "mean", F.when(F.col("_n") > 0, mean_of("_sup")).otherwise(F.lit(0.0))
    ).drop("_sup", "_n")


def hemisphere_views(boxes: DataFrame, dims: tuple[int, int, int], slabs: tuple[tuple[int, int], ...]) -> DataFrame:
    """(uid, slab, row, y, peak, mean): maps along left-right of each slab of x, on the frame of the axial map.

    Rows are S-I, columns the A-P axis that both views share; the S-I extent sits in the middle of as many rows as the volume has L-R
    planes, the odd row after it, and what surrounds it is zero. Levels are the slab's own. No shuffle.
    """
    nx, ny, nz = dims
    spare = nx - nz
    if spare < 0:
        raise ValueError("the S-I extent does not fit the axial map")
    out = None
    for k, (lo, hi) in enumerate(slabs):
        part = boxes.select("uid", F.slice("data", lo * ny * nz + 1, (hi - lo) * ny * nz).alias("data"))
        m = peak_mean_maps(part, (hi - lo, ny, nz), axis=0)
        m = m.select("uid", F.lit(k).alias("slab"), (F.col("z") + spare // 2).cast("int").alias("row"), "y", "peak", "mean")
        frame = [r for r in range(nx) if not spare // 2 <= r < spare // 2 + nz]
        if frame:
            rim = boxes.select("uid", F.lit(k).alias("slab"), F.explode(F.array(*[F.lit(r) for r in frame])).alias("row")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
            m = m.unionByName(rim.select("*", F.lit(0.0).alias("peak"), F.lit(0.0).alias("mean")))
        out = m if out is None else out.unionByName(m)
    return out


def channels(maps: DataFrame, stack: list[str], swap: dict[int, str] | None = None, name: str = "c") -> DataFrame:
    """Numbered channels c0 .. of a pixel's maps; `swap` puts another map in a channel's place."""
    return maps.withColumns({f"{name}{k}": F.col((swap or {}).get(k, c)) for k, c in enumerate(stack)})


def to_boxes(vox: DataFrame, dims: tuple[int, int, int], carry: tuple[str, ...] = ()) -> DataFrame:
    """Array form from long form; absent voxels become zero. One array per scan, bounded by the grid."""
    nx, ny, nz = dims
    n = nx * ny * nz
    i = (F.col("x") * (ny * nz) + F.col("y") * nz + F.col("z")).cast("int").alias("i")
    g = vox.groupBy("uid").agg(F.collect_list(F.struct(i, F.lit(1).alias("own"), F.col("v").cast("double").alias("v"))).alias("s"), *[F.first(c).alias(c) for c in carry])
    # a zero for every place sorts before the place's own voxel, and stays only where the next entry is another place
    zeros = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("i"), F.lit(0).alias("own"), F.lit(0.0).alias("v")))
    pick = lambda a: F.transform(F.filter(a, lambda e, k: (e["own"] == 1) | F.coalesce(F.get(a, k + 1)["i"] != e["i"], F.lit(True))), lambda e: F.coalesce(e["v"], F.lit(0.0)))
    data = let(F.array_sort(F.concat("s", zeros)), pick)
    return g.select("uid", *carry, F.array(*[F.lit(k) for k in dims]).alias("dims"), data.alias("data"))
