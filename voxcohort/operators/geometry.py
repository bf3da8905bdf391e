"""Poses, ellipsoids and affine resampling."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FRAME_CENTRE, SPAN_CLIP, TARGET_SPANS


def ellipsoid_q(radius_floor: float = 1e-3) -> Column:
    """Quadratic form of a pose rotated by th about z, at voxel (x, y, z)."""
    dx, dy, dz = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("z") - F.col("cz")
    c, s = F.cos("th"), F.sin("th")
    floor = lambda r: F.greatest(F.col(r), F.lit(radius_floor))
    u, v, w = (c * dx + s * dy) / floor("rx"), (-s * dx + c * dy) / floor("ry"), dz / floor("rz")
    return u * u + v * v + w * w


def inside_ellipsoids(vox: DataFrame, pose: DataFrame) -> DataFrame:
    """Voxels inside each side's ellipsoid; a bounding range on the centre precedes the quadratic form."""
    j = vox.join(pose, "uid")
    reach = F.greatest("rx", "ry", "rz")
    near = F.lit(True)
    for a in ("x", "y", "z"):
        near = near & F.col(a).between(F.col(f"c{a}") - reach, F.col(f"c{a}") + reach)
    return j.where(near).where(F.round(ellipsoid_q(), 9) < 1)


ROTATION = [f"m{i}{j}" for i in range(3) for j in range(3)]


def euler(a: Column, b: Column, c: Column) -> dict[str, Column]:
    """m00 .. m22 of the rotation by c about z, then b about y, then a about x; rows are the ellipsoid's axes."""
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    rows = ((cb * cc, cb * sc, -sb), (sa * sb * cc - ca * sc, sa * sb * sc + ca * cc, sa * cb), (ca * sb * cc + sa * sc, ca * sb * sc - sa * cc, ca * cb))
    return {f"m{i}{j}": rows[i][j] for i in range(3) for j in range(3)}


def rotated_cells(poses: DataFrame, dims: tuple[int, int, int], sides: tuple[str, str] = ("L", "R"), project: bool = False, radius_floor: float = 1e-3) -> DataFrame:
    """Grid cells inside the ellipsoids of a scan: uid, x, y, z, left, right, either; or their projection along z: uid, x, y and the flags.

    poses has uid, side, centre c*, radii r* and the rotation m00 .. m22, one row per side. A point is inside if the rotated, scaled distance is
    below one. Only cells within the exact axis ranges c +- sqrt(sum of (m r)^2) are made, from the poses alone: no voxel is read or joined,
    and the only shuffle brings the two poses of a scan together. A side that is missing is false.
    """
    fields = ["cx", "cy", "cz", *(F.greatest(F.col(f"r{a}"), F.lit(radius_floor)).alias(f"r{a}") for a in "xyz"), *ROTATION]
    g = poses.groupBy("uid").agg(*[F.max(F.when(F.col("side") == s, F.struct(*fields))).alias(f"_{k}") for k, s in enumerate(sides)])
    ranges = {}
    for j, (a, n) in enumerate(zip("xyz", dims, strict=True)):
        ends = []
        for k in range(2):
            f = lambda c, k=k: F.col(f"_{k}.{c}")
            reach = F.sqrt(sum((F.pow(f(f"m{i}{j}") * f(f"r{b}"), 2) for i, b in enumerate("xyz")), F.lit(0.0)))
            ends.append((F.greatest(F.lit(0), F.ceil(f(f"c{a}") - reach)).cast("int"), F.least(F.lit(n - 1), F.floor(f(f"c{a}") + reach)).cast("int")))
        lo, hi = F.least(ends[0][0], ends[1][0]), F.greatest(ends[0][1], ends[1][1])
        ranges[a] = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    def inside(k: int, z: Column) -> Column:
        f = lambda c: F.col(f"_{k}.{c}")
        d = [F.col("x") - f("cx"), F.col("y") - f("cy"), z - f("cz")]
        u = [(f(f"m{i}0") * d[0] + f(f"m{i}1") * d[1] + f(f"m{i}2") * d[2]) / f(f"r{b}") for i, b in enumerate("xyz")]
        return F.coalesce(F.round(u[0] * u[0] + u[1] * u[1] + u[2] * u[2], 9) < 1, F.lit(False))

    t = g.withColumn("x", F.explode(ranges["x"])).withColumn("y", F.explode(ranges["y"]))
    if project:
        column = lambda k: F.exists(ranges["z"], lambda z: inside(k, z))
        flags = [column(0), column(1)]
        t = t.select("uid", "x", "y", flags[0].alias("left"), flags[1].alias("right"))
    else:
        t = t.withColumn("z", F.explode(ranges["z"]))
        t = t.select("uid", "x", "y", "z", inside(0, F.col("z")).alias("left"), inside(1, F.col("z")).alias("right"))
    return t.withColumn("either", F.col("left") | F.col("right")).where("either")


def moment_ellipsoids(mask: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Centroid and quadratic form inv(5 (cov + 1e-3 I)) per group; NULL when too few voxels."""
    ax = ("x", "y", "z")
    g = mask.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(a).alias(f"c{a}") for a in ax],
        *[F.covar_samp(a, b).alias(f"v{a}{b}") for i, a in enumerate(ax) for b in ax[i:]],
    )
    for a in ax:
        g = g.withColumn(f"v{a}{a}", F.col(f"v{a}{a}") + F.lit(1e-3))
    det = F.expr("vxx*(vyy*vzz - vyz*vyz) - vxy*(vxy*vzz - vyz*vxz) + vxz*(vxy*vyz - vyy*vxz)")
    inv = {
        "mxx": "vyy*vzz - vyz*vyz", "myy": "vxx*vzz - vxz*vxz", "mzz": "vxx*vyy - vxy*vxy",
        "mxy": "vxz*vyz - vxy*vzz", "mxz": "vxy*vyz - vxz*vyy", "myz": "vxy*vxz - vxx*vyz",
    }
    ok = F.col("n") >= least
    g = g.withColumn("_d", det)
    return g.select(
        *keys, "n", *[F.when(ok, F.col(f"c{a}")).alias(f"c{a}") for a in ax],
        *[F.when(ok, F.expr(e) / (F.lit(5.0) * F.col("_d"))).alias(k) for k, e in inv.items()],
    )


def pose_matrix(
    poses: DataFrame, target=TARGET_SPANS, centre=FRAME_CENTRE, clip=SPAN_CLIP, least_gap: float = 8.0
) -> DataFrame:
    """3x4 voxel map from the canonical frame to the scan, from two centres l*, r* and spans s*.

    The axis joining the centres is turned onto the left-right axis, spans are scaled to the target within
    the clip, and the midpoint goes to the frame centre. Close centres or a missing span give identity.
    """
    flip = F.when(F.col("rx") - F.col("lx") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    p = poses.select(
        "uid",
        *[(flip * (F.col(f"r{a}") - F.col(f"l{a}"))).alias(f"d{a}") for a in "xyz"],
        *[((F.col(f"r{a}") + F.col(f"l{a}")) / 2.0).alias(f"m{a}") for a in "xyz"],
        *[
            F.when(F.col(f"s{a}").isNotNull(), F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), F.lit(t) / F.col(f"s{a}")))).alias(f"k{a}")
            for a, t in zip("xyz", target)
        ],
    )
    p = p.withColumn("_n", F.sqrt(F.expr("dx*dx + dy*dy + dz*dz")))
    p = p.withColumn("ux", F.col("dx") / F.col("_n")).withColumn("uy", F.col("dy") / F.col("_n")).withColumn("uz", F.col("dz") / F.col("_n"))
    # rotation taking u onto (1,0,0); the axis of rotation is (0, uz, -uy)
    p = p.withColumn("_s2", F.expr("uy*uy + uz*uz"))
    h = F.when(F.sqrt("_s2") < 1e-6, F.lit(0.0)).otherwise((F.lit(1.0) - F.col("ux")) / F.col("_s2"))
    p = p.withColumn("_h", h)
    tiny = F.sqrt("_s2") < 1e-6
    rot = {
        "00": "1 - (uy*uy + uz*uz)*_h", "01": "uy", "02": "uz",
        "10": "-uy", "11": "1 - uy*uy*_h", "12": "-uy*uz*_h",
        "20": "-uz", "21": "-uy*uz*_h", "22": "1 - uz*uz*_h",
    }
    eye = {k: 1.0 if k[0] == k[1] else 0.0 for k in rot}
    for k, e in rot.items():
        p = p.withColumn(f"r{k}", F.when(tiny, F.lit(eye[k])).otherwise(F.expr(e).cast("double")))
    bad = (F.col("_n") < least_gap) | F.col("kx").isNull() | F.col("ky").isNull() | F.col("kz").isNull()
    out = ["uid"]
    for i in range(3):
        row = []
        for j, a in enumerate("xyz"):
            lin = F.col(f"r{j}{i}") / F.col(f"k{a}")  # transposed rotation, then inverse scale per output axis
            row.append(lin)
            out.append(F.when(bad, F.lit(1.0 if i == j else 0.0)).otherwise(lin).alias(f"a{i}{j}"))
        shift = F.col(f"m{'xyz'[i]}")
        for j in range(3):
            shift = shift - row[j] * F.lit(float(centre[j]))
        out.append(F.when(bad, F.lit(0.0)).otherwise(shift).alias(f"a{i}3"))
    return p.select(*out)


def resample(
    boxes: DataFrame, dims: tuple[int, int, int], source: tuple[Column, Column, Column], out_dims: tuple[int, int, int] | None = None,
    border: str = "zero", data: str = "data", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Trilinear gather: output voxel (x, y, z) reads the source point given by three columns over x, y, z
    and the scan's own parameter columns.

    The eight corners are read from the scan's array, so there is no join and no shuffle. Outside is zero,
    or the nearest edge with border='edge'. One volume and one border per call: a second set of corners
    in the same stage makes the generated method too large for the JIT, which costs far more than it saves.
    """
    ox, oy, oz = out_dims or dims
    nx, ny, nz = dims
    i = F.col("_i")
    t = boxes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(ox * oy * oz - 1))))
    t = t.withColumn("x", F.floor(i / (oy * oz)).cast("int")).withColumn("y", (F.floor(i / oz) % oy).cast("int")).withColumn("z", (i % oz).cast("int"))
    names = ("_px", "_py", "_pz")
    for n, s, size in zip(names, source, dims):
        s = s.cast("double")
        if border == "edge":
            s = F.least(F.lit(float(size - 1)), F.greatest(F.lit(0.0), s))
        t = t.withColumn(n, s)
    # six axis weights and six clamped offsets, each computed once; the sum below only refers to them
    for n, size, stride in zip(names, dims, (ny * nz, nz, 1)):
        t = t.withColumn(f"{n}0", F.floor(n).cast("int")).withColumn(f"{n}f", F.col(n) - F.floor(n))
        for k in (0, 1):
            at, f = F.col(f"{n}0") + k, F.col(f"{n}f")
            t = t.withColumn(f"{n}w{k}", F.when(at.between(0, size - 1), f if k else F.lit(1.0) - f).otherwise(F.lit(0.0)))
            t = t.withColumn(f"{n}i{k}", F.greatest(F.lit(0), F.least(F.lit(size - 1), at)) * stride)
    total: Column = F.lit(0.0)
    for bx, by, bz in itertools.product((0, 1), repeat=3):
        w = F.col(f"_pxw{bx}") * F.col(f"_pyw{by}") * F.col(f"_pzw{bz}")
        total = total + w * F.get(F.col(data), F.col(f"_pxi{bx}") + F.col(f"_pyi{by}") + F.col(f"_pzi{bz}"))
    return t.select("uid", *carry, "x", "y", "z", total.alias("v"))


def half_pixel(axis_out: int, axis_in: int, coord) -> Column:
    """Source coordinate of an output index when both grids share edges (half-pixel centres)."""
    return (coord + F.lit(0.5)) * F.lit(axis_in / axis_out) - F.lit(0.5)


def corner_aligned(axis_out: int, axis_in: int, coord) -> Column:
    """Source coordinate when the first and last samples coincide."""
    return coord * F.lit((axis_in - 1) / max(axis_out - 1, 1))
