"""Volumes to two-dimensional maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import EROSION_STEPS, EROSION_STEPS_3D
from ..functions.scalars import let, mean_of, r6, sigmoid, sorted_nearest
from ..operators import maps as mp
from ..operators import volumes as vol
from ..operators.stencil import assert_dense, by_scan, eroded, frame, grow, on_grids, scan_parts, smooth
from ..session import cut
from .registry import query, r
from .sqltext import sig, smooth_sql
from .views import DIMS, IMG, scan_image, scan_voxels, v_boxes, v_grid, v_img, v_masks, v_vox
from .voxels import _PEAK, AX2, AX3, SIGMA, W5

WIN = (4, 4, 2)
INWIN = "x between 2 and 5 and y between 2 and 5"
WIDE = "x between 1 and 6 and y between 1 and 6"


@query("peak_map", f"with {_PEAK} select uid, x, y, {r('peak')} peak, {r('tau')} tau from pk", ("v_vox",))
def peak_map(spark, sf):
    m = vol.peak_mean_maps(v_boxes(spark, sf), DIMS)
    return m.select("uid", "x", "y", r6("peak").alias("peak"), r6("tau").alias("tau"))


@query("mean_map", f"select uid, x, y, {r('sum(v)/30.0::double')} mean from v_grid group by 1, 2, 3", ("v_grid",))
def mean_map(spark, sf):
    """Mean over the axis of a sparse volume: the divisor is the axis length, absent voxels are zeros."""
    return v_grid(spark, sf).groupBy("uid", "x", "y").agg(r6(F.sum("v") / F.lit(30.0)).alias("mean"))


@query(
    "support_aware_maps",
    f"""with s as (select uid, x, y, z, greatest(0, v - 1)::double v from v_vox), lv as (select uid, greatest(0.5, 4.09::double*sum(v)/greatest(count(*) filter (where v > 0), 0.001::double*count(*)) + 1.259::double) tau from s group by 1),
    g as (select uid, x, y, max(v) m, count(*) filter (where v > 0) n from s group by 1, 2, 3)
    select uid, x, y, {r('coalesce(max(m) + (ln(sum(exp(tau*(v - m))) filter (where v > 0)) - ln(max(n)))/max(tau), 0)')} peak, {r('coalesce(avg(v) filter (where v > 0), 0)')} mean from s join g using (uid, x, y) join lv using (uid) group by 1, 2, 3""",
    ("v_vox",),
)
def support_aware_maps(spark, sf):
    b = v_boxes(spark, sf).withColumn("data", F.transform("data", lambda v: F.greatest(F.lit(0.0), v - 1.0)))
    m = vol.peak_mean_maps(b, DIMS, support=True)
    return m.select("uid", "x", "y", r6("peak").alias("peak"), r6("mean").alias("mean"))


@query("generic_maps", f"select uid, x, y, {r('max(v)')} top, {r('avg(v)')} mean, {r('sqrt(var_pop(v) + 1e-6)')} sd from v_vox group by 1, 2, 3", ("v_vox",))
def generic_maps(spark, sf):
    p = vol.profiles(v_boxes(spark, sf), DIMS)
    var = let(mean_of("prof"), lambda m: F.aggregate("prof", F.lit(0.0), lambda s, v: s + (v - m) * (v - m))) / F.size("prof")
    return p.select("uid", "x", "y", r6(F.array_max("prof")).alias("top"), r6(mean_of("prof")).alias("mean"), r6(F.sqrt(var + 1e-6)).alias("sd"))


def moments_sql(src: str, v: str = "v", k: int = 3, n: str = "") -> str:
    h, a = k // 2, float(k * k)
    s = lambda e: f"sum(b.{v}{e})"
    dx, dy = "*(b.x - a.x)", "*(b.y - a.y)"
    return f"""{n}m0 as (select a.uid, a.x, a.y, greatest({s('')}/{a}::double, 1e-4) m00, {s(dx)}/{a * k}::double mx, {s(dy)}/{a * k}::double my, {s(dx + dx)}/{a * k * k}::double mxx, {s(dy + dy)}/{a * k * k}::double myy, {s(dx + dy)}/{a * k * k}::double mxy
      from {src} a join {src} b on a.uid = b.uid and abs(a.x - b.x) <= {h} and abs(a.y - b.y) <= {h} group by 1, 2, 3),
    {n}mo as (select uid, x, y, greatest(0, mxx/m00 - mx*mx/m00/m00) u20, greatest(0, myy/m00 - my*my/m00/m00) u02, mxy/m00 - mx*my/m00/m00 u11 from {n}m0),
    {n}an as (select *, (u20+u02)/2 + sqrt(greatest(pow((u20-u02)/2,2) + u11*u11, 1e-12)) l1, greatest(0, (u20+u02)/2 - sqrt(greatest(pow((u20-u02)/2,2) + u11*u11, 1e-12))) l2 from {n}mo)"""


_ANI = "(l1-l2)/(l1+l2+1e-6)"


def erosion_sql(src: str, v: str, steps: int, name: str, three: bool = False) -> str:
    """Direct neighbourhood minima of growing radius, summed."""
    z = " and abs(a.z - b.z) <= k.k" if three else ""
    cols = "a.uid, a.x, a.y" + (", a.z" if three else "")
    return f"""{name}_e as (select {cols}, k.k, min(b.{v}) e from {src} a cross join (select range + 1 k from range({steps})) k join {src} b on a.uid = b.uid and abs(a.x - b.x) <= k.k and abs(a.y - b.y) <= k.k{z} group by {cols}, k.k),
    {name} as (select {cols.replace('a.', '')}, sum(e) d from {name}_e group by {cols.replace('a.', '')})"""


_REGION = f"rg as (select uid, x, y, v, case when count(*) filter (where v > 1.5) over (partition by uid) >= 6 then (v > 1.5)::int else ({INWIN})::int end region from v_img)"
_ANCHOR = f"{_REGION}, ac as (select *, greatest(max(v*region) over (partition by uid), 1e-3) anchor from rg)"


def _anchored(spark, sf, guard=False):
    img = scan_image(spark, sf).withColumn("region", (F.col("v") > 1.5).cast("int"))
    return mp.anchored(img, "v", "region", WIN, least=6, guard=guard)


_SOFT = f"{_ANCHOR}, sf as (select *, {sig('(v - 0.5::double*anchor)/greatest(0.5::double*anchor, 1e-3)*12')} soft from ac)"
_DEPTH = f"{_SOFT}, {erosion_sql('sf', 'soft', EROSION_STEPS, 'dd')}, dp as (select uid, x, y, region, d/greatest(max(d*region) over (partition by uid), 1e-3) depth from dd join sf using (uid, x, y))"


@query(
    "anisotropy_map",
    f"""with {moments_sql('v_img')}, {_SOFT}, {smooth_sql('v_img', 'bl', AX2, W5)}, {moments_sql('bl', n='s_')}, t as (select an.*, v/greatest(max(v) over (partition by uid), 1e-3) rel from an join v_img using (uid, x, y))
    select t.uid, t.x, t.y, {r('(t.l1-t.l2)/(t.l1+t.l2+1e-6)*rel')} aniso, {r('(t.u20-t.u02)/(t.u20+t.u02+1e-6)*rel')} cos2, {r('2*t.u11/(t.u20+t.u02+1e-6)*rel')} sin2, {r('(t.l1-t.l2)/(t.l1+t.l2+1e-6)*soft')} gated, {r('(q.l1-q.l2)/(q.l1+q.l2+1e-6)*soft')} smooth_gated
    from t join sf using (uid, x, y) join s_an q using (uid, x, y)""",
    ("v_img",),
)
def anisotropy_map(spark, sf):
    """Local elongation weighted by relative uptake; or gated by the soft level set, on the map itself and on the smoothed map."""
    img = assert_dense(_anchored(spark, sf), {"x": IMG[0], "y": IMG[1]})
    t = mp.local_moments(img, "v", 3).withColumn("rel", F.col("v") / F.greatest(F.max("v").over(mp.scan()), F.lit(1e-3)))
    c, s = mp.orientation()
    rel, soft = F.col("rel"), mp.soft_above("v", F.lit(0.5) * F.col("anchor"))
    t = t.select("uid", "x", "y", "v", r6(mp.anisotropy() * rel).alias("aniso"), r6(c * rel).alias("cos2"), r6(s * rel).alias("sin2"), r6(mp.anisotropy() * soft).alias("gated"), soft.alias("soft"))
    t = mp.local_moments(smooth(t, ["x", "y"], "v", SIGMA), "v", 3)
    return t.select("uid", "x", "y", "aniso", "cos2", "sin2", "gated", r6(mp.anisotropy() * F.col("soft")).alias("smooth_gated"))


@query("depth_map", f"with {_DEPTH} select uid, x, y, {r('depth')} depth from dp", ("v_img",))
def depth_map(spark, sf):
    t = mp.depth_map(_anchored(spark, sf), "v", F.lit(0.5) * F.col("anchor"), EROSION_STEPS, IMG)
    return t.select("uid", "x", "y", r6("depth").alias("depth"))


@query(
    "anchor_region",
    f"""with {_ANCHOR}, w as (select *, greatest(max(case when {WIDE} then v end) over (partition by uid), 1e-3) wide from ac)
    select uid, {r('max(anchor)')} anchor, cast(sum(region) as bigint) pixels, {r('max(case when anchor >= 0.9*wide then anchor else wide end)')} guarded, max(wide) > max(anchor)/0.9 fired from w group by 1""",
    ("v_img",),
)
def anchor_region(spark, sf):
    t = _anchored(spark, sf).withColumn("wide", F.greatest(F.max(F.when(mp.window_flag(WIN, 1.5), F.col("v"))).over(mp.scan()), F.lit(1e-3)))
    good = F.col("anchor") >= F.lit(0.9) * F.col("wide")
    return t.groupBy("uid").agg(
        r6(F.max("anchor")).alias("anchor"), F.sum("region").cast("long").alias("pixels"), r6(F.max(F.when(good, F.col("anchor")).otherwise(F.col("wide")))).alias("guarded"),
        (F.max("wide") > F.max("anchor") / F.lit(0.9)).alias("fired"),
    )


def otsu_sql(src: str, name: str, where: str = "true") -> str:
    return f"""{name}_k as (select uid, v, row_number() over (partition by uid order by v) k, sum(v) over (partition by uid order by v rows unbounded preceding) cs, sum(v) over (partition by uid) tot, count(*) over (partition by uid) n from {src} where {where}),
    {name}_b as (select uid, v, k, case when k < n then round(k*(n-k)*pow(cs/k - (tot-cs)/greatest(n-k, 1), 2), 9) else 0 end bcv from {name}_k),
    {name} as (select uid, v lvl from (select *, row_number() over (partition by uid order by bcv desc, k) rn from {name}_b) where rn = 1)"""


@query("otsu_level", f"with {otsu_sql('v_img', 'o', WIDE)} select uid, {r('lvl')} lvl from o", ("v_img",))
def otsu_level(spark, sf):
    return mp.otsu_levels(v_img(spark, sf), "v", WIN).select("uid", r6("level").alias("lvl"))


_SMO = f"{smooth_sql('v_img', 'sm0', AX2, W5)}, sm as (select uid, x, y, round(v, 9) v from sm0), {otsu_sql('sm', 'o', WIDE)}, pkf as (select s.uid, s.x, s.y, s.v, greatest(lvl, 1e-3) lvl, s.v >= max(n.v) and s.v > greatest(lvl, 1e-3) peak from sm s join sm n on s.uid = n.uid and abs(s.x-n.x) <= 1 and abs(s.y-n.y) <= 1 join o on o.uid = s.uid group by s.uid, s.x, s.y, s.v, lvl)"


def _peaks(spark, sf):
    s = cut(mp.smooth_map(scan_image(spark, sf), "v", SIGMA).withColumn("v", F.round("v", 9)))
    return mp.peaks(by_scan(s, scan_parts(s)), "v", mp.otsu_levels(s, "v", WIN))


@query(
    "peak_distance_map",
    f"with {_SMO} select a.uid, a.x, a.y, {r('exp(-least(20, coalesce(min(greatest(abs(a.x-b.x), abs(a.y-b.y))), 20))/6.0::double)')} near from pkf a left join pkf b on a.uid = b.uid and b.peak group by 1, 2, 3",
    ("v_img",),
)
def peak_distance_map(spark, sf):
    return mp.peak_distance(_peaks(spark, sf), steps=20).select("uid", "x", "y", r6("near").alias("near"))


@query(
    "basin_map",
    f"""with recursive {_SMO}, up as (select a.uid, a.x, a.y, b.x bx, b.y b_y from pkf a join pkf b on a.uid = b.uid and abs(a.x-b.x) <= 1 and abs(a.y-b.y) <= 1 and b.v >= a.v),
    rc(uid, x, y, h) as (select uid, x, y, v from pkf where peak union select u.uid, u.x, u.y, r.h from rc r join up u on r.uid = u.uid and r.x = u.bx and r.y = u.b_y), mx as (select uid, x, y, max(h) h from rc group by 1, 2, 3)
    select p.uid, p.x, p.y, {r('case when h > 0 then least(1, p.v/greatest(h, 1e-3)) else 0 end')} ratio from pkf p left join mx on p.uid = mx.uid and p.x = mx.x and p.y = mx.y""",
    ("v_img",),
)
def basin_map(spark, sf):
    return mp.basins(_peaks(spark, sf), "v").select("uid", "x", "y", r6("ratio").alias("ratio"))


_FR = tuple(round(0.25 + 0.05 * k, 2) for k in range(9))


@query(
    "dice_optimal_level",
    f"""with {_ANCHOR}, f as (select uid, k.f, round((2*sum(region*s) + 1)/(sum(s) + sum(region) + 1), 9) dice from (select ac.*, k.f, {sig('(v - k.f*anchor)/(k.f*anchor)*12')} s from ac cross join (values {', '.join(f'({f}::double)' for f in _FR)}) k(f)) k group by 1, 2)
    select uid, f level, {r('dice')} dice from (select *, row_number() over (partition by uid order by dice desc, f) rn from f) where rn = 1""",
    ("v_img",),
)
def dice_optimal_level(spark, sf):
    """Best of nine fractions of the anchor by soft overlap with the region; the lowest wins ties."""
    t = _anchored(spark, sf)
    soft = {f: sigmoid((F.col("v") - F.lit(f) * F.col("anchor")) / (F.lit(f) * F.col("anchor")) * F.lit(12.0)) for f in _FR}
    dice = lambda s: F.round((2 * F.sum(F.col("region") * s) + 1) / (F.sum(s) + F.sum("region") + 1), 9)
    g = t.groupBy("uid").agg(*[dice(s).alias(f"d{i}") for i, s in enumerate(soft.values())])
    best = F.array_max(F.array(*[F.struct(F.col(f"d{i}").alias("dice"), F.lit(-f).alias("k")) for i, f in enumerate(_FR)]))
    return g.withColumn("b", best).select("uid", (-F.col("b.k")).alias("level"), r6("b.dice").alias("dice"))


@query("deficit_map", f"with {_ANCHOR} select uid, x, y, {r('region*(1 - least(1, v/greatest(0.8::double*anchor, 1e-3)))')} deficit from ac", ("v_img",))
def deficit_map(spark, sf):
    lvl = F.greatest(F.lit(0.8) * F.col("anchor"), F.lit(1e-3))
    return _anchored(spark, sf).select("uid", "x", "y", r6(F.col("region") * (1 - F.least(F.lit(1.0), F.col("v") / lvl))).alias("deficit"))


LEAST_3D = 3
WIN_3D = (2, 2, 1)


@query(
    "depth_map_3d",
    f"""with {_PEAK}, mk as (select distinct uid, x, y from v_masks), rg0 as (select pk.uid, pk.x, pk.y, peak, case when count(mk.uid) over (partition by pk.uid) >= {LEAST_3D} then (mk.uid is not null)::int else (pk.x between 1 and 2 and pk.y between 1 and 2)::int end region from pk left join mk using (uid, x, y)),
    a as (select uid, greatest(max(peak*region), 1e-3) a from rg0 group by 1),
    sv as (select v.uid, v.x, v.y, v.z, {sig('(v - 0.5::double*a)/greatest(0.5::double*a, 1e-3)*12')} s from v_vox v join a using (uid)), {erosion_sql('sv', 's', EROSION_STEPS_3D, 'd3', True)}, f as (select uid, x, y, avg(d) d from d3 group by 1, 2, 3),
    n as (select uid, x, y, region, d/greatest(max(d*region) over (partition by uid), 1e-3) depth from f join rg0 using (uid, x, y)) select uid, x, y, {r('depth')} depth, {r('depth*region')} roi from n""",
    ("v_vox", "v_masks"),
)
def depth_map_3d(spark, sf):
    """Erosion depth of the volume, averaged along S-I and divided by its maximum in the region; `roi` keeps the region alone.

    The region is the projected mask, or the fixed window where that has too few pixels.
    """
    pk = vol.peak_mean_maps(v_boxes(spark, sf), DIMS).select("uid", "x", "y", "peak")
    reg = v_masks(spark, sf).select("uid", "x", "y").distinct().withColumn("region", F.lit(1))
    at = pk.join(reg, ["uid", "x", "y"], "left").withColumn("region", F.coalesce("region", F.lit(0)))
    at = cut(mp.anchored(at, "peak", "region", WIN_3D, least=LEAST_3D).select("uid", "x", "y", "region", "anchor"))
    b = v_boxes(spark, sf).select("uid", "data").join(at.groupBy("uid").agg(F.max("anchor").alias("a")), "uid")
    v = vol.voxels(b.repartition("uid"), DIMS, ("a",)).withColumn("s", mp.soft_above("v", F.lit(0.5) * F.col("a")))
    d = on_grids(v, dict(zip("xyz", DIMS, strict=True)), "s", lambda g: eroded(g, EROSION_STEPS_3D), "depth").groupBy("uid", "x", "y").agg(F.avg("depth").alias("d")).join(at, ["uid", "x", "y"])
    d = d.withColumn("depth", mp.over_region_max("d"))
    return d.select("uid", "x", "y", r6("depth").alias("depth"), r6(F.col("depth") * F.col("region")).alias("roi"))


K = 3.0
_SI = f"""zz as (select uid, x, y, v, (z + 1 - 2.5::double)/{K}::double zc from v_vox), z1 as (select uid, x, y, sum(v*zc)/4/greatest(sum(v)/4, 1e-4) zb from zz group by 1, 2, 3),
    w1 as (select zz.*, v*{sig('(0.5::double - abs(zc - zb))*12')} w from zz join z1 using (uid, x, y)), z2 as (select uid, x, y, sum(w*zc)/4/greatest(sum(w)/4, 1e-4) zb2 from w1 group by 1, 2, 3),
    si as (select w1.uid, w1.x, w1.y, greatest(0, sum(v*pow(zc - zb, 2))/4/greatest(sum(v)/4, 1e-4)) m2, greatest(0, sum(w*pow(zc - zb2, 2))/4/greatest(sum(w)/4, 1e-4)) m2w, avg({sig('(v/greatest(peak, 1e-3) - 0.5)*12')}) ext, max(peak) peak
      from w1 join z1 using (uid, x, y) join z2 using (uid, x, y) join pk using (uid, x, y) group by 1, 2, 3)"""


def through_plane(p):
    """Adds m2, its windowed form m2w and the soft extent of each profile; profiles are one axis long."""
    z = lambda i, n: (i + F.lit(1.0) - (n + 1) / F.lit(2.0)) / F.lit(K)
    p = p.withColumn("zs", F.transform("prof", lambda v, i: F.struct(v.alias("w"), z(i, F.size("prof")).alias("z"))))
    n = F.size("prof")

    def centre(zs):
        s = F.aggregate(zs, F.lit(0.0), lambda a, t: a + t["w"]) / n
        m = F.aggregate(zs, F.lit(0.0), lambda a, t: a + t["w"] * t["z"]) / n
        return m / F.greatest(s, F.lit(1e-4))

    def second(zs, c):
        s = F.aggregate(zs, F.lit(0.0), lambda a, t: a + t["w"]) / n
        m = F.aggregate(zs, F.lit(0.0), lambda a, t: a + t["w"] * (t["z"] - c) * (t["z"] - c)) / n
        return F.greatest(F.lit(0.0), m / F.greatest(s, F.lit(1e-4)))

    p = p.withColumn("m2", let(centre(F.col("zs")), lambda c: second(F.col("zs"), c)))
    cut_ = let(centre(F.col("zs")), lambda c: F.transform("zs", lambda t: F.struct((t["w"] * sigmoid((F.lit(0.5) - F.abs(t["z"] - c)) * F.lit(12.0))).alias("w"), t["z"].alias("z"))))
    p = p.withColumn("m2w", let(cut_, lambda zs: let(centre(zs), lambda c: second(zs, c))))
    ext = let(F.greatest(F.col("peak"), F.lit(1e-3)), lambda m: F.aggregate("prof", F.lit(0.0), lambda a, v: a + sigmoid((v / m - F.lit(0.5)) * F.lit(12.0)))) / n
    return p.withColumn("ext", ext)


@query(
    "through_plane_stats",
    f"with {_PEAK}, {_SI}, a as (select uid, greatest(max(peak), 1e-3) a from pk group by 1) select uid, x, y, {r('m2')} m2, {r('m2w')} m2w, {r('ext')} extent, {r(sig('(peak/a - 0.3)*12'))} gate from si join a using (uid)",
    ("v_vox",),
)
def through_plane_stats(spark, sf):
    p = through_plane(vol.peak_mean_maps(v_boxes(spark, sf), DIMS))
    a = F.greatest(F.max("peak").over(mp.scan()), F.lit(1e-3))
    return p.select("uid", "x", "y", r6("m2").alias("m2"), r6("m2w").alias("m2w"), r6("ext").alias("extent"), r6(sigmoid((F.col("peak") / a - F.lit(0.3)) * F.lit(12.0))).alias("gate"))


@query(
    "flatness_map",
    f"""with {_PEAK}, {_SI}, {moments_sql('pk', 'peak')}, t as (select si.*, sqrt(greatest(0, (u20 + u02)*0.5)) sxy, sqrt(m2w) sz from si join an using (uid, x, y))
    select uid, x, y, {r('(sxy - sz)/(sxy + sz + 1e-6)*peak/greatest(max(peak) over (partition by uid), 1e-3)')} flat from t""",
    ("v_vox",),
)
def flatness_map(spark, sf):
    """In-plane against through-plane spread, weighted by relative uptake."""
    p = through_plane(vol.peak_mean_maps(v_boxes(spark, sf), DIMS)).select("uid", "x", "y", "peak", "m2w")
    t = mp.local_moments(by_scan(p), "peak", 3)
    sxy, sz = F.sqrt(F.greatest(F.lit(0.0), (F.col("u20") + F.col("u02")) * 0.5)), F.sqrt("m2w")
    rel = F.col("peak") / F.greatest(F.max("peak").over(mp.scan()), F.lit(1e-3))
    return t.select("uid", "x", "y", r6((sxy - sz) / (sxy + sz + F.lit(1e-6)) * rel).alias("flat"))


@query(
    "lateral_stats",
    f"""with h as (select uid, y, z, x, case when x < 2 then v else 0 end v from v_vox), m as (select uid, y, z, max(v) m from h group by 1, 2, 3),
    w as (select h.*, case when v > 0 then pow(v/greatest(m, 1e-3), 4) else 0 end w from h join m using (uid, y, z)), s as (select uid, y, z, greatest(sum(w), 1e-6) sw, sum(w*x)/greatest(sum(w), 1e-6) c, count(*) filter (where v > 0) n from w group by 1, 2, 3),
    sd as (select uid, sign(sum(x) filter (where v > 0)/greatest(count(*) filter (where v > 0), 1) - 1.5) side from h group by 1)
    select w.uid, w.y, w.z, {r(f'case when max(n) > 0 then max(side)*(max(c) - 1.5)/{K} else 0 end')} lat, {r(f'case when max(n) > 0 then sqrt(greatest(0, sum(w*pow(x - c, 2))/max(sw)))/{K} else 0 end')} spread from w join s using (uid, y, z) join sd using (uid) group by 1, 2, 3""",
    ("v_vox",),
)
def lateral_stats(spark, sf):
    """Signed lateral centroid and spread of one hemisphere along the left-right axis."""
    b = v_boxes(spark, sf).withColumn("data", F.transform("data", lambda v, i: F.when(i < 32, v).otherwise(F.lit(0.0))))
    pos = F.transform("data", lambda v, i: F.when(v > 0, F.floor(i / 16)))
    n = F.size(F.filter(pos, lambda p: p.isNotNull()))
    total = F.aggregate(pos, F.lit(0.0), lambda a, p: a + F.coalesce(p.cast("double"), F.lit(0.0)))
    b = b.withColumn("side", F.signum(total / F.greatest(n, F.lit(1)) - F.lit(1.5)))
    p = vol.profiles(b, DIMS, ("side",), axis=0)
    w = let(F.greatest(F.array_max("prof"), F.lit(1e-3)), lambda m: F.transform("prof", lambda v: F.when(v > 0, F.pow(v / m, 4)).otherwise(F.lit(0.0))))
    p = p.withColumn("ws", F.transform(w, lambda a, i: F.struct(a.alias("w"), i.alias("i"))))
    tot = F.greatest(F.aggregate("ws", F.lit(0.0), lambda a, t: a + t["w"]), F.lit(1e-6))
    p = p.withColumn("tot", tot).withColumn("c", F.aggregate("ws", F.lit(0.0), lambda a, t: a + t["w"] * t["i"]) / F.col("tot"))
    var = let(F.col("c"), lambda c: F.aggregate("ws", F.lit(0.0), lambda a, t: a + t["w"] * (t["i"] - c) * (t["i"] - c))) / F.col("tot")
    has = F.array_max("prof") > 0
    return p.select("uid", "y", "z", r6(F.when(has, F.col("side") * (F.col("c") - 1.5) / K).otherwise(F.lit(0.0))).alias("lat"), r6(F.when(has, F.sqrt(F.greatest(F.lit(0.0), var)) / K).otherwise(F.lit(0.0))).alias("spread"))


@query("slab_views", f"select uid, case when x < 2 then 'left' else 'right' end slab, z + 1 as row, y as col, {r('max(v)')} mip, {r('avg(v)')} mean from v_vox group by 1, 2, 3, 4", ("v_vox",))
def slab_views(spark, sf):
    """Per-hemisphere projections over left-right, transposed so A-P runs along columns and padded centrally.

    Padding rows are implicit; the first stored row is the pad.
    """
    pad = (6 - DIMS[2]) // 2
    slab = F.when(F.col("x") < 2, "left").otherwise("right").alias("slab")
    return v_vox(spark, sf).groupBy("uid", slab, (F.col("z") + pad).alias("row"), F.col("y").alias("col")).agg(r6(F.max("v")).alias("mip"), r6(F.avg("v")).alias("mean"))


@query(
    "roi_gated_map",
    f"""with {_DEPTH}, rv as (select uid, x, y, region::double v from rg), {smooth_sql('rv', 's', AX2, W5)}, g as (select rg.uid, rg.x, rg.y, rg.region, rg.v * greatest(0, least(1, s.v)) g, dp.depth * greatest(0, least(1, s.v)) h from rg join s using (uid, x, y) join dp using (uid, x, y))
    select uid, x, y, {r('g/greatest(max(g*region) over (partition by uid), 1e-3)')} gated, {r('h/greatest(max(h*region) over (partition by uid), 1e-3)')} depth from g""",
    ("v_img",),
)
def roi_gated_map(spark, sf):
    """The image, and its depth map, kept inside the soft-edged region and put back on their maximum there."""
    t = mp.depth_map(_anchored(spark, sf), "v", F.lit(0.5) * F.col("anchor"), EROSION_STEPS, IMG)
    t = smooth(t.withColumn("soft", F.col("region").cast("double")), ["x", "y"], "soft", SIGMA)
    soft = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("soft")))
    t = t.withColumns({"g": F.col("v") * soft, "h": F.col("depth") * soft})
    return t.select("uid", "x", "y", r6(mp.over_region_max("g")).alias("gated"), r6(mp.over_region_max("h")).alias("depth"))


@query(
    "contour_rezero",
    f"""with lv as (select uid, greatest(0.5, 4.09::double*avg(v) + 1.259::double) tau from v_vox group by 1), a as (select v.uid, max(case when m.uid is not null then v.v else 0 end) a from (select uid, x, y, max(v) v from v_vox group by 1, 2, 3) v left join (select distinct uid, x, y from v_masks) m using (uid, x, y) group by 1),
    s as (select v.uid, x, y, greatest(0, v - 0.3::double*greatest(a, 1e-3)) v, tau from v_vox v join a using (uid) join lv using (uid)), m as (select uid, x, y, max(v) m from s group by 1, 2, 3)
    select uid, x, y, {r('max(m) + (ln(sum(exp(tau*(v - m)))) - ln(4.0::double))/max(tau)')} peak, {r('avg(v)')} mean from s join m using (uid, x, y) group by 1, 2, 3""",
    ("v_vox", "v_masks"),
)
def contour_rezero(spark, sf):
    """Subtract a share of the in-region maximum; tau still comes from the original mean."""
    b = vol.scan_levels(v_boxes(spark, sf)).select("uid", "data", "tau")
    reg = v_masks(spark, sf).groupBy("uid").agg(F.collect_set(F.struct("x", "y")).alias("px"))
    tops = F.transform("px", lambda p: F.array_max(F.slice("data", (p["x"] * 4 + p["y"]) * 4 + 1, 4)))
    b = b.join(reg, "uid", "left").withColumn("a", F.greatest(F.coalesce(F.array_max(tops), F.lit(0.0)), F.lit(1e-3)))
    p = vol.profiles(b, DIMS, ("tau", "a")).withColumn("prof", F.transform("prof", lambda v: F.greatest(F.lit(0.0), v - F.lit(0.3) * F.col("a"))))
    return p.select("uid", "x", "y", r6(vol.soft_peak("prof", "tau")).alias("peak"), r6(mean_of("prof")).alias("mean"))


@query("box_max_norm", f"with {_PEAK} select uid, x, y, {r('peak/greatest(max(case when x between 1 and 2 and y between 1 and 2 then peak end) over (partition by uid), 1e-3)')} peak, {r('mean/greatest(max(case when x between 1 and 2 and y between 1 and 2 then peak end) over (partition by uid), 1e-3)')} mean from pk", ("v_vox",))
def box_max_norm(spark, sf):
    m = vol.peak_mean_maps(v_boxes(spark, sf), DIMS)
    top = F.greatest(F.max(F.when(mp.window_flag((2, 2, 1)), F.col("peak"))).over(mp.scan()), F.lit(1e-3))
    return m.select("uid", "x", "y", r6(F.col("peak") / top).alias("peak"), r6(F.col("mean") / top).alias("mean"))


@query("mirror_maps", f"with {_PEAK} select a.uid, a.x, a.y, {r('(a.peak + b.peak)/2')} even, {r('(a.peak - b.peak)/2')} odd from pk a join pk b on a.uid = b.uid and a.y = b.y and b.x = 3 - a.x", ("v_vox",))
def mirror_maps(spark, sf):
    """Symmetric and antisymmetric parts; the map of the mirrored volume is the mirrored map."""
    m = vol.peak_mean_maps(v_boxes(spark, sf), DIMS).select("uid", "x", "y", "peak")
    f = m.select("uid", (F.lit(DIMS[0] - 1) - F.col("x")).alias("x"), "y", F.col("peak").alias("other"))
    return m.join(f, ["uid", "x", "y"]).select("uid", "x", "y", r6((F.col("peak") + F.col("other")) / 2).alias("even"), r6((F.col("peak") - F.col("other")) / 2).alias("odd"))


@query("product_channel", f"with {_PEAK} select uid, x, y, {r('peak*mean')} product from pk", ("v_vox",))
def product_channel(spark, sf):
    return vol.peak_mean_maps(v_boxes(spark, sf), DIMS).select("uid", "x", "y", r6(F.col("peak") * F.col("mean")).alias("product"))


def _axis_sql(axis: str, a: str, b: str) -> str:
    return f"select '{axis}' axis, v.uid, v.{a} a, v.{b} b, {r('max(m) + (ln(sum(exp(tau*(v - m)))) - ln(4.0::double))/max(tau)')} peak, {r('avg(v)')} mean from v_vox v join (select uid, {a}, {b}, max(v) m from v_vox group by 1, 2, 3) m using (uid, {a}, {b}) join lv using (uid) group by 1, 2, 3, 4"


@query("axis_views", f"with lv as (select uid, greatest(0.5, 4.09::double*avg(v) + 1.259::double) tau from v_vox group by 1) {_axis_sql('x', 'y', 'z')} union all {_axis_sql('y', 'x', 'z')} union all {_axis_sql('z', 'x', 'y')}", ("v_vox",))
def axis_views(spark, sf):
    """The same maps along each axis; tau is shared because the mean of the volume is."""
    out = None
    for k, (axis, a, b) in enumerate((("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))):
        m = vol.peak_mean_maps(v_boxes(spark, sf), DIMS, axis=k).select(F.lit(axis).alias("axis"), "uid", F.col(a).alias("a"), F.col(b).alias("b"), r6("peak").alias("peak"), r6("mean").alias("mean"))
        out = m if out is None else out.unionByName(m)
    return out


_HEMI = (8, 4, 2)
_SLAB = "with s as (select *, i // 8 hx, (i // 2) % 4 hy, i % 2 hz from v_vox), t as (select uid, k slab, hx, hy, hz, v from s join (values (0, 1, 4), (1, 4, 7)) b(k, lo, hi) on hx >= lo and hx < hi)"


@query(
    "hemisphere_views",
    f"""{_SLAB}, lv as (select uid, slab, greatest(0.5, 4.09::double*avg(v) + 1.259::double) tau from t group by 1, 2), m as (select uid, slab, hy, hz, max(v) m from t group by 1, 2, 3, 4),
    p as (select uid, slab, cast(hz + 3 as int) "row", hy y, max(m) + (ln(sum(exp(tau*(v - m)))) - ln(3.0::double))/max(tau) peak, avg(v) mean from t join m using (uid, slab, hy, hz) join lv using (uid, slab) group by 1, 2, hz, 4),
    f as (select uid, slab, cast(r.range as int) "row", cast(y.range as int) y from (select distinct uid, slab from t) cross join range(8) r cross join range(4) y)
    select uid, slab, "row", y, {r('coalesce(peak, 0)')} peak, {r('coalesce(mean, 0)')} mean from f left join p using (uid, slab, "row", y)""",
    ("v_vox",),
)
def hemisphere_views(spark, sf):
    """Sagittal maps of both hemispheres, on the axial map's frame; the 64 values are read as a grid of 8 x 4 x 2."""
    t = vol.hemisphere_views(v_boxes(spark, sf), _HEMI, ((1, 4), (4, 7)))
    return t.select("uid", "slab", "row", "y", r6("peak").alias("peak"), r6("mean").alias("mean"))


@query("map_broadcast", f"with {_PEAK} select uid, x, y, z, {r('peak')} ch2, {r('mean')} ch3, {r('mu')} level, {r('peak')} c0, {r('mean')} c1, {r('mu')} c2, {r('peak*mean')} c3, {r('peak')} w0, {r('mean')} w1, {r('peak*mean')} w2, {r('mu')} w3 from pk cross join (values (1), (2)) k(z)", ("v_vox",))
def map_broadcast(spark, sf):
    """Copy two maps and a per-scan constant over a slice range; and a stack of four channels, before and after two of them are swapped for other maps."""
    m = vol.peak_mean_maps(v_boxes(spark, sf), DIMS).withColumn("prod", F.col("peak") * F.col("mean"))
    m = vol.channels(vol.channels(m, ["peak", "mean", "mu", "prod"]), ["peak", "mean", "mu", "prod"], {2: "prod", 3: "mu"}, "w")
    stack = [r6(f"{n}{k}").alias(f"{n}{k}") for n in "cw" for k in range(4)]
    return m.select("uid", "x", "y", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("z"), r6("peak").alias("ch2"), r6("mean").alias("ch3"), r6("mu").alias("level"), *stack)


@query("slice_pivot", f"select uid, x, y, {', '.join(r(f'max(case when z = {k} then v end)') + f' z{k}' for k in range(4))} from v_vox group by 1, 2, 3", ("v_vox",))
def slice_pivot(spark, sf):
    p = vol.profiles(v_boxes(spark, sf), DIMS)
    return p.select("uid", "x", "y", *[r6(F.element_at("prof", k + 1)).alias(f"z{k}") for k in range(DIMS[2])])


@query(
    "mixed_maps",
    f"""with {_ANCHOR}, {moments_sql('v_img')}, sf as (select *, {sig('(v - 0.5::double*anchor)/greatest(0.5::double*anchor, 1e-3)*12')} soft from ac), {erosion_sql('sf', 'soft', EROSION_STEPS, 'dd')}
    select sf.uid, sf.x, sf.y, {r('sf.v')} top, {r(_ANI + '*sf.v/greatest(max(sf.v) over (partition by sf.uid), 1e-3)')} aniso, {r('d/greatest(max(d*region) over (partition by sf.uid), 1e-3)')} depth from sf join an using (uid, x, y) join dd using (uid, x, y)""",
    ("v_img",),
)
def mixed_maps(spark, sf):
    """Maximum, anisotropy and depth side by side, computed on one partitioning by scan."""
    t = mp.local_moments(mp.depth_map(_anchored(spark, sf), "v", F.lit(0.5) * F.col("anchor"), EROSION_STEPS, IMG), "v", 3)
    rel = F.col("v") / F.greatest(F.max("v").over(mp.scan()), F.lit(1e-3))
    return t.select("uid", "x", "y", r6("v").alias("top"), r6(mp.anisotropy() * rel).alias("aniso"), r6("depth").alias("depth"))


def _morph(src: str, out: str, fn: str, k: int) -> str:
    return f"{out} as (select a.uid, a.x, a.y, a.z, {fn}(b.v) v from {src} a join {src} b on a.uid = b.uid and abs(a.x-b.x) <= {k} and abs(a.y-b.y) <= {k} and abs(a.z-b.z) <= {k} group by 1, 2, 3, 4)"


@query(
    "blob_removal",
    f"""with recursive sk as (select uid, v, row_number() over (partition by uid order by v) - 1 rk, count(*) over (partition by uid) n from v_vox), q as (select uid, max(v) q from sk where rk = cast(floor(0.999::double*(n - 1)) as int) group by 1),
    hd as (select v.uid, x, y, z, case when v > 0.6::double*q then 1 else 0 end v from v_vox v join q using (uid)), {_morph('hd', 'hd1', 'max', 1)}, {_morph('hd1', 'hd2', 'min', 1)}, {_morph('hd2', 'hd3', 'min', 1)},
    sh as (select a.uid, a.x, a.y, a.z, a.v - b.v v from hd2 a join hd3 b using (uid, x, y, z)), {smooth_sql('v_vox', 'sv', AX3, W5)}, {_PEAK}, pv as (select uid, x, y, peak v from pk), {smooth_sql('pv', 'ps0', {'x': 4, 'y': 4}, W5)},
    ps as (select uid, x, y, round(v, 9) v from ps0), {otsu_sql('ps', 'o', 'true')}, mk as (select s.uid, x, y, z, case when round(s.v, 9) > round(1.05::double*greatest(lvl, 1e-3), 9) then 1 else 0 end v from sv s join o using (uid)),
    rc(uid, x, y, z) as (select mk.uid, mk.x, mk.y, mk.z from mk join sh using (uid, x, y, z) where mk.v = 1 and sh.v = 1 union select m.uid, m.x, m.y, m.z from rc r join mk m on m.uid = r.uid and m.v = 1 and abs(m.x-r.x) <= 1 and abs(m.y-r.y) <= 1 and abs(m.z-r.z) <= 1),
    fin as (select distinct m.uid, m.x, m.y, m.z from rc r join mk m on m.uid = r.uid and abs(m.x-r.x) <= 1 and abs(m.y-r.y) <= 1 and abs(m.z-r.z) <= 1)
    select v.uid, v.x, v.y, v.z, {r('case when f.uid is null then v.v else least(v.v, 1.0) end')} v, f.uid is not null removed from v_vox v left join fin f on v.uid = f.uid and v.x = f.x and v.y = f.y and v.z = f.z""",
    ("v_vox",),
)
def blob_removal(spark, sf):
    """Clamp bright blobs that touch the head shell: shell seeds grown inside the bright mask, then dilated. The head is cut at a share of the quantile of all voxels."""
    ax = ["x", "y", "z"]
    b = v_boxes(spark, sf)
    pk = vol.peak_mean_maps(b, DIMS).select("uid", "x", "y", F.col("peak").alias("v"))
    ps = smooth(by_scan(pk), ["x", "y"], "v", SIGMA).withColumn("v", F.round("v", 9))
    lvl = mp.otsu_levels(ps, "v", None).withColumn("level", F.greatest("level", F.lit(1e-3)))
    top = b.select("uid", sorted_nearest(F.sort_array("data"), 0.999).alias("q"))
    t = scan_voxels(spark, sf).join(top, "uid").join(lvl, "uid").withColumn("hd", (F.col("v") > F.lit(0.6) * F.col("q")).cast("int"))
    t = frame(frame(t, ax, "hd", F.max, 1), ax, "hd", F.min, 1)
    t = frame(t.withColumn("core", F.col("hd")), ax, "core", F.min, 1)
    t = smooth(t.withColumn("sv", F.col("v")), ax, "sv", SIGMA)
    t = t.withColumn("mask", (F.round("sv", 9) > F.round(F.lit(1.05) * F.col("level"), 9)).cast("int"))
    t = t.withColumn("rec", F.least(F.col("hd") - F.col("core"), F.col("mask"))).select("uid", *ax, "v", "mask", "rec")
    grown = grow(t, "mask", ax, 40)
    g = frame(by_scan(grown, scan_parts(grown)), ax, "rec", F.max, 1)
    return g.select("uid", *ax, r6(F.when(F.col("rec") == 1, F.least(F.col("v"), F.lit(1.0))).otherwise(F.col("v"))).alias("v"), (F.col("rec") == 1).alias("removed"))


