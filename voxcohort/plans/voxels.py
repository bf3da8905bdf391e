"""Volumes and masks to scan scalars, crops and resampled grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import half_even, r6, sigmoid, sorted_nearest, sorted_quantile
from ..operators import volumes as vol
from ..operators.boxes import gather_box
from ..operators.components import components, fill_holes, largest
from ..operators.geometry import euler, inside_ellipsoids, moment_ellipsoids, pose_matrix, resample, rotated_cells
from ..operators.ranking import quantiles
from ..operators.stencil import frame, kernel, offsets_join, smooth, smooth_box
from ..session import cut
from .registry import query, r
from .sqltext import components_sql, sig, smooth_sql
from .views import DIMS, IMG, scan_voxels, table, v_affine, v_boxes, v_grid, v_img, v_masks, v_pose, v_vox

AX3 = {"x": 4, "y": 4, "z": 4}
AX2 = {"x": 8, "y": 8}
SIGMA = 0.8
W5 = kernel(SIGMA)


def boxes_long(df, carry=()):
    return vol.voxels(df, DIMS, carry)


@query(
    "brain_mean_normalise",
    f"""with q as (select uid, quantile_cont(v, 0.999) q from v_vox group by 1),
    f as (select uid, (case when count(*) filter (where v > 0.7::double*q) >= 3 then avg(v) filter (where v > 0.7::double*q) else avg(v) end) + 1e-6 ref from v_vox join q using (uid) group by 1)
    select uid, i, {r('greatest(0.0, least(12.0, v / ref))')} v from v_vox join f using (uid)""",
    ("v_vox",),
)
def brain_mean_normalise(spark, sf):
    b = v_boxes(spark, sf).select("uid", vol.brain_mean_normalise("data", f=0.7, least=3).alias("data"))
    return boxes_long(b).select("uid", "i", r6("v").alias("v"))


_REF = """(case when count(*) filter (where {v} > 0.7::double*{q}) >= 3 then avg({v}) filter (where {v} > 0.7::double*{q}) else avg({v}) end) + 1e-6"""


@query(
    "renormalise_to_source",
    f"""with t as (select uid, i, v, case when v > 1.5::double then v*0.8::double else v end m from v_vox),
    k as (select *, row_number() over (partition by uid order by v) - 1 rv, row_number() over (partition by uid order by m) - 1 rm from t),
    q as (select uid, max(case when rv = 62 then v end) qv, max(case when rm = 62 then m end) qm from k group by 1),
    f as (select uid, {_REF.format(v='v', q='qv')} fv, {_REF.format(v='m', q='qm')} fm from t join q using (uid) group by 1)
    select uid, i, {r('greatest(0.0, least(12.0, m / (fm/fv)))')} v from t join f using (uid)""",
    ("v_vox",),
)
def renormalise_to_source(spark, sf):
    b = v_boxes(spark, sf).withColumn("changed", F.transform("data", lambda v: F.when(v > 1.5, v * 0.8).otherwise(v)))
    b = b.select("uid", vol.renormalise("changed", "data", f=0.7, least=3).alias("data"))
    return boxes_long(b).select("uid", "i", r6("v").alias("v"))


@query(
    "quantile_family",
    f"""with k as (select uid, v, row_number() over (partition by uid order by v) - 1 rk, i from v_vox), s as (select uid, v, row_number() over (partition by uid order by v) - 1 rk, count(*) over (partition by uid) n from v_vox where i % 7 = 0)
    select uid, {r('(select quantile_cont(v, 0.9) from v_vox b where b.uid = k.uid)')} lin, {r('max(case when rk = cast(floor(0.9::double*63) as int) then v end)')} nearest,
    {r('(select max(s.v) from s where s.uid = k.uid and s.rk = cast(floor(0.9::double*(s.n - 1)) as int))')} stride7, {r('(select quantile_cont(v, 0.9) from v_vox b where b.uid = k.uid and x % 2 = 0 and y % 2 = 0 and z % 2 = 0)')} stride2 from k group by 1""",
    ("v_vox",),
)
def quantile_family(spark, sf):
    b = v_boxes(spark, sf)
    on_grid = lambda i: (F.floor(i / 16) % 2 == 0) & (F.floor(i / 4) % 2 == 0) & (i % 2 == 0)
    s = b.select(
        "uid", F.sort_array("data").alias("s"), F.sort_array(F.filter("data", lambda v, i: i % 7 == 0)).alias("s7"), F.sort_array(F.filter("data", lambda v, i: on_grid(i))).alias("s2")
    )
    return s.select(
        "uid", r6(sorted_quantile("s", 0.9)).alias("lin"), r6(sorted_nearest("s", 0.9)).alias("nearest"), r6(sorted_nearest("s7", 0.9)).alias("stride7"), r6(sorted_quantile("s2", 0.9)).alias("stride2")
    )


_HEAD = f"""recursive q as (select uid, quantile_cont(v, 0.995) q from v_vox group by 1), hm as (select uid, x, y, z from v_vox join q using (uid) where v > 0.6::double*q),
    {components_sql('hm', 'h', AX3)}"""


def head_component(spark, sf):
    """Largest face-connected part above a share of the scan's 99.5th percentile."""
    b = v_boxes(spark, sf).withColumn("cutoff", F.lit(0.6) * sorted_quantile(F.sort_array("data"), 0.995))
    m = vol.voxels(b, DIMS, ("cutoff",)).where("v > cutoff").select("uid", "x", "y", "z")
    return largest(components(m, AX3))


@query("largest_component", f"with {_HEAD} select uid, x, y, z, cast(label as bigint) label from h_big", ("v_vox",))
def largest_component(spark, sf):
    return head_component(spark, sf).select("uid", "x", "y", "z", "label")


@query(
    "largest_component_2d",
    f"with recursive m as (select uid, x, y from v_img where v > 1.2::double), {components_sql('m', 'h', AX2)} select uid, x, y, cast(label as bigint) label from h_big",
    ("v_img",),
)
def largest_component_2d(spark, sf):
    return largest(components(v_img(spark, sf).where("v > 1.2D"), AX2)).select("uid", "x", "y", "label")


@query(
    "bbox_margin",
    f"with {_HEAD} select uid, {', '.join(f'greatest(min({a}) - 1, 0) lo_{a}, least(max({a}) + 1 + 1, 4) hi_{a}' for a in 'xyz')} from h_big group by 1",
    ("v_vox",),
)
def bbox_margin(spark, sf):
    """Half-open bounding box of the component with a margin, clipped to the volume."""
    h = head_component(spark, sf)
    return h.groupBy("uid").agg(
        *[F.greatest(F.min(a) - 1, F.lit(0)).alias(f"lo_{a}") for a in "xyz"], *[F.least(F.max(a) + 2, F.lit(AX3[a])).alias(f"hi_{a}") for a in "xyz"]
    )


_CENTRE = "hc as (select uid, " + ", ".join(f"case when count(*) >= 25 then avg({a}) else 2.0::double end c{a}" for a in "xyz") + " from h_big group by 1)"


def head_centre_of(comp):
    n = F.count(F.lit(1))
    return comp.groupBy("uid").agg(*[F.when(n >= 25, F.avg(a)).otherwise(F.lit(2.0)).alias(f"c{a}") for a in "xyz"])


@query("head_centre", f"with {_HEAD}, {_CENTRE} select uid, {r('cx')} cx, {r('cy')} cy, {r('cz')} cz from hc", ("v_vox",))
def head_centre(spark, sf):
    return head_centre_of(head_component(spark, sf)).select("uid", *[r6(f"c{a}").alias(f"c{a}") for a in "xyz"])


_SPAN = """sq as (select uid, quantile_cont(v, 0.999) q from v_vox where x % 2 = 0 and y % 2 = 0 and z % 2 = 0 group by 1),
    sp as (select uid, count(*) n, max(x) - min(x) + 1 sx, max(y) - min(y) + 1 sy, max(z) - min(z) + 1 sz from v_vox join sq using (uid) where v > 0.9::double*q group by 1)"""


def head_spans(spark, sf, least=3):
    on_grid = lambda i: (F.floor(i / 16) % 2 == 0) & (F.floor(i / 4) % 2 == 0) & (i % 2 == 0)
    b = v_boxes(spark, sf).withColumn("top", sorted_quantile(F.sort_array(F.filter("data", lambda v, i: on_grid(i))), 0.999))
    g = vol.voxels(b, DIMS, ("top",)).where(F.col("v") > F.lit(0.9) * F.col("top")).groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"), *[(F.max(a) - F.min(a) + 1).alias(f"s{a}") for a in "xyz"]
    )
    return g.select("uid", *[F.when(F.col("n") >= least, F.col(f"s{a}")).alias(f"s{a}") for a in "xyz"])


@query("head_span", f"with {_SPAN} select uid, {', '.join(f'case when n >= 3 then s{a} end s{a}' for a in 'xyz')} from sp", ("v_vox",))
def head_span(spark, sf):
    return head_spans(spark, sf)


_LOC = f"""{_HEAD}, st as (select uid, avg(x) cx, avg(y) cy, avg(z) cz, stddev_pop(x) + 1e-6 ex, stddev_pop(y) + 1e-6 ey, stddev_pop(z) + 1e-6 ez from h_big group by 1),
    {smooth_sql('v_vox', 'sm', AX3, W5, 'replicate')},
    w as (select s.uid, s.x, s.y, s.z, s.x*16 + s.y*4 + s.z i, v, pow((s.x - cx)/ex, 2) + pow((s.y - cy)/ey, 2) + pow((s.z - cz)/ez, 2) d2, cx, cy, cz, ex, ey, ez from sm s join st using (uid))"""


def _weighted(spark, sf):
    h = head_component(spark, sf)
    st = h.groupBy("uid").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"], *[(F.stddev_pop(a) + 1e-6).alias(f"e{a}") for a in "xyz"])
    b = v_boxes(spark, sf).select("uid", smooth_box("data", DIMS, SIGMA, "replicate").alias("data"))
    j = vol.voxels(b.join(st, "uid"), DIMS, tuple(f"{k}{a}" for k in "ce" for a in "xyz"))
    d2 = F.lit(0.0)
    for a in "xyz":
        d2 = d2 + F.pow((F.col(a) - F.col(f"c{a}")) / F.col(f"e{a}"), 2)
    return j.withColumn("d2", d2)


def _reject(far, cols):
    """Fall back to the head centre when the found point is further than 1.5 extents."""
    d = F.lit(0.0)
    for a in "xyz":
        d = d + F.pow((F.col(cols[a]) - F.col(f"c{a}")) / F.col(f"e{a}"), 2)
    return [r6(F.when(F.sqrt(d) > far, F.col(f"c{a}")).otherwise(F.col(cols[a]))).alias(f"p{a}") for a in "xyz"]


_REJ = "case when sqrt(pow((qx-cx)/ex,2) + pow((qy-cy)/ey,2) + pow((qz-cz)/ez,2)) > 1.5 then c{a} else q{a} end"


@query(
    "ellipse_localiser_peak",
    f"""with {_LOC}, k as (select *, row_number() over (partition by uid order by round(v*exp(-d2), 9) desc, i) rn, x::double qx, y::double qy, z::double qz from w)
    select uid, {', '.join(r(_REJ.format(a=a)) + ' p' + a for a in 'xyz')} from k where rn = 1""",
    ("v_vox",),
)
def ellipse_localiser_peak(spark, sf):
    w = _weighted(spark, sf).withColumn("w", F.round(F.col("v") * F.exp(-F.col("d2")), 9))
    keep = [f"{p}{a}" for p in "ce" for a in "xyz"]
    g = w.groupBy("uid").agg(F.max(F.struct("w", (-F.col("i")).alias("k"), "x", "y", "z")).alias("b"), *[F.first(c).alias(c) for c in keep])
    g = g.select("uid", *[F.col(f"b.{a}").cast("double").alias(f"q{a}") for a in "xyz"], *keep)
    return g.select("uid", *_reject(1.5, {a: f"q{a}" for a in "xyz"}))


@query(
    "ellipse_localiser_com",
    f"""with {_LOC}, k as (select *, v*v*exp(-d2) wt from w), m as (select *, round(wt, 9) >= round(0.35::double*max(wt) over (partition by uid), 9) core from k),
    g as (select uid, count(*) filter (where core) n, {', '.join(f'avg({a}) filter (where core) mean_{a}, sum({a}*wt) filter (where core) / sum(wt) filter (where core) w{a}, max(c{a}) c{a}, max(e{a}) e{a}' for a in 'xyz')} from m group by 1),
    f as (select *, {', '.join(f'case when n < 10 then c{a} else mean_{a} end qx'.replace('qx', 'q' + a) for a in 'xyz')} from g)
    select uid, {', '.join(r(_REJ.format(a=a)) + ' p' + a for a in 'xyz')}, {', '.join(r(f'case when n < 10 then c{a} else w{a} end') + ' w' + a for a in 'xyz')} from f""",
    ("v_vox",),
)
def ellipse_localiser_com(spark, sf):
    w = cut(_weighted(spark, sf).withColumn("wt", F.col("v") * F.col("v") * F.exp(-F.col("d2"))))
    top = w.groupBy("uid").agg(F.max("wt").alias("top"))
    core = w.join(top, "uid").withColumn("core", F.round("wt", 9) >= F.round(F.lit(0.35) * F.col("top"), 9))
    keep = [f"{p}{a}" for p in "ce" for a in "xyz"]
    g = core.groupBy("uid").agg(
        F.count_if("core").alias("n"), *[F.first(c).alias(c) for c in keep],
        *[F.avg(F.when(F.col("core"), F.col(a))).alias(f"b{a}") for a in "xyz"],
        *[(F.sum(F.when(F.col("core"), F.col(a) * F.col("wt"))) / F.sum(F.when(F.col("core"), F.col("wt")))).alias(f"w{a}") for a in "xyz"],
    )
    few = F.col("n") < 10
    g = g.select("*", *[F.when(few, F.col(f"c{a}")).otherwise(F.col(f"b{a}")).alias(f"q{a}") for a in "xyz"])
    return g.select("uid", *_reject(1.5, {a: f"q{a}" for a in "xyz"}), *[r6(F.when(few, F.col(f"c{a}")).otherwise(F.col(f"w{a}"))).alias(f"w{a}") for a in "xyz"])


@query(
    "lobe_yaw",
    f"""with {_HEAD}, {_CENTRE}, sl as (select v.uid, x, y, z, v from v_vox v join hc using (uid) where abs(z - round_even(cz, 0)) <= 1),
    {smooth_sql('sl', 'sm', {'x': 4, 'y': 4}, W5, 'replicate', extra='z')},
    f as (select uid, x, y, max(v) mx, sum(v) sm from sm group by 1, 2, 3), u as (select uid, x, y, 'max' how, mx s from f union all select uid, x, y, 'sum', sm from f),
    m as (select u.*, cx, s > 0.8::double*max(s) over (partition by uid, how) hit from u join hc using (uid)),
    g as (select uid, how, count(*) filter (where hit) n, sum(s) filter (where hit and x < cx) sl, sum(s) filter (where hit and x >= cx) sr,
      sum(s*x) filter (where hit and x < cx)/sum(s) filter (where hit and x < cx) lx, sum(s*y) filter (where hit and x < cx)/sum(s) filter (where hit and x < cx) ly,
      sum(s*x) filter (where hit and x >= cx)/sum(s) filter (where hit and x >= cx) rx, sum(s*y) filter (where hit and x >= cx)/sum(s) filter (where hit and x >= cx) ry from m group by 1, 2),
    y as (select uid, how, case when n < 3 or sl is null or sr is null then 0 else greatest(-30, least(30, degrees(atan2(ry - ly, rx - lx)))) end yaw, case when n < 3 or sl is null or sr is null then 0 else least(sl, sr)/greatest(sl, sr) end bal from g),
    p as (select uid, max(case when how = 'max' then yaw end) ym, max(case when how = 'max' then bal end) bm, max(case when how = 'sum' then yaw end) ys, max(case when how = 'sum' then bal end) bs from y group by 1)
    select uid, {r('case when bm >= 0.3 then ym else 0 end')} yaw_max, {r('case when bs >= 0.3 then ys else 0 end')} yaw_sum,
    {r('greatest(-30, least(30, case when bm < 0.3 and bs < 0.3 then 0 when bs < 0.3 then ym when bm < 0.3 then ys when abs(ym - ys) <= 8 then (bm*ym + bs*ys)/(bm + bs) when round(bs, 9) >= round(bm, 9) then 0.5*ys else 0.5*ym end))')} yaw_mixed from p""",
    ("v_vox",),
)
def lobe_yaw(spark, sf):
    """Yaw of the line through the two bright lobes of a central slab: peak, sum and mixed projections."""
    c = head_centre_of(head_component(spark, sf)).select("uid", "cx", "cz")
    b = v_boxes(spark, sf).select("uid", smooth_box("data", DIMS, SIGMA, "replicate", only=(0, 1)).alias("data")).join(c, "uid")
    s = vol.voxels(b, DIMS, ("cx", "cz")).where(F.abs(F.col("z") - half_even("cz")) <= 1)
    f = s.groupBy("uid", "x", "y").agg(F.max("v").alias("max"), F.sum("v").alias("sum"), F.first("cx").alias("cx"))
    u = cut(f.unpivot(["uid", "x", "y", "cx"], ["max", "sum"], "how", "s"))
    top = u.groupBy("uid", "how").agg(F.max("s").alias("top"))
    m = u.join(top, ["uid", "how"]).where(F.col("s") > F.lit(0.8) * F.col("top"))
    left = F.col("x") < F.col("cx")
    sums = lambda side, t: F.sum(F.when(side, F.col("s") * t))
    g = m.groupBy("uid", "how").agg(
        F.count(F.lit(1)).alias("n"), sums(left, F.lit(1.0)).alias("sl"), sums(~left, F.lit(1.0)).alias("sr"),
        sums(left, F.col("x")).alias("lx"), sums(left, F.col("y")).alias("ly"), sums(~left, F.col("x")).alias("rx"), sums(~left, F.col("y")).alias("ry"),
    )
    bad = (F.col("n") < 3) | F.col("sl").isNull() | F.col("sr").isNull()
    ang = F.degrees(F.atan2(F.expr("ry/sr - ly/sl"), F.expr("rx/sr - lx/sl")))
    y = g.select(
        "uid", "how", F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), ang))).alias("yaw"),
        F.when(bad, F.lit(0.0)).otherwise(F.least("sl", "sr") / F.greatest("sl", "sr")).alias("bal"),
    )
    pick = lambda how, c: F.max(F.when(F.col("how") == how, F.col(c)))
    p = y.groupBy("uid").agg(pick("max", "yaw").alias("ym"), pick("max", "bal").alias("bm"), pick("sum", "yaw").alias("ys"), pick("sum", "bal").alias("bs"))
    vm, vs = F.col("bm") >= 0.3, F.col("bs") >= 0.3
    mixed = (
        F.when(~vm & ~vs, F.lit(0.0)).when(~vs, F.col("ym")).when(~vm, F.col("ys"))
        .when(F.abs(F.col("ym") - F.col("ys")) <= 8, F.expr("(bm*ym + bs*ys)/(bm + bs)"))
        .otherwise(F.when(F.round("bs", 9) >= F.round("bm", 9), F.col("ys")).otherwise(F.col("ym")) * 0.5)
    )
    return p.select(
        "uid", r6(F.when(vm, F.col("ym")).otherwise(F.lit(0.0))).alias("yaw_max"), r6(F.when(vs, F.col("ys")).otherwise(F.lit(0.0))).alias("yaw_sum"),
        r6(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), mixed))).alias("yaw_mixed"),
    )


_POSE_SQL = f"""with {_SPAN}, p as (select l.uid, l.cx lx, l.cy ly, l.cz lz, r.cx rx, r.cy + 0.2::double*(r.uid % 3) ry, r.cz - 0.1::double*(r.uid % 4) rz from v_pose l join v_pose r on l.uid = r.uid and l.side = 'L' and r.side = 'R'),
    d as (select p.*, rx - lx dx, ry - ly dy, rz - lz dz, sqrt(pow(rx-lx,2)+pow(ry-ly,2)+pow(rz-lz,2)) n, case when sp.n >= 3 then sx end sx, case when sp.n >= 3 then sy end sy, case when sp.n >= 3 then sz end sz from p left join sp using (uid)),
    u as (select *, dx/n ux, dy/n uy, dz/n uz, {', '.join(f'least(1.25, greatest(0.8, 4.0::double/s{a})) k{a}' for a in 'xyz')}, (lx+rx)/2 mx, (ly+ry)/2 my, (lz+rz)/2 mz, uid % 10 = 0 or sx is null bad from d),
    g as (select *, case when sqrt(uy*uy+uz*uz) < 1e-6 then 0 else (1-ux)/(uy*uy+uz*uz) end h from u)
    select uid, """ + ", ".join(
    r(f"case when bad then {1 if i == j else 0} else ({e})/k{'xyz'[j]} end") + f" a{i}{j}"
    for i, row in enumerate((("1-(uy*uy+uz*uz)*h", "-uy", "-uz"), ("uy", "1-uy*uy*h", "-uy*uz*h"), ("uz", "-uy*uz*h", "1-uz*uz*h")))
    for j, e in enumerate(row)
) + ", " + ", ".join(
    r(f"case when bad then 0 else m{'xyz'[i]} - 2*(" + " + ".join(f"({e})/k{'xyz'[j]}" for j, e in enumerate(row)) + ") end") + f" a{i}3"
    for i, row in enumerate((("1-(uy*uy+uz*uz)*h", "-uy", "-uz"), ("uy", "1-uy*uy*h", "-uy*uz*h"), ("uz", "-uy*uz*h", "1-uz*uz*h")))
) + " from g"


@query("pose_parameters", _POSE_SQL, ("v_vox", "v_pose"))
def pose_parameters(spark, sf):
    """Midpoint, axis rotation and clipped span scale as a 3x4 voxel map; every tenth scan lacks a span."""
    p = v_pose(spark, sf)
    side = lambda s: p.where(F.col("side") == s)
    left = side("L").select("uid", *[F.col(f"c{a}").alias(f"l{a}") for a in "xyz"])
    right = side("R").select("uid", F.col("cx").alias("rx"), (F.col("cy") + F.lit(0.2) * (F.col("uid") % 3)).alias("ry"), (F.col("cz") - F.lit(0.1) * (F.col("uid") % 4)).alias("rz"))
    spans = head_spans(spark, sf).where("uid % 10 <> 0")
    j = left.join(right, "uid").join(spans, "uid", "left")
    m = pose_matrix(j, (4.0, 4.0, 4.0), (2.0, 2.0, 2.0), least_gap=0.5)
    return m.select("uid", *[r6(c).alias(c) for c in m.columns if c != "uid"])


@query(
    "moment_ellipsoid",
    f"""with g as (select uid, side, count(*) n, avg(x) cx, avg(y) cy, avg(z) cz, covar_samp(x,x)+1e-3 a, covar_samp(x,y) b, covar_samp(x,z) c, covar_samp(y,y)+1e-3 d, covar_samp(y,z) e, covar_samp(z,z)+1e-3 f from v_masks group by 1, 2),
    h as (select *, 5*(a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c)) det from g)
    select uid, side, n, {', '.join(r(f'case when n >= 8 then c{a} end') + ' c' + a for a in 'xyz')}, {r('case when n >= 8 then (d*f-e*e)/det end')} mxx, {r('case when n >= 8 then (a*f-c*c)/det end')} myy, {r('case when n >= 8 then (a*d-b*b)/det end')} mzz, {r('case when n >= 8 then (c*e-b*f)/det end')} mxy from h""",
    ("v_masks",),
)
def moment_ellipsoid(spark, sf):
    m = moment_ellipsoids(v_masks(spark, sf), ["uid", "side"], least=8)
    return m.select("uid", "side", "n", *[r6(c).alias(c) for c in ("cx", "cy", "cz", "mxx", "myy", "mzz", "mxy")])


@query(
    "ellipsoid_geometry",
    f"""with p as (select *, 4.0::double/3*pi()*rx*ry*rz vol, greatest(rx,ry,rz)/greatest(least(rx,ry,rz), 1e-3) el, row_number() over (partition by uid order by cx) k from v_pose),
    g as (select uid, sum(vol) s, min(vol)/greatest(max(vol), 1e-3) ratio, max(case when k=1 then vol end) vl, max(case when k=2 then vol end) vh, max(case when k=1 then el end) el, max(case when k=2 then el end) eh, max(case when k=1 then cx end) x1, max(case when k=2 then cx end) x2, max(th) th from p group by 1)
    select uid, {r('s')} vol_sum, {r('ratio')} vol_ratio, {r('vl')} vol_lo, {r('vh')} vol_hi, {r('el')} elong_lo, {r('eh')} elong_hi, {r('abs(x1 - x2)')} separation, {r('greatest(0.05, least(0.95, ' + sig('0.2::double') + ' + 0.3*tanh(th)))')} alpha from g""",
    ("v_pose",),
)
def ellipsoid_geometry(spark, sf):
    import math

    rs = ("rx", "ry", "rz")
    vol_ = F.lit(4.0 / 3.0 * math.pi) * F.col("rx") * F.col("ry") * F.col("rz")
    s = F.struct("cx", vol_.alias("vol"), (F.greatest(*rs) / F.greatest(F.least(*rs), F.lit(1e-3))).alias("el"), "cy", "cz")
    g = v_pose(spark, sf).groupBy("uid").agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.max("th").alias("th"))
    sep = F.sqrt(sum(F.pow(F.col(f"lo.c{a}") - F.col(f"hi.c{a}"), 2) for a in "xyz"))
    v1, v2 = F.col("lo.vol"), F.col("hi.vol")
    alpha = F.greatest(F.lit(0.05), F.least(F.lit(0.95), sigmoid(F.lit(0.2)) + F.lit(0.3) * F.tanh("th")))
    return g.select(
        "uid", r6(v1 + v2).alias("vol_sum"), r6(F.least(v1, v2) / F.greatest(v1, v2, F.lit(1e-3))).alias("vol_ratio"), r6(v1).alias("vol_lo"), r6(v2).alias("vol_hi"),
        r6("lo.el").alias("elong_lo"), r6("hi.el").alias("elong_hi"), r6(sep).alias("separation"), r6(alpha).alias("alpha"),
    )


_DICE = """d as (select coalesce(g.uid, p.uid) uid, coalesce(g.side, p.side) side, count(g.uid) ng, count(p.uid) np, count(*) filter (where g.uid is not null and p.uid is not null) ni,
    avg(g.x) gx, avg(g.y) gy, avg(g.z) gz, avg(p.x) px, avg(p.y) py, avg(p.z) pz from v_masks g full join pm p on g.uid = p.uid and g.side = p.side and g.x = p.x and g.y = p.y and g.z = p.z group by 1, 2)"""


@query(
    "dice_centroid",
    f"""with pm as (select uid, case when x < 2 then 'L' else 'R' end side, x, y, z from v_vox where v > 1.2::double), {_DICE},
    e as (select 2.0::double*ni/greatest(ng + np, 1) dice, case when np > 3 then 2*sqrt(pow(gx-px,2)+pow(gy-py,2)+pow(gz-pz,2)) end err from d where ng >= 5)
    select {r('avg(dice)')} dice, {r('quantile_cont(round(err, 9), 0.5)')} err_median, {r('quantile_cont(round(err, 9), 0.9)')} err_p90, count(*) n from e""",
    ("v_masks", "v_vox"),
)
def dice_centroid(spark, sf):
    key = ["uid", "side", "x", "y", "z"]
    side = F.when(F.col("x") < 2, "L").otherwise("R").alias("side")
    gt = v_masks(spark, sf).withColumn("g", F.lit(1))
    pred = v_vox(spark, sf).where("v > 1.2D").select("uid", side, "x", "y", "z").withColumn("p", F.lit(1))
    j = gt.join(pred, key, "full_outer")
    at = lambda flag, a: F.avg(F.when(F.col(flag) == 1, F.col(a)))
    d = j.groupBy("uid", "side").agg(
        F.count("g").alias("ng"), F.count("p").alias("np"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("ni"),
        *[at("g", a).alias(f"g{a}") for a in "xyz"], *[at("p", a).alias(f"p{a}") for a in "xyz"],
    ).where("ng >= 5")
    err = F.lit(2.0) * F.sqrt(sum(F.pow(F.col(f"g{a}") - F.col(f"p{a}"), 2) for a in "xyz"))
    e = cut(d.select((F.lit(2.0) * F.col("ni") / F.greatest(F.col("ng") + F.col("np"), F.lit(1))).alias("dice"), F.round(F.when(F.col("np") > 3, err), 9).alias("err")))
    q = quantiles(e, [], "err", {"m": 0.5, "h": 0.9})
    return e.agg(F.avg("dice").alias("dice"), F.count(F.lit(1)).alias("n")).join(F.broadcast(q)).select(r6("dice").alias("dice"), r6("m").alias("err_median"), r6("h").alias("err_p90"), "n")


@query(
    "mask_mismatch",
    f"""with a as (select uid, x, y from v_img where v > 1.2::double), b as (select uid, x, y from v_img where v > 1.25::double), d as (select coalesce(a.uid, b.uid) uid, count(*) filter (where a.uid is null or b.uid is null) bad from a full join b on a.uid=b.uid and a.x=b.x and a.y=b.y group by 1)
    select {r('sum(bad)/64.0::double/(select count(distinct uid) from v_img)')} rate, count(*) filter (where bad/64.0::double > 0.02) n_above, {r('max(bad)/64.0::double')} worst from d""",
    ("v_img",),
)
def mask_mismatch(spark, sf):
    key = ["uid", "x", "y"]
    img = v_img(spark, sf)
    j = img.where("v > 1.2D").select(*key, F.lit(1).alias("a")).join(img.where("v > 1.25D").select(*key, F.lit(1).alias("b")), key, "full_outer")
    d = j.groupBy("uid").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("bad"))
    size = F.lit(float(IMG[0] * IMG[1]))
    n = img.groupBy("uid").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("scans"))
    t = d.agg(F.sum("bad").alias("s"), F.count_if(F.col("bad") / size > 0.02).alias("n_above"), F.max("bad").alias("w"))
    return t.join(F.broadcast(n)).select(r6(F.col("s") / size / F.col("scans")).alias("rate"), "n_above", r6(F.col("w") / size).alias("worst"))


@query(
    "mask_retention",
    f"""with k as (select uid, count(*) filter (where x between 1 and 3)/cast(count(*) as double) kept, count(*)/64.0::double occ from v_masks group by 1)
    select {r('quantile_cont(kept, 0.5)')} median_kept, {r('min(kept)')} min_kept, {r('avg(occ)')} occupancy, count(*) n from k""",
    ("v_masks",),
)
def mask_retention(spark, sf):
    n = F.count(F.lit(1))
    k = cut(v_masks(spark, sf).groupBy("uid").agg((F.count_if(F.col("x").between(1, 3)) / n).alias("kept"), (n / F.lit(64.0)).alias("occ")))
    q = quantiles(k, [], "kept", {"m": 0.5})
    return k.agg(F.min("kept").alias("lo"), F.avg("occ").alias("occ"), n.alias("n")).join(F.broadcast(q)).select(r6("m").alias("median_kept"), r6("lo").alias("min_kept"), r6("occ").alias("occupancy"), "n")


@query(
    "side_stats",
    f"""with s as (select m.uid, m.side, count(*) n, avg(v) mean, max(v) top from v_masks m join v_vox using (uid, x, y, z) group by 1, 2), g as (select uid, {', '.join(f"max(case when side = '{s}' then {c} end) {c}_{s.lower()}" for s in 'LR' for c in ('n', 'mean', 'top'))} from s group by 1)
    select uid, coalesce(n_l, 0) n_l, coalesce(n_r, 0) n_r, {', '.join(r(f'{c}_{s}') + f' {c}_{s}' for s in 'lr' for c in ('mean', 'top'))}, {r('abs(coalesce(n_l,0) - coalesce(n_r,0))/(coalesce(n_l,0) + coalesce(n_r,0) + 1e-9)')} asymmetry from g""",
    ("v_masks", "v_vox"),
)
def side_stats(spark, sf):
    m = v_masks(spark, sf).join(v_vox(spark, sf).select("uid", "x", "y", "z", "v"), ["uid", "x", "y", "z"])
    on = lambda s, c: F.when(F.col("side") == s, c)
    v = F.col("v")
    g = m.groupBy("uid").agg(*[x for s in "LR" for x in (F.count(on(s, v)).alias(f"n_{s.lower()}"), F.avg(on(s, v)).alias(f"mean_{s.lower()}"), F.max(on(s, v)).alias(f"top_{s.lower()}"))])
    asym = F.abs(F.col("n_l") - F.col("n_r")) / (F.col("n_l") + F.col("n_r") + F.lit(1e-9))
    return g.select("uid", "n_l", "n_r", *[r6(f"{c}_{s}").alias(f"{c}_{s}") for s in "lr" for c in ("mean", "top")], r6(asym).alias("asymmetry"))


# Striatal axes in the left-right / anterior-posterior plane.
_AXES = {"L": (0.562, 0.827), "R": (-0.538, 0.843)}
_RADIUS, _STEP = 0.9, 0.6


@query(
    "regional_ratio",
    f"""with occ as (select v.uid, avg(v.v) occ from v_vox v left join v_masks m using (uid, x, y, z) where m.uid is null and v.y = 0 group by 1),
    w as (select m.uid, m.side, avg(v.v) roi, avg(m.z) zc from v_masks m join v_vox v using (uid, x, y, z) group by 1, 2),
    ax as (select 'L' side, 0.562::double ax, 0.827::double ay union all select 'R', -0.538::double, 0.843::double),
    f as (select distinct uid, side, x, y from v_masks), c as (select uid, side, avg(x) fx, avg(y) fy from f group by 1, 2), t as (select uid, side, fx, fy, ax, ay, max((x-fx)*ax + (y-fy)*ay) tip from f join c using (uid, side) join ax using (side) group by all),
    s as (select t.uid, t.side, k.k part, avg(v.v) m from t join w using (uid, side) cross join (select range k from range(3)) k join v_vox v on v.uid = t.uid where round(pow(v.x - (fx + (tip - {_RADIUS}::double - k.k*{_STEP}::double)*ax), 2) + pow(v.y - (fy + (tip - {_RADIUS}::double - k.k*{_STEP}::double)*ay), 2) + pow(v.z - zc, 2), 9) <= round({_RADIUS}::double*{_RADIUS}::double, 9) group by 1, 2, 3),
    g as (select w.uid, w.side, (roi - occ)/occ sbr, {', '.join(f'max(case when part = {k} then (m - occ)/occ end) sub{k}' for k in range(3))} from w join occ using (uid) left join s using (uid, side) group by all)
    select uid, side, {r('sbr')} sbr, {', '.join(r(f'sub{k}') + f' sub{k}' for k in range(3))}, {r("2*abs(max(case when side = 'L' then sbr end) over p - max(case when side = 'R' then sbr end) over p)/(max(case when side = 'L' then sbr end) over p + max(case when side = 'R' then sbr end) over p + 1e-9)")} asymmetry from g window p as (partition by uid)""",
    ("v_vox", "v_masks"),
)
def regional_ratio(spark, sf):
    """Binding ratios (roi - occ) / occ per side and in three spheres back from the anterior tip."""
    xyz = ["uid", "x", "y", "z"]
    vox, mask = v_vox(spark, sf).select(*xyz, "v"), v_masks(spark, sf)
    occ = vox.where("y = 0").join(mask.drop("side"), xyz, "left_anti").groupBy("uid").agg(F.avg("v").alias("occ"))
    whole = mask.join(vox, xyz).groupBy("uid", "side").agg(F.avg("v").alias("roi"), F.avg("z").alias("zc"))
    flat = mask.select("uid", "side", "x", "y").distinct()
    ax = F.when(F.col("side") == "L", F.lit(_AXES["L"][0])).otherwise(F.lit(_AXES["R"][0]))
    ay = F.when(F.col("side") == "L", F.lit(_AXES["L"][1])).otherwise(F.lit(_AXES["R"][1]))
    # the largest projection on a fixed axis needs only the centroid and the largest dot product
    tip = flat.groupBy("uid", "side").agg(F.avg("x").alias("fx"), F.avg("y").alias("fy"), F.max(F.col("x") * ax + F.col("y") * ay).alias("dot"))
    tip = tip.withColumn("tip", F.col("dot") - (F.col("fx") * ax + F.col("fy") * ay))
    pose = tip.join(whole, ["uid", "side"]).select("uid", "side", "roi", "zc", "fx", "fy", "tip", F.posexplode(F.array(*[F.lit(k * _STEP) for k in range(3)])).alias("part", "back"))
    d = F.col("tip") - F.lit(_RADIUS) - F.col("back")
    pose = pose.withColumn("cx", F.col("fx") + d * ax).withColumn("cy", F.col("fy") + d * ay)
    near = (F.abs(F.col("x") - F.col("cx")) <= _RADIUS + 1e-6) & (F.abs(F.col("y") - F.col("cy")) <= _RADIUS + 1e-6)
    dist = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("z") - F.col("zc"), 2)
    sub = vox.join(pose, "uid").where(near & (F.round(dist, 9) <= round(_RADIUS * _RADIUS, 9))).groupBy("uid", "side").agg(*[F.avg(F.when(F.col("part") == k, F.col("v"))).alias(f"m{k}") for k in range(3)])
    g = whole.join(occ, "uid").join(sub, ["uid", "side"], "left")
    ratio = lambda c: (F.col(c) - F.col("occ")) / F.col("occ")
    g = g.select("uid", "side", ratio("roi").alias("sbr"), *[ratio(f"m{k}").alias(f"sub{k}") for k in range(3)])
    both = g.groupBy("uid").agg(F.max(F.when(F.col("side") == "L", F.col("sbr"))).alias("l"), F.max(F.when(F.col("side") == "R", F.col("sbr"))).alias("r"))
    asym = both.select("uid", (2 * F.abs(F.col("l") - F.col("r")) / (F.col("l") + F.col("r") + 1e-9)).alias("asymmetry"))
    return g.join(asym, "uid").select("uid", "side", r6("sbr").alias("sbr"), *[r6(f"sub{k}").alias(f"sub{k}") for k in range(3)], r6("asymmetry").alias("asymmetry"))


@query(
    "occipital_roi",
    f"""with recursive t as (select uid, max(v) mx from v_img group by 1), a as (select uid, avg(v) m from v_img join t using (uid) where v > 0.02::double*mx group by 1),
    fg as (select uid, x, y from v_img join a using (uid) where v > 1.1::double*m), bg as (select uid, x, y from v_img join a using (uid) where not v > 1.1::double*m), {components_sql('bg', 'b', AX2)},
    openb as (select distinct uid, label from b where x in (0, 7) or y in (0, 7)), filled as (select * from fg union all select b.uid, b.x, b.y from b left join openb o using (uid, label) where o.uid is null), {components_sql('filled', 'h', AX2)},
    ext as (select uid, min(x) x0, max(x) - min(x) px, min(y) y0, max(y) - min(y) py from h_big group by 1)
    select h.uid, h.x, h.y from h_big h join ext using (uid) join v_img i using (uid, x, y) where y < y0 + 0.5::double*py and x > x0 + 0.2::double*px and x < x0 + 0.8::double*px and not i.v > 1.6::double""",
    ("v_img",),
)
def occipital_roi(spark, sf):
    """Posterior band of the filled, largest brain region, without the striatum."""
    img = v_img(spark, sf)
    top = img.groupBy("uid").agg(F.max("v").alias("mx"))
    mean = img.join(top, "uid").where("v > 0.02D*mx").groupBy("uid").agg(F.avg("v").alias("m"))
    fg = cut(img.join(mean, "uid").where("v > 1.1D*m").select("uid", "x", "y"))
    body = cut(largest(components(fill_holes(fg, AX2, img), AX2)).select("uid", "x", "y"))
    ext = body.groupBy("uid").agg(F.min("x").alias("x0"), (F.max("x") - F.min("x")).alias("px"), F.min("y").alias("y0"), (F.max("y") - F.min("y")).alias("py"))
    band = body.join(ext, "uid").where("y < y0 + 0.5D*py and x > x0 + 0.2D*px and x < x0 + 0.8D*px").select("uid", "x", "y")
    return band.join(img.where("v > 1.6D").select("uid", "x", "y"), ["uid", "x", "y"], "left_anti")


@query(
    "gaussian_smooth",
    f"with {smooth_sql('v_img', 'a', AX2, W5)}, {smooth_sql('v_img', 'b', AX2, W5, 'replicate')} select uid, x, y, {r('a.v')} zero_border, {r('b.v')} edge_border from a join b using (uid, x, y)",
    ("v_img",),
)
def gaussian_smooth(spark, sf):
    """Both borders in the scan's row; no sort and no shuffle."""
    b = v_boxes(spark, sf).select("uid", *[smooth_box("data", IMG, SIGMA, border).alias(n) for n, border in (("a", "zero"), ("b", "replicate"))])
    t = b.select("uid", F.posexplode_outer(F.arrays_zip("a", "b")).alias("i", "v"))
    ij = (F.floor(F.col("i") / IMG[1]).cast("int").alias("x"), (F.col("i") % IMG[1]).alias("y"))
    return t.select("uid", *ij, r6("v.a").alias("zero_border"), r6("v.b").alias("edge_border"))


def _corr_sql(w: str) -> str:
    return f"greatest(-1, least(1, sum({w}*(y - yb_{w})*(v - vb_{w})) / greatest(sqrt(greatest(sum({w}*(y - yb_{w})*(y - yb_{w})), 1e-6)) * sqrt(greatest(sum({w}*(v - vb_{w})*(v - vb_{w})), 1e-6)), 1e-6)))"


@query(
    "ap_gradient",
    f"""with m as (select uid, x, y, v, avg(x) over (partition by uid) cx from v_img where v > 1.1::double), g as (select *, {sig('cx - x')} lo, 1 - {sig('cx - x')} hi from m),
    b as (select *, {', '.join(f'sum({w}*y) over p / greatest(sum({w}) over p, 1e-3) yb_{w}, sum({w}*v) over p / greatest(sum({w}) over p, 1e-3) vb_{w}' for w in ('lo', 'hi'))} from g window p as (partition by uid))
    select uid, {r(_corr_sql('lo'))} ap_lo, {r(_corr_sql('hi'))} ap_hi from b group by 1""",
    ("v_img",),
)
def ap_gradient(spark, sf):
    """Mask-weighted correlation of intensity with the A-P index per soft side, centred before squaring."""
    m = v_img(spark, sf).where("v > 1.1D")
    c = m.groupBy("uid").agg(F.avg("x").alias("cx"))
    g = m.join(c, "uid").withColumn("lo", sigmoid(F.col("cx") - F.col("x"))).withColumn("hi", F.lit(1.0) - F.col("lo"))
    mean = lambda w, t: F.sum(F.col(w) * F.col(t)) / F.greatest(F.sum(w), F.lit(1e-3))
    mu = g.groupBy("uid").agg(*[mean(w, t).alias(f"{t}_{w}") for w in ("lo", "hi") for t in "yv"])
    d = g.join(mu, "uid")

    def rho(w):
        dy, dv, ww = F.col("y") - F.col(f"y_{w}"), F.col("v") - F.col(f"v_{w}"), F.col(w)
        sd = lambda t: F.sqrt(F.greatest(F.sum(ww * t * t), F.lit(1e-6)))
        c = F.sum(ww * dy * dv) / F.greatest(sd(dy) * sd(dv), F.lit(1e-6))
        return r6(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))

    return d.groupBy("uid").agg(rho("lo").alias("ap_lo"), rho("hi").alias("ap_hi"))


@query(
    "background_subtract",
    f"""with k as (select uid, v, row_number() over (partition by uid order by v) - 1 rk, count(*) over (partition by uid) n from v_vox where v > 0.15), p as (select uid, max(v) p20 from k where rk = cast(floor(0.2::double*(n - 1)) as int) group by 1),
    m as (select uid, sum(v)/greatest(count(*), 1) bg from v_vox where v > 0.15 and v < 1 group by 1)
    select uid, i, {r('greatest(0, (v - coalesce(bg, 0))/greatest(1 - coalesce(bg, 0), 0.2))')} by_mean, {r('greatest(0, (v - p20)/greatest(1 - p20, 0.2))')} by_p20 from v_vox join p using (uid) left join m using (uid)""",
    ("v_vox",),
)
def background_subtract(spark, sf):
    b = v_boxes(spark, sf)
    low = F.filter("data", lambda v: (v > 0.15) & (v < 1.0))
    head = F.sort_array(F.filter("data", lambda v: v > 0.15))
    b = b.select("uid", "data", F.coalesce(F.aggregate(low, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(low), F.lit(1)), F.lit(0.0)).alias("bg"), sorted_nearest(head, 0.2).alias("p20"))
    sub = lambda c: F.greatest(F.lit(0.0), (F.col("v") - F.col(c)) / F.greatest(F.lit(1.0) - F.col(c), F.lit(0.2)))
    return b.select("uid", "bg", "p20", F.posexplode("data").alias("i", "v")).select("uid", "i", r6(sub("bg")).alias("by_mean"), r6(sub("p20")).alias("by_p20"))


@query(
    "inferior_cut",
    f"""with k as (select uid, v, row_number() over (partition by uid order by v) - 1 rk, count(*) over (partition by uid) n from v_vox where i % 7 = 0), q as (select uid, max(v) q from k where rk = cast(floor(0.999::double*(n - 1)) as int) group by 1),
    c as (select uid, z, count(*) filter (where v > 0.7::double*q) n from v_vox join q using (uid) group by 1, 2), b as (select uid, coalesce(min(z) filter (where n > 6), 0) bottom from c group by 1)
    select uid, i, b.bottom, {r('case when z >= b.bottom + 1 then v else 0 end')} v from v_vox join b using (uid)""",
    ("v_vox",),
)
def inferior_cut(spark, sf):
    """Zero everything below the first slice with enough head voxels plus a margin."""
    b = v_boxes(spark, sf).withColumn("top", sorted_nearest(F.sort_array(F.filter("data", lambda v, i: i % 7 == 0)), 0.999))
    nx, ny, nz = DIMS
    hits = lambda z: F.size(F.filter(F.sequence(F.lit(0), F.lit(nx * ny - 1)), lambda k: F.get("data", k * nz + z) > F.lit(0.7) * F.col("top")))
    bottom = F.coalesce(F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(nz - 1)), lambda z: F.when(hits(z) > 6, z)), lambda z: z.isNotNull())), F.lit(0))
    v = vol.voxels(b.withColumn("bottom", bottom), DIMS, ("bottom",))
    return v.select("uid", "i", "bottom", r6(F.when(F.col("z") >= F.col("bottom") + 1, F.col("v")).otherwise(F.lit(0.0))).alias("v"))


@query(
    "normal_template",
    f"""with t as (select x, y, avg(v) mu, sqrt(greatest(avg(v*v) - avg(v)*avg(v), 1e-4)) sd from v_img where uid % 3 = 0 and uid % 5 <> 0 group by 1, 2)
    select uid, x, y, {r('greatest(-8, least(8, (v - mu)/sd))/3')} z from v_img join t using (x, y)""",
    ("v_img",),
)
def normal_template(spark, sf):
    """Deviation from the normal training scans per pixel; the template has one row per pixel of the grid."""
    img = v_img(spark, sf)
    train = img.where("uid % 3 = 0 and uid % 5 <> 0")
    t = train.groupBy("x", "y").agg(F.avg("v").alias("mu"), F.avg(F.col("v") * F.col("v")).alias("m2"))
    t = t.select("x", "y", "mu", F.sqrt(F.greatest(F.col("m2") - F.col("mu") * F.col("mu"), F.lit(1e-4))).alias("sd"))
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("v") - F.col("mu")) / F.col("sd"))) / 3.0
    return img.join(F.broadcast(t), ["x", "y"]).select("uid", "x", "y", r6(z).alias("z"))


_PEAK = """lv as (select uid, avg(v) mu, greatest(0.5, 4.09::double*avg(v) + 1.259::double) tau from v_vox group by 1), mx as (select uid, x, y, max(v) m from v_vox group by 1, 2, 3),
    pk as (select v.uid, v.x, v.y, max(m) + (ln(sum(exp(tau*(v - m)))) - ln(4.0::double))/max(tau) peak, avg(v) mean, max(mu) mu, max(tau) tau from v_vox v join mx using (uid, x, y) join lv using (uid) group by 1, 2, 3)"""


@query(
    "scan_scalars",
    f"""with {_PEAK}, rg as (select distinct uid, x, y from v_masks) select uid, {r('max(mu)')} mu, {r('max(tau)')} tau, {r('greatest(max(case when rg.uid is not null then peak else 0 end), 1e-3)')} anchor_max from pk left join rg using (uid, x, y) group by 1""",
    ("v_vox", "v_masks"),
)
def scan_scalars(spark, sf):
    pk = vol.peak_mean_maps(v_boxes(spark, sf), DIMS)
    reg = v_masks(spark, sf).select("uid", "x", "y").distinct().withColumn("in", F.lit(1))
    j = pk.select("uid", "x", "y", "mu", "tau", "peak").join(reg, ["uid", "x", "y"], "left")
    a = F.greatest(F.max(F.when(F.col("in") == 1, F.col("peak")).otherwise(F.lit(0.0))), F.lit(1e-3))
    return j.groupBy("uid").agg(r6(F.max("mu")).alias("mu"), r6(F.max("tau")).alias("tau"), r6(a).alias("anchor_max"))


@query(
    "mask_midline",
    f"""with m as (select uid, case when count(*) > 12 then cast(greatest(1, least(3, round_even(avg(x), 0))) as int) else 2 end mid from (select distinct uid, x, y from v_masks) group by 1)
    select uid, case when x < mid then 'low' else 'high' end half, case when x < mid then x - (mid - 2) else 1 - (x - mid) end hx, y, z, {r('v')} v, mid from v_vox join m using (uid) where x >= mid - 2 and x < mid + 2""",
    ("v_masks", "v_vox"),
)
def mask_midline(spark, sf):
    """Split at the mask's own midline and mirror the high half onto the low one; outside the volume is absent."""
    flat = v_masks(spark, sf).select("uid", "x", "y").distinct()
    mid = F.greatest(F.lit(1), F.least(F.lit(3), half_even(F.avg("x")).cast("int")))
    m = flat.groupBy("uid").agg(F.when(F.count(F.lit(1)) > 12, mid).otherwise(F.lit(2)).alias("mid"))
    low = F.col("x") < F.col("mid")
    v = v_vox(spark, sf).join(m, "uid").where("x >= mid - 2 and x < mid + 2")
    return v.select("uid", F.when(low, "low").otherwise("high").alias("half"), F.when(low, F.expr("x - (mid - 2)")).otherwise(F.expr("1 - (x - mid)")).alias("hx"), "y", "z", r6("v").alias("v"), "mid")


_YAW = """c as (select uid, avg(x) cx, avg(y) cy from v_masks group by 1), h as (select uid, cx, cy, count(*) filter (where x <= cx) nl, count(*) filter (where x > cx) nr, avg(x) filter (where x <= cx) lx, avg(y) filter (where x <= cx) ly, avg(x) filter (where x > cx) rx, avg(y) filter (where x > cx) ry from v_masks join c using (uid) group by all),
    yw as (select uid, cx, cy, case when nl > 10 and nr > 10 then atan2(ry - ly, greatest(rx - lx, 1e-3)) else 0 end yaw from h)"""


def corner_sql(src: str, pts: str, name: str, n: str = "4") -> str:
    """Trilinear read of v_vox at (px, py, pz) of each row of `pts`, zero outside."""
    return f"""{name} as (select p.uid, p.x, p.y, p.z, sum(coalesce(s.v, 0) * (case when o.a = 1 then px - floor(px) else 1 - (px - floor(px)) end) * (case when o.b = 1 then py - floor(py) else 1 - (py - floor(py)) end) * (case when o.c = 1 then pz - floor(pz) else 1 - (pz - floor(pz)) end)) v
    from {pts} p cross join (select a.range a, b.range b, c.range c from range(2) a, range(2) b, range(2) c) o left join {src} s on s.uid = p.uid and s.x = cast(floor(px) as int) + o.a and s.y = cast(floor(py) as int) + o.b and s.z = cast(floor(pz) as int) + o.c group by 1, 2, 3, 4)"""


@query(
    "mask_yaw",
    f"""with {_YAW}, pt as (select v.uid, x, y, z, cos(yaw)*(x - cx) - sin(yaw)*(y - cy) + cx px, sin(yaw)*(x - cx) + cos(yaw)*(y - cy) + cy py, z::double pz, yaw from v_vox v join yw using (uid)), {corner_sql('v_vox', 'pt', 'g')}
    select g.uid, x, y, z, {r('v')} v, {r('yaw')} yaw from g join yw using (uid)""",
    ("v_masks", "v_vox"),
)
def mask_yaw(spark, sf):
    """Yaw from the two mask halves, undone by rotating about the mask centroid."""
    m = v_masks(spark, sf)
    c = m.groupBy("uid").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    left = F.col("x") <= F.col("cx")
    h = m.join(c, "uid").groupBy("uid").agg(
        F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.count_if(left).alias("nl"), F.count_if(~left).alias("nr"),
        *[F.avg(F.when(s, F.col(a))).alias(f"{n}{a}") for n, s in (("l", left), ("r", ~left)) for a in "xy"],
    )
    yaw = F.when((F.col("nl") > 10) & (F.col("nr") > 10), F.atan2(F.col("ry") - F.col("ly"), F.greatest(F.col("rx") - F.col("lx"), F.lit(1e-3)))).otherwise(F.lit(0.0))
    b = v_boxes(spark, sf).select("uid", "data").join(h.select("uid", "cx", "cy", yaw.alias("yaw")), "uid")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    cs, sn = F.cos("yaw"), F.sin("yaw")
    out = resample(b, DIMS, (cs * dx - sn * dy + F.col("cx"), sn * dx + cs * dy + F.col("cy"), F.col("z")), carry=("yaw",))
    return out.select("uid", "x", "y", "z", r6("v").alias("v"), r6("yaw").alias("yaw"))


@query("soft_side_split", f"with c as (select uid, avg(x) cx from v_masks group by 1) select uid, x, {r(sig('(x - cx)/0.7::double'))} right_w, {r('1 - ' + sig('(x - cx)/0.7::double'))} left_w from c cross join (select cast(range as int) x from range(4))", ("v_masks",))
def soft_side_split(spark, sf):
    c = v_masks(spark, sf).groupBy("uid").agg(F.avg("x").alias("cx"))
    w = sigmoid((F.col("x") - F.col("cx")) / F.lit(0.7))
    return c.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("uid", "x", r6(w).alias("right_w"), r6(F.lit(1.0) - w).alias("left_w"))


@query(
    "aperture_weight",
    f"""with m as (select v.uid, v.x, v.y, v.z, case when k.uid is null then 0.0::double else 1.0::double end v from v_vox v left join (select uid, x, y, z from v_vox where v > 1.7::double) k using (uid, x, y, z)),
    d as (select a.uid, a.x, a.y, a.z, max(b.v) v from m a join m b on a.uid = b.uid and abs(a.x-b.x) <= 1 and abs(a.y-b.y) <= 1 and abs(a.z-b.z) <= 1 group by 1, 2, 3, 4), {smooth_sql('d', 's', AX3, W5, 'replicate')}
    select s.uid, s.x, s.y, s.z, {r('o.v * greatest(0, least(1, s.v))')} v from s join v_vox o using (uid, x, y, z)""",
    ("v_vox",),
)
def aperture_weight(spark, sf):
    """Volume times the blurred, dilated mask."""
    v = scan_voxels(spark, sf).withColumn("m", (F.col("v") > 1.7).cast("double"))
    ax = ["x", "y", "z"]
    s = smooth(frame(v, ax, "m", F.max, 1), ax, "m", SIGMA, "replicate")
    return s.select("uid", *ax, r6(F.col("v") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m")))).alias("v"))


_Q = "pow((cos(th)*(x-cx) + sin(th)*(y-cy))/greatest(rx, 1e-3), 2) + pow((-sin(th)*(x-cx) + cos(th)*(y-cy))/greatest(ry, 1e-3), 2) + pow((z-cz)/greatest(rz, 1e-3), 2)"


@query("ellipsoid_membership", f"select v.uid, v.x, v.y, v.z, p.side from v_vox v join v_pose p using (uid) where round({_Q}, 9) < 1", ("v_vox", "v_pose"))
def ellipsoid_membership(spark, sf):
    return inside_ellipsoids(v_vox(spark, sf), v_pose(spark, sf)).select("uid", "x", "y", "z", "side")


_ANGLES = ("0.05::double*label", "0.07::double*label", "th")
_TURN = f"""an as (select uid, side, cx, cy, cz, greatest(rx, 1e-3) rx, greatest(ry, 1e-3) ry, greatest(rz, 1e-3) rz, {', '.join(f'cos({e}) c{k}, sin({e}) s{k}' for k, e in enumerate(_ANGLES))} from v_pose p join (select vec_id, label from embeddings) e on e.vec_id = p.uid),
    ro as (select *, c1*c2 m00, c1*s2 m01, -s1 m02, s0*s1*c2 - c0*s2 m10, s0*s1*s2 + c0*c2 m11, s0*c1 m12, c0*s1*c2 + s0*s2 m20, c0*s1*s2 - s0*c2 m21, c0*c1 m22 from an),
    el as (select uid, x, y, z, bool_or(side = 'L') "left", bool_or(side = 'R') "right", true either from ro cross join (select cast(range as int) x from range(4)) cross join (select cast(range as int) y from range(4)) cross join (select cast(range as int) z from range(4))
    where round({' + '.join(f"pow((m{i}0*(x - cx) + m{i}1*(y - cy) + m{i}2*(z - cz))/r{a}, 2)" for i, a in enumerate("xyz"))}, 9) < 1 group by 1, 2, 3, 4)"""


def _turned(spark, sf):
    lab = table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), "label")
    return v_pose(spark, sf).join(lab, "uid").withColumns(euler(F.lit(0.05) * F.col("label"), F.lit(0.07) * F.col("label"), F.col("th")))


@query("ellipsoid_rotated", f"with {_TURN} select * from el", ("v_pose",))
def ellipsoid_rotated(spark, sf):
    """Cells inside fully rotated ellipsoids, per side and united."""
    return rotated_cells(_turned(spark, sf), DIMS)


@query("ellipsoid_projected", f"""with {_TURN} select uid, x, y, bool_or("left") "left", bool_or("right") "right", true either from el group by 1, 2, 3""", ("v_pose",))
def ellipsoid_projected(spark, sf):
    """The same, projected along S-I, per side and united."""
    return rotated_cells(_turned(spark, sf), DIMS, project=True)


@query(
    "axis_ellipsoid_cut",
    f"""with m as (select v.uid, x, y, z, side, v from v_vox v join v_pose p using (uid) where round(pow((x-cx)/rx, 2) + pow((y-cy)/ry, 2) + pow((z-cz)/rz, 2), 9) <= 1), t as (select uid, max(v) top from m group by 1)
    select uid, x, y, z, side, {r('v')} v from m join t using (uid) where v >= 0.5::double*top""",
    ("v_vox", "v_pose"),
)
def axis_ellipsoid_cut(spark, sf):
    """Inside an axis-aligned ellipsoid and above a share of the maximum over both sides."""
    j = v_vox(spark, sf).join(v_pose(spark, sf), "uid")
    near = F.lit(True)
    for a in "xyz":
        near = near & (F.abs(F.col(a) - F.col(f"c{a}")) <= F.col(f"r{a}"))
    q = sum(F.pow((F.col(a) - F.col(f"c{a}")) / F.col(f"r{a}"), 2) for a in "xyz")
    m = j.where(near).where(F.round(q, 9) <= 1).select("uid", "x", "y", "z", "side", "v")
    top = m.groupBy("uid").agg(F.max("v").alias("top"))
    return m.join(top, "uid").where("v >= 0.5D*top").select("uid", "x", "y", "z", "side", r6("v").alias("v"))


@query(
    "slab_window",
    f"select uid, case when x between 8 and 15 then 'left' when x between 16 and 23 then 'right' else 'outside' end slab, count(*) n, {r('sum(v)')} total, count(*) filter (where x >= 10 and x < 22 and y >= 6 and y < 18) n_window from v_grid group by 1, 2",
    ("v_grid",),
)
def slab_window(spark, sf):
    x, y = F.col("x"), F.col("y")
    slab = F.when((x >= 8) & (x < 16), "left").when((x >= 16) & (x < 24), "right").otherwise("outside")
    inside = (x >= 10) & (x < 22) & (y >= 6) & (y < 18)
    return v_grid(spark, sf).groupBy("uid", slab.alias("slab")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v")).alias("total"), F.count_if(inside).alias("n_window"))


@query(
    "crop_box",
    f"""with c as (select uid, cast(round_even(avg(x), 0) as int) - 6 lx, cast(round_even(avg(y), 0) as int) - 5 ly, cast(round_even(avg(z), 0) as int) - 4 lz from v_grid where v > 50 group by 1)
    select uid, x - lx x, y - ly y, z - lz z, {r('v')} v from v_grid join c using (uid) where x >= lx and x < lx + 12 and y >= ly and y < ly + 10 and z >= lz and z < lz + 8""",
    ("v_grid",),
)
def crop_box(spark, sf):
    """Fixed-size crop about a half-even rounded centre; voxels outside stay implicit zeros."""
    g = v_grid(spark, sf)
    size = {"x": 12, "y": 10, "z": 8}
    c = g.where("v > 50").groupBy("uid").agg(*[(half_even(F.avg(a)).cast("int") - n // 2).alias(f"l{a}") for a, n in size.items()])
    j = g.join(c, "uid")
    for a, n in size.items():
        j = j.where((F.col(a) >= F.col(f"l{a}")) & (F.col(a) < F.col(f"l{a}") + n))
    return j.select("uid", *[(F.col(a) - F.col(f"l{a}")).alias(a) for a in size], r6("v").alias("v"))


@query(
    "neighbour_join",
    f"""with o(dx, dy, dz) as (values (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) select a.uid, a.x + dx x, a.y + dy y, a.z + dz z, {r('sum(v)')} total, {r('max(v)')} top, count(*) n from v_grid a cross join o group by 1, 2, 3, 4""",
    ("v_grid",),
)
def neighbour_join(spark, sf):
    """Sparse six-neighbour stencil."""
    faces = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    return offsets_join(v_grid(spark, sf), ["x", "y", "z"], faces, {"total": r6(F.sum("v")), "top": r6(F.max("v")), "n": F.count(F.lit(1))})


_PT = "pt as (select v.uid, x, y, z, cos(th)*(x-1.5) + sin(th)*(y-1.5) + 1.5 + sx px, -sin(th)*(x-1.5) + cos(th)*(y-1.5) + 1.5 py, z::double pz from v_vox v join v_affine using (uid))"


@query(
    "affine_resample",
    f"""with {_PT}, {corner_sql('v_vox', 'pt', 'g')}, pe as (select uid, x, y, z, greatest(0, least(3, px)) px, greatest(0, least(3, py)) py, pz from pt), {corner_sql('v_vox', 'pe', 'h')}
    select uid, x, y, z, {r('g.v')} zero_border, {r('h.v')} edge_border from g join h using (uid, x, y, z)""",
    ("v_vox", "v_affine"),
)
def affine_resample(spark, sf):
    """Both borders in the scan's row."""
    b = v_boxes(spark, sf).select("uid", "data").join(v_affine(spark, sf), "uid")
    c, s, one, none = F.cos("th"), F.sin("th"), F.lit(1.0), F.lit(0.0)
    m = [c, s, none, -1.5 * c - 1.5 * s + 1.5 + F.col("sx"), -s, c, none, 1.5 * s - 1.5 * c + 1.5, none, none, one, none]
    t = b.select("uid", gather_box("data", DIMS, m).alias("a"), gather_box("data", DIMS, m, border="edge").alias("b"))
    return vol.cells(t, DIMS, "uid", "a", "b").select("uid", "x", "y", "z", r6("a").alias("zero_border"), r6("b").alias("edge_border"))


@query(
    "zoom_resample",
    f"""with o as (select uid, x, y, z from (select distinct uid from v_vox) cross join (select cast(range as int) x from range(6)) cross join (select cast(range as int) y from range(6)) cross join (select cast(range as int) z from range(6))),
    pc as (select uid, x, y, z, x*3/5.0::double px, y*3/5.0::double py, z*3/5.0::double pz from o), ph as (select uid, x, y, z, greatest(0, least(3, (x+0.5)*4/6.0::double - 0.5)) px, greatest(0, least(3, (y+0.5)*4/6.0::double - 0.5)) py, greatest(0, least(3, (z+0.5)*4/6.0::double - 0.5)) pz from o),
    {corner_sql('v_vox', 'pc', 'g')}, {corner_sql('v_vox', 'ph', 'h')} select uid, x, y, z, round(g.v, 5) corner_aligned, round(h.v, 5) half_pixel from g join h using (uid, x, y, z)""",
    ("v_vox",),
)
def zoom_resample(spark, sf):
    """Resizing under the two grid conventions: corners coincide, or edges coincide."""
    diagonal = lambda k, c: [x for i in range(3) for x in (*[k if i == j else 0.0 for j in range(3)], c)]
    big = (6, 6, 6)
    t = v_boxes(spark, sf).select(
        "uid", gather_box("data", DIMS, diagonal(3 / 5, 0.0), big, "edge").alias("a"), gather_box("data", DIMS, diagonal(4 / 6, 4 / 12 - 0.5), big, "edge").alias("b")
    )
    return vol.cells(t, big, "uid", "a", "b").select("uid", "x", "y", "z", F.round("a", 5).alias("corner_aligned"), F.round("b", 5).alias("half_pixel"))


