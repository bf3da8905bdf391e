"""Seeded augmentation of volumes and masks."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.draws import uniform_sql
from ..functions.scalars import clamp, half_even, r6
from ..operators import augment as ag
from ..operators import volumes as vol
from ..operators.boxes import warp_box
from ..operators.stencil import kernel, smooth_box
from .ordering import _AXIS_SQL
from .registry import query, r
from .sqltext import smooth_sql
from .views import DIMS, table, v_boxes, v_masks, v_vox
from .voxels import AX3, SIGMA, W5, corner_sql

XYZ = ["x", "y", "z"]
Y_SQL = "ys as (select vec_id uid, label % 2 y from embeddings)"


def d(op: str, k: int = 0, scope: str = "scan", uid: str = "uid") -> str:
    key = f"{uid} // 24" if scope == "batch" else uid
    return uniform_sql(f"'{scope}'", key, "0", f"'{op}'", str(k))


def labels(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), (F.col("label") % 2).alias("y"))


@query("flip_lr", f"select v.uid, case when {d('flip.gate', 0, 'batch', 'v.uid')} < 0.5 then 3 - v.x else v.x end x, v.y, v.z, {r('v.v')} v, m.uid is not null masked from v_vox v left join (select distinct uid, x, y, z from v_masks) m using (uid, x, y, z)", ("v_vox", "v_masks"))
def flip_lr(spark, sf):
    """Mirror image and mask together; the gate is drawn once per batch."""
    m = v_masks(spark, sf).select("uid", *XYZ).distinct().withColumn("masked", F.lit(True))
    v = v_vox(spark, sf).select("uid", *XYZ, "v").join(m, ["uid", *XYZ], "left")
    out = ag.flip(v, DIMS[0], ag.gate("flip", 0.5))
    return out.select("uid", *XYZ, r6("v").alias("v"), F.coalesce("masked", F.lit(False)).alias("masked"))


_S = lambda k: f"({d('affine', k)}*2 - 1)"
_ROT = (
    ("c1*c2", "s0*s1*c2 - c0*s2", "c0*s1*c2 + s0*s2"),
    ("c1*s2", "s0*s1*s2 + c0*c2", "c0*s1*s2 - s0*c2"),
    ("-s1", "s0*c1", "c0*c1"),
)
_ZOOM, _MOVE = lambda k: f"1 + {_S(3 + k)}*0.15::double", lambda k: f"{_S(6 + k)}*0.06::double"


def affine_sql(name: str = "th", axes=(1.0, 1.0, 1.0), zoom=_ZOOM, move=_MOVE) -> str:
    return f"""{name}_d as (select uid, {', '.join(f'{_S(k)}*{15.0 * math.pi / 180!r}::double*{axes[k]!r}::double a{k}, {zoom(k)} z{k}, {move(k)} t{k}3' for k in range(3))} from (select vec_id uid from embeddings)),
    {name}_c as (select *, {', '.join(f'cos(a{k}) c{k}, sin(a{k}) s{k}' for k in range(3))} from {name}_d), {name} as (select uid, {', '.join(f'({_ROT[i][j]})*z{j} t{i}{j}' for i in range(3) for j in range(3))}, t03, t13, t23 from {name}_c)"""


_AFF = affine_sql()
_T = ag.THETA
_OPTIONS = {"rot_axes": (1.0, 0.0, 0.5), "zoom_range": (0.85, 1.1), "shift_ap": 0.15625}
_AFF_O = affine_sql("tho", _OPTIONS["rot_axes"], lambda k: f"0.85::double + {d('affine', 3)}*{1.1 - 0.85!r}::double", lambda k: f"{_S(7)}*0.15625::double" if k == 1 else "0.0::double")


@query("affine_params", f"with {_AFF}, {_AFF_O} select uid, {', '.join(r('th.' + t) + ' ' + t + ', ' + r('tho.' + t) + ' o' + t for t in _T)} from th join tho using (uid)")
def affine_params(spark, sf):
    """Drawn maps with the default options, and (o..) with weighted angles, one zoom for all axes and an A-P shift."""
    uids = labels(spark, sf).select("uid")
    t = ag.affine_draws(uids).select("uid", F.array(*_T).alias("t"))
    both = ag.affine_draws(t, **_OPTIONS)
    return both.select("uid", *[r6(F.get("t", k)).alias(c) for k, c in enumerate(_T)], *[r6(c).alias("o" + c) for c in _T])


_G = {a: f"(({a} + 0.5::double)/4*2 - 1)" for a in XYZ}
_ROW = lambda i: f"(t{i}0*{_G['z']} + t{i}1*{_G['y']} + t{i}2*{_G['x']} + t{i}3)"
_SRC = lambda i: f"(({_ROW(i)} + 1)*4 - 1)/2"


@query(
    "affine_apply",
    f"""with {_AFF}, pt as (select v.uid, x, y, z, {_SRC(2)} px, {_SRC(1)} py, {_SRC(0)} pz from v_vox v join th using (uid)), mv as (select v.uid, v.x, v.y, v.z, case when m.uid is null then 0.0::double else 1.0::double end v from v_vox v left join (select distinct uid, x, y, z from v_masks) m using (uid, x, y, z)),
    {corner_sql('v_vox', 'pt', 'g')}, {corner_sql('mv', 'pt', 'h')} select uid, x, y, z, {r('g.v')} v, round(h.v, 9) > 0.5 masked from g join h using (uid, x, y, z)""",
    ("v_vox", "v_masks"),
)
def affine_apply(spark, sf):
    """Image by trilinear gather with zeros outside; the mask is resampled the same way, in the same row, and cut at one half."""
    t = ag.affine_draws(boxes_and_masks(spark, sf))
    b = t.select("uid", warp_box("data", DIMS, _T).alias("v"), warp_box("mask", DIMS, _T).alias("m"))
    return cells(b, "uid", "v", "m").select("uid", *XYZ, r6("v").alias("v"), (F.round("m", 9) > 0.5).alias("masked"))


def boxes_and_masks(spark, sf):
    """(uid, data, mask) arrays of every scan; a scan without a mask has an empty one."""
    m = v_masks(spark, sf).select("uid", *XYZ).distinct().withColumn("v", F.lit(1.0))
    m = vol.to_boxes(m, DIMS).select("uid", F.col("data").alias("mask"))
    b = v_boxes(spark, sf).select("uid", "data").join(m, "uid", "left")
    return b.withColumn("mask", F.coalesce("mask", F.transform("data", lambda v: F.lit(0.0))))


_HEX = "md5('voxel|' || cast(uid as varchar) || '|' || cast(i as varchar) || '|' || cast(k as varchar))"
_UNIT = lambda h, at: f"((cast(('0x' || substr({h}, {at}, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double)"
_SER = lambda n: f"(1/({n})*(1/12.0::double - 1/({n})/({n})*(1/360.0::double - 1/({n})/({n})*(1/1260.0::double - 1/({n})/({n})/1680.0::double))))"


def poisson_sql(source: str, name: str, attempts: int = 128) -> str:
    """CTEs: `<name>` (uid, i, n) are Poisson counts of mean lam of `source` (uid, i, lam > 0), by the first accepted attempt."""
    return f"""{name}_m as (select uid, i, lam, floor(lam) m, exp(-lam + floor(lam)*ln(lam) - lgamma(floor(lam) + 1)) p from {source} where lam > 0),
    {name}_h as (select *, 1 + p/2 w, {_HEX} h from {name}_m cross join (select range + 1 k from range({attempts}))), {name}_u as (select *, {_UNIT('h', 1)} u, {_UNIT('h', 14)} a, case when cast(('0x' || substr(h, 27, 1)) as int) < 8 then -1 else 1 end g from {name}_h),
    {name}_y as (select *, case when u*(1 + w) <= w then u*(1 + w) else w - ln((1 - u)*(1 + w)) end / p y from {name}_u), {name}_x as (select *, g*floor(y + 0.5::double) x from {name}_y),
    {name} as (select uid, i, arg_min(m + x, k) n from {name}_x where m + x >= 0 and ln(a) + least(0, w - p*y) <= x*ln(lam) - lgamma(greatest(m + x, 0) + 1) + lgamma(m + 1) group by 1, 2)"""


@query(
    "count_noise",
    f"""with t as (select uid, i, v, 25::double + 150::double*{d('count')} gain, {d('count.gate', 0, 'batch')} < 0.9 hit from v_vox), l as (select *, greatest(v, 0)*gain lam from t), {poisson_sql('l', 'c')}
    select l.uid, l.i, {r('case when not hit then v when lam > 0 then n/gain else 0 end')} v from l left join c using (uid, i)""",
    ("v_vox",),
)
def count_noise(spark, sf):
    """Poisson counts at a drawn level, exact for every mean, from this library's own draws: other generators agree in distribution."""
    gain = F.lit(25.0) + F.lit(150.0) * ag.draw("count")
    out = F.when(ag.gate("count", 0.9), ag.count_noise("data", gain)).otherwise(F.col("data"))
    return v_boxes(spark, sf).select("uid", F.posexplode_outer(out).alias("i", "v")).select("uid", "i", r6("v").alias("v"))


@query("gamma_gain", f"select uid, i, {r('case when ' + d('gamma.gate', 0, 'batch') + ' < 0.3 then pow(greatest(v, 0)/12, 0.7::double + 0.6::double*' + d('gamma') + ')*12 else v end')} v from v_vox", ("v_vox",))
def gamma_gain(spark, sf):
    g = F.lit(0.7) + F.lit(0.6) * ag.draw("gamma")
    return v_vox(spark, sf).select("uid", "i", r6(F.when(ag.gate("gamma", 0.3), ag.gamma_gain(F.col("v"), g)).otherwise(F.col("v"))).alias("v"))


@query(
    "truncate_si",
    f"""with b as (select uid, {d('cutsi.gate', 0, 'batch')} < 0.5 hit, 1 + cast(floor({d('cutsi', 0, 'batch')}*2) as int) k, {d('cutsi', 1, 'batch')} < 0.5 top from (select distinct uid from v_vox))
    select v.uid, i, {r('case when hit and ((top and z >= 4 - k) or (not top and z < k)) then 0 else v end')} v from v_vox v join b using (uid)""",
    ("v_vox",),
)
def truncate_si(spark, sf):
    k = 1 + F.floor(ag.draw("cutsi", 0, scope="batch") * 2)
    top = ag.draw("cutsi", 1, scope="batch") < 0.5
    out = F.when(top, F.col("z") >= F.lit(DIMS[2]) - k).otherwise(F.col("z") < k)
    return v_vox(spark, sf).select("uid", "i", r6(F.when(ag.gate("cutsi", 0.5) & out, F.lit(0.0)).otherwise(F.col("v"))).alias("v"))


_WEIGHTS = """nn as (select cast(range + 2 as int) n from range(3)), rd as (select n, cast(k.range as int) k, greatest(0, least(3, (k.range + 0.5::double)*4/n - 0.5::double)) q from nn, range(4) k where k.range < n),
    dn as (select n, k, cast(floor(q) as int) + o.range i, case when o.range = 1 then q - floor(q) else 1 - (q - floor(q)) end w from rd, range(2) o), ru as (select n, cast(j.range as int) j, greatest(0, least(n - 1, (j.range + 0.5::double)*n/4.0::double - 0.5::double)) p from nn, range(4) j),
    up as (select n, j, cast(floor(p) as int) + o.range k, case when o.range = 1 then p - floor(p) else 1 - (p - floor(p)) end w from ru, range(2) o), wt as (select up.n, up.j, dn.i, sum(up.w*dn.w) w from up join dn on up.n = dn.n and up.k = dn.k group by 1, 2, 3)"""
_SMALL = lambda k: f"greatest(2, cast(round(4/(1 + {d('psf', k, 'batch')}*1.2::double)) as int))"


_PSF = f"""pb as (select uid, {_SMALL(0)} n0, {_SMALL(1)} n1, {_SMALL(2)} n2, 0.4::double + 0.8::double*{d('psf', 3, 'batch')} sg, {d('psf.gate', 0, 'batch')} < 0.5 coarse, {d('blur.gate', 0, 'batch')} < 0.5 blur from (select distinct uid from v_vox)),
    kk as (select range - 2 dd from range(5)), ws as (select uid, dd, exp(-0.5*pow(dd/sg, 2))/sum(exp(-0.5*pow(dd/sg, 2))) over (partition by uid) w from pb, kk)"""


def psf_sql(source: str, name: str) -> str:
    """CTEs: `<name>_d` is source on a coarser grid and back where that gate is open, `<name>` also blurred where the other is; needs _WEIGHTS and _PSF."""
    n, prev, out = name, source, []
    for k, ax in enumerate(XYZ):
        cols = ", ".join(f"wt.j {a}" if a == ax else f"v.{a}" for a in XYZ)
        out.append(f"{n}_a{k} as (select v.uid, {cols}, sum(w*v) v from {prev} v join pb using (uid) join wt on wt.n = n{k} and wt.i = v.{ax} group by 1, 2, 3, 4)")
        prev = f"{n}_a{k}"
    out.append(f"{n}_d as (select s.uid, s.x, s.y, s.z, case when coarse then a.v else s.v end v from {source} s join {prev} a using (uid, x, y, z) join pb using (uid))")
    prev = f"{n}_d"
    for k, ax in enumerate(XYZ):
        at = " and ".join(f"s.{a} = greatest(0, least(3, a.{a} + dd))" if a == ax else f"s.{a} = a.{a}" for a in XYZ)
        out.append(f"{n}_g{k} as (select a.uid, a.x, a.y, a.z, sum(w*s.v) v from {prev} a join ws using (uid) join {prev} s on s.uid = a.uid and {at} group by 1, 2, 3, 4)")
        prev = f"{n}_g{k}"
    out.append(f"{n} as (select s.uid, s.x, s.y, s.z, case when blur then g.v else s.v end v from {n}_d s join {prev} g using (uid, x, y, z) join pb using (uid))")
    return ", ".join(out)


@query("resolution_loss", f"with {_WEIGHTS}, {_PSF}, {psf_sql('v_vox', 'q')} select uid, x, y, z, {r('q_d.v')} degraded, {r('q.v')} blurred from q_d join q using (uid, x, y, z)", ("v_vox",))
def resolution_loss(spark, sf):
    """Coarser grid per axis and back, then a Gaussian of drawn width, each behind its own gate; the mask is not touched."""
    b = v_boxes(spark, sf).select("uid", "data")
    coarse = ag.degrade_box("data", DIMS, ag.coarse_sizes(DIMS, 2))
    b = b.withColumn("data", F.when(ag.gate("psf", 0.5), coarse).otherwise(F.col("data")))
    soft = smooth_box("data", DIMS, F.lit(0.4) + F.lit(0.8) * ag.draw("psf", 3, scope="batch"), "replicate", taps=5)
    b = b.withColumn("g", F.when(ag.gate("blur", 0.5), soft).otherwise(F.col("data")))
    return cells(b, "uid", "data", "g").select("uid", *XYZ, r6("data").alias("degraded"), r6("g").alias("blurred"))


def cells(b, *columns):
    return vol.cells(b, DIMS, *columns)


_W2, _W12 = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-2, 3)], [math.exp(-0.5 * (k / 1.2) ** 2) for k in range(-2, 3)]
_W2, _W12 = [w / sum(_W2) for w in _W2], [w / sum(_W12) for w in _W12]


def scatter_sql(source: str, name: str, level: str) -> str:
    """CTEs: `<name>_b` has a blurred head mask added where that gate is open, `<name>` a halo of that where the other is."""
    n = name
    return f"""{n}_h0 as (select uid, x, y, z, case when v > {level}::double then 1.0::double else 0.0::double end v from {source}), {smooth_sql(f'{n}_h0', f'{n}_h', AX3, _W2, 'replicate')},
    {n}_b as (select s.uid, x, y, z, s.v + case when {d('bg.gate', 0, 'batch', 's.uid')} < 0.5 then 0.3::double*{d('bg', 0, 'scan', 's.uid')}*h.v else 0 end v from {source} s join {n}_h h using (uid, x, y, z)),
    {smooth_sql(f'{n}_b', f'{n}_p', AX3, _W12, 'replicate')}, {smooth_sql(f'{n}_p', f'{n}_q', AX3, _W12, 'replicate')},
    {n} as (select s.uid, x, y, z, s.v + case when {d('scatter.gate', 0, 'batch', 's.uid')} < 0.5 then 0.2::double*{d('scatter', 0, 'scan', 's.uid')}*h.v else 0 end v from {n}_b s join {n}_q h using (uid, x, y, z))"""


@query("background_scatter", f"with {scatter_sql('v_vox', 's', '0.9')} select uid, x, y, z, {r('s_b.v')} background, {r('s.v')} v from s_b join s using (uid, x, y, z)", ("v_vox",))
def background_scatter(spark, sf):
    """A diffuse background inside the head, then a halo of the result, each behind its own gate."""
    b = v_boxes(spark, sf).select("uid", "data")
    add = lambda amount, extra: F.zip_with("data", extra, lambda v, e: v + amount * e)
    b = b.withColumn("b", F.when(ag.gate("bg", 0.5), add(F.lit(0.3) * ag.draw("bg"), ag.diffuse("data", DIMS, 0.9))).otherwise(F.col("data"))).withColumn("data", F.col("b"))
    b = b.withColumn("s", F.when(ag.gate("scatter", 0.5), add(F.lit(0.2) * ag.draw("scatter"), ag.halo("data", DIMS))).otherwise(F.col("data")))
    return cells(b, "uid", "b", "s").select("uid", *XYZ, r6("b").alias("background"), r6("s").alias("v"))


@query("clamp", f"select uid, i, {r('least(12, greatest(0, 9*v - 4))')} v from v_vox", ("v_vox",))
def clamp_intensity(spark, sf):
    return v_vox(spark, sf).select("uid", "i", r6(clamp(F.lit(9.0) * F.col("v") - 4, 0.0, 12.0)).alias("v"))


_LES = f"""ld as (select uid, y, y = 0 and {d('lesion', 0)} < 0.7 hit, 0.3::double + 0.5::double*{d('lesion', 1)} sv, {d('lesion', 2)} u2, {d('lesion', 3)} < 0.5 heavy_l from ys),
    les as (select uid, y, hit, case when not hit then 0 when heavy_l then sv else sv*(0.4::double + 0.6::double*u2) end sev_l, case when not hit then 0 when heavy_l then sv*(0.4::double + 0.6::double*u2) else sv end sev_r, case when hit then 1 else y end y_new from ld)"""


@query("lesion_draws", f"with {Y_SQL}, {_LES} select uid, y, hit lesioned, {r('sev_l')} sev_l, {r('sev_r')} sev_r, y_new from les")
def lesion_draws(spark, sf):
    t = ag.lesion_draws(labels(spark, sf), 0.7, 0.3, 0.8, 0.4)
    return t.select("uid", "y", "lesioned", r6("sev_l").alias("sev_l"), r6("sev_r").alias("sev_r"), "y_new")


_SEV = "case when v.x < lr then sev_l else sev_r end"


def field_sql(name: str, u_edge: str = "0.55::double", u_ramp: str = "0.35::double", base: str = "0.25::double", more: str = "1", joins: str = "") -> str:
    """CTE `<name>`: the blurred field of every scan with a mask; needs mid."""
    loss = f"least(1, {_SEV}*({base} + (1 - {base})*greatest(0, least(1, ({u_edge} - u)/{u_ramp})))*({more}))"
    return f"""{name}_0 as (select v.uid, v.x, v.y, v.z, 1 - {loss}*(case when m.uid is null then 0 else 1 end) v
    from v_vox v join mid using (uid) join les using (uid) join ax on ax.uid = v.uid and ax.y = v.y left join mk m on m.uid = v.uid and m.x = v.x and m.y = v.y and m.z = v.z {joins}), {smooth_sql(f'{name}_0', f'{name}_s', AX3, W5, 'replicate')}, {name} as (select uid, x, y, z, greatest(0, least(1, v)) f from {name}_s)"""


_MID = "mk as (select distinct uid, x, y, z from v_masks), mid as (select uid, avg(x) lr from mk group by 1)"
_FIELD = f"{_MID}, {field_sql('lf')}"
# margins of the image, jittered shape and texture
_RIM = f"""sp as (select uid, x, y, z, greatest(v - 1, 0) v from v_vox), {smooth_sql('sp', 'ss', AX3, kernel(1.5), 'replicate')}, mx as (select uid, greatest(max(ss.v), 1e-6) top from ss join mk using (uid, x, y, z) group by 1), rim as (select uid, x, y, z, greatest(0, least(1, 1 - ss.v/top)) e from ss join mx using (uid) semi join mk using (uid, x, y, z))"""
_EDGED = field_sql("le", more="1 + 0.8::double*coalesce(rim.e, 0)", joins="left join rim on rim.uid = v.uid and rim.x = v.x and rim.y = v.y and rim.z = v.z")
_JIT = [f"(jt.j{k})" for k in range(3)]
_TEX_H = "md5('texture|' || cast(uid as varchar) || '|' || cast(i as varchar) || '|0')"
_JITTERED = f"""jt as (select uid, {', '.join(f"{lo}::double + 0.3::double*{d('jitter', k)} j{k}" for k, lo in enumerate((0.4, 0.2, 0.1)))} from (select distinct uid from v_vox)), {field_sql('lj', *_JIT, joins='join jt on jt.uid = v.uid')},
    tx as (select uid, x, y, z, sqrt(-2*ln({_UNIT(_TEX_H, 1)}))*cos(2*pi()*{_UNIT(_TEX_H, 14)}) v from v_vox), {smooth_sql('tx', 'ts', AX3, kernel(4.0), 'replicate')}, td as (select uid, greatest(stddev_samp(v), 1e-6) sd from ts group by 1),
    lt as (select uid, x, y, z, greatest(0, least(1, 1 - (1 - f)*(1 + 0.3::double*v/sd))) f from lj join ts using (uid, x, y, z) join td using (uid))"""


def lesioned(spark, sf):
    """(uid, data, mask, sev_l, sev_r) of the scans with a mask."""
    dr = ag.lesion_draws(labels(spark, sf), 0.7, 0.3, 0.8, 0.4).select("uid", "sev_l", "sev_r")
    return boxes_and_masks(spark, sf).where(F.exists("mask", lambda m: m > 0)).join(dr, "uid")


@query("lesion_field", f"with {Y_SQL}, {_LES}, {_AXIS_SQL}, {_FIELD}, {_RIM}, {_EDGED}, {_JITTERED} select uid, x, y, z, {r('lf.f')} f, {r('le.f')} edged, {r('lj.f')} jittered, {r('lt.f')} textured from lf join le using (uid, x, y, z) join lj using (uid, x, y, z) join lt using (uid, x, y, z)", ("v_vox", "v_masks"))
def lesion_field(spark, sf):
    """The plain field, with more loss at the image's own margins, with a jittered A-P shape, and that with a smooth texture."""
    b = lesioned(spark, sf).withColumns({"f": ag.lesion_field("mask", DIMS, SIGMA), "e": ag.lesion_field("mask", DIMS, SIGMA, edge=0.8, margins=ag.margins_of("data", "mask", DIMS)), "j": ag.lesion_field("mask", DIMS, SIGMA, ag.jittered_shape())})
    b = b.withColumn("t", ag.textured("j", DIMS))
    return cells(b, "uid", *"fejt").select("uid", *XYZ, *[r6(c).alias(n) for c, n in zip("fejt", ("f", "edged", "jittered", "textured"))])


def _level(name: str, f: str) -> str:
    """CTEs: `<name>` is the source reduced by the field f and put back on its own reference."""
    o = name
    return f"""{o}_o as (select v.uid, v.x, v.y, v.z, v.v src, v.v - greatest(v.v - 1, 0)*(1 - f) v from v_vox v join {f} using (uid, x, y, z)), {back_sql(f'{o}_o', o)}"""


def back_sql(o: str, name: str) -> str:
    return f"""{name}_k as (select *, row_number() over (partition by uid order by src) - 1 rs, row_number() over (partition by uid order by v) - 1 rv from {o}), {name}_q as (select uid, max(case when rs = 62 then src end) qs, max(case when rv = 62 then v end) qv from {name}_k group by 1),
    {name}_r as (select uid, (case when count(*) filter (where src > 0.7::double*qs) >= 3 then avg(src) filter (where src > 0.7::double*qs) else avg(src) end) + 1e-6 fs, (case when count(*) filter (where v > 0.7::double*qv) >= 3 then avg(v) filter (where v > 0.7::double*qv) else avg(v) end) + 1e-6 fv from {o} join {name}_q using (uid) group by 1),
    {name} as (select uid, x, y, z, least(12, greatest(0, v/(fv/fs))) v from {o} join {name}_r using (uid))"""


@query(
    "lesion_apply",
    f"with {Y_SQL}, {_LES}, {_AXIS_SQL}, {_FIELD}, {_RIM}, {_EDGED}, {_JITTERED}, {_level('l1', 'lf')}, {_level('l2', 'le')}, {_level('l3', 'lt')} select uid, cast(x*16 + y*4 + z as int) i, {r('l1.v')} v, {r('l2.v')} edged, {r('l3.v')} textured from l1 join l2 using (uid, x, y, z) join l3 using (uid, x, y, z)",
    ("v_vox", "v_masks"),
)
def lesion_apply(spark, sf):
    """Reduce specific binding by each of the fields, then return the volume to its own reference level."""
    b = lesioned(spark, sf)
    fields = {"a": ag.lesion_field("mask", DIMS, SIGMA), "b": ag.lesion_field("mask", DIMS, SIGMA, edge=0.8, margins=ag.margins_of("data", "mask", DIMS)), "c": ag.textured(ag.lesion_field("mask", DIMS, SIGMA, ag.jittered_shape()), DIMS)}
    b = b.withColumns(fields).withColumns({c: F.zip_with("data", c, ag.lesion_apply) for c in fields})
    b = b.select("uid", *[vol.renormalise(c, "data", f=0.7, least=3).alias(c) for c in fields])
    t = b.select("uid", F.posexplode_outer(F.arrays_zip(*fields)).alias("i", "_v"))
    return t.select("uid", "i", r6("_v.a").alias("v"), r6("_v.b").alias("edged"), r6("_v.c").alias("textured"))


@query(
    "peak_clip",
    f"""with {Y_SQL}, {_LES}, {_AXIS_SQL}, {_MID}, rg as (select m.uid, m.x, m.y, m.z, v.v, case when m.x < lr then 'L' else 'R' end sd from mk m join v_vox v using (uid, x, y, z) join ax on ax.uid = m.uid and ax.y = m.y join mid on mid.uid = m.uid where u < 0.6 and u >= -0.1),
    q as (select uid, sd, count(*) n, quantile_cont(v, 0.7) q from rg group by 1, 2),
    pc as (select v.uid, v.x, v.y, v.z, v.v src, case when q.n >= 4 and v.v > q.q then q.q + (v.v - q.q)*(1 - case when rg.sd = 'L' then sev_l else sev_r end) else v.v end v from v_vox v semi join mid using (uid) left join rg on rg.uid = v.uid and rg.x = v.x and rg.y = v.y and rg.z = v.z left join q on q.uid = rg.uid and q.sd = rg.sd join les on les.uid = v.uid),
    dl as (select uid, x, y, z, src - v v from pc), {smooth_sql('dl', 'ds', AX3, W5, 'replicate')}, sm as (select pc.uid, x, y, z, src, src - ds.v v from pc join ds using (uid, x, y, z)), {back_sql('sm', 'bk')}
    select pc.uid, x, y, z, {r('pc.v')} v, {r('sm.v')} smoothed, {r('bk.v')} renormalised from pc join sm using (uid, x, y, z) join bk using (uid, x, y, z)""",
    ("v_vox", "v_masks"),
)
def peak_clip(spark, sf):
    """Compress the brightest share of the posterior region per side, small regions are skipped; then with the change blurred, and that back on the source's reference."""
    b = lesioned(spark, sf).withColumns({"p": ag.peak_clipped("data", "mask", DIMS, 0.3, 0.6, 4), "s": ag.peak_clipped("data", "mask", DIMS, 0.3, 0.6, 4, SIGMA)})
    b = b.withColumn("k", vol.renormalise("s", "data", f=0.7, least=3))
    return cells(b, "uid", "p", "s", "k").select("uid", *XYZ, r6("p").alias("v"), r6("s").alias("smoothed"), r6("k").alias("renormalised"))


@query(
    "severity_triplets",
    f"""with {Y_SQL}, t as (select uid, 0.3::double*{d('order', 0)} a, {d('order', 1)} u1 from ys where y = 0), b as (select uid, a, least(1, a + 0.3::double + 0.45::double*u1) b from t), s as (select uid, avg(v) z0, stddev_pop(v) sd from v_vox group by 1),
    z as (select uid, a, b, z0, z0 + a*sd*2 za, z0 + b*sd*2 zb from b join s using (uid)) select {r('avg(greatest(0, 0.5::double - (zb - za)))')} hinge_order, {r('avg(greatest(0, 0.5::double*a - (za - z0)))')} hinge_native, count(*) n from z""",
    ("v_vox",),
)
def severity_triplets(spark, sf):
    """Native, mild and severe variants of the same normal scan, joined on their source for the ordering hinge."""
    src = labels(spark, sf).where("y = 0").select("uid", (F.lit(0.3) * ag.draw("order", 0)).alias("a"), ag.draw("order", 1).alias("u1"))
    src = src.withColumn("b", F.least(F.lit(1.0), F.col("a") + 0.3 + F.lit(0.45) * F.col("u1")))
    s = v_vox(spark, sf).groupBy("uid").agg(F.avg("v").alias("z0"), F.stddev_pop("v").alias("sd"))
    variants = src.join(s, "uid").select("uid", "a", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"), "b", "z0", "sd")
    sev = F.when(F.col("level") == 0, F.lit(0.0)).when(F.col("level") == 1, F.col("a")).otherwise(F.col("b"))
    scored = variants.withColumn("z", F.col("z0") + sev * F.col("sd") * 2)
    g = scored.groupBy("uid").agg(F.max("a").alias("a"), *[F.max(F.when(F.col("level") == k, F.col("z"))).alias(f"z{k}") for k in range(3)])
    hinge = lambda c: F.avg(F.greatest(F.lit(0.0), c))
    return g.agg(
        r6(hinge(F.lit(0.5) - (F.col("z2") - F.col("z1")))).alias("hinge_order"), r6(hinge(F.lit(0.5) * F.col("a") - (F.col("z1") - F.col("z0")))).alias("hinge_native"), F.count(F.lit(1)).alias("n")
    )


@query(
    "hemisphere_copies",
    f"""with j as (select uid, cast(floor({d('hemi', 0)}*3) as int) - 1 dl, cast(floor({d('hemi', 1)}*3) as int) - 1 dr from (select distinct uid from v_vox))
    select v.uid, i, {r('case when x < 2 + dl and x >= 2 + dl - 2 then v else 0 end')} low, {r('case when x >= 2 + dr and x < 2 + dr + 2 then v else 0 end')} high from v_vox v join j using (uid)""",
    ("v_vox",),
)
def hemisphere_copies(spark, sf):
    """Two copies, each zero past its own jittered cut and outside a band beside it."""
    jit = lambda k: F.floor(ag.draw("hemi", k) * 3).cast("int") - 1
    cl, cr, x, band = 2 + jit(0), 2 + jit(1), F.col("x"), 2
    keep = lambda c: r6(F.when(c, F.col("v")).otherwise(F.lit(0.0)))
    return v_vox(spark, sf).select("uid", "i", keep((x < cl) & (x >= cl - band)).alias("low"), keep((x >= cr) & (x < cr + band)).alias("high"))


_DON = """rk as (select uid, uid // 24 bt, row_number() over (partition by uid // 24 order by {h}, uid) - 1 k, count(*) over (partition by uid // 24) n from ys), dn as (select a.uid, b.uid donor from rk a join rk b on a.bt = b.bt and b.k = (a.k + 1) % a.n)"""


def donors(df, op):
    """Partner by a seeded cyclic shift inside the batch of at most 24 scans."""
    t = df.select("uid", ag.batch_of().alias("bt"), ag.draw(op).alias("h"))
    w = Window.partitionBy("bt").orderBy("h", "uid")
    first = F.first("uid").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return t.select("uid", F.coalesce(F.lead("uid", 1).over(w), first).alias("donor"))


@query(
    "region_transplant",
    f"""with {Y_SQL}, {_DON.format(h=d('transplant'))}, cn as (select uid, avg(x) cx, avg(y) cy, avg(z) cz from v_masks group by 1),
    pr as (select a.uid, a.donor, c.cx, c.cy, c.cz, cast(round_even(c.cx - e.cx, 0) as int) ox, cast(round_even(c.cy - e.cy, 0) as int) oy, cast(round_even(c.cz - e.cz, 0) as int) oz from dn a join cn c on c.uid = a.uid join cn e on e.uid = a.donor),
    b as (select v.uid, v.x, v.y, v.z, v.v, s.v dv, greatest(0, least(1, (1 - sqrt(pow((v.x-cx)/2, 2) + pow((v.y-cy)/2, 2) + pow((v.z-cz)/2, 2)))*2 + 0.5)) w from v_vox v join pr using (uid) join v_vox s on s.uid = donor and s.x = (v.x - ox + 8) % 4 and s.y = (v.y - oy + 8) % 4 and s.z = (v.z - oz + 8) % 4),
    sh as (select uid, coalesce(sum(v) filter (where w > 0.05 and w < 0.95), 0)/greatest(count(*) filter (where w > 0.05 and w < 0.95), 1) sr, coalesce(sum(dv) filter (where w > 0.05 and w < 0.95), 0)/greatest(count(*) filter (where w > 0.05 and w < 0.95), 1) sd from b group by 1)
    select b.uid, b.x, b.y, b.z, {r('(1 - w)*v + w*dv*sr/greatest(sd, 1e-3)')} v, ys.y as label from b join sh using (uid) join pr using (uid) join ys on ys.uid = pr.donor""",
    ("v_vox", "v_masks"),
)
def region_transplant(spark, sf):
    """Blend the donor's region in at matching centroids, matched in level on the transition shell.

    The donor volume is read by index from its array, so the join is one row per scan.
    """
    lab = labels(spark, sf)
    cen = v_masks(spark, sf).groupBy("uid").agg(*[F.avg(a).alias(f"c{a}") for a in XYZ])
    box = v_boxes(spark, sf).select("uid", "data")
    don = box.join(cen, "uid").join(lab, "uid").select(F.col("uid").alias("donor"), F.col("data").alias("other"), *[F.col(f"c{a}").alias(f"e{a}") for a in XYZ], F.col("y").alias("label"))
    t = box.join(cen, "uid").join(donors(lab, "transplant"), "uid").join(don, "donor")
    t = t.select("uid", "data", "other", "label", *[f"c{a}" for a in XYZ], *[half_even(F.col(f"c{a}") - F.col(f"e{a}")).cast("int").alias(f"o{a}") for a in XYZ])
    v = vol.voxels(t, DIMS, ("other", "label", *[f"c{a}" for a in XYZ], *[f"o{a}" for a in XYZ]))
    at = F.lit(0)
    for a, n in zip(XYZ, DIMS):
        at = at * n + F.pmod(F.col(a) - F.col(f"o{a}"), F.lit(n))
    r2 = sum(F.pow((F.col(a) - F.col(f"c{a}")) / 2.0, 2) for a in XYZ)
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.sqrt(r2)) * 2.0 + 0.5))
    v = v.select("uid", *XYZ, "v", F.get("other", at).alias("dv"), w.alias("w"), "label")
    shell = (F.col("w") > 0.05) & (F.col("w") < 0.95)
    mean = lambda c: F.coalesce(F.sum(F.when(shell, F.col(c))), F.lit(0.0)) / F.greatest(F.count_if(shell), F.lit(1))
    lev = v.groupBy("uid").agg(mean("v").alias("sr"), mean("dv").alias("sd"))
    out = (1 - F.col("w")) * F.col("v") + F.col("w") * F.col("dv") * F.col("sr") / F.greatest("sd", F.lit(1e-3))
    return v.join(lev, "uid").select("uid", *XYZ, r6(out).alias("v"), "label")


@query(
    "hemisphere_mix",
    f"""with {Y_SQL}, {_DON.format(h=d('mix'))}, rp as (select cast(range as int) x, 1 - (greatest(-0.5, least(0.5, (range - 1.5::double)/2)) + 0.5) m from range(4))
    select a.uid, a.i, {r('m*a.v + (1 - m)*b.v')} v, greatest(ya.y, yb.y) as label from v_vox a join dn using (uid) join v_vox b on b.uid = donor and b.i = a.i join rp on rp.x = a.x join ys ya on ya.uid = a.uid join ys yb on yb.uid = donor""",
    ("v_vox",),
)
def hemisphere_mix(spark, sf):
    """Linear cross-fade at the midline with a partner; the label is the OR of both."""
    lab = labels(spark, sf)
    box = v_boxes(spark, sf).select("uid", "data").join(lab, "uid")
    other = box.select(F.col("uid").alias("donor"), F.col("data").alias("other"), F.col("y").alias("y2"))
    t = box.join(donors(lab, "mix"), "uid").join(other, "donor")
    v = t.select("uid", F.greatest("y", "y2").alias("label"), F.posexplode(F.arrays_zip("data", "other")).alias("i", "p"))
    m = F.lit(0.5) - F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (F.floor(F.col("i") / 16) - 1.5) / 2.0))
    return v.select("uid", "i", r6(m * F.col("p.data") + (1 - m) * F.col("p.other")).alias("v"), "label")


@query(
    "variant_swap",
    f"""with s as (select uid, {d('swap', 0)} < 0.5 hit, cast(floor({d('swap', 1)}*3) as int) k from (select distinct uid from v_vox))
    select v.uid, i, {r('case when hit and k > 0 then v*(1 + 0.1::double*k) else v end')} v from v_vox v join s using (uid)""",
    ("v_vox",),
)
def variant_swap(spark, sf):
    """Replace a volume by the stored variant it draws; variant 0 is unbuilt (all zero) and falls back.

    Scans draw first, on their ids alone, so only the drawn variants are read out of the bank and joined.
    """
    b = v_boxes(spark, sf).select("uid", "data")
    drawn = b.select("uid", (ag.draw("swap", 0) < 0.5).alias("hit"), F.floor(ag.draw("swap", 1) * 3).cast("int").alias("k")).where("hit").select("uid", "k")
    bank = b.select("uid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), "data").join(drawn, ["uid", "k"], "left_semi")
    bank = bank.select("uid", F.transform("data", lambda v: F.when(F.col("k") == 0, F.lit(0.0)).otherwise(v * (1 + F.lit(0.1) * F.col("k")))).alias("variant"))
    use = F.coalesce(F.array_max("variant"), F.lit(0.0)) > 0
    out = b.join(bank, "uid", "left").select("uid", F.when(use, F.col("variant")).otherwise(F.col("data")).alias("data"))
    return vol.voxels(out, DIMS).select("uid", "i", r6("v").alias("v"))


@query("joint_mask_flip", f"select uid, case when {d('jflip.gate', 0, 'scan')} < 0.5 then (case when side = 'L' then 'R' else 'L' end) else side end side, case when {d('jflip.gate', 0, 'scan')} < 0.5 then 3 - x else x end x, y, z from v_masks", ("v_masks",))
def joint_mask_flip(spark, sf):
    return ag.flip(v_masks(spark, sf), DIMS[0], ag.gate("jflip", 0.5, scope="scan"), "side").select("uid", "side", *XYZ)


_FLIP = d("flip.gate", 0, "batch", "v.uid") + " < 0.5"
_CHAIN = f"""{_AFF}, pt as (select v.uid, x, y, z, case when {_FLIP} then 3 - {_SRC(2)} else {_SRC(2)} end px, {_SRC(1)} py, {_SRC(0)} pz from v_vox v join th using (uid)),
    mv as (select v.uid, v.x, v.y, v.z, case when m.uid is null then 0.0::double else 1.0::double end v from v_vox v left join (select distinct uid, x, y, z from v_masks) m using (uid, x, y, z)), {corner_sql('v_vox', 'pt', 'g')}, {corner_sql('mv', 'pt', 'h')},
    cb as (select uid, {d('cutsi.gate', 0, 'batch')} < 0.5 hit, 1 + cast(floor({d('cutsi', 0, 'batch')}*2) as int) k, {d('cutsi', 1, 'batch')} < 0.5 top, {d('count.gate', 0, 'batch')} < 0.6 counted, 25::double + 150::double*{d('count')} gain, {d('gamma.gate', 0, 'batch')} < 0.6 curved, 0.7::double + 0.6::double*{d('gamma')} gm from (select distinct uid from v_vox)),
    t as (select uid, x, y, z, x*16 + y*4 + z i, case when hit and ((top and z >= 4 - k) or (not top and z < k)) then 0 else g.v end v, case when hit and ((top and z >= 4 - k) or (not top and z < k)) then false else round(h.v, 9) > 0.5 end masked, counted, gain from g join h using (uid, x, y, z) join cb using (uid)),
    l as (select uid, i, greatest(v, 0)*gain lam from t where counted), {poisson_sql('l', 'c')}, n as (select t.uid, x, y, z, case when not counted then v when v > 0 then c.n/gain else 0 end v from t left join c using (uid, i)),
    {_WEIGHTS}, {_PSF}, {psf_sql('n', 'q')}, {scatter_sql('q', 's', '0.15')}"""


@query(
    "geometric_then_intensity",
    f"with {_CHAIN} select s.uid, x, y, z, {r('least(12, greatest(0, case when curved then pow(greatest(s.v, 0)/12, gm)*12 else s.v end))')} v, masked from s join t using (uid, x, y, z) join cb on cb.uid = s.uid",
    ("v_vox", "v_masks"),
)
def geometric_then_intensity(spark, sf):
    """The whole chain with every step and gate: geometry moves image and mask, intensity touches the image only."""
    out = ag.chain(boxes_and_masks(spark, sf), DIMS, si_slices=2, count_p=0.6, psf=True, least=2, background=0.3, scatter=0.2, gamma_p=0.6)
    return cells(out, "uid", "data", "mask").select("uid", *XYZ, r6("data").alias("v"), (F.col("mask") > 0.5).alias("masked"))
