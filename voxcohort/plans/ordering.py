"""Running, rolling and ranked results; top-k reports, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.draws import uniform, uniform_sql
from ..functions.scalars import bce_from_logit, logit, r6
from ..operators.ensemble import metrics
from ..operators.masks import axis_positions
from ..operators.ranking import row_numbers, running, tile
from ..operators.stencil import frame, frames
from ..session import cut
from .registry import query, r
from .sqltext import auc_sql, bce, ll, logit as lsql
from .views import DIMS, scan_image, table, v_ens, v_img, v_masks, v_pose, v_preds, v_runs, v_vox

BLOCK = 4096


@query(
    "best_so_far",
    f"""with t as (select *, min((ll, epoch)) over (partition by run order by epoch rows unbounded preceding) b from v_runs) select run, epoch, {r('b[1]')} best_ll, cast(b[2] as bigint) best_epoch from t""",
    ("v_runs",),
)
def best_so_far(spark, sf):
    """Running minimum and the earliest epoch attaining it."""
    t = running(v_runs(spark, sf), ["run"], ["epoch"], {"n": F.lit(1)}, {"best": F.struct("ll", "epoch")}, bounds=False)
    return t.select("run", "epoch", r6("best_upto.ll").alias("best_ll"), F.col("best_upto.epoch").alias("best_epoch"))


@query(
    "best_epoch",
    f"""with t as (select run, min((ll, epoch)) b, max((epoch, ll)) f from v_runs group by 1) select run, {r('b[1]')} best_ll, cast(b[2] as bigint) best_epoch, {r('f[2]')} final_ll, cast(f[1] as bigint) final_epoch from t""",
    ("v_runs",),
)
def best_epoch(spark, sf):
    g = v_runs(spark, sf).groupBy("run").agg(F.min(F.struct("ll", "epoch")).alias("b"), F.max(F.struct("epoch", "ll")).alias("f"))
    return g.select("run", r6("b.ll").alias("best_ll"), F.col("b.epoch").alias("best_epoch"), r6("f.ll").alias("final_ll"), F.col("f.epoch").alias("final_epoch"))


@query(
    "rolling_mean_200",
    "select run, epoch, avg(round(ll*10000)) over (partition by run order by epoch rows between 199 preceding and current row) mean200 from v_runs",
    ("v_runs",),
)
def rolling_mean_200(spark, sf):
    """Mean of the last 200 steps in blocks of steps, each block carrying the 199 steps before it.

    A run of any length becomes many bounded windows; the copied margin is about 5 % of the rows. Losses
    are in 1e-4 units so the mean is one division of an exact sum in every engine.
    """
    k = 200
    t = v_runs(spark, sf).withColumn("ll", F.round(F.col("ll") * 10000)).withColumn("own", F.floor(F.col("epoch") / BLOCK))
    reach = F.floor((F.col("epoch") + (k - 1)) / BLOCK)
    t = t.withColumn("block", F.explode(F.sequence("own", reach)))
    w = Window.partitionBy("run", "block").orderBy("epoch").rowsBetween(-(k - 1), 0)
    return t.withColumn("m", F.avg("ll").over(w)).where("block = own").select("run", "epoch", F.col("m").alias("mean200"))


_AXIS_SQL = """p as (select uid, a.y, count(m.y) n from (select distinct uid from v_masks) u cross join (select cast(range as int) y from range(4)) a left join v_masks m using (uid, y) group by 1, 2),
    c as (select uid, y, sum(n) over (partition by uid order by y) / greatest(sum(n) over (partition by uid), 1) c from p),
    b as (select *, count(*) filter (where c < 0.02) over (partition by uid) lo, count(*) filter (where c < 0.98) over (partition by uid) hi from c),
    ax as (select uid, y, c, lo, hi, cast(y - lo as double) / greatest(hi - lo, 2) u from b)"""


@query("axis_cdf", f"with {_AXIS_SQL} select uid, y, {r('c')} c, {r('u')} u from ax", ("v_masks",))
def axis_cdf(spark, sf):
    a = axis_positions(v_masks(spark, sf), "y", DIMS[1])
    return a.select("uid", "y", r6("c").alias("c"), r6("u").alias("u"))


@query(
    "order_stats",
    f"with t as (select member, p, row_number() over (partition by member order by p) - 1 k, count(*) over (partition by member) n from v_preds) select member, {r('p')} kth from t where k = cast(floor(0.2::double*(n - 1)) as bigint)",
    ("v_preds",),
)
def order_stats(spark, sf):
    """k-th smallest by position, k = floor(0.2 (n-1)), for groups of any size."""
    t = running(v_preds(spark, sf), ["member"], ["p"], {"n": F.lit(1)})
    k = F.floor(F.lit(0.2) * (F.col("n_all") - 1))
    return t.where((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))).select("member", r6("p").alias("kth"))


@query("severity_tercile", "select uid, y, cast(ntile(3) over (partition by y order by z, uid) as int) tercile from v_ens", ("v_ens",))
def severity_tercile(spark, sf):
    return row_numbers(v_ens(spark, sf), ["y"], ["z", "uid"]).select("uid", "y", tile("rn", "n", 3).alias("tercile"))


@query(
    "position_ordered_sides",
    f"with k as (select *, row_number() over (partition by uid order by cx) rn from v_pose) select uid, {r('max(case when rn = 1 then rx*ry*rz end)')} lo, {r('max(case when rn = 2 then rx*ry*rz end)')} hi, {r('max(case when rn = 2 then cx end)')} cx_hi from k group by 1",
    ("v_pose",),
)
def position_ordered_sides(spark, sf):
    p = v_pose(spark, sf).select("uid", F.struct("cx", (F.col("rx") * F.col("ry") * F.col("rz")).alias("vol")).alias("s"))
    g = p.groupBy("uid").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return g.select("uid", r6("lo.vol").alias("lo"), r6("hi.vol").alias("hi"), r6("hi.cx").alias("cx_hi"))


@query("batch_index", "with u as (select doc_id uid, row_number() over (order by doc_id) - 1 row from documents) select uid, row, cast(row // 8 as bigint) batch from u")
def batch_index(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    rows = row_numbers(docs, [], ["uid"]).select("uid", (F.col("rn") - 1).alias("row"))
    return rows.select("uid", "row", F.floor(F.col("row") / 8).alias("batch"))


def _frame_sql(fn: str, k: int) -> str:
    return f"select a.uid, a.x, a.y, {fn}(b.v) v from v_img a join v_img b on a.uid = b.uid and abs(a.x - b.x) <= {k} and abs(a.y - b.y) <= {k} group by 1, 2, 3"


@query(
    "row_frame_filter",
    f"""with e as ({_frame_sql('min', 1)}), d as ({_frame_sql('max', 2)}), s as ({_frame_sql('sum', 2)}), m as (select uid, x, y, case when v > 1.2::double then 1 else 0 end v from v_img),
    md as (select a.uid, a.x, a.y, max(b.v) v from m a join m b on a.uid = b.uid and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2, 3),
    mc as (select a.uid, a.x, a.y, min(b.v) v from md a join md b on a.uid = b.uid and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2, 3)
    select e.uid, e.x, e.y, {r('e.v')} eroded, {r('d.v')} dilated, {r('s.v')} box_sum, mc.v closed from e join d using (uid, x, y) join s using (uid, x, y) join mc using (uid, x, y)""",
    ("v_img",),
)
def row_frame_filter(spark, sf):
    img = scan_image(spark, sf).withColumn("e", F.col("v")).withColumn("d", F.col("v")).withColumn("s", F.col("v"))
    img = img.withColumn("m", (F.col("v") > 1.2).cast("int"))
    ax = ["x", "y"]
    t = frames(img, ax, {"e": (F.min, 1), "d": (F.max, 2), "s": (F.sum, 2), "m": (F.max, 1)})
    t = frame(t, ax, "m", F.min, 1)
    return t.select("uid", "x", "y", r6("e").alias("eroded"), r6("d").alias("dilated"), r6("s").alias("box_sum"), F.col("m").alias("closed"))


@query(
    "discordant_topk",
    f"(select uid, y, {r('z')} z from v_ens where y = 1 order by v_ens.z, uid limit 2) union all (select uid, y, {r('z')} z from v_ens where y = 0 order by v_ens.z desc, uid limit 2)",
    ("v_ens",),
)
def discordant_topk(spark, sf):
    e = v_ens(spark, sf)
    low = e.where("y = 1").orderBy("z", "uid").limit(2)
    high = e.where("y = 0").orderBy(F.desc("z"), "uid").limit(2)
    return low.unionByName(high).select("uid", "y", r6("z").alias("z"))


@query(
    "exemplars",
    """select 'normal' kind, (select uid from v_ens where y = 0 order by z, uid limit 1) uid union all select 'abnormal', (select uid from v_ens where y = 1 order by z desc, uid limit 1)
    union all select 'mild', (select uid from v_ens where y = 1 order by abs(z - 1), uid limit 1)""",
    ("v_ens",),
)
def exemplars(spark, sf):
    y0, y1, z, u = F.col("y") == 0, F.col("y") == 1, F.col("z"), F.col("uid")
    key = lambda c: F.struct(c.alias("k"), u.alias("uid"))
    g = v_ens(spark, sf).agg(F.min(F.when(y0, key(z))).alias("normal"), F.min(F.when(y1, key(-z))).alias("abnormal"), F.min(F.when(y1, key(F.abs(z - 1)))).alias("mild"))
    return g.select(*[F.col(f"{n}.uid").alias(n) for n in ("normal", "abnormal", "mild")]).unpivot([], ["normal", "abnormal", "mild"], "kind", "uid")


@query("seeded_sample", f"select doc_id uid from documents where doc_id not in (select doc_id from labels) order by {uniform_sql('doc_id', chr(39) + 'held' + chr(39), '0')}, doc_id limit 16")
def seeded_sample(spark, sf):
    """Sixteen scans by seeded hash order, outside a reference set; independent of partitioning."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    seen = table(spark, sf, "labels").select(F.col("doc_id").alias("uid"))
    return docs.join(seen, "uid", "left_anti").orderBy(uniform(F.col("uid"), F.lit("held"), F.lit(0)), "uid").limit(16)


@query(
    "drop_worst_share",
    f"""with m as (select uid, round(avg({bce(lsql('p'))}), 9) l from v_preds where member <> 0 group by 1), k as (select *, row_number() over (order by l desc, uid) rn, count(*) over () n from m)
    select uid, {r('l')} mean_loss from k where rn <= cast(floor(n*0.05::double) as bigint)""",
    ("v_preds",),
)
def drop_worst_share(spark, sf):
    """The worst 5 % by mean loss under the other members only, so the choice does not see member 0."""
    m = v_preds(spark, sf).where("member <> 0").groupBy("uid").agg(F.round(F.avg(bce_from_logit(logit("p"), "y")), 9).alias("l"))
    k = row_numbers(m.withColumn("neg", -F.col("l")), [], ["neg", "uid"])
    return k.where(F.col("rn") <= F.floor(F.col("n") * 0.05)).select("uid", r6(-F.col("neg")).alias("mean_loss"))


@query(
    "worst_members",
    f"with d as (select member, fold, max(abs(p - round(p, 2))) d from v_preds group by 1, 2) select {r('max(d)')} worst, (select member || '_f' || fold from d order by d desc, member, fold limit 1) as name, count(*) n from d",
    ("v_preds",),
)
def worst_members(spark, sf):
    d = v_preds(spark, sf).groupBy("member", "fold").agg(F.max(F.abs(F.col("p") - F.round("p", 2))).alias("d"))
    g = d.agg(F.min(F.struct((-F.col("d")).alias("k"), "member", "fold")).alias("w"), F.count(F.lit(1)).alias("n"))
    return g.select(r6(-F.col("w.k")).alias("worst"), F.concat(F.col("w.member").cast("string"), F.lit("_f"), F.col("w.fold").cast("string")).alias("name"), "n")


@query("mask_union", "select uid, x, y, z from v_masks where side = 'L' union select uid, x, y, z from v_masks where side = 'R'", ("v_masks",))
def mask_union(spark, sf):
    m = v_masks(spark, sf)
    return m.where("side = 'L'").drop("side").union(m.where("side = 'R'").drop("side")).distinct()


@query("mask_difference", "select uid, x, y, z from v_masks where (uid, x, y, z) not in (select uid, x, y, z from v_vox where v > 1.5::double)", ("v_masks", "v_vox"))
def mask_difference(spark, sf):
    core = v_vox(spark, sf).where("v > 1.5D").select("uid", "x", "y", "z")
    return v_masks(spark, sf).drop("side").join(core, ["uid", "x", "y", "z"], "left_anti")


@query("mask_intersection", "select uid, x, y, z from v_masks where (uid, x, y, z) in (select uid, x, y, z from v_vox where v < 1.4::double)", ("v_masks", "v_vox"))
def mask_intersection(spark, sf):
    faint = v_vox(spark, sf).where("v < 1.4D").select("uid", "x", "y", "z")
    return v_masks(spark, sf).drop("side").join(faint, ["uid", "x", "y", "z"], "left_semi")


_ROSTER = """select distinct 'fu_a' || cast(member as varchar) member from v_preds where member < 6 union all select distinct 'ex_a' || cast(member as varchar) from v_preds where member >= 6"""


@query("roster_concat", f"select member, starts_with(member, 'ex_') projected_anchor from ({_ROSTER})", ("v_preds",))
def roster_concat(spark, sf):
    m = v_preds(spark, sf).select("member").distinct()
    name = lambda p: F.concat(F.lit(p), F.col("member").cast("string")).alias("member")
    both = m.where("member < 6").select(name("fu_a")).unionByName(m.where("member >= 6").select(name("ex_a")))
    return both.select("member", F.col("member").startswith("ex_").alias("projected_anchor"))


@query(
    "topk_overlap",
    f"""with m as (select member, {ll('p')} ll from v_preds group by 1), a as (select member, auc from {auc_sql('v_preds', ['member'], 'p')}) select count(*) overlap from (
    select member from (select member from m order by ll, member limit 4) intersect select member from (select member from a order by auc desc, member limit 4))""",
    ("v_preds",),
)
def topk_overlap(spark, sf):
    m = cut(metrics(v_preds(spark, sf), ["member"]))
    a = m.orderBy("ll", "member").limit(4).select("member")
    b = m.orderBy(F.desc("auc"), "member").limit(4).select("member")
    return a.intersect(b).agg(F.count(F.lit(1)).alias("overlap"))


@query("roster_gate", "select member, count(distinct fold) n_folds, count(distinct fold) <> 5 incomplete from v_preds where (member + fold) % 7 <> 0 group by 1", ("v_preds",))
def roster_gate(spark, sf):
    """Members whose fold artefacts are not exactly five."""
    art = v_preds(spark, sf).where((F.col("member") + F.col("fold")) % 7 != 0).select("member", "fold").distinct()
    n = art.groupBy("member").agg(F.count(F.lit(1)).alias("n_folds"))
    return n.select("member", "n_folds", (F.col("n_folds") != 5).alias("incomplete"))


@query("side_label_map", "select v.uid, v.x, v.y, v.z, cast(coalesce(max(case m.side when 'L' then 1 when 'R' then 2 end), 0) as int) label from v_vox v left join v_masks m using (uid, x, y, z) group by 1, 2, 3, 4", ("v_vox", "v_masks"))
def side_label_map(spark, sf):
    lab = F.when(F.col("side") == "L", 1).otherwise(2)
    m = v_masks(spark, sf).groupBy("uid", "x", "y", "z").agg(F.max(lab).alias("label"))
    return v_vox(spark, sf).select("uid", "x", "y", "z").join(m, ["uid", "x", "y", "z"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


@query("mask_project", f"select v.uid, v.x, v.y, {r('max(v.v)')} mip, max(case when m.uid is not null then 1 else 0 end) = 1 covered from v_vox v left join v_masks m using (uid, x, y, z) group by 1, 2, 3", ("v_vox", "v_masks"))
def mask_project(spark, sf):
    mip = v_vox(spark, sf).groupBy("uid", "x", "y").agg(F.max("v").alias("mip"))
    flat = v_masks(spark, sf).select("uid", "x", "y").distinct().withColumn("covered", F.lit(True))
    return mip.join(flat, ["uid", "x", "y"], "left").select("uid", "x", "y", r6("mip").alias("mip"), F.coalesce("covered", F.lit(False)).alias("covered"))


