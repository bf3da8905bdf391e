"""Probability and logit expressions, filters and per-row losses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import bce_from_logit, calibrate as cal, cap_logit, clamp, clip_prob as clip, compress_input, half_even, logit as lg, r6, sanitise as san, softplus
from ..operators.ensemble import view_mean as mean_views
from ..operators.augment import BATCH
from ..operators.ranking import quantiles
from .registry import query, r
from .views import DIMS, table, v_boxes, v_ens, v_preds, v_vox

Z = "ln(greatest(1e-6::double, least(1 - 1e-6::double, p)) / (1 - greatest(1e-6::double, least(1 - 1e-6::double, p))))"


@query("clip_prob", f"select uid, member, {r('greatest(1e-6::double, least(1 - 1e-6::double, 3*p - 1))')} p from v_preds", ("v_preds",))
def clip_prob(spark, sf):
    return v_preds(spark, sf).select("uid", "member", r6(clip(F.lit(3.0) * F.col("p") - F.lit(1.0))).alias("p"))


@query("logit", f"select uid, member, {r(Z)} z from v_preds", ("v_preds",))
def logit(spark, sf):
    return v_preds(spark, sf).select("uid", "member", r6(lg("p")).alias("z"))


@query("calibrate", f"""select uid, member, {r('greatest(1e-6::double, least(1 - 1e-6::double, 1 / (1 + exp(-(0.78::double*' + Z + ' - 0.147824566::double)))))')} p from v_preds""", ("v_preds",))
def calibrate(spark, sf):
    return v_preds(spark, sf).select("uid", "member", r6(cal(lg("p"), 0.78, -0.147824566)).alias("p"))


@query("cap_logit", f"select uid, member, {r(f'greatest(-2.0::double, least(2.0::double, 3*{Z}))')} z, {r(f'3*{Z}')} uncapped from v_preds", ("v_preds",))
def cap(spark, sf):
    z = F.lit(3.0) * lg("p")
    return v_preds(spark, sf).select("uid", "member", r6(cap_logit(z, 2.0)).alias("z"), r6(cap_logit(z, None)).alias("uncapped"))


@query(
    "view_mean",
    f"""select uid, member, {r('greatest(-1.0::double, least(1.0::double, avg(z)))')} z from (
    select uid, member, {Z} z from v_preds union all select uid, member, {Z}*0.5::double + 0.1::double*member from v_preds) group by 1, 2""",
    ("v_preds",),
)
def view_mean(spark, sf):
    p = v_preds(spark, sf).withColumn("z", lg("p"))
    both = p.select("uid", "member", F.explode(F.array("z", F.col("z") * 0.5 + F.lit(0.1) * F.col("member"))).alias("z"))
    return mean_views(both, ["uid", "member"], 1.0).withColumn("z", r6("z"))


@query(
    "sanitise",
    f"""select uid, member, {r('case when member = 0 then 0.5 when member = 1 then 1.0 when member = 2 then 0.0 else p end')} p from v_preds""",
    ("v_preds",),
)
def sanitise(spark, sf):
    m = F.col("member")
    dirty = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).when(m == 2, F.lit(float("-inf"))).otherwise(F.col("p"))
    return v_preds(spark, sf).select("uid", "member", r6(san(dirty)).alias("p"))


@query(
    "hedge",
    f"""select uid, member, {r("case when coalesce(try_cast(raw as double), -1) between 0 and 1 then try_cast(raw as double) else 0.5 end")} p,
    coalesce(try_cast(raw as double), -1) between 0 and 1 ok from (
    select uid, member, case when (uid + member) % 7 = 0 then 'unreadable' when (uid + member) % 11 = 0 then '2.5' else cast(cast(round(p*1000) as bigint) / 1000.0::double as varchar) end raw from v_preds)""",
    ("v_preds",),
)
def hedge(spark, sf):
    """A row that fails to parse or leaves [0, 1] becomes 0.5 with ok = false; the run goes on."""
    k = F.col("uid") + F.col("member")
    raw = F.when(k % 7 == 0, "unreadable").when(k % 11 == 0, "2.5").otherwise((F.round(F.col("p") * 1000).cast("long") / F.lit(1000.0)).cast("string"))
    t = v_preds(spark, sf).withColumn("_v", raw.try_cast("double"))
    ok = F.coalesce(F.col("_v").between(0.0, 1.0), F.lit(False))
    return t.select("uid", "member", r6(F.when(ok, F.col("_v")).otherwise(F.lit(0.5))).alias("p"), ok.alias("ok"))


@query(
    "fold_filter",
    "select member, case when fold = 2 then 'valid' else 'train' end role, count(*) n, cast(sum(y) as bigint) positives from v_preds group by 1, 2",
    ("v_preds",),
)
def fold_filter(spark, sf):
    role = F.when(F.col("fold") == 2, "valid").otherwise("train")
    return v_preds(spark, sf).groupBy("member", role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"))


@query(
    "train_subset",
    """select member, count(*) filter (where fold <> 0) train_all, count(*) filter (where fold <> 0 and keep) train_kept, count(*) filter (where fold = 0) valid
    from (select p.*, l.doc_id is not null keep from v_preds p left join (select doc_id from labels where toxic = 0) l on p.uid = l.doc_id) group by 1""",
    ("v_preds",),
)
def train_subset(spark, sf):
    """Flagged training rows only; validation rows are untouched."""
    p = v_preds(spark, sf)
    flagged = table(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").alias("uid"))
    kept = p.where("fold <> 0").join(flagged, "uid", "left_semi").groupBy("member").agg(F.count(F.lit(1)).alias("train_kept"))
    sizes = p.groupBy("member").agg(F.count_if(F.col("fold") != 0).alias("train_all"), F.count_if(F.col("fold") == 0).alias("valid"))
    return sizes.join(kept, "member", "left").select("member", "train_all", F.coalesce("train_kept", F.lit(0)).alias("train_kept"), "valid")


def _array_q(arr, q):
    """Linear-interpolated quantile of a sorted array column."""
    at = F.lit(float(q)) * (F.size(arr) - F.lit(1))
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.element_at(arr, lo + 1) * (F.lit(1.0) - (at - lo)) + F.element_at(arr, hi + 1) * (at - lo)


@query(
    "rel_threshold",
    f"""with q as (select uid, quantile_cont(v, 0.995) a, quantile_cont(v, 0.999) b from v_vox group by 1)
    select uid, i, v > 0.6::double*a head, v > 0.7::double*b brain, v > 0.5::double*b span from v_vox join q using (uid)""",
    ("v_vox",),
)
def rel_threshold(spark, sf):
    """Voxel flags relative to the scan's own percentiles; sorted inside the row, so nothing is shuffled."""
    b = v_boxes(spark, sf).withColumn("s", F.sort_array("data"))
    b = b.select("uid", "data", _array_q(F.col("s"), 0.995).alias("a"), _array_q(F.col("s"), 0.999).alias("b"))
    vox = b.select("uid", "a", "b", F.posexplode("data").alias("i", "v"))
    return vox.select("uid", "i", (F.col("v") > 0.6 * F.col("a")).alias("head"), (F.col("v") > 0.7 * F.col("b")).alias("brain"), (F.col("v") > 0.5 * F.col("b")).alias("span"))


@query(
    "min_support",
    f"""select uid, count(*) filter (where v > 1.5::double) n, {r('case when count(*) filter (where v > 1.5::double) >= 4 then avg(x) filter (where v > 1.5::double) else 2.0 end')} cx,
    count(*) filter (where v > 1.5::double) < 4 fallback from v_vox group by 1""",
    ("v_vox",),
)
def min_support(spark, sf):
    """A statistic over too few voxels falls back to its stated default."""
    hit = F.col("v") > 1.5
    g = v_vox(spark, sf).groupBy("uid").agg(F.count_if(hit).alias("n"), F.avg(F.when(hit, F.col("x"))).alias("c"))
    return g.select("uid", "n", r6(F.when(F.col("n") >= 4, F.col("c")).otherwise(F.lit(DIMS[0] / 2.0))).alias("cx"), (F.col("n") < 4).alias("fallback"))


@query("round_half_even", "select uid, i, cast(round_even(x / 2.0::double + y, 0) as double) c from v_vox", ("v_vox",))
def round_half_even(spark, sf):
    return v_vox(spark, sf).select("uid", "i", half_even(F.col("x") / 2.0 + F.col("y")).alias("c"))


@query(
    "bce_terms",
    f"""with t as (select uid, y, z, z - 0.3::double*(2*y - 1) zm from v_ens), l as (select uid, greatest(z, 0) - z*y + ln(1 + exp(-abs(z))) bce, greatest(zm, 0) - zm*y + ln(1 + exp(-abs(zm))) m from t),
    q as (select quantile_cont(bce, 0.9) q from l), bq as (select uid // {BATCH} b, quantile_cont(bce, 0.9) bq from l group by 1)
    select uid, {r('bce')} bce, {r('m')} margin_bce, {r('least(bce, 1.0)')} capped, {r('least(bce, q)')} winsorised, {r('least(bce, bq)')} batch_winsorised from l join bq on uid // {BATCH} = b, q""",
    ("v_ens",),
)
def bce_terms(spark, sf):
    """Losses winsorised at the quantile of the whole cohort, and at that of their training batch."""
    e = v_ens(spark, sf)
    y = F.col("y").cast("double")
    b = F.floor(F.col("uid") / BATCH).alias("b")
    t = e.select("uid", b, bce_from_logit("z", "y").alias("bce"), bce_from_logit(F.col("z") - F.lit(0.3) * (2 * y - 1), "y").alias("m"))
    q = quantiles(t, [], "bce", {"q": 0.9})
    # a batch holds at most 24 scans, and its quantile is a constant of the batch
    t = t.withColumn("bq", F.percentile("bce", 0.9).over(Window.partitionBy("b"))).join(F.broadcast(q))
    capped = {"capped": F.lit(1.0), "winsorised": F.col("q"), "batch_winsorised": F.col("bq")}
    return t.select("uid", r6("bce").alias("bce"), r6("m").alias("margin_bce"), *[r6(F.least("bce", c)).alias(n) for n, c in capped.items()])


@query("channel_select", f"select uid, x, y, {r('max(v)')} peak, {r('avg(v)')} mean from v_vox group by 1, 2, 3", ("v_vox",))
def channel_select(spark, sf):
    """Dropping a channel is a projection; the unused one is never computed."""
    v = v_vox(spark, sf).groupBy("uid", "x", "y").agg(F.max("v").alias("peak"), F.avg("v").alias("mean"), F.sqrt(F.var_pop("v") + 1e-6).alias("sd"))
    return v.drop("sd").select("uid", "x", "y", r6("peak").alias("peak"), r6("mean").alias("mean"))


@query(
    "relabel",
    """with t as (select uid, y, (uid * 7919) % 10 < 3 lesion, uid % 2 donor_y from v_ens) select uid, y, case when lesion then 1 else y end lesioned, greatest(y, cast(donor_y as int)) either, cast(donor_y as int) donor from t""",
    ("v_ens",),
)
def relabel(spark, sf):
    u = F.col("uid")
    donor = (u % 2).cast("int")
    return v_ens(spark, sf).select("uid", "y", F.when((u * 7919) % 10 < 3, 1).otherwise(F.col("y")).alias("lesioned"), F.greatest("y", donor).alias("either"), donor.alias("donor"))


@query(
    "input_compress",
    f"select uid, i, {r('least(v, 1.8)')} capped, {r('ln(1 + v) * 12.0::double / ln(13.0::double)')} logged from v_vox",
    ("v_vox",),
)
def input_compress(spark, sf):
    return v_vox(spark, sf).select("uid", "i", r6(compress_input("v", 1.8)).alias("capped"), r6(compress_input("v", log_scale=True)).alias("logged"))


@query(
    "predicted_score",
    f"""with c as (select member, corr(ln(p/(1-p)), z) rho, avg(-(p.y*ln(p) + (1-p.y)*ln(1-p))) ll from v_preds p join v_ens e using (uid) group by 1)
    select member, {r('0.2313::double + 0.452::double*(1 - rho)')} predicted, {r('regr_slope(ll, 1 - rho) over ()')} refit_slope, {r('regr_intercept(ll, 1 - rho) over ()')} refit_base from c""",
    ("v_preds", "v_ens"),
)
def predicted_score(spark, sf):
    """Score predicted from departure 1 - rho, and the line refitted on the members at hand."""
    from .views import v_ens as ens

    p = v_preds(spark, sf).withColumn("zm", lg("p"))
    term = -(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))
    c = p.join(ens(spark, sf).select("uid", "z"), "uid").groupBy("member").agg(F.corr("zm", "z").alias("rho"), F.avg(term).alias("ll"))
    c = c.withColumn("d", 1 - F.col("rho"))
    line = c.agg(F.regr_slope("ll", "d").alias("s"), F.regr_intercept("ll", "d").alias("b"))
    return c.join(F.broadcast(line)).select("member", r6(F.lit(0.2313) + F.lit(0.452) * F.col("d")).alias("predicted"), r6("s").alias("refit_slope"), r6("b").alias("refit_base"))


