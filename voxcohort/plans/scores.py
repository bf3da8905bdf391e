"""Ensembles, calibration fits and metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import LOGIT_CAP, SLOPES
from ..functions.scalars import bce_from_logit, calibrate, clip_prob, log_loss_term, logit, r6, sigmoid
from ..operators import calibration as cal
from ..operators.cohort import mean_one_weights
from ..operators.ensemble import class_centred_correlation, ensemble_mean, group_dro as dro_step, member_logits, metrics, noisy_or as combine_sides
from ..operators.ranking import auc as auc_of, midranks, quantiles, row_numbers, tile
from ..session import stored
from .registry import query, r
from .sqltext import auc_sql, bce, clip, ll, logit as lsql, newton, settled, sig
from .views import table, v_ens, v_folds, v_preds


@query("ensemble_mean_logit", f"select uid, {r('z')} z, cast(10 as bigint) n_members from v_ens", ("v_ens",))
def ensemble_mean_logit(spark, sf):
    return ensemble_mean(member_logits(v_preds(spark, sf))).withColumn("z", r6("z"))


@query("log_loss", f"select member, {r(ll('p'))} ll from v_preds group by 1", ("v_preds",))
def log_loss(spark, sf):
    return v_preds(spark, sf).groupBy("member").agg(r6(F.avg(log_loss_term("y", "p"))).alias("ll"))


@query("auc", f"select member, {r('auc')} auc from {auc_sql('v_preds', ['member'], 'p')}", ("v_preds",))
def auc(spark, sf):
    return auc_of(v_preds(spark, sf), ["member"], "p", "y").select("member", r6("auc").alias("auc"))


_FLAG = f"""with z as (select uid, y, z from v_ens),
{newton('z', 'fitb', a='0.78::double')}"""


@query(
    "ensemble_report",
    f"""{_FLAG}, c as (select z.uid, y, z, {sig('z')} p, {clip(sig('a*z + b'))} pc, a, b from z cross join fitb)
    select cast(10 as bigint) members, count(*) n, {r(ll('p'))} ll_raw, {r(ll('pc'))} ll_cal, {r('(select auc from ' + auc_sql('z', [], 'z') + ')')} auc,
    {r('stddev_pop(z)')} logit_sd, {r('max(a)')} a, {r('max(b)')} b from c""",
    ("v_ens",),
)
def ensemble_report(spark, sf):
    """Flagship: coverage-checked ensemble, intercept fit at the shipped slope, loss, AUC and spread."""
    e = cal.cut(
        ensemble_mean(member_logits(v_preds(spark, sf)), ["y"]).withColumn("z", F.round("z", 9))
    )
    head = e.agg(F.max("n_members").alias("members"), F.min("n_members").alias("least"), F.count(F.lit(1)).alias("n"), F.stddev_pop("z").alias("sd")).first()
    if head["members"] != head["least"]:
        raise ValueError("some scans are not scored by every member; run coverage_exact_once for the list")
    fit = cal.fit(e, slopes=[0.78], intercept_bounds=(-3.0, 3.0), ready=True).first()
    raw, done = log_loss_term("y", sigmoid("z")), log_loss_term("y", calibrate("z", fit["a"], fit["b"]))
    losses = e.agg(F.avg(raw).alias("ll_raw"), F.avg(done).alias("ll_cal"))
    return losses.join(F.broadcast(auc_of(e, [], "z", "y"))).select(
        F.lit(head["members"]).cast("long").alias("members"), F.lit(head["n"]).cast("long").alias("n"), r6("ll_raw").alias("ll_raw"), r6("ll_cal").alias("ll_cal"), r6("auc").alias("auc"),
        r6(F.lit(head["sd"])).alias("logit_sd"), r6(F.lit(fit["a"])).alias("a"), r6(F.lit(fit["b"])).alias("b"),
    )


_RULES = ("mean_logit", "mean_prob", "median", "trimmed", "mean_rank", "zscore")


@query(
    "aggregator_ladder",
    f"""with m as (select uid, y, member, p, {lsql('p')} z from v_preds),
    k as (select *, rank() over (partition by member order by p) + (count(*) over (partition by member, p) - 1)/2.0::double mr, (z - avg(z) over (partition by member)) / stddev_pop(z) over (partition by member) zs from m),
    s as (select uid, max(y) y, avg(z) mean_logit, avg(p) mean_prob, median(z) median, (sum(z) - max(z) - min(z)) / (count(*) - 2) trimmed, avg(mr) mean_rank, avg(zs) zscore from k group by 1),
    t as ({' union all '.join(f"select '{n}' rule, y, round({n}, 9) score from s" for n in _RULES)})
    select rule, {r('auc')} auc from {auc_sql('t', ['rule'], 'score')}""",
    ("v_preds",),
)
def aggregator_ladder(spark, sf):
    """AUC of six ways to pool the members of a scan; a scan has one row per member of the roster."""
    m = v_preds(spark, sf).withColumn("z", logit("p"))
    ranks = midranks(m, ["member"], "p").select("member", "p", "midrank")
    spread = m.groupBy("member").agg(F.avg("z").alias("mz"), F.stddev_pop("z").alias("sz"))
    k = m.join(ranks, ["member", "p"]).join(stored(spread), "member")
    s = k.groupBy("uid").agg(
        F.max("y").alias("y"), F.avg("z").alias("mean_logit"), F.avg("p").alias("mean_prob"), F.percentile("z", 0.5).alias("median"),
        ((F.sum("z") - F.max("z") - F.min("z")) / (F.count("z") - 2)).alias("trimmed"), F.avg("midrank").alias("mean_rank"),
        F.avg((F.col("z") - F.col("mz")) / F.col("sz")).alias("zscore"),
    )
    t = s.unpivot(["y"], list(_RULES), "rule", "score").withColumn("score", F.round("score", 9))
    return auc_of(t, ["rule"], "score", "y").select("rule", r6("auc").alias("auc"))


@query("platt_fit", f"with {newton('v_ens', 'f')} select {r('a')} a, {r('b')} b, {settled('f')} converged from f", ("v_ens",))
def platt_fit(spark, sf):
    return cal.fit(v_ens(spark, sf)).select(r6("a").alias("a"), r6("b").alias("b"), "converged")


@query("intercept_fit", f"with {newton('v_ens', 'f', a='0.85::double')} select {r('a')} slope, {r('greatest(-3.0::double, least(3.0::double, b))')} b, {settled('f')} converged from f", ("v_ens",))
def intercept_fit(spark, sf):
    return cal.fit(v_ens(spark, sf), slopes=[0.85], intercept_bounds=(-3.0, 3.0)).select(r6("slope").alias("slope"), r6("b").alias("b"), "converged")


_BOUND_A = "greatest(0.2::double, least(3.0::double, a))"


@query(
    "opt_temp_refit",
    f"""with {newton('v_ens', 'f')}, g as (select {_BOUND_A} a from f), {newton('v_ens', 'h', a='(select a from g)')}
    select {r('a')} opt_temp, {r('b')} b, {settled('h')} converged from h""",
    ("v_ens",),
)
def opt_temp_refit(spark, sf):
    """Best slope in (0.2, 3) with the intercept refitted at every slope."""
    t = cal.fit(v_ens(spark, sf), slope_bounds=(0.2, 3.0))
    return t.select(r6("a").alias("opt_temp"), r6("b").alias("b"), "converged")


@query("opt_temp_fixed_b", f"with {newton('v_ens', 'f', b='-0.147824566::double')} select {r(_BOUND_A)} opt_temp, {settled('f')} converged from f", ("v_ens",))
def opt_temp_fixed_b(spark, sf):
    """Best slope with the intercept held at a given value."""
    return cal.fit(v_ens(spark, sf), intercept=-0.147824566, slope_bounds=(0.2, 3.0)).select(r6("a").alias("opt_temp"), "converged")


_SLOPE_SQL = "(select uid, y, z, s.s slope from v_ens cross join (values " + ", ".join(f"({s}::double)" for s in SLOPES) + ") s(s))"


@query(
    "slope_bracket",
    f"""with zs as {_SLOPE_SQL}, n0 as materialized (select distinct slope, 0.0::double b from zs),
    {', '.join(f"n{i} as materialized (select slope, max(b) - sum(p - y)/sum(p*(1-p)) b from (select *, 1/(1+exp(-(slope*z+b))) p from zs join n{i-1} using (slope)) group by 1)" for i in range(1, 13))}
    select slope, {r('max(b)')} intercept, {r(ll(sig('slope*z + b')))} ll, max(abs(b - b0)) < 1e-7 converged from zs join n12 using (slope) join (select slope, b b0 from n11) using (slope) group by 1""",
    ("v_ens",),
)
def slope_bracket(spark, sf):
    e = cal.cut(v_ens(spark, sf).select("uid", "y", "z"))
    t = cal.fit(e, slopes=list(SLOPES), intercept_bounds=(-3.0, 3.0), ready=True)
    return cal.losses(e, t).join(F.broadcast(t.select("slope", "converged")), "slope").select("slope", r6("b").alias("intercept"), r6("ll").alias("ll"), "converged")


@query("logit_spread", f"select {r('stddev_pop(z)')} logit_sd from v_ens", ("v_ens",))
def logit_spread(spark, sf):
    return v_ens(spark, sf).agg(r6(F.stddev_pop("z")).alias("logit_sd"))


@query("fold_metrics", f"select a.member, a.fold, {r('a.auc')} auc, {r('l.ll')} ll, l.n from {auc_sql('v_preds', ['member', 'fold'], 'p')} a join (select member, fold, {ll('p')} ll, count(*) n from v_preds group by 1, 2) l using (member, fold)", ("v_preds",))
def fold_metrics(spark, sf):
    return metrics(v_preds(spark, sf), ["member", "fold"]).select("member", "fold", r6("ll").alias("ll"), r6("auc").alias("auc"), "n")


def _with_teacher(spark, sf):
    """Member logits next to the ensemble logit."""
    return v_preds(spark, sf).withColumn("zm", logit("p")).join(v_ens(spark, sf).select("uid", "z"), "uid")


def _rho_sql(weight: str) -> str:
    return f"""with t as (select member, p.y, {lsql('p')} a, z b from v_preds p join v_ens e using (uid)), w as (select *, {weight} w from t),
    c as (select *, a - sum(w*a) over g / sum(w) over g ca, b - sum(w*b) over g / sum(w) over g cb, count(*) over g k from w window g as (partition by member, y))
    select member, count(*) n, {r('case when count(*) >= 8 then (sum(w*ca*cb)/sum(w)) / (sqrt(sum(w*ca*ca)/sum(w)) * sqrt(sum(w*cb*cb)/sum(w)) + 1e-6) end')} rho from c where k >= 3 group by 1"""


@query("rho_class_centred", _rho_sql("1.0::double"), ("v_preds", "v_ens"))
def rho_class_centred(spark, sf):
    return class_centred_correlation(_with_teacher(spark, sf), ["member"], "zm", "z").withColumn("rho", r6("rho"))


@query("rho_weighted", _rho_sql(f"pow({bce('b')}, 1.5)"), ("v_preds", "v_ens"))
def rho_weighted(spark, sf):
    t = _with_teacher(spark, sf)
    return class_centred_correlation(t, ["member"], "zm", "z", weight=F.pow(bce_from_logit("z", "y"), F.lit(1.5))).withColumn("rho", r6("rho"))


@query(
    "rank_correlation",
    f"""with m as (select a.member, l.ll, -a.auc na from {auc_sql('v_preds', ['member'], 'p')} a join (select member, {ll('p')} ll from v_preds group by 1) l using (member)),
    k as (select *, rank() over (order by ll) + (count(*) over (partition by ll) - 1)/2.0::double ra, rank() over (order by na) + (count(*) over (partition by na) - 1)/2.0::double rb, row_number() over (order by ll, member) pa, row_number() over (order by na, member) pb from m)
    select {r('corr(ra, rb)')} spearman, {r('corr(ll, na)')} pearson, count(*) filter (where pa <= 3 and pb <= 3) top3_overlap from k""",
    ("v_preds",),
)
def rank_correlation(spark, sf):
    m = metrics(v_preds(spark, sf), ["member"]).select("member", "ll", (-F.col("auc")).alias("na"))
    m = cal.cut(m)
    ra, rb = midranks(m, [], "ll").select("ll", F.col("midrank").alias("ra")), midranks(m, [], "na").select("na", F.col("midrank").alias("rb"))
    both = m.join(ra, "ll").join(rb, "na").agg(F.corr("ra", "rb").alias("spearman"), F.corr("ll", "na").alias("pearson"))
    top = m.orderBy("ll", "member").limit(3).select("member").join(m.orderBy("na", "member").limit(3).select("member"), "member", "left_semi")
    return both.join(F.broadcast(top.agg(F.count(F.lit(1)).alias("top3_overlap")))).select(r6("spearman").alias("spearman"), r6("pearson").alias("pearson"), "top3_overlap")


@query(
    "parity_gate",
    f"""with t as (select p, p + 1e-4::double*((uid % 3) - 1) q, 1 - p c from v_preds) select {r('max(abs(p - q))')} worst, {r('corr(p, q)')} rho,
    max(abs(p - q)) < 5e-3 and corr(p, q) > 0.999999 passed, max(abs(p - c)) >= 5e-3 control_differs from t""",
    ("v_preds",),
)
def parity_gate(spark, sf):
    """Same predictions within tolerance, and a perturbed control that must not pass."""
    p = F.col("p")
    q, c = p + F.lit(1e-4) * ((F.col("uid") % 3) - 1), F.lit(1.0) - p
    t = v_preds(spark, sf).select("p", q.alias("q"), c.alias("c"))
    d = t.agg(F.max(F.abs(p - F.col("q"))).alias("d"), F.corr("p", "q").alias("k"), F.max(F.abs(p - F.col("c"))).alias("e"))
    return d.select(r6("d").alias("worst"), r6("k").alias("rho"), ((F.col("d") < 5e-3) & (F.col("k") > 0.999999)).alias("passed"), (F.col("e") >= 5e-3).alias("control_differs"))


@query(
    "row_weights",
    f"""with w as (select uid, (case when cluster in (0, 1, 2, 5, 6) then 2.0::double else 1.0::double end) * (0.5::double + (uid % 4)/4.0::double) raw from v_ens)
    select uid, {r('raw / avg(raw) over ()')} w, count(*) filter (where 0.5::double + (uid % 4)/4.0::double > 1) over () n_up, count(*) filter (where 0.5::double + (uid % 4)/4.0::double < 1) over () n_down from w""",
    ("v_ens",),
)
def row_weights(spark, sf):
    """Product of two weight tables at mean one, with the number of up- and down-weighted rows."""
    e = v_ens(spark, sf).select("uid", "cluster")
    rows = e.select("uid", (F.lit(0.5) + (F.col("uid") % 4) / F.lit(4.0)).alias("rw"))
    joined = e.join(rows, "uid").withColumn("cw", F.when(F.col("cluster").isin(0, 1, 2, 5, 6), F.lit(2.0)).otherwise(F.lit(1.0)))
    counts = rows.agg(F.count_if(F.col("rw") > 1).alias("n_up"), F.count_if(F.col("rw") < 1).alias("n_down"))
    return mean_one_weights(joined, F.col("cw") * F.col("rw")).join(F.broadcast(counts)).select("uid", r6("w").alias("w"), "n_up", "n_down")


@query(
    "group_dro",
    f"""with g as (select cluster, avg({bce('z')}) loss, count(*) n from v_ens group by 1), w as (select *, exp(0.5::double*loss)/8.0::double raw from g), t as (select *, raw / sum(raw) over () w from w)
    select cluster, {r('loss')} loss, {r('w')} w, {r('sum(w*n*loss) over () / sum(w*n) over ()')} weighted_loss from t""",
    ("v_ens",),
)
def group_dro(spark, sf):
    e = v_ens(spark, sf).withColumn("loss", bce_from_logit("z", "y"))
    start = e.select("cluster").distinct().withColumn("w", F.lit(1.0 / 8.0))
    out = dro_step(e, "cluster", start, 0.5)
    return out.select("cluster", r6("loss").alias("loss"), r6("w").alias("w"), r6("weighted_loss").alias("weighted_loss"))


@query("error_concentration", f"""with t as (select uid, z, y, {bce('z')} l from v_ens), k as (select *, row_number() over (order by l desc, uid) rn from t)
    select {r('sum(l) filter (where rn <= 20) / sum(l)')} share_worst20, count(*) filter (where (z > 0) <> (y = 1)) misclassified, {r('sum(l) filter (where (z > 0) <> (y = 1)) / sum(l)')} share_misclassified from k""", ("v_ens",))
def error_concentration(spark, sf):
    t = v_ens(spark, sf).select("uid", "z", "y", bce_from_logit("z", "y").alias("l"))
    worst = t.orderBy(F.desc("l"), "uid").limit(20).agg(F.sum("l").alias("top"))
    wrong = (F.col("z") > 0) != (F.col("y") == 1)
    s = t.agg(F.sum("l").alias("all"), F.count_if(wrong).alias("misclassified"), F.sum(F.when(wrong, F.col("l"))).alias("w"))
    return s.join(F.broadcast(worst)).select(r6(F.col("top") / F.col("all")).alias("share_worst20"), "misclassified", r6(F.col("w") / F.col("all")).alias("share_misclassified"))


@query("logit_tail", f"select member, {r(f'avg(case when abs(1.5::double*{lsql(chr(112))}) > 2 then 1.0::double else 0.0::double end)')} tail from v_preds group by 1", ("v_preds",))
def logit_tail(spark, sf):
    return v_preds(spark, sf).groupBy("member").agg(r6(F.avg((F.abs(F.lit(1.5) * logit("p")) > 2).cast("double"))).alias("tail"))


_VARIANT_SQL = f"""v as (select uid, y, k.variant, z * (1 - 0.15::double*k.variant) + 0.05::double*k.variant*((uid % 5) - 2) z from v_ens cross join (select cast(range as int) variant from range(4)) k)"""


def _variants(spark, sf):
    k = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("variant")
    e = v_ens(spark, sf).select("uid", "y", F.col("z").alias("z0"), k)
    return e.withColumn("z", F.col("z0") * (1 - F.lit(0.15) * F.col("variant")) + F.lit(0.05) * F.col("variant") * ((F.col("uid") % 5) - 2))


@query(
    "variant_degradation",
    f"""with {_VARIANT_SQL}, m as (select a.variant, a.auc, l.ll from {auc_sql('v', ['variant'], 'z')} a join (select variant, {ll(sig('z'))} ll from v group by 1) l using (variant))
    select m.variant, {r('m.ll - n.ll')} d_ll, {r('m.auc - n.auc')} d_auc, {r('avg(m.ll - n.ll) over ()')} mean_d_ll, {r('max(m.ll - n.ll) over ()')} worst_d_ll from m, m n where n.variant = 0 and m.variant > 0""",
    ("v_ens",),
)
def variant_degradation(spark, sf):
    m = cal.cut(metrics(_variants(spark, sf).withColumn("p", sigmoid("z")), ["variant"]).select("variant", "ll", "auc"))
    base = m.where("variant = 0").select(F.col("ll").alias("ll0"), F.col("auc").alias("auc0"))
    d = m.where("variant > 0").join(F.broadcast(base)).select("variant", (F.col("ll") - F.col("ll0")).alias("d"), (F.col("auc") - F.col("auc0")).alias("e"))
    s = d.agg(F.avg("d").alias("m"), F.max("d").alias("w"))
    return d.join(F.broadcast(s)).select("variant", r6("d").alias("d_ll"), r6("e").alias("d_auc"), r6("m").alias("mean_d_ll"), r6("w").alias("worst_d_ll"))


@query("group_holdout", f"select a.cluster, {r('auc')} auc, {r('ll')} ll, n from {auc_sql('v_ens', ['cluster'], 'z')} a join (select cluster, {ll(sig('z'))} ll, count(*) n from v_ens group by 1) l using (cluster)", ("v_ens",))
def group_holdout(spark, sf):
    m = metrics(v_ens(spark, sf).withColumn("p", sigmoid("z")), ["cluster"])
    return m.select("cluster", r6("auc").alias("auc"), r6("ll").alias("ll"), "n")


@query("fold_label_rollup", "select partition, fold, y, count(*) n from v_folds group by rollup(partition, fold, y)", ("v_folds",))
def fold_label_rollup(spark, sf):
    return v_folds(spark, sf).rollup("partition", "fold", "y").agg(F.count(F.lit(1)).alias("n"))


_SIDES = f"select uid, member, case when member < 5 then z + 0.5::double else z - 0.5::double end z from (select uid, member, {lsql('p')} z from v_preds where member in (0, 5))"


@query("noisy_or", f"with s as ({_SIDES}), q as (select uid, 1 - exp(sum(ln(1 - {clip(sig('z'))}))) p from s group by 1) select uid, {r(lsql('p'))} z from q", ("v_preds",))
def noisy_or(spark, sf):
    z = logit("p")
    sides = v_preds(spark, sf).where("member in (0, 5)").select("uid", F.when(F.col("member") < 5, z + F.lit(0.5)).otherwise(z - F.lit(0.5)).alias("z"))
    return combine_sides(sides).withColumn("z", r6("z"))


@query("variant_consistency", f"with {_VARIANT_SQL} select v.variant, {r('avg((v.z - n.z)*(v.z - n.z))')} mse from v join v n on v.uid = n.uid and n.variant = 0 where v.variant > 0 group by 1", ("v_ens",))
def variant_consistency(spark, sf):
    v = _variants(spark, sf)
    native = v_ens(spark, sf).select("uid", F.col("z").alias("n"))
    return v.where("variant > 0").join(native, "uid").groupBy("variant").agg(r6(F.avg((F.col("z") - F.col("n")) * (F.col("z") - F.col("n")))).alias("mse"))


@query("residual_fit", f"select {r('avg(pow(tanh(m.z2) - greatest(-1, least(1, e.y - ' + sig('e.z') + ')), 2))')} mse, {r('avg(abs(e.y - ' + sig('e.z') + '))')} mean_abs_residual from v_ens e join (select uid, {lsql('p')} z2 from v_preds where member = 3) m using (uid)", ("v_preds", "v_ens"))
def residual_fit(spark, sf):
    second = v_preds(spark, sf).where("member = 3").select("uid", logit("p").alias("z2"))
    res = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("y") - sigmoid("z")))
    t = v_ens(spark, sf).join(second, "uid").withColumn("res", res)
    return t.agg(r6(F.avg(F.pow(F.tanh("z2") - F.col("res"), 2))).alias("mse"), r6(F.avg(F.abs("res"))).alias("mean_abs_residual"))


@query(
    "view_aux_loss",
    f"""with t as (select member, {bce('z')} l, 1 + 0.5::double*(case when cluster in (1, 4) then 1 else 0 end) w from (select *, {lsql('p')} z from v_preds)), v as (select member, sum(l*w)/sum(w) wl, avg(l) l from t group by 1)
    select {r('avg(wl)')} weighted_aux, {r('avg(l)')} aux from v""",
    ("v_preds",),
)
def view_aux_loss(spark, sf):
    """Mean over views of the band-weighted cross-entropy; here every member is a view."""
    w = F.lit(1.0) + F.lit(0.5) * F.col("cluster").isin(1, 4).cast("double")
    t = v_preds(spark, sf).withColumn("l", bce_from_logit(logit("p"), "y")).withColumn("w", w)
    v = t.groupBy("member").agg((F.sum(F.col("l") * F.col("w")) / F.sum("w")).alias("wl"), F.avg("l").alias("l"))
    return v.agg(r6(F.avg("wl")).alias("weighted_aux"), r6(F.avg("l")).alias("aux"))


@query("evidence_product", f"select uid, {r('sum(greatest(-6.0::double, least(6.0::double, ' + lsql('p') + ')))')} z_sum, {r('avg(greatest(-6.0::double, least(6.0::double, ' + lsql('p') + ')))')} z_mean from v_preds group by 1", ("v_preds",))
def evidence_product(spark, sf):
    return member_logits(v_preds(spark, sf), LOGIT_CAP).groupBy("uid").agg(r6(F.sum("z")).alias("z_sum"), r6(F.avg("z")).alias("z_mean"))


@query(
    "group_standardise",
    f"""with m as (select uid, y, member, fold, {lsql('p')} z from v_preds), s as (select *, (z - avg(z) over (partition by member, fold)) / stddev_pop(z) over (partition by member, fold) zs from m), e as (select uid, max(y) y, round(avg(zs), 9) z from s group by 1)
    select uid, {r('z')} z, {r('(select auc from ' + auc_sql('e', [], 'z') + ')')} auc from e""",
    ("v_preds",),
)
def group_standardise(spark, sf):
    """Z-score inside every member and fold before the member mean; the statistics are one row per cell."""
    m = member_logits(v_preds(spark, sf), None)
    cells = m.groupBy("member", "fold").agg(F.avg("z").alias("mz"), F.stddev_pop("z").alias("sz"))
    s = m.join(stored(cells), ["member", "fold"]).withColumn("z", (F.col("z") - F.col("mz")) / F.col("sz"))
    e = cal.cut(ensemble_mean(s, ["y"]).withColumn("z", F.round("z", 9)))
    return e.join(F.broadcast(auc_of(e, [], "z", "y"))).select("uid", r6("z").alias("z"), r6("auc").alias("auc"))


@query(
    "robust_scale",
    f"""with t as (select uid, member, fold, {lsql('p')} z from v_preds), q as (select member, quantile_cont(z, 0.5) med, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) iqr from t where fold <> 0 group by 1)
    select uid, member, {r('greatest(-5.0::double, least(5.0::double, (z - med) / greatest(iqr, 1e-3)))')} s from t join q using (member)""",
    ("v_preds",),
)
def robust_scale(spark, sf):
    """Median and quartile range from training rows only, applied to every row."""
    t = member_logits(v_preds(spark, sf), None)
    q = quantiles(t.where("fold <> 0"), ["member"], "z", {"lo": 0.25, "med": 0.5, "hi": 0.75})
    s = (F.col("z") - F.col("med")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-3))
    return t.join(stored(q), "member").select("uid", "member", r6(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), s))).alias("s"))


@query(
    "temperature_ladder",
    f"""with t as (select uid % 3 subset, y, z from v_ens), {newton('t', 'f', group='subset')}, bounded as (select t.*, {_BOUND_A} held from t join f using (subset)), {newton('bounded', 'k', a='held', group='subset')}
    select subset, {r('a')} opt_slope, {r('b')} b, {settled('k', group='subset')} converged from k""",
    ("v_ens",),
)
def temperature_ladder(spark, sf):
    """Optimal slope in (0.2, 3) of the same roster on each evaluation subset."""
    t = v_ens(spark, sf).withColumn("subset", F.col("uid") % 3)
    return cal.fit(t, group="subset", slope_bounds=(0.2, 3.0)).select("subset", r6("a").alias("opt_slope"), r6("b").alias("b"), "converged")


