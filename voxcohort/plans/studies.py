"""Comparisons, resampling and audits over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import poisson1_sql, uniform, uniform_sql
from ..functions.scalars import calibrate, log_loss_term, logit, r6, sigmoid
from ..operators import calibration as cal
from ..operators.ensemble import ensemble_mean, member_logits, metrics
from ..operators.ranking import auc as auc_of, row_numbers, tile
from ..operators.study import bootstrap_deltas, covariance_gap, covariances, epps_pulley, logistic_fits, permuted
from ..session import stored
from .registry import query, r
from .sqltext import auc_sql, clip, ll, logistic_sql, logit as lsql, newton, sig
from .views import table, v_boxes, v_ens, v_preds

DIM = 64


@query(
    "group_covariance_gap",
    f"""with v as (select vec_id, label, unnest(embedding) e, unnest(range({DIM})) i from embeddings),
    c as (select a.label, a.i, b.i j, covar_samp(a.e::double, b.e::double) c from v a join v b on a.vec_id = b.vec_id group by 1, 2, 3 having count(*) >= 3),
    p as (select a.label la, b.label lb, avg((a.c - b.c)*(a.c - b.c)) d from c a join c b on a.i = b.i and a.j = b.j and a.label < b.label group by 1, 2)
    select (select count(distinct label) from c) n_groups, {r('1e6*avg(d)')} gap_e6 from p""",
)
def group_covariance_gap(spark, sf):
    c = covariances(table(spark, sf, "embeddings"), "label", "embedding")
    return covariance_gap(c, "label", DIM).select(F.col("groups").alias("n_groups"), r6(F.col("gap") * 1e6).alias("gap_e6"))


def _direction_sql(k: str, i: str) -> str:
    return f"sqrt(-2*ln({uniform_sql(chr(39) + 'dir' + chr(39), k, i, '0')})) * cos(6.283185307179586::double*{uniform_sql(chr(39) + 'dir' + chr(39), k, i, '1')})"


@query(
    "isotropy_score",
    f"""with v as (select vec_id, unnest(embedding)::double e, unnest(range({DIM})) i from embeddings), c as (select *, e - avg(e) over (partition by i) h from v),
    u0 as (select k, i, {_direction_sql('k', 'i')} g from (select range k from range(4)) cross join (select range i from range({DIM}))), u as (select k, i, g / sqrt(sum(g*g) over (partition by k)) u from u0),
    p as (select k, vec_id, 3*sum(h*u) x from c join u using (i) group by 1, 2), n as (select k, count(*) n, avg(exp(-x*x/4)) g from p group by 1),
    d as (select a.k, avg(exp(-(a.x - b.x)*(a.x - b.x)/2)) m from p a join p b on a.k = b.k group by 1)
    select k, n, {r('m - sqrt(2.0::double)*g + 1/sqrt(3.0::double)')} distance from d join n using (k)""",
)
def isotropy_score(spark, sf):
    """Centre features, project on seeded unit directions, measure the distance of each projection to N(0, 1)."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).withColumn("e", F.col("e").cast("double"))
    mean = e.groupBy("i").agg(F.avg("e").alias("m"))
    i = F.explode(F.sequence(F.lit(0), F.lit(DIM - 1))).alias("i")
    grid = spark.range(4).select(F.col("id").alias("k"), i)
    two_pi = F.lit(6.283185307179586)
    g = F.sqrt(F.lit(-2.0) * F.log(uniform(F.lit("dir"), F.col("k"), F.col("i"), F.lit(0)))) * F.cos(two_pi * uniform(F.lit("dir"), F.col("k"), F.col("i"), F.lit(1)))
    u = grid.withColumn("g", g)
    norm = u.groupBy("k").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))
    u = u.join(norm, "k").select("k", "i", (F.col("g") / F.col("norm")).alias("u"))
    # one row per dimension, and per dimension and direction
    p = e.join(F.broadcast(mean), "i").join(F.broadcast(u), "i").groupBy("vec_id", "k").agg((3 * F.sum((F.col("e") - F.col("m")) * F.col("u"))).alias("v"))
    return epps_pulley(p, "v", "k").select("k", "n", r6("distance").alias("distance"))


_ARMS = f"select uid, max(y) y, round(avg(z) filter (where member < 5), 9) a, round(avg(z) filter (where member >= 5), 9) b from (select uid, y, member, {lsql('p')} z from v_preds) group by 1"


def _arms(spark, sf):
    m = member_logits(v_preds(spark, sf), None)
    side = F.col("member") < 5
    return m.groupBy("uid").agg(F.max("y").alias("y"), F.round(F.avg(F.when(side, F.col("z"))), 9).alias("a"), F.round(F.avg(F.when(~side, F.col("z"))), 9).alias("b"))


REPS = 200
_HALVES = 50


@query(
    "paired_bootstrap",
    f"""with t as ({_ARMS}), w as (select rep, y, a, b, {poisson1_sql(uniform_sql('uid', "'boot'", 'rep'))} w from t cross join (select range rep from range({REPS}))),
    l as (select rep, sum(w*(y*ln({clip(sig('a'))}) + (1-y)*ln(1-{clip(sig('a'))}) - y*ln({clip(sig('b'))}) - (1-y)*ln(1-{clip(sig('b'))}))) / sum(w) d_ll from w group by 1),
    x as (select p.rep, sum(p.w*n.w*(case when p.a > n.a then 1.0::double when p.a = n.a then 0.5::double else 0.0::double end)) / sum(p.w*n.w) auc_a, sum(p.w*n.w*(case when p.b > n.b then 1.0::double when p.b = n.b then 0.5::double else 0.0::double end)) / sum(p.w*n.w) auc_b
      from w p join w n on p.rep = n.rep and p.y = 1 and n.y = 0 group by 1), d as (select d_ll, auc_b - auc_a d_auc from l join x using (rep))
    select {r('avg(d_ll)')} d_ll, {r('stddev_samp(d_ll)')} se_ll, {r('avg(d_auc)')} d_auc, {r('stddev_samp(d_auc)')} se_auc, {r('avg(case when d_auc > 0 then 1.0::double else 0.0::double end)')} p_auc_up, {r('quantile_cont(d_auc, 0.025)')} lo, {r('quantile_cont(d_auc, 0.975)')} hi from d""",
    ("v_preds",),
)
def paired_bootstrap(spark, sf):
    d = cal.cut(bootstrap_deltas(_arms(spark, sf), "a", "b", "y", REPS, "boot"))
    return d.agg(
        r6(F.avg("d_ll")).alias("d_ll"), r6(F.stddev_samp("d_ll")).alias("se_ll"), r6(F.avg("d_auc")).alias("d_auc"), r6(F.stddev_samp("d_auc")).alias("se_auc"),
        r6(F.avg((F.col("d_auc") > 0).cast("double"))).alias("p_auc_up"), r6(F.percentile("d_auc", 0.025)).alias("lo"), r6(F.percentile("d_auc", 0.975)).alias("hi"),
    )


_HALF = f"""h as (select rep, uid, y, z, row_number() over (partition by rep, y order by {uniform_sql('uid', "'half'", 'rep')}, uid) % 2 half from v_ens cross join (select range rep from range({_HALVES})))"""


def _halves(ens, reps: int):
    """(rep, uid, y, z, half) of every scan in every replicate: odd and even places of a seeded order within each class.

    The score rides along with the order. Joined back by scan, the scans would be taken for as few as they are before the replicates unfold them, and all be broadcast.
    """
    rep = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep")
    e = ens.select("uid", "y", "z", rep).withColumn("h", uniform(F.col("uid"), F.lit("half"), F.col("rep")))
    return row_numbers(e, ["rep", "y"], ["h", "uid"], carry=("z",)).select("rep", "uid", "y", "z", (F.col("rn") % 2).alias("half"))


@query(
    "split_half",
    f"""with {_HALF}, fitrows as (select * from h where half = 1), {newton('fitrows', 'f', group='rep')},
    bounded as (select r.*, greatest(0.2::double, least(3.0::double, a)) held from fitrows r join f using (rep)), {newton('bounded', 'k', a='held', group='rep')}
    select rep, count(*) n, {r('max(a)')} a, {r('max(b)')} b, {r(ll(sig('a*z + b')))} ll_fit, {r(ll(sig('z')))} ll_raw from h join k using (rep) where half = 0 group by 1""",
    ("v_ens",),
)
def split_half(spark, sf):
    """Fit on one class-stratified half, score on the other, repeated.

    The slope is bounded because a half may be separable, and then no finite optimum exists.
    """
    t = cal.cut(_halves(v_ens(spark, sf), _HALVES))
    fits = cal.fit(t.where("half = 1"), group="rep", slope_bounds=(0.2, 3.0), ready=True)
    s = cal.losses(t.where("half = 0"), fits, "rep")
    raw = t.where("half = 0").groupBy("rep").agg(F.avg(log_loss_term("y", sigmoid("z"))).alias("raw"))
    return s.join(raw, "rep").select("rep", "n", r6("a").alias("a"), r6("b").alias("b"), r6("ll").alias("ll_fit"), r6("raw").alias("ll_raw"))


_EDITS = ("base", "remove", "perfect", "half")


@query(
    "whatif_remove_fix",
    f"""with t as (select uid, y, z, (z > 0) <> (y = 1) and uid % 2 = 0 edited, case when y = 1 then 4.0::double else -4.0::double end target from v_ens),
    e as (select 'base' edit, uid, y, z from t union all select 'remove', uid, y, z from t where not edited union all select 'perfect', uid, y, case when edited then target else z end from t union all select 'half', uid, y, case when edited then (z + target)/2 else z end from t)
    select a.edit, {r('auc')} auc, {r('ll')} ll, n from {auc_sql('e', ['edit'], 'z')} a join (select edit, {ll(sig('z'))} ll, count(*) n from e group by 1) l using (edit)""",
    ("v_ens",),
)
def whatif_remove_fix(spark, sf):
    t = v_ens(spark, sf)
    edits = t.where(((F.col("z") > 0) != (F.col("y") == 1)) & (F.col("uid") % 2 == 0)).select("uid", F.when(F.col("y") == 1, F.lit(4.0)).otherwise(F.lit(-4.0)).alias("target"))
    j = t.join(edits, "uid", "left").select("uid", "y", "z", "target", F.explode(F.array(*[F.lit(k) for k in _EDITS])).alias("edit"))
    hit = F.col("target").isNotNull()
    z = F.when((F.col("edit") == "perfect") & hit, F.col("target")).when((F.col("edit") == "half") & hit, (F.col("z") + F.col("target")) / 2).otherwise(F.col("z"))
    j = j.where(~((F.col("edit") == "remove") & hit)).withColumn("z", z).withColumn("p", sigmoid("z"))
    m = j.groupBy("edit").agg(F.avg(log_loss_term("y", "p")).alias("ll"), F.count(F.lit(1)).alias("n")).join(auc_of(j, ["edit"], "z", "y"), "edit")
    return m.select("edit", r6("auc").alias("auc"), r6("ll").alias("ll"), "n")


@query(
    "stratum_pair_auc",
    f"""with t as (select uid, y, z, ntile(3) over (partition by y order by (uid*7919) % 997, uid) tercile from v_ens), s as (select k.k stratum, y, z from t cross join (select cast(range + 1 as int) k from range(3)) k where y = 0 or tercile = k.k)
    select stratum, {r('auc')} auc from {auc_sql('s', ['stratum'], 'z')}""",
    ("v_ens",),
)
def stratum_pair_auc(spark, sf):
    """AUC over the pairs whose positive lies in one severity tercile."""
    e = v_ens(spark, sf).withColumn("sev", (F.col("uid") * 7919) % 997)
    t = row_numbers(e, ["y"], ["sev", "uid"]).select("uid", tile("rn", "n", 3).alias("tercile"))
    j = e.join(t, "uid")
    every = F.array(F.lit(1), F.lit(2), F.lit(3))
    s = j.select("y", "z", F.explode(F.when(F.col("y") == 0, every).otherwise(F.array("tercile"))).alias("stratum"))
    return auc_of(s, ["stratum"], "z", "y").select("stratum", r6("auc").alias("auc"))


@query("reweight_ess", f"with t as (select y, {sig('z')} p, exp(-0.3::double*abs(z)) w from v_ens) select {r(f'sum(w*-(y*ln({clip(chr(112))}) + (1-y)*ln(1-{clip(chr(112))})))/sum(w)')} ll, {r('sum(w)*sum(w)/sum(w*w)')} ess, {r('sum(w)*sum(w)/sum(w*w)/count(*)')} ess_share from t", ("v_ens",))
def reweight_ess(spark, sf):
    w = F.exp(F.lit(-0.3) * F.abs("z"))
    t = v_ens(spark, sf).select(w.alias("w"), log_loss_term("y", sigmoid("z")).alias("l"))
    ess = F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))
    return t.agg(r6(F.sum(F.col("w") * F.col("l")) / F.sum("w")).alias("ll"), r6(ess).alias("ess"), r6(ess / F.count(F.lit(1))).alias("ess_share"))


@query(
    "three_seed_verdict",
    f"""with t as (select k.k arm, member seed, fold, y, {lsql('p')}*(1 - 0.2::double*k.k) + 0.02::double*k.k*member - 0.1::double zc, {lsql('p')} z from v_preds cross join (select cast(range + 1 as int) k from range(3)) k where member < 3),
    d as (select arm, seed, fold, {ll(sig('zc'))} - {ll(sig('z'))} d from t group by 1, 2, 3), s as (select arm, seed, avg(d) d from d group by 1, 2),
    f as (select arm, min(d) < -0.010 and max(d) > 0.010 conflict from d group by 1)
    select s.arm, {r('avg(s.d)')} mean_delta, greatest(count(*) filter (where s.d > 0), count(*) filter (where s.d < 0)) same_sign, {r('3*stddev_samp(s.d)/sqrt(count(*))')} bar, max(f.conflict) fold_conflict,
    avg(s.d) < 0 and abs(avg(s.d)) > 3*stddev_samp(s.d)/sqrt(count(*)) and count(*) filter (where s.d < 0) = count(*) and not max(f.conflict) ship from s join f using (arm) group by 1""",
    ("v_preds",),
)
def three_seed_verdict(spark, sf):
    """Ship an arm only if every seed improves, the mean clears three standard errors and no folds disagree."""
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("arm")
    t = v_preds(spark, sf).where("member < 3").select(F.col("member").alias("seed"), "fold", "y", logit("p").alias("z"), k)
    zc = F.col("z") * (1 - F.lit(0.2) * F.col("arm")) + F.lit(0.02) * F.col("arm") * F.col("seed") - F.lit(0.1)
    d = t.groupBy("arm", "seed", "fold").agg((F.avg(log_loss_term("y", sigmoid(zc))) - F.avg(log_loss_term("y", sigmoid("z")))).alias("d"))
    s = d.groupBy("arm", "seed").agg(F.avg("d").alias("d"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    g = s.groupBy("arm").agg(
        F.avg("d").alias("m"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), (3 * F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("bar"),
        ((F.min("lo") < -0.010) & (F.max("hi") > 0.010)).alias("fold_conflict"), F.count(F.lit(1)).alias("n"),
    )
    ship = (F.col("m") < 0) & (F.abs("m") > F.col("bar")) & (F.col("down") == F.col("n")) & ~F.col("fold_conflict")
    return g.select("arm", r6("m").alias("mean_delta"), F.greatest("up", "down").alias("same_sign"), r6("bar").alias("bar"), "fold_conflict", ship.alias("ship"))


_PERM = 100


@query(
    "residual_auc",
    f"""with t as (select e.uid, e.y, e.z, {lsql('p')} reader from v_ens e join v_preds p on e.uid = p.uid and p.member = 7),
    a as (select y, uid, row_number() over (partition by y, rep order by {uniform_sql('uid', "'perm' || cast(rep as varchar)", "'to'")}, uid) rn, rep from t cross join (select range + 1 rep from range({_PERM}))),
    b as (select y, reader, row_number() over (partition by y, rep order by {uniform_sql('uid', "'perm' || cast(rep as varchar)", "'from'")}, uid) rn, rep from t cross join (select range + 1 rep from range({_PERM}))),
    alls as (select 0 rep, y, z, reader from t union all select a.rep, a.y, t.z, b.reader from a join b using (y, rn, rep) join t on t.uid = a.uid),
    c as (select rep, y, covar_pop(reader, z)*count(*) cv, var_pop(z)*count(*) vz from alls group by 1, 2), s as (select rep, sum(cv)/sum(vz) slope from c group by 1),
    q as (select rep, y, round(reader - slope*z, 9) res from alls join s using (rep)) select cast(rep as int) rep, {r('auc')} auc from {auc_sql('q', ['rep'], 'res')}""",
    ("v_ens", "v_preds"),
)
def residual_auc(spark, sf):
    """AUC of a second reader after removing its within-class dependence on the reference; rep > 0 is the null."""
    second = v_preds(spark, sf).where("member = 7").select("uid", logit("p").alias("second"))
    t = cal.cut(v_ens(spark, sf).select("uid", "y", "z").join(second, "uid"))
    reps = t.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(_PERM))))
    null = permuted(reps, ["rep", "y"], "second", F.concat(F.lit("perm"), F.col("rep").cast("string")))
    sets = cal.cut(t.withColumn("rep", F.lit(0)).unionByName(null))
    c = sets.groupBy("rep", "y").agg((F.covar_pop("second", "z") * F.count(F.lit(1))).alias("cv"), (F.var_pop("z") * F.count(F.lit(1))).alias("vz"))
    slope = c.groupBy("rep").agg((F.sum("cv") / F.sum("vz")).alias("slope"))
    q = sets.join(stored(slope), "rep").withColumn("res", F.round(F.col("second") - F.col("slope") * F.col("z"), 9))
    return auc_of(q, ["rep"], "res", "y").select("rep", r6("auc").alias("auc"))


_POOLS = {"core": 6, "plus2": 8, "plus4": 10}


@query(
    "pool_addition",
    f"""with m as (select uid, y, member, {lsql('p')} z from v_preds), e as ({' union all '.join(f"select '{n}' pool, uid, max(y) y, round(avg(z), 9) z from m where member < {k} group by 2" for n, k in _POOLS.items())}),
    s as (select pool, auc, ll from {auc_sql('e', ['pool'], 'z')} a join (select pool, {ll(sig('z'))} ll from e group by 1) l using (pool))
    select s.pool, {r('s.auc - c.auc')} d_auc, {r('s.ll - c.ll')} d_ll from s, s c where c.pool = 'core' and s.pool <> 'core'""",
    ("v_preds",),
)
def pool_addition(spark, sf):
    m = member_logits(v_preds(spark, sf), None)
    wide = m.groupBy("uid").agg(F.max("y").alias("y"), *[F.round(F.avg(F.when(F.col("member") < k, F.col("z"))), 9).alias(n) for n, k in _POOLS.items()])
    e = wide.unpivot(["uid", "y"], list(_POOLS), "pool", "z").withColumn("p", sigmoid("z"))
    s = cal.cut(e.groupBy("pool").agg(F.avg(log_loss_term("y", "p")).alias("ll")).join(auc_of(e, ["pool"], "z", "y"), "pool"))
    core = s.where("pool = 'core'").select(F.col("auc").alias("a0"), F.col("ll").alias("l0"))
    return s.where("pool <> 'core'").join(F.broadcast(core)).select("pool", r6(F.col("auc") - F.col("a0")).alias("d_auc"), r6(F.col("ll") - F.col("l0")).alias("d_ll"))


@query(
    "epoch_average",
    f"""with t as (select uid, member epoch, {lsql('p')}*(1 + 0.1::double*member) z from v_preds), s as (select *, z / stddev_pop(z) over (partition by epoch) zs from t),
    m as (select uid, avg({sig('z')}) filter (where epoch >= 5) prob_late, avg(z) filter (where epoch >= 5) logit_late, avg(zs) filter (where epoch >= 5) scaled_late,
    sum(z*pow(0.5::double, 9 - epoch)*(case when epoch = 0 then 1.0::double else 0.5::double end)) ema from s group by 1)
    select uid, {r('prob_late')} prob_late, {r('logit_late')} logit_late, {r('scaled_late')} scaled_late, {r('ema')} ema from m""",
    ("v_preds",),
)
def epoch_average(spark, sf):
    """Average predictions over late epochs four ways; here a member stands for an epoch of one run.

    The exponential average folds the epoch-ordered array of a scan, whose length is the epoch count.
    """
    t = v_preds(spark, sf).select("uid", F.col("member").alias("epoch"), (logit("p") * (1 + F.lit(0.1) * F.col("member"))).alias("z"))
    sd = t.groupBy("epoch").agg(F.stddev_pop("z").alias("sd"))
    late = F.col("epoch") >= 5
    g = t.join(stored(sd), "epoch").groupBy("uid").agg(
        F.avg(F.when(late, sigmoid("z"))).alias("prob_late"), F.avg(F.when(late, F.col("z"))).alias("logit_late"), F.avg(F.when(late, F.col("z") / F.col("sd"))).alias("scaled_late"),
        F.array_sort(F.collect_list(F.struct("epoch", "z"))).alias("path"),
    )
    start = F.element_at("path", 1)["z"]
    ema = F.aggregate(F.slice("path", 2, F.size("path")), start, lambda acc, s: acc * 0.5 + s["z"] * 0.5)
    return g.select("uid", r6("prob_late").alias("prob_late"), r6("logit_late").alias("logit_late"), r6("scaled_late").alias("scaled_late"), r6(ema).alias("ema"))


@query(
    "nested_routing",
    f"""with f as (select uid, max(y) y, max(cluster) cluster, avg(z) filter (where member < 5) a, avg(z) filter (where member >= 5) b from (select *, {lsql('p')} z from v_preds) group by 1),
    c as (select k.w, cluster, sum(-(y*ln({clip(sig('w*a + (1-w)*b'))}) + (1-y)*ln(1-{clip(sig('w*a + (1-w)*b'))}))) s, count(*) n from f cross join (select range/4.0::double w from range(5)) k group by 1, 2),
    h as (select g.cluster, c.w, sum(c.s)/sum(c.n) ll from (select distinct cluster from c) g join c on c.cluster <> g.cluster group by 1, 2), b as (select *, row_number() over (partition by cluster order by round(ll, 9), w) rn from h)
    select b.cluster, b.w, {r('c.s/c.n')} ll_held_out from b join c on b.cluster = c.cluster and b.w = c.w where rn = 1""",
    ("v_preds",),
)
def nested_routing(spark, sf):
    """Family weight per cluster, chosen with that cluster held out.

    The held-out loss is total minus the cluster's own sum, so every candidate is evaluated once.
    """
    m = member_logits(v_preds(spark, sf), None)
    side = F.col("member") < 5
    f = m.groupBy("uid").agg(F.max("y").alias("y"), F.max("cluster").alias("cluster"), F.avg(F.when(side, F.col("z"))).alias("a"), F.avg(F.when(~side, F.col("z"))).alias("b"))
    ws = F.explode(F.array(*[F.lit(k / 4.0) for k in range(5)])).alias("w")
    t = f.select("y", "cluster", "a", "b", ws)
    z = F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b")
    c = cal.cut(t.groupBy("w", "cluster").agg(F.sum(log_loss_term("y", sigmoid(z))).alias("s"), F.count(F.lit(1)).alias("n")))
    tot = c.groupBy("w").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    h = c.join(tot, "w").withColumn("out", F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 9))
    best = h.groupBy("cluster").agg(F.min(F.struct("out", "w", (F.col("s") / F.col("n")).alias("own"))).alias("b"))
    return best.select("cluster", "b.w", r6("b.own").alias("ll_held_out"))


_AUDIT = f"""ft as (select e.uid, e.y, e.z, max({lsql('p')}) filter (where member = 2) f1, max({lsql('p')}) filter (where member = 8) f2 from v_ens e join v_preds p on p.uid = e.uid where member in (2, 8) group by 1, 2, 3),
    pt as (select uid, y, z, row_number() over (order by {uniform_sql('uid', "'audit'", "'to'")}, uid) rn from ft), pf as (select f1, f2, row_number() over (order by {uniform_sql('uid', "'audit'", "'from'")}, uid) rn from ft),
    ks as (select uid, y, z, f1, f2, 'block' kind from ft union all select uid, y, z, f1, f2, 'permuted' from pt join pf using (rn) union all select uid, y, z, 0.0::double, 0.0::double, 'z_only' from ft),
    rows_ as materialized (select *, kind || '-' || cast(seed as varchar) fit, cast(floor({uniform_sql('uid', "'audit'", 'seed')}*10) as int) fold from ks cross join (select range seed from range(3)))"""


@query(
    "feature_block_audit",
    f"""with {_AUDIT}, {logistic_sql('rows_', 'm', ['z', 'f1', 'f2'])}, sc as (select kind, seed, y, round(b0 + b1*z + b2*f1 + b3*f2, 9) score from rows_ join m on rows_.fit = m.fit and rows_.fold = m.model)
    select kind, {r('avg(auc)')} auc from {auc_sql('sc', ['kind', 'seed'], 'score')} group by 1""",
    ("v_ens", "v_preds"),
)
def feature_block_audit(spark, sf):
    """Out-of-fold logistic model on [z, block] against the same model on a row-permuted block."""
    e = v_ens(spark, sf).select("uid", "y", "z")
    second = v_preds(spark, sf).where("member in (2, 8)").groupBy("uid").agg(
        F.max(F.when(F.col("member") == 2, logit("p"))).alias("f1"), F.max(F.when(F.col("member") == 8, logit("p"))).alias("f2")
    )
    t = cal.cut(e.join(second, "uid").withColumn("block", F.struct("f1", "f2")))
    null = permuted(t.drop("f1", "f2"), [], "block", "audit")
    both = t.select("uid", "y", "z", "block", F.lit("block").alias("kind")).unionByName(null.select("uid", "y", "z", "block", F.lit("permuted").alias("kind")))
    base = t.select("uid", "y", "z", F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("f2")).alias("block"), F.lit("z_only").alias("kind"))
    seeds = F.explode(F.array(*[F.lit(s) for s in range(3)])).alias("seed")
    rows = both.unionByName(base).select("uid", "y", "z", "kind", F.col("block.f1").alias("f1"), F.col("block.f2").alias("f2"), seeds)
    rows = rows.withColumn("fold", F.floor(uniform(F.col("uid"), F.lit("audit"), F.col("seed")) * 10).cast("int")).withColumn("fit", F.concat_ws("-", "kind", "seed"))
    scored = logistic_fits(rows, "fit", "fold", ["z", "f1", "f2"], "y", ridge=1e-3).withColumn("score", F.round("score", 9))
    m = auc_of(scored, ["kind", "seed"], "score", "y").groupBy("kind").agg(F.avg("auc").alias("auc"))
    return m.select("kind", r6("auc").alias("auc"))


def _probe(spark, sf):
    """Summary features of real scans and of scans with a synthetic gain."""
    b = v_boxes(spark, sf).select("uid", F.explode(F.array(F.lit(0), F.lit(1))).alias("synthetic"), "data")
    d = F.when((F.col("synthetic") == 1), F.transform("data", lambda v: F.least(v * 1.05, F.lit(2.5)))).otherwise(F.col("data"))
    b = b.select("uid", "synthetic", d.alias("data"))
    n = F.size("data")
    mean = F.aggregate("data", F.lit(0.0), lambda a, v: a + v) / n
    return b.select(
        "uid", "synthetic", F.round(mean, 9).alias("mean"), F.round(F.array_max("data"), 9).alias("top"),
        F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v * v) / n - mean * mean, 9).alias("variance"),
    )


_FEATS = ("mean", "top", "variance")


@query(
    "separability_probe",
    f"""with g as (select uid, s.s synthetic, case when s.s = 1 then least(v*1.05::double, 2.5::double) else v end v from v_vox cross join (select cast(range as int) s from range(2)) s),
    f as (select uid, synthetic y, round(avg(v), 9) mean, round(max(v), 9) top, round(avg(v*v) - avg(v)*avg(v), 9) variance from g group by 1, 2), t as ({' union all '.join(f"select '{n}' feature, y, {n} score from f" for n in _FEATS)})
    select feature, {r('auc')} auc from {auc_sql('t', ['feature'], 'score')}""",
    ("v_vox",),
)
def separability_probe(spark, sf):
    f = _probe(spark, sf).unpivot(["synthetic"], list(_FEATS), "feature", "score")
    return auc_of(f, ["feature"], "score", "synthetic").select("feature", r6("auc").alias("auc"))


@query(
    "separability_probe_fit",
    f"""with g as (select uid, s.s synthetic, case when s.s = 1 then least(v*1.05::double, 2.5::double) else v end v from v_vox cross join (select cast(range as int) s from range(2)) s),
    f as materialized (select uid, synthetic y, 'probe' fit, cast(uid % 5 as int) fold, round(avg(v), 9) mean, round(max(v), 9) top, round(avg(v*v) - avg(v)*avg(v), 9) variance from g group by 1, 2), {logistic_sql('f', 'm', list(_FEATS))},
    sc as (select y, round(b0 + b1*mean + b2*top + b3*variance, 9) score from f join m on f.fit = m.fit and f.fold = m.model) select 'probe' feature, {r('auc')} auc from {auc_sql('sc', [], 'score')}""",
    ("v_vox",),
)
def separability_probe_fit(spark, sf):
    """The same question asked of a fitted probe, out of fold."""
    f = _probe(spark, sf).withColumn("fold", (F.col("uid") % 5).cast("int")).withColumn("fit", F.lit("probe"))
    scored = logistic_fits(f, "fit", "fold", list(_FEATS), "synthetic", ridge=1e-3).withColumn("score", F.round("score", 9))
    return auc_of(scored, [], "score", "synthetic").select(F.lit("probe").alias("feature"), r6("auc").alias("auc"))


