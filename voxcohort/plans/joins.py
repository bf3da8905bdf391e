"""Joins between scan lists, labels, folds and prediction tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.constants import HARD_CLUSTERS
from ..functions.draws import uniform, uniform_sql
from ..functions.scalars import calibrate, log_loss_term, logit, r6, softplus
from ..operators.cohort import alignment, coverage, folds_of, mean_one_weights, pair_arms, small_list
from ..operators.ensemble import metrics
from ..operators.ranking import row_numbers, tile
from ..session import stored
from .registry import query, r
from .sqltext import auc_sql, ll, logit as lsql, sig
from .views import labelled, table, v_boxes, v_ens, v_folds, v_preds

BATCH = 24


@query(
    "fold_join",
    "select d.doc_id uid, f.fold, f.fold is null missing from documents d left join (select * from v_folds where partition = 'part3') f on d.doc_id = f.uid",
    ("v_folds",),
)
def fold_join(spark, sf):
    scans = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    folds = v_folds(spark, sf).where("partition = 'part3'").select("uid", "fold")
    return folds_of(scans, folds).select("uid", "fold", F.col("fold").isNull().alias("missing"))


@query(
    "label_alignment",
    """select partition, count(*) n, count(*) filter (where f.y <> l.toxic) disagree, count(*) filter (where f.y <> l.quality) = 0 aligned, count(*) filter (where l.doc_id is null) missing, true checked
    from v_folds f left join labels l on f.uid = l.doc_id group by 1
    union all select partition || '-plain', count(*), 0, true, count(*) filter (where l.doc_id is null), false from v_folds f left join labels l on f.uid = l.doc_id group by 1""",
    ("v_folds",),
)
def label_alignment(spark, sf):
    """Disagreements of every list with two label sets; a list that carries no label has nothing to disagree with, and says so."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), "toxic", "quality")
    folds = v_folds(spark, sf)
    plain = folds.drop("y").withColumn("partition", F.concat("partition", F.lit("-plain")))
    rows = [alignment(f, lab, "y", "toxic", ["partition"]).withColumnRenamed("aligned", "_").join(
        alignment(f, lab, "y", "quality", ["partition"]).select("partition", "aligned"), "partition") for f in (folds, plain)]
    return rows[0].unionByName(rows[1]).select("partition", "n", "disagree", "aligned", "missing", "checked")


@query(
    "cluster_weights",
    f"""with w as (select uid, cluster, case when cluster in {HARD_CLUSTERS} then 3.0::double else 1.0::double end raw from v_ens)
    select uid, cluster, {r('raw / avg(raw) over ()')} w from w""",
    ("v_ens",),
)
def cluster_weights(spark, sf):
    lookup = spark.createDataFrame([(c, 3.0) for c in HARD_CLUSTERS], "cluster int, hard double")
    scans = v_ens(spark, sf).select("uid", "cluster").join(F.broadcast(lookup), "cluster", "left")
    return mean_one_weights(scans, F.coalesce("hard", F.lit(1.0))).select("uid", "cluster", r6("w").alias("w"))


@query("preds_labels", f"select p.uid, p.member, l.quality, {r('p')} p from v_preds p join labels l on p.uid = l.doc_id", ("v_preds",))
def preds_labels(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), "quality")
    return v_preds(spark, sf).drop("y").join(lab, "uid").select("uid", "member", "quality", r6("p").alias("p"))


@query(
    "score_submission",
    f"""with s as (select uid, y, {sig('0.85::double*z')} p from v_ens) select {r(ll('p'))} ll, {r('(select auc from ' + auc_sql('s', [], 'p') + ')')} auc,
    count(*) n, {r('min(p)')} p_min, {r('max(p)')} p_max from s""",
    ("v_ens",),
)
def score_submission(spark, sf):
    sub = v_ens(spark, sf).select("uid", calibrate("z", 0.85, 0.0).alias("p"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), F.col("quality").alias("y"))
    s = sub.join(lab, "uid")
    rng = s.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return metrics(s, []).join(F.broadcast(rng)).select(r6("ll").alias("ll"), r6("auc").alias("auc"), "n", r6("lo").alias("p_min"), r6("hi").alias("p_max"))


@query(
    "leakfree_model",
    f"""with m as (select p.uid, p.member, k.k fold, p.p*(0.9::double + 0.02::double*k.k) p from v_preds p cross join (select cast(range as int) k from range(5)) k)
    select m.uid, m.member, m.fold, {r('m.p')} p from m join v_folds f on f.partition = 'part' || cast(m.member as varchar) and f.uid = m.uid and f.fold = m.fold""",
    ("v_preds", "v_folds"),
)
def leakfree_model(spark, sf):
    """Of the five fold models of a member, keep for each scan the one that did not train on it."""
    k = F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("fold")
    every = v_preds(spark, sf).select("uid", "member", "p", k).withColumn("p", F.col("p") * (F.lit(0.9) + F.lit(0.02) * F.col("fold")))
    every = every.withColumn("partition", F.concat(F.lit("part"), F.col("member").cast("string")))
    return every.join(v_folds(spark, sf).select("partition", "uid", "fold"), ["partition", "uid", "fold"]).select("uid", "member", "fold", r6("p").alias("p"))


EXPERT = "select doc_id uid from labels where toxic = 0"


@query("expert_minus_holdout", f"select uid, uid % 10 = 3 in_random from ({EXPERT}) where uid not in (select doc_id from documents where source = 'src3')")
def expert_minus_holdout(spark, sf):
    expert = table(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").alias("uid"))
    holdout = table(spark, sf, "documents").where("source = 'src3'").select(F.col("doc_id").alias("uid"))
    return expert.join(holdout, "uid", "left_anti").select("uid", (F.col("uid") % 10 == 3).alias("in_random"))


@query("random_in_expert", f"select doc_id uid from documents where {uniform_sql('doc_id', chr(39) + 'sample' + chr(39))} < 0.3 and doc_id in ({EXPERT})")
def random_in_expert(spark, sf):
    sample = table(spark, sf, "documents").select(F.col("doc_id").alias("uid")).where(uniform(F.col("uid"), F.lit("sample")) < 0.3)
    expert = table(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").alias("uid"))
    return sample.join(expert, "uid", "left_semi")


@query(
    "coverage_exact_once",
    """with d as (select uid, member from v_preds where (uid + member) % 97 <> 0 union all select uid, member from v_preds where (uid*3 + member) % 89 = 0),
    s as (select distinct uid from v_preds), e as (select s.uid, m.m member from s cross join (select cast(range as int) m from range(10)) m)
    select e.uid, e.member, count(d.uid) n from e left join d on e.uid = d.uid and e.member = d.member group by 1, 2 having count(d.uid) <> 1""",
    ("v_preds",),
)
def coverage_exact_once(spark, sf):
    p = v_preds(spark, sf).select("uid", "member")
    damaged = p.where((F.col("uid") + F.col("member")) % 97 != 0).unionByName(p.where((F.col("uid") * 3 + F.col("member")) % 89 == 0))
    scans = labelled(spark, sf).select(F.col("doc_id").alias("uid"))
    return coverage(damaged, scans, small_list(p, "member"))


@query(
    "pair_join",
    f"""with t as (select uid // {BATCH} batch, member, y, {lsql('p')} z from v_preds)
    select a.member, a.batch, count(*) n_pairs, {r(f'avg(ln(1 + exp(-(a.z - b.z) / 0.5::double)))')} rank_loss, {r('avg(a.z - b.z)')} margin, {r('avg(greatest(0, 0.5::double - (a.z - b.z)))')} hinge, {r('avg(case when a.z > b.z then 1.0::double when a.z = b.z then 0.5::double else 0.0::double end)')} pair_auc from t a join t b on a.member = b.member and a.batch = b.batch and a.y = 1 and b.y = 0 group by 1, 2""",
    ("v_preds",),
)
def pair_join(spark, sf):
    """Ranking loss, mean margin, hinge and AUC over positive x negative pairs inside a batch.

    A batch holds at most 24 scans by construction (row div 24), so both logit lists are short arrays
    and the pair sum is folded inside the row; no pair rows exist. Cohort-wide pair counts come from
    the sorted AUC instead.
    """
    t = v_preds(spark, sf).select(F.floor(F.col("uid") / BATCH).alias("batch"), "member", "y", logit("p").alias("z"))
    g = t.groupBy("member", "batch").agg(
        F.collect_list(F.when(F.col("y") == 1, F.col("z"))).alias("pos"), F.collect_list(F.when(F.col("y") == 0, F.col("z"))).alias("neg")
    ).where((F.size("pos") > 0) & (F.size("neg") > 0))
    over = lambda f: F.aggregate("pos", F.lit(0.0), lambda acc, p: acc + F.aggregate("neg", F.lit(0.0), lambda s, n: s + f(p - n)))
    n = (F.size("pos") * F.size("neg")).cast("long")
    win = lambda d: F.when(d > 0, F.lit(1.0)).when(d == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    kinds = {"rank_loss": lambda d: softplus(-d / F.lit(0.5)), "margin": lambda d: d, "hinge": lambda d: F.greatest(F.lit(0.0), F.lit(0.5) - d), "pair_auc": win}
    return g.select("member", "batch", n.alias("n_pairs"), *[r6(over(f) / n).alias(k) for k, f in kinds.items()])


@query(
    "donor_pairing",
    f"""with t as (select uid, uid // {BATCH} batch, row_number() over (partition by uid // {BATCH} order by {uniform_sql('uid', "'donor'", "3")}, uid) - 1 k, count(*) over (partition by uid // {BATCH}) n from v_ens)
    select a.uid, b.uid donor from t a join t b on a.batch = b.batch and b.k = (a.k + 1) % a.n""",
    ("v_ens",),
)
def donor_pairing(spark, sf):
    """Partner by a seeded cyclic shift inside each batch of at most 24 scans."""
    e = labelled(spark, sf).select(F.col("doc_id").alias("uid"))
    t = e.withColumn("batch", F.floor(F.col("uid") / BATCH)).withColumn("h", uniform(F.col("uid"), F.lit("donor"), F.lit(3)))
    w = Window.partitionBy("batch").orderBy("h", "uid")
    first = F.first("uid").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return t.select("uid", F.coalesce(F.lead("uid", 1).over(w), first).alias("donor"))


@query(
    "matched_null",
    f"""with t as (select uid, y, z, (uid * 7919) % 20 = 0 treated, ntile(3) over (partition by y order by z, uid) cell from v_ens),
    c as (select y, cell, count(*) n from t where treated group by 1, 2),
    k as (select uid, y, cell, row_number() over (partition by y, cell order by {uniform_sql('uid', "'null'")}, uid) rn from t where not treated)
    select k.uid, k.y, k.cell from k join c using (y, cell) where rn <= n""",
    ("v_ens",),
)
def matched_null(spark, sf):
    """Random controls with the treated set's size in every class x severity-tercile cell."""
    e = v_ens(spark, sf)
    pos = row_numbers(e, ["y"], ["z", "uid"])
    t = pos.select("uid", "y", tile("rn", "n", 3).alias("cell"), ((F.col("uid") * 7919) % 20 == 0).alias("treated"))
    size = t.where("treated").groupBy("y", "cell").agg(F.count(F.lit(1)).alias("want"))
    pool = t.where("not treated").withColumn("h", uniform(F.col("uid"), F.lit("null")))
    ranked = row_numbers(pool, ["y", "cell"], ["h", "uid"])
    # six cells of known size: the engine broadcasts them
    return ranked.join(stored(size), ["y", "cell"]).where("rn <= want").select("uid", "y", "cell")


@query(
    "paired_arms",
    f"""with a as (select member, fold, uid, p from v_preds where (uid + member) % 13 <> 0), b as (select member, fold, uid, p*0.97::double p from v_preds where (uid + member) % 17 <> 0)
    select coalesce(a.member, b.member) member, count(*) filter (where a.p is not null and b.p is not null) matched, count(*) filter (where b.p is null) arm_only, count(*) filter (where a.p is null) control_only,
    {r('max(abs(a.p - b.p))')} worst, {r('avg(a.p - b.p)')} mean_delta from a full join b on a.member = b.member and a.fold = b.fold and a.uid = b.uid group by 1""",
    ("v_preds",),
)
def paired_arms(spark, sf):
    p = v_preds(spark, sf)
    arm = p.where((F.col("uid") + F.col("member")) % 13 != 0)
    control = p.where((F.col("uid") + F.col("member")) % 17 != 0).withColumn("p", F.col("p") * 0.97)
    j = pair_arms(arm, control, ["member", "fold", "uid"], "p")
    d = F.col("arm") - F.col("control")
    return j.groupBy("member").agg(
        F.count_if("matched").alias("matched"), F.count_if(F.col("control").isNull()).alias("arm_only"), F.count_if(F.col("arm").isNull()).alias("control_only"),
        r6(F.max(F.abs(d))).alias("worst"), r6(F.avg(d)).alias("mean_delta"),
    )


@query(
    "cache_verify",
    f"""with c as (select uid, corr(v, cast(round(v * 4) as double)) rho from v_vox group by 1) select uid, {r('rho')} rho, {r('min(rho) over ()')} worst, min(rho) over () > 0.95::double passed from c""",
    ("v_vox",),
)
def cache_verify(spark, sf):
    """Rebuilt against stored volume, joined as arrays: the shuffle carries compact rows, not voxels."""
    kept = v_boxes(spark, sf).select("uid", "data")
    rebuilt = kept.select("uid", F.transform("data", lambda v: F.round(v * 4)).alias("again"))
    pairs = kept.join(rebuilt, "uid").select("uid", F.explode(F.arrays_zip("data", "again")).alias("t"))
    c = pairs.groupBy("uid").agg(F.corr("t.data", "t.again").alias("rho"))
    worst = c.agg(F.min("rho").alias("worst"))
    return c.join(F.broadcast(worst)).select("uid", r6("rho").alias("rho"), r6("worst").alias("worst"), (F.col("worst") > 0.95).alias("passed"))


@query(
    "rank_shift",
    f"""with s as (select member, cluster < 4 public, {ll('p')} ll from v_preds group by 1, 2), k as (select member, public, ll, rank() over (partition by public order by ll) rk from s)
    select a.member, a.rk rank_public, b.rk rank_private, a.rk - b.rk moved, {r('b.ll - a.ll')} drift from k a join k b on a.member = b.member and a.public and not b.public""",
    ("v_preds",),
)
def rank_shift(spark, sf):
    """Rank movement between two boards; the window runs over the roster, one row per entrant and board."""
    s = v_preds(spark, sf).groupBy("member", (F.col("cluster") < 4).alias("public")).agg(F.avg(log_loss_term("y", "p")).alias("ll"))
    k = s.withColumn("rk", F.rank().over(Window.partitionBy("public").orderBy("ll")).cast("long"))
    g = k.groupBy("member").agg(
        F.max(F.when(F.col("public"), F.col("rk"))).alias("rank_public"), F.max(F.when(~F.col("public"), F.col("rk"))).alias("rank_private"),
        F.max(F.when(F.col("public"), F.col("ll"))).alias("a"), F.max(F.when(~F.col("public"), F.col("ll"))).alias("b"),
    ).where("a is not null and b is not null")
    return g.select("member", "rank_public", "rank_private", (F.col("rank_public") - F.col("rank_private")).alias("moved"), r6(F.col("b") - F.col("a")).alias("drift"))
