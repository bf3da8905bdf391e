"""Streaming and user-scorer queries; each equals its batch form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.scalars import logit, r6
from ..session import scratch_path
from ..streaming import scoring as sc
from .files import log_lines
from .registry import query, r
from .sqltext import logit as lsql, sig
from .views import v_boxes, v_preds

SCHEMA = "uid long, logits array<double>"


def scan_logits(spark, sf):
    """Arriving rows: the logits of a scan's members as one array; every 50th scan has a NULL among them."""
    z = F.when((F.col("uid") % 50 == 0) & (F.col("member") == 0), F.lit(None).cast("double")).otherwise(logit("p") * 4)
    g = v_preds(spark, sf).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("member", z.alias("z")))).alias("a"))
    return g.select("uid", F.transform("a", lambda s: s["z"]).alias("logits"))


@query("stream_score", f"with s as (select uid, avg(greatest(-6.0::double, least(6.0::double, 4*{lsql('p')}))) z from v_preds group by 1) select uid, {r('case when uid % 50 = 0 then 0.5 else greatest(1e-6::double, least(1 - 1e-6::double, ' + sig('0.78::double*z - 0.1478::double') + ')) end')} p, uid % 50 <> 0 ok from s", ("v_preds",))
def stream_score(spark, sf):
    src, out = scratch_path(spark, "arriving"), scratch_path(spark, "scored")
    scan_logits(spark, sf).repartition(4).write.parquet(src)
    return sc.stream_scores(spark, src, SCHEMA, out, 0.78, -0.1478, 6.0).select("uid", r6("p").alias("p"), "ok")


@query("stream_run_monitor", f"with t as (select run, min((round(ll, 4), epoch)) b, max(epoch) seen from v_runs group by 1) select 'run' || run::varchar member, 0 fold, {r('b[1]')} best_ll, b[2]::int best_epoch, seen::int seen from t", ("v_runs",))
def stream_run_monitor(spark, sf):
    src, out = scratch_path(spark, "lines"), scratch_path(spark, "best")
    log_lines(spark, sf).write.text(src)
    return sc.stream_monitor(spark, src, out).select("member", "fold", r6("best_ll").alias("best_ll"), "best_epoch", "seen")


def toy_scorer(member, batch: pd.DataFrame, mirrored: bool) -> pd.Series:
    """Deterministic stand-in: contrast of the two halves, tilted by member; some scans fail."""
    if (batch["uid"] % 41 == 0).any():
        raise ValueError("unreadable scan")
    v = np.stack(batch["data"].to_numpy())
    left, right = v[:, :32].mean(1), v[:, 32:].mean(1)
    a, b = (right, left) if mirrored else (left, right)
    return pd.Series((a * (1 + 0.1 * member) - b) * 4.0)


@query(
    "score_with",
    f"""with h as (select uid, avg(v) filter (where x < 2) l, avg(v) filter (where x >= 2) r from v_vox group by 1), z as (select uid, member, ((l*(1 + 0.1::double*member) - r)*4 + (r*(1 + 0.1::double*member) - l)*4)/2 z from h cross join (select cast(range as int) member from range(3)))
    select uid, {r('case when uid % 41 = 0 then 0.5 else greatest(1e-6::double, least(1 - 1e-6::double, ' + sig('0.85::double*avg(greatest(-6.0::double, least(6.0::double, z)))') + ')) end')} p, uid % 41 <> 0 ok from z group by 1""",
    ("v_vox",),
)
def score_with(spark, sf):
    """User scorer per member on both views, then view mean, cap, member mean and calibration; failed scans are hedged."""
    views = sc.score_with(v_boxes(spark, sf).select("uid", "data"), [0, 1, 2], toy_scorer)
    return sc.hedge_views(views, 0.85, 0.0, 6.0).select("uid", r6("p").alias("p"), "ok")
