"""Scoring arriving scans and monitoring running jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import calibrate, clip_prob
from ..session import scratch_path
from ..sources.files import parse_log


def score_logits(scans: DataFrame, a: float, b: float, cap: float | None) -> DataFrame:
    """Cap, mean over the scan's own logits, calibrate; a row without usable logits is hedged.

    A column expression per row: no statistic over the scored set exists, so batch and stream are the
    same function.
    """
    z = F.filter("logits", lambda v: v.isNotNull() & ~F.isnan(v))
    if cap is not None:
        z = F.transform(z, lambda v: F.greatest(F.lit(-float(cap)), F.least(F.lit(float(cap)), v)))
    ok = (F.size(z) > 0) & (F.size(z) == F.size("logits"))
    mean = F.aggregate(z, F.lit(0.0), lambda s, v: s + v) / F.size(z)
    p = F.when(ok, calibrate(mean, a, b)).otherwise(F.lit(0.5))
    return scans.select("uid", clip_prob(p).alias("p"), F.coalesce(ok, F.lit(False)).alias("ok"))


#: Logical operators that keep every scan alone.
PER_SCAN = frozenset({"Project", "Filter", "Generate", "SubqueryAlias", "View", "StreamingRelation", "StreamingRelationV2", "StreamingExecutionRelation", "LogicalRelation", "LocalRelation", "LogicalRDD"})


def plan_nodes(df: DataFrame) -> list[str]:
    """Names of all operators of the analysed plan."""
    out, todo = [], [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        out.append(node.nodeName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def assert_per_scan(df: DataFrame) -> DataFrame:
    """Refuse a scoring plan with any operator that could mix scans or drop some."""
    other = [n for n in plan_nodes(df) if n.split(" ")[0] not in PER_SCAN]
    if other:
        raise ValueError(f"scoring must treat every scan alone, but the plan has {', '.join(other)}")
    return df


def stream_scores(spark: SparkSession, source: str, schema: str, out: str, a: float, b: float, cap: float | None, checkpoint: str | None = None):
    """File source -> append-only scored Parquet; processes what is available and stops."""
    scored = assert_per_scan(score_logits(spark.readStream.schema(schema).parquet(source), a, b, cap))
    q = (
        scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint or scratch_path(spark, "progress"))
        .trigger(availableNow=True).start(out)
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def monitor_runs(lines: DataFrame) -> DataFrame:
    """Best loss and its earliest epoch per run so far; state is one row per run."""
    e = parse_log(lines).where("kind = 'epoch'")
    g = e.groupBy("member", "fold").agg(F.min(F.struct("ll", "epoch")).alias("best"), F.max("epoch").alias("seen"))
    return g.select("member", "fold", F.col("best.ll").alias("best_ll"), F.col("best.epoch").alias("best_epoch"), "seen")


def stream_monitor(spark: SparkSession, source: str, out: str, checkpoint: str | None = None) -> DataFrame:
    """Update-mode aggregation; each batch's changed runs are written, the last version per run wins."""
    from pyspark.sql import Window

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("version", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/version={epoch}")

    q = (
        monitor_runs(spark.readStream.text(source)).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "progress")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    last = Window.partitionBy("member", "fold").orderBy(F.desc("version"))
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "version")


def score_with(boxes: DataFrame, members: list, fn: Callable[[object, pd.DataFrame, bool], pd.Series], rows: int = 64) -> DataFrame:
    """Apply a user scorer to batches of at most `rows` volumes, both views of every member.

    `fn(member, batch, mirrored)` returns one logit per row. A batch that raises, or answers with another number of rows, is retried
    row by row, so only the failing scans get a NULL logit and ok = false, with the cause in `error`; see hedge_views.
    """

    def one(m, row: pd.DataFrame, mirrored: bool) -> tuple[float | None, str | None]:
        try:
            (z,) = list(fn(m, row, mirrored))
            return float(z), None
        except Exception as e:  # noqa: BLE001 -- hedge only the rows that fail
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), rows):
                pdf = whole.iloc[at : at + rows]
                for m in members:
                    for view, mirrored in ((0, False), (1, True)):
                        try:
                            z = [(float(v), None) for v in fn(m, pdf, mirrored)]
                        except Exception:  # noqa: BLE001
                            z = []
                        if len(z) != len(pdf):
                            z = [one(m, pdf.iloc[i : i + 1], mirrored) for i in range(len(pdf))]
                        yield pd.DataFrame({"uid": pdf["uid"].to_numpy(), "member": m, "view": view, "z": [v for v, _ in z], "ok": [v is not None for v, _ in z], "error": [e for _, e in z]})

    uid = dict(boxes.dtypes)["uid"]
    kind = "string" if isinstance(members[0], str) else "int"
    return boxes.mapInPandas(run, f"uid {uid}, member {kind}, view int, z double, ok boolean, error string")


def hedge_views(views: DataFrame, a: float, b: float, cap: float) -> DataFrame:
    """Per scan: p, ok and the first error. View mean, cap, member mean and calibration; a scan with any failed view is hedged at 0.5, none disappears."""
    z = F.greatest(F.lit(-float(cap)), F.least(F.lit(float(cap)), F.avg("z")))
    m = views.groupBy("uid", "member").agg(z.alias("z"), F.min("ok").alias("ok"), F.min("error").alias("error"))
    g = m.groupBy("uid").agg(F.avg("z").alias("z"), F.min("ok").alias("ok"), F.min("error").alias("error"))
    return g.select("uid", F.when(F.col("ok"), calibrate("z", a, b)).otherwise(F.lit(0.5)).alias("p"), "ok", "error")
