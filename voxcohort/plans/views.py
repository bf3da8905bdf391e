"""Fixture views over the given tables, once as DataFrames and once as SQL text.

The integer hashes make both engines build identical rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cap_logit, logit
from ..operators.ranking import row_numbers
from ..operators.stencil import by_scan, scan_parts
from ..operators.volumes import voxels

MEMBERS = 10
DIMS = (4, 4, 4)
IMG = (8, 8)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def labelled(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id")


def v_preds(spark, sf) -> DataFrame:
    d = labelled(spark, sf).withColumn(
        "member", F.explode(F.array(*[F.lit(m) for m in range(MEMBERS)]))
    )
    h = (F.col("doc_id") * 7919 + F.col("member") * 104729 + F.col("n_chars") * 31) % 997
    return d.select(
        F.col("doc_id").alias("uid"),
        F.col("quality").alias("y"),
        "member",
        ((F.col("doc_id") * 31 + F.col("member") * 17) % 5).cast("int").alias("fold"),
        (F.substring("source", 4, 9).cast("int") % 8).alias("cluster"),
        ((h + 1 + F.col("quality") * 400).cast("double") / F.lit(1400.0)).alias("p"),
    )


def v_ens(spark, sf) -> DataFrame:
    """Ensemble logit per scan, rounded so ties are the same in every engine."""
    return (
        v_preds(spark, sf)
        .groupBy("uid")
        .agg(
            F.max("y").alias("y"),
            F.max("cluster").alias("cluster"),
            F.round(F.avg(cap_logit(logit("p"), 6.0)), 9).alias("z"),
        )
    )


def v_boxes(spark, sf) -> DataFrame:
    """Array form: one row per scan, x-major, z fastest."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("uid"),
        F.array(*[F.lit(n) for n in DIMS]).alias("dims"),
        F.transform(
            "embedding", lambda v: F.greatest(F.lit(0.0), F.lit(1.0) + F.lit(4.0) * v.cast("double"))
        ).alias("data"),
        "label",
    )


def v_vox(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("uid"), F.posexplode("embedding").alias("i", "e")
    )
    return e.select(
        "uid",
        "i",
        F.floor(F.col("i") / 16).cast("int").alias("x"),
        (F.floor(F.col("i") / 4) % 4).cast("int").alias("y"),
        (F.col("i") % 4).alias("z"),
        F.greatest(F.lit(0.0), F.lit(1.0) + F.lit(4.0) * F.col("e").cast("double")).alias("v"),
    )


def _dealt(spark, sf) -> DataFrame:
    """Arrays by scan, in partitions sized by the voxels they unfold into; the count reads no column."""
    b = v_boxes(spark, sf)
    return by_scan(b.select("uid", "data"), scan_parts(b, math.prod(DIMS)))


def scan_voxels(spark, sf) -> DataFrame:
    """v_vox partitioned by scan: the arrays are shuffled, then unfolded inside their partition."""
    return voxels(_dealt(spark, sf), DIMS)


def scan_image(spark, sf) -> DataFrame:
    """v_img partitioned by scan, again by shuffling arrays instead of pixels."""
    i = F.col("i")
    t = _dealt(spark, sf).select("uid", F.posexplode_outer("data").alias("i", "v"))
    return t.select("uid", F.floor(i / 8).cast("int").alias("x"), (i % 8).alias("y"), "v")


def v_img(spark, sf) -> DataFrame:
    return v_vox(spark, sf).select(
        "uid", F.floor(F.col("i") / 8).cast("int").alias("x"), (F.col("i") % 8).alias("y"), "v"
    )


def v_grid(spark, sf) -> DataFrame:
    """Sparse volumes 32 x 24 x 30; cents are summed as integers so order cannot matter."""
    e = table(spark, sf, "events")
    return (
        e.groupBy(
            F.col("event_type").alias("uid"),
            (F.col("user_id") % 32).cast("int").alias("x"),
            F.hour("ts").alias("y"),
            (F.dayofmonth("ts") - 1).alias("z"),
        )
        .agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.lit(100.0)).alias("v"))
    )


def v_runs(spark, sf) -> DataFrame:
    """Epoch logs: the position of an event within its user is the epoch."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    pos = row_numbers(e, ["run"], ["ts", "event_id"], "rn", carry=("value",))
    return pos.select(
        "run", (F.col("rn") - 1).cast("long").alias("epoch"), (F.col("value") / F.lit(100.0)).alias("ll")
    )


def v_draws(spark, sf, ops: int = 3) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid")).join(
        table(spark, sf, "labels").select(F.col("doc_id").alias("uid")), "uid"
    )
    d = d.withColumn("op", F.explode(F.array(*[F.lit(k + 1) for k in range(ops)])))
    return d.withColumn(
        "u",
        (2 * ((F.col("uid") * 7919 + F.col("op") * 104729) % 9973) + 1).cast("double") / F.lit(19946.0),
    )


def v_folds(spark, sf) -> DataFrame:
    return v_preds(spark, sf).select(
        F.concat(F.lit("part"), F.col("member").cast("string")).alias("partition"), "uid", "fold", "y"
    )


def v_masks(spark, sf) -> DataFrame:
    return v_vox(spark, sf).where("v > 1.0D").select(
        "uid", F.when(F.col("x") < 2, "L").otherwise("R").alias("side"), "x", "y", "z"
    )


def v_pose(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label").withColumn(
        "side", F.explode(F.array(F.lit("L"), F.lit("R")))
    )
    lab = F.col("label")
    return e.select(
        F.col("vec_id").alias("uid"),
        "side",
        F.when(F.col("side") == "L", F.lit(0.75)).otherwise(F.lit(2.4)).alias("cx"),
        F.lit(1.25).alias("cy"),
        F.lit(1.6).alias("cz"),
        (F.lit(0.9) + F.lit(0.3) * (lab % 3)).alias("rx"),
        (F.lit(0.8) + F.lit(0.35) * (lab % 4)).alias("ry"),
        (F.lit(1.0) + F.lit(0.3) * (lab % 2)).alias("rz"),
        (F.lit(0.1) * lab).alias("th"),
    )


def v_affine(spark, sf) -> DataFrame:
    lab = F.col("label")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("uid"),
        (F.lit(0.1) * lab).alias("th"),
        (F.lit(0.25) * (lab % 4)).alias("sx"),
    )


SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_preds": (
        """select d.doc_id uid, l.quality y, m.m member, cast((d.doc_id*31 + m.m*17) % 5 as int) fold,
        cast(substring(d.source, 4) as int) % 8 cluster,
        cast(((d.doc_id*7919 + m.m*104729 + d.n_chars*31) % 997) + 1 + l.quality*400 as double) / 1400.0::double p
        from documents d join labels l on d.doc_id = l.doc_id
        cross join (select cast(range as int) m from range(10)) m""",
        (),
    ),
    "v_ens": (
        """select uid, max(y) y, max(cluster) cluster,
        round(avg(greatest(-6.0::double, least(6.0::double, ln(p / (1 - p))))), 9) z
        from (select uid, y, cluster, greatest(1e-6::double, least(1 - 1e-6::double, p)) p from v_preds) group by uid""",
        ("v_preds",),
    ),
    "v_vox": (
        """select uid, i, i // 16 x, (i // 4) % 4 y, i % 4 z, greatest(0.0::double, 1.0::double + 4.0::double*cast(e as double)) v
        from (select vec_id uid, unnest(embedding) e, cast(unnest(range(64)) as int) i from embeddings)""",
        (),
    ),
    "v_img": ("select uid, i // 8 x, i % 8 y, v from v_vox", ("v_vox",)),
    "v_grid": (
        """select event_type uid, cast(user_id % 32 as int) x, cast(hour(ts) as int) y, cast(day(ts) - 1 as int) z,
        cast(sum(cast(round(value*100) as bigint)) as double) / 100.0::double v from events group by 1, 2, 3, 4""",
        (),
    ),
    "v_runs": (
        """select user_id run, row_number() over (partition by user_id order by ts, event_id) - 1 epoch,
        value / 100.0::double ll from events""",
        (),
    ),
    "v_draws": (
        """select d.doc_id uid, op, cast(2*((d.doc_id*7919 + op*104729) % 9973) + 1 as double) / 19946.0::double u
        from documents d join labels l on d.doc_id = l.doc_id
        cross join (select cast(range + 1 as int) op from range(3))""",
        (),
    ),
    "v_folds": (
        "select 'part' || cast(member as varchar) partition, uid, fold, y from v_preds",
        ("v_preds",),
    ),
    "v_masks": (
        "select uid, case when x < 2 then 'L' else 'R' end side, x, y, z from v_vox where v > 1.0::double",
        ("v_vox",),
    ),
    "v_pose": (
        """select vec_id uid, side, case when side = 'L' then 0.75::double else 2.4::double end cx, 1.25::double cy,
        1.6::double cz, 0.9::double + 0.3::double*(label % 3) rx, 0.8::double + 0.35::double*(label % 4) ry,
        1.0::double + 0.3::double*(label % 2) rz, 0.1::double*label th
        from embeddings cross join (select 'L' side union all select 'R') s""",
        (),
    ),
    "v_affine": (
        "select vec_id uid, 0.1::double*label th, 0.25::double*(label % 4) sx from embeddings",
        (),
    ),
}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix a SELECT with the named views and everything they need."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for need in SQL[name][1]:
            add(need)
        done.append(name)

    for v in views:
        add(v)
    if not done:
        return sql.strip()
    heads = ",\n".join(f"{n} as ({SQL[n][0]})" for n in done)
    body = sql.strip()
    if body[:4].lower() == "with":
        rest = body[4:].lstrip()
        if rest[:9].lower() == "recursive":
            return f"with recursive {heads},\n{rest[9:].lstrip()}"
        return f"with {heads},\n{rest}"
    return f"with {heads}\n{body}"
