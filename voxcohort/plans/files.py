"""Files written from the tables, read back through the cohort readers, and the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import calibrate, r6
from ..operators.masks import missing_scans, union_sides
from ..operators.ranking import row_numbers
from ..session import scratch_path
from ..sources import files as fs
from .registry import query, r
from .sqltext import sig
from .views import table, v_boxes, v_ens, v_folds, v_masks, v_pose, v_preds, v_runs

CHUNK = 4096


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))


@query("src_manifest", "select doc_id uid, 0.5::double is_pathologic from documents")
def src_manifest(spark, sf):
    path = scratch_path(spark, "format")
    _docs(spark, sf).withColumn("is_pathologic", F.lit(0.5)).write.csv(path, header=True)
    return fs.read_list(spark, path, "uid long, is_pathologic double")


@query("src_uids", "select cast(doc_id as varchar) uid, row_number() over (order by doc_id) - 1 as row from documents")
def src_uids(spark, sf):
    """The row number is stored in the file; it is never taken from the position of a line."""
    path = scratch_path(spark, "uids")
    row_numbers(_docs(spark, sf), [], ["uid"]).select("uid", (F.col("rn") - 1).alias("row")).write.csv(path, header=True)
    return fs.read_list(spark, path, "uid string, row long")


@query("src_folds", "select partition, uid, case when substr(partition, 5)::int < 5 then y end as label, fold from v_folds", ("v_folds",))
def src_folds(spark, sf):
    a, b = scratch_path(spark, "labelled"), scratch_path(spark, "plain")
    f = v_folds(spark, sf).withColumn("k", F.substring("partition", 5, 9).cast("int"))
    f.where("k < 5").select("partition", "uid", F.col("y").alias("label"), "fold").write.partitionBy("partition").csv(a, header=True)
    f.where("k >= 5").select("partition", "uid", "fold").write.partitionBy("partition").csv(b, header=True)
    return fs.read_folds(spark, a, b)


@query("src_labels", "select doc_id uid, quality is_pathologic from labels")
def src_labels(spark, sf):
    path = scratch_path(spark, "labels")
    table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), F.col("quality").alias("is_pathologic")).write.csv(path, header=True)
    return fs.read_list(spark, path, "uid long, is_pathologic int")


@query("src_scan_listing")
def src_scan_listing(spark, sf):
    """Names and sizes of the files of a folder, here the table files themselves."""
    return fs.list_scans(spark, sf, ".parquet")


@query("src_boxes", f"select uid, 64 n, {r('sum(v)')} total from v_vox group by 1", ("v_vox",))
def src_boxes(spark, sf):
    path = scratch_path(spark, "boxes")
    v_boxes(spark, sf).select("uid", "dims", "data").write.parquet(path)
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    return fs.read_boxes(spark, path).select("uid", F.size("data").alias("n"), r6(total).alias("total"))


@query("src_masks", "with m as (select * from v_masks where uid % 9 <> 0) select (select count(*) from (select distinct uid, x, y, z from m)) voxels, (select count(distinct uid) from v_vox) - (select count(distinct uid) from m) missing", ("v_masks", "v_vox"))
def src_masks(spark, sf):
    path = scratch_path(spark, "masks")
    v_masks(spark, sf).where("uid % 9 <> 0").write.partitionBy("side").parquet(path)
    m = spark.read.schema("uid long, x int, y int, z int, side string").parquet(path)
    scans = v_boxes(spark, sf).select("uid")
    n = union_sides(m).agg(F.count(F.lit(1)).alias("voxels"))
    return n.join(F.broadcast(missing_scans(scans, m).agg(F.count(F.lit(1)).alias("missing"))))


@query("src_preds", f"select uid, member, fold, {r('p')} p from v_preds where member = 3 and fold in (1, 2)", ("v_preds",))
def src_preds(spark, sf):
    """Long prediction table partitioned by member, footing and fold; other partitions are never opened."""
    path = scratch_path(spark, "preds")
    v_preds(spark, sf).select("uid", "p", "member", F.lit("best").alias("footing"), "fold").hint("rebalance", "member", "fold").write.partitionBy("member", "footing", "fold").parquet(path)
    t = spark.read.schema("uid long, p double, member int, footing string, fold int").parquet(path)
    return t.where("footing = 'best' and member = 3 and fold in (1, 2)").select("uid", "member", "fold", r6("p").alias("p"))


@query("src_recipe", "select 'roster' as name, 'm' || member::varchar member, member seed, 'part' || member::varchar || '.csv' splits, 'rot_deg' as key, '31.7' as value, 0.78::double slope from (select distinct member from v_preds)", ("v_preds",))
def src_recipe(spark, sf):
    """Members and shared settings of a recipe; a setting outside the known fields is dropped."""
    path = scratch_path(spark, "recipe")
    name = F.col("member").cast("string")
    one = v_preds(spark, sf).select("member").distinct().groupBy().agg(
        F.collect_list(F.struct(F.concat(F.lit("m"), name).alias("member"), F.col("member").alias("seed"), F.concat(F.lit("part"), name, F.lit(".csv")).alias("splits"))).alias("members")
    )
    one = one.select(
        F.lit("roster").alias("name"), "members", F.create_map(F.lit("rot_deg"), F.lit("31.7"), F.lit("retired_knob"), F.lit("1")).alias("shared_recipe"),
        F.struct(F.lit(0.78).alias("slope"), F.lit(-0.1478).alias("intercept"), F.lit(6.0).alias("member_logit_cap")).alias("calibration"),
    )
    one.coalesce(1).write.json(path)
    members, shared = fs.read_recipe(spark, path, ["rot_deg", "zoom"])
    return members.join(shared, "name").select("name", "member", "seed", "splits", "key", "value", "calibration.slope")


_LL = "avg(-(y*ln(p) + (1 - y)*ln(1 - p)))"


@query("src_run_manifest", f"select 'm' || member::varchar member, fold, {r(_LL)} ll from v_preds group by 1, 2", ("v_preds",))
def src_run_manifest(spark, sf):
    path = scratch_path(spark, "manifests")
    y = F.col("y")
    per = v_preds(spark, sf).groupBy("member", "fold").agg(F.avg(-(y * F.log("p") + (1 - y) * F.log(1 - F.col("p")))).alias("ll"))
    m = per.groupBy("member").agg(F.sort_array(F.collect_list(F.struct("fold", "ll"))).alias("results"))
    m.select(F.concat(F.lit("m"), F.col("member").cast("string")).alias("member"), F.create_map(F.lit("aug"), F.lit("std")).alias("recipe"), "results").write.json(path)
    return fs.read_manifests(spark, path).select("member", "fold", r6("ll").alias("ll"))


def log_lines(spark, sf):
    """Log text from the run table, with two lines of no numeric form per run."""
    t = v_runs(spark, sf)
    head = F.concat(F.lit("[run"), F.col("run").cast("string"), F.lit(" f0] "))
    line = F.concat(head, F.lit("ep"), F.format_string("%02d", F.col("epoch").cast("int")), F.lit(" val ll "), F.format_string("%.4f", "ll"), F.lit(" auc 0.9000 (best "), F.format_string("%.4f", "ll"), F.lit("@"), F.col("epoch").cast("string"), F.lit(")"))
    body = t.select(line.alias("value"))
    other = t.where("epoch = 0").select(F.concat(head, F.lit("weights averaged and statistics renewed")).alias("value"))
    done = t.where("epoch = 1").select(F.concat(head, F.lit("done 61.9 min: ll "), F.format_string("%.4f", "ll"), F.lit(" auc 0.9823")).alias("value"))
    return body.unionByName(other).unionByName(done)


@query(
    "src_run_log",
    f"""with l as (select 'epoch' kind, 'run' || run::varchar member, 0 fold, epoch::int epoch, ll from v_runs union all select 'done', 'run' || run::varchar, 0, null, ll from v_runs where epoch = 1 union all select 'other', null, null, null, null from v_runs where epoch = 0)
    select kind, member, fold, epoch, {r('ll')} ll from l""",
    ("v_runs",),
)
def src_run_log(spark, sf):
    path = scratch_path(spark, "logs")
    log_lines(spark, sf).write.text(path)
    return fs.parse_log(spark.read.text(path)).select("kind", "member", "fold", "epoch", r6("ll").alias("ll"))


@query("src_history", f"select run, epoch, {r('ll')} ll, {r('1 - ll')} auc from v_runs", ("v_runs",))
def src_history(spark, sf):
    """Histories stored as arrays in chunks of epochs, so a very long run is many bounded rows."""
    path = scratch_path(spark, "history")
    t = v_runs(spark, sf).withColumn("first", F.floor(F.col("epoch") / CHUNK) * CHUNK)
    packed = F.array_sort(F.collect_list(F.struct("epoch", "ll")))
    h = t.groupBy("run", "first").agg(packed.alias("h")).select("run", "first", F.transform("h", lambda e: F.struct(e["ll"].alias("ll"), (1 - e["ll"]).alias("auc"))).alias("history"))
    h.write.parquet(path)
    return fs.read_history(spark, path).select("run", "epoch", r6("ll").alias("ll"), r6("auc").alias("auc"))


@query("sink_submission", f"select d.doc_id uid, {r('greatest(1e-6::double, least(1 - 1e-6::double, coalesce(' + sig('0.78::double*z - 0.1478::double') + ', 0.5)))')} is_pathologic from documents d left join v_ens e on d.doc_id = e.uid", ("v_ens",))
def sink_submission(spark, sf):
    path = scratch_path(spark, "submission")
    preds = v_ens(spark, sf).select("uid", calibrate("z", 0.78, -0.1478).alias("p"))
    fs.submission(_docs(spark, sf), preds).select("uid", "is_pathologic").write.csv(path, header=True)
    return fs.read_list(spark, path, "uid long, is_pathologic double").select("uid", r6("is_pathologic").alias("is_pathologic"))


@query("sink_calibration", f"select {r('stddev_pop(z)')} a, {r('avg(z)')} b, cast(null as double) cap, false gland_removal from v_ens", ("v_ens",))
def sink_calibration(spark, sf):
    """One-row JSON; a reader treats an absent key as off."""
    path = scratch_path(spark, "calibration")
    v_ens(spark, sf).agg(F.stddev_pop("z").alias("a"), F.avg("z").alias("b")).write.json(path)
    return fs.read_calibration(spark, path).select(r6("a").alias("a"), r6("b").alias("b"), "cap", "gland_removal")


@query("upsert_annotations", f"select uid, side, {r('cx')} cx, {r('rx')} rx from v_pose where uid % 4 <> 1 union all select uid, 'L', {r('cx + 0.5')}, {r('rx')} from v_pose where uid % 4 = 1 and side = 'L'", ("v_pose",))
def upsert_annotations(spark, sf):
    old, new = scratch_path(spark, "annotations"), scratch_path(spark, "annotations-next")
    p = v_pose(spark, sf).select("uid", "side", "cx", "rx")
    p.write.parquet(old)
    incoming = p.where("uid % 4 = 1 and side = 'L'").withColumn("cx", F.col("cx") + 0.5)
    fs.upsert(spark.read.parquet(old), incoming).write.parquet(new)
    return spark.read.parquet(new).select("uid", "side", r6("cx").alias("cx"), r6("rx").alias("rx"))


@query("artifact_manifest", "select 'member=' || member::varchar as name, case when member = 3 then 'differ' when member = 5 then 'only_left' else 'equal' end state from (select distinct member from v_preds)", ("v_preds",))
def artifact_manifest(spark, sf):
    """Checksums of written artefacts against a second writing in which one member changed. A member has several writers, and not the same ones twice."""
    one, two = scratch_path(spark, "a"), scratch_path(spark, "b")
    line = F.concat_ws(",", F.col("uid").cast("string"), F.round("p", 6).cast("string"))
    t = v_preds(spark, sf)
    t.repartition("member", F.col("uid") % 3).select("member", line.alias("value")).write.partitionBy("member").text(one)
    bump = F.when(F.col("member") == 3, F.concat(line, F.lit("!"))).otherwise(line)
    t.where("member <> 5").repartition("member", F.col("uid") % 2).select("member", bump.alias("value")).write.partitionBy("member").text(two)
    roots = lambda p: fs.content_roots(spark.read.text(p).select(F.concat(F.lit("member="), F.col("member").cast("string")).alias("name"), "value"))
    return fs.compare_listings(roots(one), roots(two))


@query("write_box_cache", f"with m as (select uid, count(*) mask_voxels from v_masks group by 1) select v.uid, {r('sum(v)')} total, coalesce(max(m.mask_voxels), 0) mask_voxels from v_vox v left join m using (uid) group by 1", ("v_vox", "v_masks"))
def write_box_cache(spark, sf):
    """Boxes and masks in one pass; the second call only writes what an interrupted first one left out."""
    path = scratch_path(spark, "cache")
    m = v_masks(spark, sf).groupBy("uid").agg(F.collect_list(F.struct("side", "x", "y", "z")).alias("mask"))
    b = v_boxes(spark, sf).select("uid", "dims", "data").join(m, "uid", "left")
    fs.write_cache(b.where("uid % 3 = 0"), path)
    fs.write_cache(b, path, existing=spark.read.parquet(path))
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    return fs.read_boxes(spark, path).select("uid", r6(total).alias("total"), F.coalesce(F.size("mask"), F.lit(0)).cast("long").alias("mask_voxels"))


@query("resume_pending", "select m.member, f.fold from (select distinct member from v_preds) m cross join (select distinct fold from v_preds) f where (m.member + f.fold) % 4 = 0", ("v_preds",))
def resume_pending(spark, sf):
    p = v_preds(spark, sf).select("member", "fold").distinct()
    return fs.pending(p, 5, p.where((F.col("member") + F.col("fold")) % 4 != 0))


