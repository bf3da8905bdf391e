"""Physical plans: what is pruned, what is pushed down and what moves."""

import re

from pyspark.sql import functions as F

from voxcohort.operators import stencil
from voxcohort.operators.geometry import resample
from voxcohort.operators.stencil import frame
from voxcohort.operators.study import permuted
from voxcohort.plans import files, maps, ordering, probabilities, studies, views, voxels
from voxcohort.sources.files import list_scans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"^[^\n]*Exchange ", plan(df).split("== Initial Plan ==")[0], re.M))


def test_stencils_shuffle_arrays_once(spark):
    t = frame(views.scan_image(spark, SF), ["x", "y"], "v", F.max, 2)
    text = plan(t)
    assert exchanges(t) == 1 and text.index("Generate") < text.index("Exchange")
    assert exchanges(ordering.row_frame_filter(spark, SF)) == 1
    assert exchanges(voxels.gaussian_smooth(spark, SF)) == 0


def test_scan_local_operators_do_not_shuffle(spark):
    for q in (voxels.brain_mean_normalise, voxels.quantile_family, voxels.background_subtract, maps.peak_map, maps.axis_views, maps.through_plane_stats, probabilities.rel_threshold):
        assert exchanges(q(spark, SF)) <= (1 if q in (maps.through_plane_stats,) else 0), q.__name__


def test_resampling_reads_its_own_row(spark):
    b = views.v_boxes(spark, SF).select("uid", "data")
    assert exchanges(resample(b, views.DIMS, (F.col("x") + 0.25, F.col("y"), F.col("z")))) == 0


def test_prediction_partitions_are_pruned(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        text = files.src_preds(spark, SF)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", text).group(1)
    assert all(c in filters for c in ("footing", "member", "fold"))


def test_listing_never_reads_content(spark):
    text = plan(list_scans(spark, SF, ".parquet"))
    assert "content" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_only_needed_columns_are_read(spark):
    text = plan(views.v_ens(spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("text" not in s and "toxic" not in s for s in schemas)


def test_replicates_are_not_joined_back_by_scan(spark):
    """Rows unfolded into replicates are estimated as before they were, so a join by scan would broadcast them all."""
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "uid long, y int, z double")
    halves = studies._halves(df, 3)
    reps = df.withColumns({"second": -F.col("z"), "rep": F.explode(F.sequence(F.lit(1), F.lit(3)))})
    moved = permuted(reps, ["rep", "y"], "second", "s")
    for d in (halves, moved):
        assert not [line for line in re.findall(r"^.*Join .*$", plan(d), re.M) if "uid" in line]
    assert halves.where("y = cast(uid % 2 as int) and z = uid").groupBy("rep", "y").agg(F.sum("half").alias("odd"), F.count("*").alias("n")).where("odd = 5 and n = 10").count() == 6
    assert moved.columns == ["rep", "y", "uid", "z", "second"] and moved.where("z = uid").count() == 60


def test_losses_are_winsorised_over_the_whole_cohort(spark):
    """One quantile for all scans, and beside it one per batch of neighbouring ids."""
    got = probabilities.bce_terms(spark, SF).toPandas()
    over = got.bce.quantile(0.9)
    assert (got.winsorised - got.bce.clip(upper=over)).abs().max() < 2e-6
    per = got.groupby(got.uid // probabilities.BATCH).bce.transform(lambda x: x.quantile(0.9))
    assert (got.batch_winsorised - got.bce.clip(upper=per)).abs().max() < 2e-6
    assert ((got.winsorised - got.batch_winsorised).abs() > 1e-3).any()


def test_partitions_of_scans_do_not_grow_with_the_table(spark, monkeypatch):
    """More scans make more partitions, not larger ones."""
    monkeypatch.setattr(stencil, "SCAN_ROWS", 640)
    n = views.v_boxes(spark, SF).count()
    assert n > 80
    assert views.scan_voxels(spark, SF).rdd.getNumPartitions() == views.scan_image(spark, SF).rdd.getNumPartitions() == -(-n // 10)


def test_head_is_cut_by_all_voxels(spark, tmp_path):
    """A bright corner between the voxels of a stride of seven: the quantile of all voxels sees it, so its shell seeds the removal."""
    e = [2.25 if i in (1, 4, 5, 16, 17, 20) else 0.0 for i in range(64)]
    spark.createDataFrame([(1, e, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = maps.blob_removal(spark, str(tmp_path)).where("removed").select("x", "y", "z", "v").collect()
    assert {(0, 0, 1), (0, 1, 0), (1, 0, 0)} <= {(r.x, r.y, r.z) for r in got} and {r.v for r in got} == {1.0}
