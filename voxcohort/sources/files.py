"""Cohort files: lists, folds, predictions, recipes, manifests, logs, caches and their sinks.

Schemas are given, never inferred; optional columns and keys stay NULL when a file lacks them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clip_prob
from ..operators.volumes import check_shape
from ..session import stored

MEMBER = "struct<member:string, seed:int, splits:string>"
RECIPE = f"name string, members array<{MEMBER}>, shared_recipe map<string,string>, calibration struct<slope:double, intercept:double, member_logit_cap:double>"
MANIFEST = "member string, recipe map<string,string>, folds array<int>, results array<struct<fold:int, ll:double, auc:double, best_ll:double>>"
CALIBRATION = "a double, b double, member_logit_cap double, gland_rm double"
HISTORY = "run long, first long, history array<struct<ll:double, auc:double>>"

# Line formats of the run logs.
EPOCH_LINE = r"^\[(\S+) f(\d+)\] ep(\d+) val ll ([0-9.]+) auc ([0-9.]+) \(best ([0-9.]+)@(\d+)\)"
DONE_LINE = r"^\[(\S+) f(\d+)\] done ([0-9.]+) min: ll ([0-9.]+) auc ([0-9.]+)"


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema; columns are matched by the header."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def read_folds(spark: SparkSession, with_label: str, without_label: str) -> DataFrame:
    """Fold files of two headers in one table; the partition is the folder a file lies in."""
    part = F.regexp_extract(F.col("_metadata.file_path"), r"partition=([^/]+)/", 1).alias("partition")
    read = lambda p, s: spark.read.schema(s).option("recursiveFileLookup", "true").csv(p, header=True, enforceSchema=False)
    a = read(with_label, "uid long, label int, fold int").select(part, "uid", "label", "fold")
    b = read(without_label, "uid long, fold int").select(part, "uid", "fold")
    return a.unionByName(b, allowMissingColumns=True)


def list_scans(spark: SparkSession, path: str, suffix: str = ".nii.gz") -> DataFrame:
    """Scan files with uid and size; the content column is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select(F.regexp_extract("path", rf"([^/]+){suffix.replace('.', '[.]')}$", 1).alias("uid"), "length")


def checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, md5, length) per file below a folder; files are artefacts of bounded size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.md5("content").alias("md5"), "length")


def content_roots(lines: DataFrame, name: str = "name", value: str = "value", leaf: int = 1000) -> DataFrame:
    """(name, md5, length): the root of a hash tree over the lines of each artefact, whatever files and writers they came from.

    Equal lines are counted once. Leaves are the digests that share a prefix, whose length follows from the number of different lines, so
    a leaf holds about `leaf` of them and an inner node at most sixteen; every level is one grouping, and no file is read as one row.
    """
    d = lines.groupBy(F.col(name).alias("name"), F.md5(F.col(value).cast("binary")).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    size = d.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("length"))
    size = stored(size.withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log(F.col("k") / float(leaf)) / math.log(16.0))).cast("int")))
    deepest = size.agg(F.max("depth")).first()[0] or 0
    join = lambda c: F.md5(F.array_join(F.array_sort(F.collect_list(c)), ",").cast("binary"))
    t = d.join(size, "name").withColumn("at", F.substring("d", F.lit(1), F.col("depth")))
    t = t.groupBy("name", "at").agg(join(F.concat("d", F.lit(":"), F.col("c").cast("string"))).alias("h"))
    for n in range(deepest, 0, -1):
        up = t.where(F.length("at") == n).withColumn("up", F.substring("at", 1, n - 1))
        up = up.groupBy("name", F.col("up").alias("at")).agg(join(F.concat("at", F.lit(":"), "h")).alias("h"))
        t = t.where(F.length("at") != n).unionByName(up)
    return t.join(size, "name").select("name", F.col("h").alias("md5"), "length")


def compare_listings(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("name", F.col("md5").alias("left")).join(b.select("name", F.col("md5").alias("right")), "name", "full_outer")
    state = F.when(F.col("left").isNull(), "only_right").when(F.col("right").isNull(), "only_left").when(F.col("left") == F.col("right"), "equal").otherwise("differ")
    return j.select("name", state.alias("state"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    return check_shape(spark.read.parquet(path))


def read_recipe(spark: SparkSession, path: str, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members, shared settings); settings outside `known` are dropped."""
    r = spark.read.schema(RECIPE).json(path, multiLine=True)
    members = r.select("name", F.inline("members"))
    keep = F.array(*[F.lit(k) for k in known])
    shared = r.select("name", F.explode(F.map_filter("shared_recipe", lambda k, v: F.array_contains(keep, k))).alias("key", "value"), "calibration")
    return members, shared


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path).select("member", F.inline("results"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Every line, classified; lines of no known form keep kind 'other' instead of being dropped."""
    part = lambda p, i: F.regexp_extract("value", p, i)
    epoch, done = F.col("value").rlike(EPOCH_LINE), F.col("value").rlike(DONE_LINE)
    pick = lambda i, j: F.when(epoch, part(EPOCH_LINE, i)).when(done, part(DONE_LINE, j))
    on = lambda i: F.when(epoch, part(EPOCH_LINE, i))
    return lines.select(
        F.when(epoch, "epoch").when(done, "done").otherwise("other").alias("kind"), pick(1, 1).alias("member"), pick(2, 2).cast("int").alias("fold"),
        on(3).cast("int").alias("epoch"), pick(4, 4).cast("double").alias("ll"), pick(5, 5).cast("double").alias("auc"),
        on(6).cast("double").alias("best_ll"), on(7).cast("int").alias("best_epoch"), "value",
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Per-epoch rows from stored chunks of history; `first` is the epoch of a chunk's first entry."""
    h = spark.read.schema(HISTORY).parquet(path)
    return h.select("run", "first", F.posexplode("history").alias("pos", "h")).select("run", (F.col("first") + F.col("pos")).alias("epoch"), "h.ll", "h.auc")


def submission(manifest: DataFrame, preds: DataFrame) -> DataFrame:
    """One row per manifest uid; a scan without a prediction is hedged at one half."""
    return manifest.join(preds.select("uid", "p"), "uid", "left").select("uid", clip_prob(F.coalesce("p", F.lit(0.5))).alias("is_pathologic"), F.col("p").isNull().alias("hedged"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Absent keys mean off."""
    c = spark.read.schema(CALIBRATION).json(path)
    return c.select("a", "b", F.when(F.col("member_logit_cap") > 0, F.col("member_logit_cap")).alias("cap"), F.coalesce(F.col("gland_rm") > 0, F.lit(False)).alias("gland_removal"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "uid") -> DataFrame:
    """All rows of an incoming key replace the existing ones; write the result to a new path and swap."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def write_cache(boxes: DataFrame, path: str, buckets: int = 16, existing: DataFrame | None = None) -> None:
    """Materialise boxes and masks in one pass, by uid bucket; a restart skips the uids already written.

    The rebalance gathers a bucket's rows and splits a bucket that is too large for one file, so writers grow with the rows.
    """
    todo = boxes if existing is None else boxes.join(existing.select("uid"), "uid", "left_anti")
    bucket: Column = F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int")
    todo.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def pending(members: DataFrame, folds: int, existing: DataFrame) -> DataFrame:
    """(member, fold) pairs with no output yet; folds are an explode of a literal range."""
    want = members.select("member").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return want.join(existing.select("member", "fold").distinct(), ["member", "fold"], "left_anti")
