"""Quality rules and a likelihood ratio between trusted and raw text, in built-in Spark expressions only.

Words and word pairs of every text are hashed into a fixed number of buckets. Bucket counts over the whole corpus give the raw
multinomial, those of trusted rows the target multinomial; a text's score is its log-likelihood ratio per n-gram. Both passes keep
a text in its row: arrays of word hashes are combined pairwise, so nothing but bucket counts is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BUCKETS = 1 << 13
TRUSTED_ROWS = 20_000
THRESHOLD = -0.1
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text; null or blank: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPLIT, -1))


def adjacent(left: Column, right: Column, start: int, n: Column) -> Column:
    """Hash of left[i] and right[i + start] for i below n."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(start + 1), n), lambda a, b: F.xxhash64(a, b))


def with_grams(docs: DataFrame) -> DataFrame:
    """docs with _words, _n, _h (a hash per word) and _pair (a hash per pair of neighbours)."""
    d = docs.withColumn("_words", words(F.col("text"))).withColumn("_n", F.size("_words"))
    d = d.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    return d.withColumn("_pair", adjacent(F.col("_h"), F.col("_h"), 1, F.col("_n") - 1))


def log_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, rows: int = TRUSTED_ROWS) -> np.ndarray:
    """log(target / raw) per bucket, one count added to each bucket on both sides.

    Raw counts cover all of docs. The target is fitted on at most `rows` trusted ids (those with the least hash), which bounds the
    broadcast; the driver receives `buckets` counters. Without trusted rows the ratio is 0 everywhere.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows).withColumn("_good", F.lit(1))
    rows_ = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left").select("text", "_good")
    d = with_grams(rows_)
    grams = d.select("_good", F.explode(F.concat("_h", "_pair")).alias("g")).groupBy(F.pmod("g", F.lit(buckets)).alias("b")).agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    raw, good = np.ones(buckets), np.ones(buckets)
    for b, r, t in grams.collect():
        raw[b] += r
        good[b] += t
    return np.log(good / good.sum()) - np.log(raw / raw.sum()) if good.sum() > buckets else np.zeros(buckets)


def score(docs: DataFrame, ratio: np.ndarray, threshold: float) -> DataFrame:
    """docs' doc_id with base counts, base_failed, score and kept.

    Null text has no words; it fails the base rules and is not kept. Very long texts stay in their row. Rows with
    equal ids are answered one by one.
    """
    d = with_grams(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n, size = F.col("_n"), F.size
    four = adjacent(F.col("_pair"), F.col("_pair"), 2, n - 3)
    d = d.withColumn("_five", adjacent(four, F.col("_h"), 4, n - 4))
    placed = F.array_sort(F.transform("_five", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_placed", F.when(size(F.array_distinct("_five")) < size("_five"), placed))
    m = F.greatest(size("_placed") - 1, F.lit(0))
    twins = F.zip_with(F.slice("_placed", F.lit(1), m), F.slice("_placed", F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("_starts", F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    k = F.greatest(size("_starts") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("_starts", F.lit(1), k), F.slice("_starts", F.lit(2), k), lambda a, b: F.least(b - a, F.lit(5)))
    covered = F.when(size("_starts") > 0, F.aggregate(gaps, F.lit(5), lambda s, x: s + x)).otherwise(F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    table = F.lit(ratio)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, g: s + F.get(table, F.pmod(g, F.lit(len(ratio))).cast("int")))
    d = d.withColumn("_lines", lines).select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (size("_lines") - size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(n > 0, (total(F.col("_h")) + total(F.col("_pair"))) / (2 * n - 1)).otherwise(F.lit(0.0)).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Fit the ratio on docs and trusted (doc_id), then judge every row of docs."""
    return score(docs, log_ratio(docs, trusted, buckets, rows), threshold)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(documents(spark, sf_dir), labels.where("quality = 1 and toxic = 0"))
