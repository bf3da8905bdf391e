"""A training corpus from raw documents: language, near duplicates, repeated passages, benchmark leaks, packing.

Every stage works on all rows it is given and passes the columns of its input on; only the texts (and n_chars) change, in the third.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.llm import decontaminate, language_id, ngram_join, packing, suffix_dedup
from voxcohort.session import scratch_path


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator needs, and the whole row beside them, so no name can clash."""
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: all with a letter, whatever the language and the score. Without labels to learn from it is the same rows."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return language_id.with_letters(docs)
    known = language_id.predict(_packed(docs), model, "_row.text")
    return known.where(F.col("lang_pred") != language_id.UNKNOWN).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id. Rows without an id are in no group and stay; a repeated row is one."""
    return ngram_join.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that also stand earlier in passages of 100 bytes or more; a text may become empty, its row stays."""
    cut = suffix_dedup.remove(_packed(docs, "doc_id", "text"))
    text = F.when(F.col("_row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified copy of a benchmark item."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their place in training sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

# no SQL states a trained classifier or the packing; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to shared storage and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
