"""What the document operators share: reading, row keys, stable draws and lineage cuts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut, scratch_path

__all__ = ["cut", "freeze", "passing", "documents", "held_out", "arrow_map", "batch", "partitions"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str, of: int) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == 0, F.lit(False))


def freeze(df: DataFrame) -> DataFrame:
    """Evaluate once into a table in shared storage: like cut(), but compressed and read by column, for what is large."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """freeze() for tables that nothing reads after the block, which removes them: what is returned from it must be evaluated within."""
    folder = scratch_path(spark, "passing")
    made = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(path := f"{folder}/{len(made)}")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        if made:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return freed memory to the system. Spark keeps a Python worker for the tasks that follow, and allocators keep what a task has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose worker holds no memory of a task beyond it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(it)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    """A record batch of named arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
