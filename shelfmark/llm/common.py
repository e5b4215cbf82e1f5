"""Shared helpers: reading tables, scratch tables in the shared folder, Arrow columns as bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.shared import fresh_path

#: Fixed pattern: words are runs of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str) -> Column:
    """A text column as UTF-8 bytes: bytes.split() and bytes.lower() then know ASCII only, as WORD does."""
    return F.col(column).cast("string").cast("binary")


#: Bytes of an Arrow batch that goes to a Python worker; Spark's own bound is meant for narrow rows.
BATCH_BYTES = "4m"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep batches of long texts small, in the JVM and in Python, unless the session has a bound of its own."""
    if spark.conf.get(_ARROW_BYTES) in ("67108864b", "64m", "64MB"):
        spark.conf.set(_ARROW_BYTES, BATCH_BYTES)


def give_back() -> None:
    """Hand freed memory back to the system; the C library would keep it for the worker's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that leaves a small worker behind: workers outlive their task, beside the executor's heap."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


class Scratch:
    """Intermediate tables of one run, written to the folder that all executors share.

    A written table survives lost executors and is computed once; `drop` removes it when nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, fresh_path(spark, name), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a narrow key table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_KEYS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast if it was counted and is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
