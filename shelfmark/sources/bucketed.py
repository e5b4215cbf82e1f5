"""Tables laid out in buckets of a key, so that a change reads and writes the buckets it falls into and no others.

Plain Parquet folders, one partition a bucket. A replaced bucket keeps one row without a key, so that a bucket that
lost its last row is written too; `read` leaves these rows out. The bucket of a key is a hash of its value: pick the
count so that a bucket fills one file. Buckets are plain partition filters, so Catalyst prunes them like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.shared import exists, materialize, remove

BUCKET = "bucket"


def _overwrite(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucket(self, key: Column = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that keys (any table with the key column) fall into: at most `buckets` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def read(self, only: list[int] = None) -> DataFrame:
        """All rows, or those of some buckets, which reach the scan as partition filters."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        if only is not None:
            rows = rows.where(F.col(BUCKET).isin(only))
        return rows.where(F.col(self.key).isNotNull()).drop(BUCKET)

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys, from their buckets only."""
        return self.read(self.buckets_of(keys)).join(keys.select(self.key), self.key, "left_semi")

    def replace(self, rows: DataFrame, only: list[int] = None) -> None:
        """Make `rows` the content of the buckets `only`, of all without it. `rows` may be read from this table."""
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = rows.select(*columns)
        # Only rows that may come from this table are written aside first.
        staged = materialize(rows, "bucketed") if exists(self.spark, self.path) else None
        dealt = (rows if staged is None else staged).withColumn(BUCKET, self.bucket())
        # Keys may fall into few buckets: a large one is cut, so that it is not the work of one task.
        if only is None:
            dealt.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self.path)
        elif only:
            marks = self.spark.createDataFrame([(b,) for b in only], f"{BUCKET} int")
            _overwrite(dealt.unionByName(marks, allowMissingColumns=True).hint("rebalance", BUCKET), self.path, BUCKET)
        if staged is not None:
            remove(self.spark, staged.written_at)


class Marks:
    """A handful of numbers that outlive the driver. Two slots take turns, so a write that breaks off leaves the one before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _newest(self) -> tuple[int, dict]:
        if not exists(self.spark, self.path):
            return 0, {}
        rows = self.spark.read.schema("step bigint, facts map<string,bigint>, slot int").parquet(self.path)
        row = rows.agg(F.max_by(F.struct("step", "facts"), "step").alias("m")).head()
        return (row["m"]["step"], dict(row["m"]["facts"])) if row["m"] else (0, {})

    def read(self) -> dict:
        return self._newest()[1]

    def write(self, facts: dict) -> None:
        step = self._newest()[0] + 1
        row = self.spark.createDataFrame([(step, facts, step % 2)], "step bigint, facts map<string,bigint>, slot int")
        _overwrite(row.coalesce(1), self.path, "slot")
