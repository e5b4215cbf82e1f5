"""The change log: numbered changes in segments, and its head, a record of its own of what the log still holds.

A reader asks the head, not a batch, whether changes may be lost: a batch may be empty or a part of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.refresh import log_bounds
from shelfmark.schemas import LOG_RING
from shelfmark.sources.bucketed import Marks
from shelfmark.sources.shared import exists, remove

LOG_SCHEMA = "seq bigint, track_id bigint"


class ChangeLog:
    """The newest `ring` sequence numbers of (seq, track_id). A segment holds a span of numbers and goes as a whole."""

    def __init__(self, spark: SparkSession, root: str, ring: int = LOG_RING, span: int = None):
        self.spark, self.path, self.ring = spark, f"{root}/segments", ring
        self.span, self._head = span or max(1, ring // 8), Marks(spark, f"{root}/head")

    def head(self) -> tuple[int, int]:
        """The smallest and the largest retained number; (0, 0) for an empty log."""
        at = self._head.read()
        return at.get("min_seq", 0), at.get("max_seq", 0)

    def append(self, rows: DataFrame) -> None:
        """Add changes, then move the head and drop what is behind it. Rows that are appended again are counted once.

        Rows that would be dropped at once are not written, so a batch of any length makes as many segments as the log keeps."""
        low, high = log_bounds(rows).head()
        if not high:
            return
        kept_from, last = self.head()
        last = max(last, high)
        first = max(min(kept_from or low, low), last - self.ring + 1)
        segment = F.floor(F.col("seq") / self.span)
        kept = rows.select("seq", "track_id").where(F.col("seq") >= first)
        kept.withColumn("segment", segment).write.mode("append").partitionBy("segment").parquet(self.path)
        self._head.write({"min_seq": first, "max_seq": last, "first_segment": first // self.span})
        self._drop_before(first // self.span)

    def clear(self) -> None:
        """Empty the log, as an operator outside may do."""
        self._head.write({"min_seq": 0, "max_seq": 0})
        remove(self.spark, self.path)

    def read(self) -> DataFrame:
        first, last = self.head()
        if not last or not exists(self.spark, self.path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        rows = self.spark.read.schema(f"{LOG_SCHEMA}, segment bigint").parquet(self.path).where(F.col("segment") >= first // self.span)
        return rows.where(F.col("seq").between(first, last)).select("seq", "track_id").distinct()

    def _drop_before(self, segment: int) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for entry in files.listStatus(folder):
            name, _, at = entry.getPath().getName().partition("=")
            if name == "segment" and int(at) < segment:
                files.delete(entry.getPath(), True)
