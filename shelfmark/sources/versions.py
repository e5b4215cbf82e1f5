"""Versioned table store on plain Parquet.

A commit writes the changed tables to new folders and then appends one row to
the commit table: that row makes the version visible. Tables a commit does not
name keep the folder of the version before, so a commit costs what it changes.
There is one writer; readers pin one version for a whole run.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_COMMITS = "version bigint, folders map<string,string>, facts map<string,bigint>"


class VersionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(_COMMITS).parquet(f"{self.root}/_commits")

    def current(self) -> Row:
        """Newest commit (version, folders, facts); version 0 before the first one."""
        try:
            row = self._commits().agg(F.max_by(F.struct("version", "folders", "facts"), "version").alias("c")).head()
        except AnalysisException:
            row = None
        return row["c"] if row and row["c"] else Row(version=0, folders={}, facts={})

    def commit(self, tables: dict, facts: dict = None, partition_by: dict = None, drop=()) -> int:
        """Write `tables` as the next version. `facts` are numbers kept with it (such as last_seq)."""
        now = self.current()
        version = now["version"] + 1
        folders = {n: f for n, f in dict(now["folders"]).items() if n not in drop}
        for name, df in tables.items():
            folder = f"{self.root}/{name}/v={version:012d}"
            writer = df.write.mode("overwrite")
            if partition_by and name in partition_by:
                writer = writer.partitionBy(*partition_by[name])
            writer.parquet(folder)
            folders[name] = folder
        kept = {**dict(now["facts"]), **(facts or {})}
        row = self.spark.createDataFrame([(version, folders, kept)], _COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_commits")
        return version

    def read(self, name: str, at: Row = None) -> DataFrame:
        return self.spark.read.parquet((at or self.current())["folders"][name])
