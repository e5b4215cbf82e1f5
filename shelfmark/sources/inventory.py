"""File inventories and landed JSON records."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.schemas import COLLECTION


def file_inventory(spark: SparkSession, roots) -> DataFrame:
    """path, size and mtime of all files below the roots. The content column is pruned,
    so only the listing is read; files that vanish meanwhile are left out."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .load(list(roots))
    )
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
    )


def content_hashes(files: DataFrame, content="content") -> DataFrame:
    """Full-content hash per file."""
    return files.withColumn("content_hash", F.sha2(content, 256))


def read_collection(spark: SparkSession, path, kind: str) -> DataFrame:
    """One kind of landed API record (artists, albums, files, tracks), declared schema, no inference."""
    return spark.read.schema(COLLECTION[kind]).json(path)


def parse_collection(payloads: DataFrame, kind: str, column="payload") -> DataFrame:
    """Same from a column that holds one JSON object per row."""
    return payloads.select(F.from_json(column, COLLECTION[kind]).alias("r")).select("r.*")


@dataclass
class Landed:
    """What landed files gave: typed records, rejected texts with their file, and fields that the schema does not have."""

    records: DataFrame
    rejects: DataFrame
    drift: DataFrame


def read_landed(spark: SparkSession, path, kind: str) -> Landed:
    """API records of one kind from files of JSON lines; a line is one object or an array of them.

    A line that is no JSON, and an object whose fields do not fit their types, is rejected whole, with its file and text.
    Fields beyond the schema are ignored and counted in `drift`.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")
    listed = F.col("line").startswith("[")
    parts = F.when(listed, F.from_json("line", "array<string>")).otherwise(F.array("line"))
    # A broken array gives no parts: its line is rejected as it stands.
    items = lines.select("file", F.explode(F.coalesce(parts, F.array("line"))).alias("text"))
    schema = T.StructType([*COLLECTION[kind].fields, T.StructField("_corrupt", T.StringType())])
    keys = F.json_object_keys("text")
    parsed = items.withColumn("r", F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).withColumn("keys", keys)
    good = F.col("keys").isNotNull() & F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    names = [f.name for f in COLLECTION[kind].fields]
    unknown = F.array_except("keys", F.array(*[F.lit(n) for n in names]))
    drift = parsed.where(good).select(F.explode(unknown).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    return Landed(parsed.where(good).select(*[F.col(f"r.{n}") for n in names]), parsed.where(~F.coalesce(good, F.lit(False))).select("file", "text"), drift)
