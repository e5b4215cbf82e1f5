"""Weighted rendezvous sharding with gapless slots, in built-in functions only.

Every (key, shard) pair has a hash; a row goes to the shard with the smallest -ln(u) / weight. A shard's score
depends on the key and that shard alone, so adding a shard moves rows only into it, and a shard gets a share of
the keys in proportion to its weight.

Cases: a null key is one key of its own (all its rows share a shard), a null text has size `overhead` and CRC 0,
repeated rows get slots of their own, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.llm.common import Scratch

#: Rows that one slot-numbering group may hold on average, and the least number of such groups in a shard.
GROUP_ROWS, LEAST_GROUPS = 50_000, 64


def score(key: Column, shard: Column, weight: Column) -> Column:
    """Smaller wins. The hash's upper 53 bits become a number strictly between 0 and 1."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.ln(unit) / weight


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Struct (score, shard) of the winning shard among len(weights)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shares = F.array(*[F.lit(float(w)) for w in weights])
    ids = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    return F.array_min(F.transform(ids, lambda s: F.struct(score(key, s, F.element_at(shares, s + 1)).alias("score"), s.alias("shard"))))


def assign(df: DataFrame, weights: list[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """key, size, text_crc32, shard and grown_shard (with one more shard of `grown_weight`); one pass, no shuffle."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    n = len(weights)
    rows = df.select(F.col(key), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumn("won", rendezvous(F.col(key), weights))
    extra = score(F.col(key), F.lit(n), F.lit(float(grown_weight)))
    return rows.select(
        key, "size", "text_crc32", F.col("won.shard").cast("int").alias("shard"),
        F.when(extra < F.col("won.score"), F.lit(n)).otherwise(F.col("won.shard")).cast("int").alias("grown_shard"),
    )


def slots(assigned: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """Add `slot`, gapless from 0 in each shard.

    A shard is numbered in many groups at once: rows are dealt to groups by a hash, each group is counted, and a
    group starts where the earlier groups of its shard end. The table of groups has one row per GROUP_ROWS rows.
    """
    kept = scratch.write(assigned, "assigned")
    shards = max(1, kept.agg(F.max("shard")).first()[0] or 0)
    groups = max(LEAST_GROUPS, math.ceil(kept.count() / shards / GROUP_ROWS))
    # The partition of origin is part of the group, so that even a third of all rows with one key and one text is cut.
    dealt = F.pmod(F.xxhash64(F.col(key), "text_crc32", F.spark_partition_id()), F.lit(groups)).cast("int")
    rows = scratch.write(kept.withColumn("part", dealt), "dealt")
    scratch.drop(kept)
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.alias("start"))
    local = W.partitionBy("shard", "part").orderBy(key, "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(local))
    return numbered.join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + F.col("at") - 1).cast("long")).drop("start", "at", "part")


def shard(df: DataFrame, weights: list[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """key, size, text_crc32, law ('key'), shard, slot, grown_shard of every row."""
    scratch = Scratch(df.sparkSession, "sharding")
    out = slots(assign(df, weights, grown_weight, key, text, overhead), scratch, key)
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> None:
    """Write whole rows into one folder a shard; several files a shard, dealt by a hash of all columns."""
    files = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    out = df.withColumn("shard", rendezvous(F.col(key), weights)["shard"])
    out.repartition(F.col("shard"), files).write.partitionBy("shard").parquet(path)
