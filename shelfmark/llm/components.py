"""Connected components of a table of links, by alternating large-star and small-star steps.

Each half step is a combining minimum per node and a join; nothing is gathered on the driver. The join key has a
salt, because the centre of a star may hold a third of all links. Each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch

SALTS = 8


def _with_minimum(rows: DataFrame) -> DataFrame:
    """rows (u, v) with m, the smallest v of its u."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"))
    low = low.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low, ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """edges u > v. Every larger neighbour of u is linked to the smallest node of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = F.least("m", "u")
    return _with_minimum(both).where("v > u").select(F.col("v").alias("u"), m.alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges u > v. u and all its smaller neighbours are linked to the smallest of them."""
    found = _with_minimum(edges)
    rest = found.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(found.where("v = m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): every node with a link and the smallest node that it is connected to.

    `edges` has long columns u and v, u > v. Ends when a whole round changes no row.
    """
    now = scratch.write(edges.select("u", "v").distinct(), "edges")
    state = None
    while True:
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = tuple(total)
        large = scratch.write(_large_star(now), "large")
        small = scratch.write(_small_star(large), "small")
        scratch.drop(now)
        scratch.drop(large)
        now = small
