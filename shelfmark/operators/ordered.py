"""Ranks, running sums and previous rows that stay parallel inside a hot group.

A window partition is one task. A group holding a third of the rows would put a
third of the work on it, so groups above `hot_rows` are cut into buckets by a
column that never decreases along the order (`coarse`, such as an id). The cuts are
quantiles of that column over the hot rows, so that a bucket's size follows the rows,
dense ids or not. Each bucket is one window partition; the totals of the buckets before it are
added afterwards. All other groups use the plain window in a single shuffle. Whether any group is hot is counted
first, by one aggregation of bounded size; if none is, the plain window is all that runs.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
#: Buckets that the hot rows are cut into; a power of two.
BUCKETS = 1024
#: Cells that groups are counted in before any is counted by itself: what a task holds and sends does not grow with the groups.
CELLS = 1 << 16
#: Rows that one task sorts: beyond this many in each shuffle partition, there are more partitions.
TASK_ROWS = 500_000


def id_bucket(c: str) -> Column:
    """The order of a unique integer column, to be cut into buckets."""
    return F.col(c).cast("bigint")


def _bucket_of(value: Column, bounds: Column) -> Column:
    """Number of bounds (BUCKETS - 1, ascending) that are not above the value: a binary search."""
    steps = F.array(*[F.lit(BUCKETS >> k) for k in range(1, BUCKETS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.try_element_at(bounds, at + step) <= value, step).otherwise(0)).cast("bigint")


def partitions_for(spark, rows: int) -> int | None:
    """Partitions that hold TASK_ROWS rows each, or None if those of the session do."""
    needed = -(-rows // TASK_ROWS)
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, rows: int, *keys) -> DataFrame:
    """df as it is, or by `keys` in as many partitions as its rows need, so that the memory of a task does not grow with them."""
    parts = partitions_for(df.sparkSession, rows)
    return df.repartition(parts, *keys) if parts else df


def _cells(df: DataFrame, keys) -> DataFrame:
    """cell, count: rows of the groups that share a cell; at most CELLS rows."""
    return df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias("cell")).count()


def fullest_cell(df: DataFrame, keys) -> tuple[int, int]:
    """Rows of the fullest cell (no group has more), and of all."""
    return tuple(_cells(df, keys).agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).head())


def any_hot(df: DataFrame, keys, hot_rows: int = HOT_ROWS) -> bool:
    """Whether a group has more than hot_rows rows; groups that share a hash count as one."""
    return hot_and_rows(df, keys, hot_rows)[0]


def hot_and_rows(df: DataFrame, keys, hot_rows: int = HOT_ROWS) -> tuple[bool, int]:
    """What `any_hot` says, and the number of rows.

    Groups are counted in cells first, and one by one only where a cell has more than hot_rows rows."""
    if not keys:
        rows = df.count()
        return rows > hot_rows, rows
    fullest, rows = fullest_cell(df, keys)
    if fullest <= hot_rows:
        return False, rows
    full, group = _cells(df, keys).where(F.col("count") > hot_rows), F.xxhash64(*keys)
    some = df.select(group.alias("group")).withColumn("cell", F.pmod("group", F.lit(CELLS))).join(F.broadcast(full.select("cell")), "cell", "left_semi")
    return not some.groupBy("group").count().where(F.col("count") > hot_rows).isEmpty(), rows


def _bounds(hot: DataFrame, coarse: Column) -> Column:
    parts = [i / BUCKETS for i in range(1, BUCKETS)]
    return hot.agg(F.percentile_approx(coarse, parts, 10 * BUCKETS).alias("bounds")).scalar()


def _mark(df: DataFrame, keys, coarse: Column, hot_rows: int) -> DataFrame:
    """Add `_hot` and `_bucket`, spread by group and bucket.

    Hot groups are found by an 8-byte hash: two groups sharing one are both cut,
    which changes no result. At most rows / hot_rows hashes pass the filter, so the
    broadcast is 8 MB for 10**12 rows and the usual `hot_rows`; a smaller one leaves the
    choice of the join to its size. The explicit repartition keeps a partitioning by `keys` alone,
    left by an earlier step, from doing the same.
    """
    value = coarse.cast("bigint")
    if not keys:
        marked = df.withColumn("_hot", F.lit(True)).withColumn("_bounds", _bounds(df, value))
        return marked.withColumn("_bucket", _bucket_of(value, F.col("_bounds"))).drop("_bounds").repartition("_bucket")
    group = F.xxhash64(*keys)
    hot = df.groupBy(group.alias("_group")).count().where(F.col("count") > hot_rows).select("_group", F.lit(True).alias("_hot"))
    hot = F.broadcast(hot) if hot_rows >= HOT_ROWS else hot
    marked = df.withColumn("_group", group).join(hot, "_group", "left").drop("_group")
    bucket = F.when(F.col("_hot"), _bucket_of(value, F.col("_bounds"))).otherwise(F.lit(0).cast("bigint"))
    cut = marked.withColumn("_bounds", _bounds(marked.where("_hot"), value)).withColumn("_bucket", bucket).drop("_bounds")
    return cut.repartition(*keys, "_bucket")


def _add_offsets(local: DataFrame, offsets: DataFrame, keys) -> DataFrame:
    """Left join on group and bucket; null group keys match each other."""
    right = offsets.withColumnsRenamed({c: f"_k_{c}" for c in (*keys, "_bucket")})
    same = F.col("_bucket") == F.col("_k__bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(right, same, "left")


def running_sums(df: DataFrame, keys, order, coarse: Column, sums: dict, hot_rows: int = HOT_ROWS, wide: bool = False, rows: int = 0) -> DataFrame:
    """Add inclusive running sums of `sums` per `keys` along `order`.

    hot_rows None: the caller has counted and no group is hot; one plain window does. rows: how many it has counted.
    wide: rows that take far more memory than bytes in a shuffle; their partitions are not merged before the sort.
    """
    keys = list(keys)
    hot, rows = hot_and_rows(df, keys, hot_rows) if hot_rows is not None and keys else (hot_rows is not None, rows)
    if not hot:
        if wide:
            spark = df.sparkSession
            df = df.repartition(partitions_for(spark, rows) or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
        else:
            df = spread(df, rows, *keys)
        plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*[c for c in df.columns if c not in sums], *[F.sum(e).over(plain).alias(n) for n, e in sums.items()])
    marked = _mark(df, keys, coarse, hot_rows)
    frame = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select("*", *[F.sum(e).over(frame).alias(n) for n, e in sums.items()])
    totals = marked.where("_hot").groupBy(*keys, "_bucket").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    # One row per bucket of a hot group, so this window sees few rows.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
    joined = _add_offsets(local, offsets, keys)
    kept = [c for c in df.columns if c not in sums]
    return joined.select(*kept, *[(F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums])


def ranked(df: DataFrame, keys, order, coarse: Column, name: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the 1-based position of each row in its group; `order` must be total."""
    return running_sums(df, keys, order, coarse, {name: F.lit(1).cast("bigint")}, hot_rows)


def with_previous(df: DataFrame, keys, order, coarse: Column, value: Column, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the value of the row before in the group, null for the first row."""
    keys = list(keys)
    hot, rows = hot_and_rows(df, keys, hot_rows) if keys else (True, 0)
    if not hot:
        return spread(df, rows, *keys).select("*", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)).alias(name))
    marked = _mark(df, keys, coarse, hot_rows)
    step = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = marked.select("*", F.lag(F.struct(value.alias("v"))).over(step).alias("_prev"))
    last = marked.where("_hot").groupBy(*keys, "_bucket").agg(F.max_by(F.struct(value.alias("v")), F.struct(*order)).alias("_last"))
    carry = last.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    joined = _add_offsets(local, carry, keys)
    return joined.select(*df.columns, F.coalesce("_prev", "_carry")["v"].alias(name))


def dense_index(df: DataFrame, order_id: str, tie, name: str) -> DataFrame:
    """Global 1-based index along (order_id, *tie) without a one-task sort."""
    return running_sums(df, [], [order_id, *tie], id_bucket(order_id), {name: F.lit(1).cast("bigint")})
