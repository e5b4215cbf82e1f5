"""Keeping the rendered view fresh from the change log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ordered import id_bucket, running_sums, with_previous
from shelfmark.schemas import LOG_RING


def log_bounds(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.min("seq"), F.lit(0)).alias("min_seq"), F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"))


def changed_ids(log: DataFrame, after: int = 0) -> DataFrame:
    return log.where(F.col("seq") > after).select(F.col("track_id").alias("id")).distinct()


def has_gap(min_seq: int, max_seq: int, last_seq: int) -> bool:
    """Changes may be lost: an emptied log behind a watermark, or a log that no longer reaches back to it."""
    return last_seq > 0 if max_seq == 0 else min_seq > last_seq + 1


def gap_rows(bounds: DataFrame, last_seq) -> DataFrame:
    """Same decision as a column, for many watermarks at once."""
    last = F.col(last_seq) if isinstance(last_seq, str) else F.lit(last_seq)
    return bounds.withColumn("gap", F.when(F.col("max_seq") == 0, last > 0).otherwise(F.col("min_seq") > last + 1))


def retained_log(log: DataFrame, ring: int = LOG_RING) -> DataFrame:
    """The newest `ring` sequence numbers: one scalar maximum, no window."""
    return log.where(F.col("seq") > log.agg(F.max("seq")).scalar() - ring)


def running_versions(events: DataFrame, hot_rows=None) -> DataFrame:
    """content_version after each log event (seq, track_id, bump)."""
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    return running_sums(events, ["track_id"], ["seq"], id_bucket("seq"), {"content_version": F.col("bump")}, **extra)


GEOMETRY = ("format", "audio_offset", "audio_length", "backing_size", "backing_mtime_ns")


def geometry_changes(history: DataFrame, key="id", order="seq", hot_rows=None) -> DataFrame:
    """Versions of a track whose geometry differs from the version before."""
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    now = F.struct(*[F.col(c) for c in GEOMETRY])
    prev = with_previous(history, [key], [order], id_bucket(order), now, "_before", **extra)
    changed = F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(now)
    return prev.withColumn("geometry_changed", changed).drop("_before")


def partition_changes(snapshot: DataFrame, ids: DataFrame, live: DataFrame) -> DataFrame:
    """id, change: changed / added / removed / none. live: id, content_version, format."""
    prev = snapshot.select("id", F.struct("content_version", "format").alias("p"))
    now = live.select("id", F.struct("content_version", "format").alias("n"))
    change = (
        F.when(F.col("p").isNotNull() & F.col("n").isNotNull() & ~F.col("p").eqNullSafe(F.col("n")), "changed")
        .when(F.col("p").isNull() & F.col("n").isNotNull(), "added")
        .when(F.col("p").isNotNull() & F.col("n").isNull(), "removed")
        .otherwise("none")
    )
    return ids.select("id").join(prev, "id", "left").join(now, "id", "left").select("id", change.alias("change"))


def to_render(changes: DataFrame) -> DataFrame:
    changed = changes.where("change = 'changed'").select("id")
    return changed.unionByName(changes.where("change = 'added'").select("id"))


def reconcile_dropped(changes: DataFrame, rendered: DataFrame) -> DataFrame:
    """A changed track that rendered nothing counts as removed; an added one falls out."""
    shown = rendered.where(F.col("path").isNotNull()).select("id", F.lit(True).alias("shown"))
    j = changes.where("change <> 'none'").join(shown, "id", "left")
    lost = F.col("shown").isNull()
    change = F.when(lost & (F.col("change") == "changed"), "removed").when(~(lost & (F.col("change") == "added")), F.col("change"))
    return j.select("id", change.alias("change")).where("change is not null")


def merge_snapshot(snapshot: DataFrame, changes: DataFrame, rendered: DataFrame) -> DataFrame:
    """Snapshot after a change set; rendered has id, content_version, format, path."""
    touched = changes.where("change <> 'none'").select("id")
    new = rendered.join(changes.where("change in ('changed', 'added')").select("id"), "id", "left_semi")
    return snapshot.join(touched, "id", "left_anti").select("id", "content_version", "format", "path").unionByName(
        new.select("id", "content_version", "format", "path")
    )


def invalidated_nodes(old: DataFrame, new: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame, changes: DataFrame = None) -> DataFrame:
    """node, id, reason: the current node where content changed under one path, the old
    node where a track moved or went. With `changes`, only their ids are looked at."""
    if changes is not None:
        ids = changes.where("change in ('changed', 'removed')").select("id")
        old = old.join(ids, "id", "left_semi")
        new = new.join(changes.where("change in ('changed', 'added')").select("id"), "id", "left_semi")
    o = old.select("id", F.col("content_version").alias("ov"), F.col("path").alias("op"))
    n = new.select("id", F.col("content_version").alias("nv"), F.col("path").alias("np"))
    j = o.join(n, "id", "full")
    content = F.col("op").isNotNull() & (F.col("op") == F.col("np")) & (F.col("ov") != F.col("nv"))
    moved = F.col("op").isNotNull() & (F.col("np").isNull() | (F.col("np") != F.col("op")))
    hits = j.select("id", F.when(content, "content").when(moved, "moved").alias("reason")).where("reason is not null")
    a = hits.where("reason = 'content'").join(new_nodes.select("id", "node"), "id")
    b = hits.where("reason = 'moved'").join(old_nodes.select("id", "node"), "id")
    return a.unionByName(b).select("node", "id", "reason")
