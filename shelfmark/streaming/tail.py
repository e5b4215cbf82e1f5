"""Change-log tailing: the rendered snapshot and the final names follow the log.

State is two tables in buckets: `rows` by track id (what is shown and its version) and, if asked for, `places` by
top-level name family (final names). A batch reads and replaces the buckets that its ids and families fall into, of the
catalogue's tables as well if they are bucketed by id, so its work follows the change and not the library. Repeating a
batch gives the same state, so a restarted stream is exactly-once. The watermark moves after the tables; a run that
broke off in between is noticed by its open mark and leads to one rebuild.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import refresh as R
from shelfmark.operators import tree as T
from shelfmark.plans.view import render
from shelfmark.sources.bucketed import BucketedTable, Marks
from shelfmark.sources.shared import exists, materialize, remove

STATE = "id bigint, content_version bigint, format string, path string"
PLACES = f"{STATE}, family string, final_path string"
NOTES = "node string, id bigint, reason string"


class SnapshotState:
    """The shown tracks of one view; with `places`, their final names and what each batch invalidates as well."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, places: bool = False, case_insensitive: bool = False):
        self.spark, self.root, self.folded = spark, root.rstrip("/"), case_insensitive
        self.rows = BucketedTable(spark, f"{self.root}/rows", STATE, "id", buckets)
        self.places = BucketedTable(spark, f"{self.root}/places", PLACES, "family", buckets) if places else None
        self.marks = Marks(spark, f"{self.root}/marks")

    def read(self) -> DataFrame:
        return self.rows.read()

    def read_places(self) -> DataFrame:
        return self.places.read()

    def notes(self, last_seq: int) -> DataFrame:
        """The nodes that the batch which ended at `last_seq` made stale."""
        path = f"{self.root}/notes/{last_seq}"
        return self.spark.read.schema(NOTES).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], NOTES)

    def facts(self) -> dict:
        """last_seq, batch_id and gaps, as far as there are any."""
        return {k: v for k, v in self.marks.read().items() if k in ("last_seq", "batch_id", "gaps")}

    def replace_all(self, shown: DataFrame, facts: dict) -> None:
        """Make `shown` (id, content_version, format, path) the whole state."""
        self.marks.write({**self.marks.read(), "open": 1})
        self.rows.replace(shown)
        long = 0
        if self.places:
            long = self._place_all()
        self.marks.write({**{k: v for k, v in self.marks.read().items() if k not in ("open", "emptied")}, **facts, "long": long})

    def _place_all(self) -> int:
        shown = self.rows.read()
        self.places.replace(self._placed(shown))
        return int(shown.agg(F.coalesce(F.bool_or(T.is_long(F.col("path"), self.folded)), F.lit(False))).head()[0])

    def _family(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("family", T.top_family(F.col("path"), self.folded))

    def _placed(self, rows: DataFrame) -> DataFrame:
        final = T.place(rows.select("id", "path"), self.folded).select("id", "final_path")
        return self._family(rows).join(final, "id")

    def place_changes(self, before: DataFrame, delta: DataFrame, last_seq: int) -> int:
        """Name the families anew that a delta touches, and note what became stale. Returns whether names near the byte limit showed up."""
        new = delta.where("path IS NOT NULL")
        paths = before.select("path").unionByName(new.select("path"))
        touched = self._family(paths).where("family IS NOT NULL").select("family").distinct()
        touched = materialize(touched, "touched")
        only = self.places.buckets_of(touched)
        there = materialize(self.places.read(only), "there")
        members = there.join(touched, "family", "left_semi")
        kept = members.join(delta.select("id"), "id", "left_anti").select(*STATE_COLUMNS)
        named = materialize(self._placed(kept.unionByName(new.select(*STATE_COLUMNS))), "named")
        old, now = members.withColumn("node", F.col("final_path")), named.withColumn("node", F.col("final_path"))
        view = lambda rows: rows.select("id", "content_version", F.col("final_path").alias("path"))
        R.invalidated_nodes(view(old), view(now), old, now).write.mode("overwrite").parquet(f"{self.root}/notes/{last_seq}")
        self.places.replace(there.join(touched, "family", "left_anti").unionByName(named.select(*there.columns)), only)
        long = int(new.agg(F.coalesce(F.bool_or(T.is_long(F.col("path"), self.folded)), F.lit(False))).head()[0])
        for df in (touched, there, named):
            remove(self.spark, df.written_at)
        return long


STATE_COLUMNS = ["id", "content_version", "format", "path"]


def rebuild(state: SnapshotState, tracks: DataFrame, tags: DataFrame, template: str, facts: dict, **options) -> None:
    """Full recompute. The log position in `facts` is read before the tables."""
    state.replace_all(render(tracks, tags, template, **options).where("path is not null"), facts)


def rows_of(table, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the given ids: from their buckets if the table is a BucketedTable, by a semi-join otherwise."""
    keys = ids.select(F.col("id").alias(key))
    return table.matching(keys) if isinstance(table, BucketedTable) else table.join(keys, key, "left_semi")


def whole(table) -> DataFrame:
    return table.read() if isinstance(table, BucketedTable) else table


def apply_batch(state: SnapshotState, log: DataFrame, load_catalogue, template: str, batch_id: int = None, head: tuple[int, int] = None, **options) -> str:
    """One refresh step. Returns what happened: skip, idle, delta or rebuild.

    `head` is the smallest and the largest sequence number that the log still holds, (0, 0) if none; without it `log` is
    the whole retained log and speaks for itself. `load_catalogue` returns tracks and tags, each a table or a
    BucketedTable by track id.
    """
    at = state.marks.read()
    if batch_id is not None and at.get("batch_id", -1) >= batch_id:
        return "skip"
    mark = {} if batch_id is None else {"batch_id": batch_id}
    last = at.get("last_seq", 0)
    bounds = R.log_bounds(log).head()
    lowest, highest = head or (bounds["min_seq"], bounds["max_seq"])
    seq = max(bounds["max_seq"], highest, last)
    tracks, tags = load_catalogue()
    gap = R.has_gap(lowest, highest, last)
    if gap and highest == 0 and at.get("emptied"):
        return "idle"  # The log was empty at the rebuild already.
    if gap or at.get("open"):
        told = {"last_seq": seq, "gaps": at.get("gaps", 0) + int(gap), **({"emptied": 1} if gap and highest == 0 else {}), **mark}
        rebuild(state, whole(tracks), whole(tags), template, told, **options)
        return "rebuild"
    if bounds["max_seq"] <= last:
        return "idle"
    seq = max(bounds["max_seq"], last)  # The head may be ahead of the rows of this batch.
    ids = materialize(R.changed_ids(log, last), "changed")
    live = rows_of(tracks, ids)
    only = state.rows.buckets_of(ids)
    held = materialize(state.rows.read(only), "held")
    before = held.join(ids, "id", "left_semi")
    changes = R.partition_changes(before, ids, live.select("id", "content_version", "format"))
    wanted = materialize(R.to_render(changes), "wanted")
    rendered = render(live.join(wanted, "id", "left_semi"), rows_of(tags, wanted, "track_id"), template, **options)
    final = R.reconcile_dropped(changes, rendered)
    path = F.when(F.col("change") != "removed", F.col("path"))
    delta = final.join(rendered.where("path is not null"), "id", "left").select("id", "content_version", "format", path.alias("path"))
    delta = materialize(delta, "delta")
    facts = {k: v for k, v in at.items() if k != "emptied"}
    state.marks.write({**facts, "open": 1})
    state.rows.replace(held.join(delta.select("id"), "id", "left_anti").unionByName(delta.where("path IS NOT NULL")), only)
    if state.places:
        if not facts.get("long"):
            facts["long"] = state.place_changes(before, delta, seq)
        if facts["long"]:
            facts["long"] = state._place_all()
    state.marks.write({**facts, "last_seq": seq, **mark})
    for df in (ids, held, wanted, delta):
        remove(state.spark, df.written_at)
    return "delta"


def read_log_stream(spark: SparkSession, path: str, schema, pattern: str = None, files_per_trigger: int = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tail_log(log_stream: DataFrame, state: SnapshotState, load_catalogue, template: str, checkpoint: str, head=None, **options):
    """Start the tail over (seq, track_id) rows and run until the input is used up.

    `head` (such as ChangeLog.head) is asked for each micro-batch and decides about gaps. Without it a batch that begins
    beyond the watermark is a gap, and a batch without rows says nothing.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        if head is not None or not batch.isEmpty():
            apply_batch(state, batch, load_catalogue, template, batch_id, head() if head else None, **options)

    query = log_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def version_counters(event_stream: DataFrame, checkpoint: str, batches_kept: int = 2):
    """Running content_version per track, a sum in the stream's own state store; nothing is written beside it.

    The store keeps the last few versions of each partition, so its files do not grow with the number of batches.
    """
    spark = event_stream.sparkSession
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.minBatchesToRetain": str(batches_kept),
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        totals = event_stream.groupBy("track_id").agg(F.sum("bump").alias("content_version"))
        query = totals.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return query


def current_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(track_id, content_version) as of the last finished batch, read from the state store."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.track_id", F.col("value.sum").alias("content_version"))
