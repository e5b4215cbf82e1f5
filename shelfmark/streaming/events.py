"""Routing of library events to actions, and a run that carries them out."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import values as V
from shelfmark.operators.catalog import text_tags, tracks_with_tag
from shelfmark.operators.mapping import OWNER_KEY, OWNER_VALUE, assemble_records, map_collection_records
from shelfmark.operators.sync import rename_prune, sync_records
from shelfmark.sources.shared import exists, materialize

# Event types the host sends.
EVENT_TYPES = ("Test", "AlbumDownload", "Rename", "TrackRetag", "ArtistDeleted", "AlbumDeleted")


def _paths(c: Column) -> Column:
    return F.coalesce(P.split_list(c), F.array().cast("array<string>"))


def parse_events(raw: DataFrame) -> DataFrame:
    """Typed events: paths only for download and rename, old paths only for rename."""
    kind = F.when(F.col("raw_type").isin(*EVENT_TYPES), F.col("raw_type")).otherwise("Unsupported")
    none = F.array().cast("array<string>")
    return raw.withColumn("event_type", kind).select(
        "event_id",
        "event_type",
        "raw_type",
        F.when(kind == "AlbumDownload", _paths(F.col("added_paths"))).when(kind == "Rename", _paths(F.col("file_paths"))).otherwise(none).alias("paths"),
        F.when(kind == "Rename", _paths(F.col("previous_paths"))).otherwise(none).alias("previous_paths"),
        V.safe_int("artist_id").alias("artist_id"),
        V.safe_int("album_id").alias("album_id"),
        P.trim_to_null("album_mbid").alias("album_mbid"),
        P.trim_to_null("artist_mbid").alias("artist_mbid"),
    )


def route_events(events: DataFrame, symlinked: bool = False) -> DataFrame:
    """action: none, sync, sync_prune, delete or reject, with the tag a delete looks for."""
    kind = F.col("event_type")
    album, artist = kind == "AlbumDeleted", kind == "ArtistDeleted"
    mbid = F.when(album, F.col("album_mbid")).when(artist, F.col("artist_mbid"))
    sync = kind.isin("AlbumDownload", "Rename")
    prunes = (kind == "Rename") & (F.size("previous_paths") > 0) & F.lit(not symlinked)
    action = (
        F.when(kind.isin("Test", "Unsupported", "TrackRetag"), "none")
        .when(album | artist, F.when(mbid.isNull(), "none").otherwise("delete"))
        .when(sync & F.col("album_id").isNull() & F.col("artist_id").isNull(), "reject")
        .when(prunes, "sync_prune")
        .otherwise("sync")
    )
    return events.withColumn("action", action).withColumn(
        "delete_key", F.when(F.col("action") == "delete", F.when(album, "musicbrainz_albumid").otherwise("musicbrainz_artistid"))
    ).withColumn("delete_value", F.when(F.col("action") == "delete", mbid))


class EventRun:
    """What library events make of a catalogue: one routed pass a batch, and sinks that a repeated batch overwrites.

    Below `root`, each in a folder per batch: `routed` events; `rejects` (event_id, path, reason); `touched`
    (track_id, removed); and the `tracks` and `tags` rows of the touched tracks as they are afterwards. Nothing is
    written for other tracks. `current` lays the latest batch of each track over the catalogue that the run began with.
    A batch sees what smaller batch ids wrote, never its own output, so its repetition changes nothing.

    load_catalogue() and load_inventory() give the catalogue and the listing; load_collection() a dict of files, tracks,
    albums and artists. Outcome of a batch is that of its events one after another in the order of event_id:
    a delete before the first sync of a track asks its stored tags, a later one the tags which that sync wrote.
    An event without an id, or with a path of several collection files, is rejected whole and prunes nothing; a path
    without metadata and a record that breaks a rule are rejected alone.
    """

    def __init__(self, spark: SparkSession, root: str, load_catalogue, load_collection, load_inventory, owner_key: str = OWNER_KEY, symlinked: bool = False, mode: str = "merge"):
        self.spark, self.root = spark, root
        self.load_catalogue, self.load_collection, self.load_inventory = load_catalogue, load_collection, load_inventory
        self.owner_key, self.symlinked, self.mode = owner_key, symlinked, mode

    def _write(self, rows: DataFrame, table: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch_id}")

    def _read(self, table: str, schema: str, before: int = None) -> DataFrame:
        path = f"{self.root}/{table}"
        full = f"{schema}, batch bigint"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def rejects(self) -> DataFrame:
        return self._read("rejects", "event_id bigint, path string, reason string")

    def current(self, before: int = None) -> dict:
        """The catalogue after all batches, or after those before the given one."""
        base = self.load_catalogue()
        touched = self._read("touched", "track_id bigint, removed boolean", before)
        last = touched.groupBy("track_id").agg(F.max("batch").alias("batch"), F.max_by("removed", "batch").alias("removed"))
        laid = lambda table, key: (
            base[table].join(last.select(F.col("track_id").alias(key)), key, "left_anti").select(*base[table].columns)
            .unionByName(self._read(table, _ddl(base[table]), before).join(last.select(F.col("track_id").alias(key), "batch"), [key, "batch"], "left_semi").select(*base[table].columns))
        )
        gone = last.where("removed").select("track_id")
        rest = {t: base[t].join(gone, "track_id", "left_anti") for t in ("track_art", "structural_blocks") if t in base}
        return {**base, **rest, "tracks": laid("tracks", "id"), "tags": laid("tags", "track_id")}

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One batch of raw events."""
        self._write(route_events(parse_events(batch), self.symlinked), "routed", batch_id)
        routed = self.spark.read.parquet(f"{self.root}/routed/batch={batch_id}")
        now, collection = self.current(batch_id), self.load_collection()

        wanted = routed.where("action IN ('sync', 'sync_prune')").select("event_id", F.explode("paths").alias("path"))
        found = materialize(assemble_records(wanted.select("path").distinct(), collection["files"], collection["tracks"], collection["albums"], collection["artists"]), "event-records")
        marked = wanted.join(found.select("path", "status"), "path")
        unclear = marked.where("status = 'ambiguous'").select("event_id").distinct()
        asked = marked.join(unclear, "event_id", "left_anti")
        pairs = map_collection_records(found.join(asked.select("path").distinct(), "path", "left_semi"), collection["tracks"], self.owner_key, ambiguous="skip")
        old_paths = routed.where("action = 'sync_prune'").join(unclear, "event_id", "left_anti").select(F.explode("previous_paths").alias("path"))
        pruned = rename_prune(now["tracks"], old_paths, self.load_inventory(), self.symlinked).select(F.col("id").alias("track_id"))

        deletes = routed.where("action = 'delete'").select("event_id", F.col("delete_key").alias("key"), F.col("delete_value").alias("value"))
        named = self._named(now["tags"], deletes)
        ids = now["tracks"].join(asked.where("status = 'ok'").select(F.col("path").alias("backing_path")).distinct(), "backing_path", "left_semi").select(F.col("id").alias("track_id"))
        touched = materialize(ids.unionByName(named.select("track_id")).unionByName(pruned).distinct(), "event-tracks")
        of = lambda table, key: now[table].join(touched.withColumnRenamed("track_id", key), key, "left_semi").select(*now[table].columns)
        small = {**now, "tracks": of("tracks", "id"), "tags": of("tags", "track_id"), "track_art": of("track_art", "track_id")}
        synced, _, problems, _ = sync_records(small, pairs, mode=self.mode)

        first = asked.where("status = 'ok'").join(problems.select(F.col("record_key").alias("path")).distinct(), "path", "left_anti")
        first = first.groupBy("path").agg(F.min("event_id").alias("first_sync"))
        first = small["tracks"].select(F.col("id").alias("track_id"), F.col("backing_path").alias("path")).join(first, "path").select("track_id", "first_sync")
        early = named.join(first, "track_id", "left").where("first_sync IS NULL OR event_id < first_sync")
        late = self._named(synced["tags"], deletes).join(first, "track_id").where("event_id > first_sync")
        removed = materialize(early.select("track_id").unionByName(late.select("track_id")).unionByName(pruned).distinct(), "event-removed")

        reject = lambda rows, reason: rows.select("event_id", "path", reason.alias("reason"))
        no_path = F.lit(None).cast("string").alias("path")
        self._write(
            reject(routed.where("action = 'reject'").select("event_id", no_path), F.lit("no artist or album id"))
            .unionByName(reject(marked.where("status = 'ambiguous'"), F.lit("several collection files")))
            .unionByName(reject(asked.where("status <> 'ok'"), F.col("status")))
            .unionByName(reject(asked.join(problems.select(F.col("record_key").alias("path"), "problem"), "path"), F.col("problem"))),
            "rejects", batch_id,
        )
        self._write(synced["tracks"].join(removed.withColumnRenamed("track_id", "id"), "id", "left_anti").select(*now["tracks"].columns), "tracks", batch_id)
        self._write(synced["tags"].join(removed, "track_id", "left_anti").select(*now["tags"].columns), "tags", batch_id)
        # What counts as touched is written last: rows of a batch that broke off before are not looked at.
        self._write(touched.join(removed.withColumn("removed", F.lit(True)), "track_id", "left").select("track_id", F.coalesce("removed", F.lit(False)).alias("removed")), "touched", batch_id)

    def _named(self, tags: DataFrame, deletes: DataFrame) -> DataFrame:
        """track_id, event_id: owned tracks with the tag that a delete event names, by its first and last such event."""
        d = deletes.groupBy("key", "value").agg(F.array_distinct(F.array(F.min("event_id"), F.max("event_id"))).alias("events"))
        hits = text_tags(tags).join(d, ["key", "value"]).select("track_id", F.explode("events").alias("event_id"))
        return hits.join(tracks_with_tag(tags, self.owner_key, OWNER_VALUE), "track_id", "left_semi")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def run_events(stream: DataFrame, run: EventRun, checkpoint: str):
    """Apply a stream of raw events until the input is used up."""
    query = stream.writeStream.foreachBatch(run.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
