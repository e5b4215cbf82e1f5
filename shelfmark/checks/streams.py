"""I: streaming operators over the events table."""

import os

from pyspark.sql import functions as F

from shelfmark.checks.fixtures import Fixtures, query
from shelfmark.checks.functions import FIELDS
from shelfmark.checks.joins import VIEWS, INVALID, views
from shelfmark.operators import refresh as R
from shelfmark.plans.view import render
from shelfmark.sources.shared import fresh_path
from shelfmark.sources.bucketed import BucketedTable
from shelfmark.streaming import events as EV
from shelfmark.streaming import tail as TL
from shelfmark.streaming.log import ChangeLog

TEMPLATE = "$albumartist/$album/[$disc - ]$title"


def event_stream(spark, d):
    """The events table as a file stream: a folder of files, or the one file by name."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path) or "://" in d:
        return TL.read_log_stream(spark, path, schema)
    return TL.read_log_stream(spark, d, schema, "events.parquet")


def log_stream(spark, d):
    return event_stream(spark, d).select((F.col("event_id") + 1).alias("seq"), (F.col("user_id") + 1).alias("track_id"), "event_type")


def seeded(spark, d, last_seq, template=TEMPLATE, **options):
    """A state whose snapshot is one version behind for every second track and lacks every fifth."""
    fx = Fixtures(spark, d)
    state = TL.SnapshotState(spark, fresh_path(spark, "view"), **options)
    i = F.col("id")
    old = render(fx.tracks(), fx.tags(), template, default="Unknown").where(i % 5 != 0)
    old = old.withColumn("content_version", F.col("content_version") - F.when(i % 2 == 0, 1).otherwise(0)).withColumn("path", F.when(i % 2 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")))
    state.replace_all(old, {"last_seq": last_seq})
    return fx, state


def bucketed(spark, fx):
    """The catalogue as the refresh wants it at scale: tracks and tags in buckets of the track id."""
    root, tracks, tags = fresh_path(spark, "catalogue"), fx.tracks().select("id", "content_version", "format"), fx.tags()
    tables = BucketedTable(spark, f"{root}/tracks", tracks.schema.toDDL(), "id"), BucketedTable(spark, f"{root}/tags", tags.schema.toDDL(), "track_id")
    for table, rows in zip(tables, (tracks, tags)):
        table.replace(rows)
    return tables


SEEN = "ids AS (SELECT DISTINCT track_id AS id FROM log_fx WHERE seq > 0)"
RENDERED = f"{FIELDS}, r AS (SELECT f.id, t.content_version, f.format, concat(COALESCE(aa, 'Unknown'), '/', al, '/', CASE WHEN di IS NOT NULL THEN concat(di, ' - ') ELSE '' END, ti, '.', f.format) AS path FROM f JOIN tracks_fx t ON t.id = f.id)"


@query(
    "i01_tail_snapshot",
    f"""WITH {RENDERED}, {SEEN} SELECT * FROM r WHERE id IN (SELECT id FROM ids)
    UNION ALL SELECT id, content_version - CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END, format, CASE WHEN id % 2 = 0 THEN concat('old/', path) ELSE path END FROM r WHERE id NOT IN (SELECT id FROM ids) AND id % 5 <> 0""",
)
def i01(spark, d):
    fx, state = seeded(spark, d, 0)
    TL.tail_log(log_stream(spark, d), state, lambda: (fx.tracks(), fx.tags()), TEMPLATE, fresh_path(spark, "tail"), default="Unknown")
    return state.read()


@query("i02_gap_rebuild", f"WITH {RENDERED} SELECT *, 1 AS gaps FROM r")
def i02(spark, d):
    """The log begins at 501 while the watermark is 0: one full rebuild."""
    fx, state = seeded(spark, d, 0)
    TL.tail_log(log_stream(spark, d).where("seq > 500"), state, lambda: (fx.tracks(), fx.tags()), TEMPLATE, fresh_path(spark, "tail"), default="Unknown")
    return state.read().withColumn("gaps", F.lit(state.facts()["gaps"]).cast("int"))


@query("i02_emptied_log", f"WITH {RENDERED} SELECT *, 1 AS gaps FROM r")
def i02e(spark, d):
    """An emptied log behind a watermark: one rebuild, though the batch has no rows; the next empty batches are idle."""
    fx, state = seeded(spark, d, 100)
    log = ChangeLog(spark, fresh_path(spark, "log"))
    log.append(fx.log())
    log.clear()
    load = lambda: (fx.tracks(), fx.tags())
    for batch in range(3):
        TL.apply_batch(state, log.read(), load, TEMPLATE, batch, head=log.head(), default="Unknown")
    return state.read().withColumn("gaps", F.lit(state.facts()["gaps"]).cast("int"))


@query("i02_gap_decision", "SELECT w.last_seq, max_seq, CASE WHEN max_seq = 0 THEN w.last_seq > 0 ELSE min_seq > w.last_seq + 1 END AS gap FROM (SELECT min(seq) AS min_seq, max(seq) AS max_seq FROM log_fx) b, (SELECT DISTINCT seq - 95 AS last_seq FROM log_fx) w")
def i02d(spark, d):
    log = Fixtures(spark, d).log()
    marks = log.select((F.col("seq") - 95).alias("last_seq")).distinct()
    bounds = R.log_bounds(log).select(F.struct("min_seq", "max_seq")).scalar()
    marks = marks.withColumn("b", bounds).select("last_seq", "b.min_seq", "b.max_seq")
    return R.gap_rows(marks, "last_seq").select("last_seq", "max_seq", "gap")


@query("i03_watermark", "SELECT greatest(max(seq), 100) AS last_seq FROM log_fx")
def i03(spark, d):
    """Batches in order, then an old one again: the watermark ends at the newest and stays there."""
    fx, state = seeded(spark, d, 0)
    log = fx.log().select("seq", "track_id")
    load = lambda: (fx.tracks(), fx.tags())
    for batch, upto in enumerate((100, None, 50)):
        part = log if upto is None else log.where(F.col("seq") <= upto)
        TL.apply_batch(state, part, load, TEMPLATE, batch, default="Unknown")
    return spark.range(1).select(F.lit(state.facts()["last_seq"]).cast("bigint").alias("last_seq"))


def _refresh(spark, d):
    fx = Fixtures(spark, d)
    old, _, _, _ = views(fx)
    live = fx.tracks().where("id % 5 <> 0")
    prev = old.join(fx.tracks().select("id", "format"), "id").withColumn("content_version", F.col("content_version") - 1)
    ids = fx.tracks().where("id % 3 <> 0").select("id")
    changes = R.partition_changes(prev, ids, live)
    rendered = render(live.join(R.to_render(changes), "id", "left_semi"), fx.tags(), "$albumartist/$title", skip_missing=True)
    final = R.reconcile_dropped(changes, rendered)
    return prev, final, R.merge_snapshot(prev, final, rendered.where("path is not null"))


@query(
    "i04_refresh_snapshot",
    f"""WITH {FIELDS} SELECT t.id, CASE WHEN t.id % 3 = 0 THEN t.content_version - 1 ELSE t.content_version END AS content_version, t.format,
    CASE WHEN t.id % 3 = 0 THEN concat('a/', t.id) ELSE concat(aa, '/', ti, '.', t.format) END AS path FROM tracks_fx t JOIN f ON f.id = t.id
    WHERE CASE WHEN t.id % 3 = 0 THEN t.id % 7 <> 0 ELSE t.id % 5 <> 0 AND aa IS NOT NULL END""",
)
def i04(spark, d):
    return _refresh(spark, d)[2]


@query("i05_version_counters", "SELECT track_id, CAST(sum(bump) AS BIGINT) AS content_version FROM log_fx GROUP BY track_id")
def i05(spark, d):
    checkpoint = fresh_path(spark, "counters")
    bumps = log_stream(spark, d).select("track_id", F.when(F.col("event_type") == "error", 0).otherwise(1).cast("bigint").alias("bump"))
    TL.version_counters(bumps, checkpoint)
    return TL.current_counters(spark, checkpoint)


@query("i06_bounded_log", "SELECT seq, track_id FROM log_fx WHERE seq > (SELECT max(seq) FROM log_fx) - 700")
def i06(spark, d):
    log = ChangeLog(spark, fresh_path(spark, "ring"), ring=700)
    query_ = log_stream(spark, d).writeStream.foreachBatch(lambda b, _: log.append(b)).option("checkpointLocation", fresh_path(spark, "ring-checkpoint")).trigger(availableNow=True).start()
    query_.awaitTermination()
    return log.read()


RAW = """raw AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Test' WHEN 1 THEN 'AlbumDownload' WHEN 2 THEN 'Rename' WHEN 3 THEN 'TrackRetag' WHEN 4 THEN 'ArtistDeleted' WHEN 5 THEN 'AlbumDeleted' WHEN 6 THEN event_type ELSE 'Rename' END AS raw_type,
    CASE WHEN user_id % 5 > 0 THEN user_id END AS artist_id, CASE WHEN user_id % 3 = 0 THEN event_id END AS album_id, CASE WHEN event_id % 3 > 0 THEN concat('al', user_id) END AS album_mbid, CASE WHEN event_id % 5 > 0 THEN concat('ar', user_id) END AS artist_mbid, event_type, user_id FROM events)"""


def raw_events(e):
    i, u = F.col("event_id"), F.col("user_id")
    us = u.cast("string")
    kind = F.when(i % 8 == 0, "Test").when(i % 8 == 1, "AlbumDownload").when((i % 8 == 2) | (i % 8 == 7), "Rename").when(i % 8 == 3, "TrackRetag").when(i % 8 == 4, "ArtistDeleted").when(i % 8 == 5, "AlbumDeleted").otherwise(F.col("event_type"))
    return e.select(
        "event_id", kind.alias("raw_type"), F.concat(F.lit("/n/"), us, F.lit("||/m/"), us).alias("added_paths"), F.concat(F.lit("/r/"), us).alias("file_paths"),
        F.when(i % 8 == 2, F.concat(F.lit("/o/"), us, F.lit("|"))).alias("previous_paths"), F.when(u % 5 > 0, F.concat(us, F.lit(" "))).otherwise("x").alias("artist_id"),
        F.when(u % 3 == 0, i.cast("string")).alias("album_id"), F.when(i % 3 > 0, F.concat(F.lit(" al"), us)).otherwise(" ").alias("album_mbid"), F.when(i % 5 > 0, F.concat(F.lit("ar"), us)).alias("artist_mbid"),
    )


@query(
    "i10_event_routing",
    f"""WITH {RAW} SELECT event_id, CASE WHEN event_id % 8 IN (0, 3, 6) THEN 'none' WHEN event_id % 8 = 4 THEN CASE WHEN artist_mbid IS NULL THEN 'none' ELSE 'delete' END WHEN event_id % 8 = 5 THEN CASE WHEN album_mbid IS NULL THEN 'none' ELSE 'delete' END
      WHEN artist_id IS NULL AND album_id IS NULL THEN 'reject' WHEN event_id % 8 = 2 THEN 'sync_prune' ELSE 'sync' END AS action,
    CASE event_id % 8 WHEN 1 THEN concat('/n/', user_id, '+/m/', user_id) WHEN 2 THEN concat('/r/', user_id) WHEN 7 THEN concat('/r/', user_id) ELSE '' END AS paths, CASE WHEN event_id % 8 = 2 THEN concat('/o/', user_id) ELSE '' END AS previous_paths,
    CASE WHEN event_id % 8 = 4 THEN artist_mbid WHEN event_id % 8 = 5 THEN album_mbid END AS delete_value FROM raw""",
)
def i10(spark, d):
    out = fresh_path(spark, "routed")
    routed = EV.route_events(EV.parse_events(raw_events(event_stream(spark, d))))
    flat = routed.select("event_id", "action", F.array_join("paths", "+").alias("paths"), F.array_join("previous_paths", "+").alias("previous_paths"), "delete_value")
    flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "routed-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(out)


# The run's own library: four tracks a user, at the paths that the events name.
RUN = f"""{RAW}, tr AS (SELECT id, id // 4 AS u, id % 4 AS v, concat('/', substr('nmro', CAST(id % 4 + 1 AS INT), 1), '/', id // 4) AS path FROM tracks_fx),
    ok AS (SELECT tr.*, c.c_name AS name FROM tr JOIN customer c ON c.c_custkey = tr.u WHERE v < 3 AND id % 11 <> 0),
    sync AS (SELECT event_id, user_id AS u, event_id % 8 AS k FROM raw WHERE event_id % 8 IN (1, 2, 7) AND (artist_id IS NOT NULL OR album_id IS NOT NULL)),
    first AS (SELECT ok.id, ok.name, min(sync.event_id) AS s FROM ok JOIN sync ON sync.u = ok.u AND (sync.k = 1) = (ok.v < 2) GROUP BY ok.id, ok.name),
    gone AS (SELECT id FROM tr WHERE id % 3 = 0 AND EXISTS (SELECT 1 FROM raw e WHERE e.event_id % 8 = 5 AND e.user_id = tr.u AND e.album_mbid IS NOT NULL)
      UNION SELECT f.id FROM first f JOIN tr ON tr.id = f.id WHERE EXISTS (SELECT 1 FROM raw e WHERE e.event_id % 8 = 4 AND e.user_id = tr.u AND e.artist_mbid IS NOT NULL AND e.event_id > f.s)
      UNION SELECT id FROM tr WHERE v = 3 AND id % 8 <> 3 AND EXISTS (SELECT 1 FROM sync e WHERE e.k = 2 AND e.u = tr.u)),
    live AS (SELECT tr.id, tr.u, first.s, first.name FROM tr LEFT JOIN first ON first.id = tr.id WHERE tr.id NOT IN (SELECT id FROM gone))"""


def run_library(fx):
    """catalogue, collection and inventory of the run."""
    n = fx.tracks().select("id", F.floor(F.col("id") / 4).alias("u"), (F.col("id") % 4).cast("int").alias("v"))
    path = F.concat(F.lit("/"), F.substring(F.lit("nmro"), F.col("v") + 1, F.lit(1)), F.lit("/"), F.col("u").cast("string"))
    n = n.withColumn("path", path)
    text = lambda rows, key, value: rows.select(F.col("id").alias("track_id"), F.lit(key).alias("key"), value.alias("value"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(None).cast("binary").alias("value_blob"))
    owned = n.where("id % 3 = 0")
    tags = text(n, "title", F.lit("old")).unionByName(text(owned, "musicbrainz_albumid", F.concat(F.lit("al"), F.col("u").cast("string")))).unionByName(text(owned, EV.OWNER_KEY, F.lit("1")))
    cat = fx.catalogue()
    tracks = fx.tracks().join(n.select("id", "path"), "id").withColumn("backing_path", F.col("path")).select(*cat["tracks"].columns)
    none, genres = F.lit(None).cast("string"), F.array().cast("array<string>")
    collection = {
        "files": n.where("v < 3").select("id", F.col("u").cast("string").alias("artistId"), F.lit("1").alias("albumId"), "path"),
        "tracks": n.where("v < 3 AND id % 11 <> 0").select(
            "id", none.alias("artistId"), none.alias("albumId"), F.col("id").alias("trackFileId"), *[none.alias(c) for c in ("foreignTrackId", "foreignRecordingId", "trackNumber", "absoluteTrackNumber", "mediumNumber")],
            F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"),
        ),
        "albums": fx.table("nation").where("n_nationkey = 1").select(F.lit("1").alias("id"), F.lit("Album").alias("title"), none.alias("foreignAlbumId"), none.alias("releaseDate"), genres.alias("genres")),
        "artists": fx.table("customer").select(
            F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("artistName"), none.alias("name"), F.concat(F.lit("ar"), F.col("c_custkey").cast("string")).alias("foreignArtistId"), none.alias("mbId"), genres.alias("genres")
        ),
    }
    return {**cat, "tracks": tracks, "tags": tags}, collection, n.where("id % 8 = 3 OR v < 3").select("path")


def event_run(spark, d):
    catalogue, collection, inventory = run_library(Fixtures(spark, d))
    run = EV.EventRun(spark, fresh_path(spark, "event-run"), lambda: catalogue, lambda: collection, lambda: inventory)
    EV.run_events(raw_events(event_stream(spark, d)), run, fresh_path(spark, "event-run-checkpoint"))
    return run


@query(
    "i10_run",
    f"""WITH {RUN} SELECT id, key, value FROM (
      SELECT id, 'title' AS key, CASE WHEN s IS NULL THEN 'old' ELSE concat('T', id) END AS value FROM live
      UNION ALL SELECT id, 'musicbrainz_albumid', concat('al', u) FROM live WHERE id % 3 = 0
      UNION ALL SELECT id, 'collection_managed', '1' FROM live WHERE id % 3 = 0 OR s IS NOT NULL
      UNION ALL SELECT id, k, name FROM live, (VALUES ('artist'), ('albumartist')) v(k) WHERE s IS NOT NULL
      UNION ALL SELECT id, 'album', 'Album' FROM live WHERE s IS NOT NULL
      UNION ALL SELECT id, 'musicbrainz_artistid', concat('ar', u) FROM live WHERE s IS NOT NULL) x""",
)
def i10run(spark, d):
    """All event types through the run: syncs, prunes and deletes carried out on the catalogue."""
    return event_run(spark, d).current()["tags"].select(F.col("track_id").alias("id"), "key", "value")


@query(
    "i10_run_rejects",
    f"""WITH {RUN}, paths AS (SELECT event_id, unnest(CASE WHEN k = 1 THEN [concat('/n/', u), concat('/m/', u)] ELSE [concat('/r/', u)] END) AS path FROM sync)
    SELECT event_id, CAST(NULL AS VARCHAR) AS path, 'no artist or album id' AS reason FROM raw WHERE event_id % 8 IN (1, 2, 7) AND artist_id IS NULL AND album_id IS NULL
    UNION ALL SELECT p.event_id, p.path, CASE WHEN tr.id IS NULL THEN 'no matching track file' WHEN tr.id % 11 = 0 THEN 'multi-track metadata unavailable' ELSE 'album or artist metadata unavailable' END
      FROM paths p LEFT JOIN tr ON tr.path = p.path WHERE p.path NOT IN (SELECT path FROM ok)""",
)
def i10rej(spark, d):
    return event_run(spark, d).rejects().drop("batch")


@query("i11_notify_set", f"WITH {VIEWS} {INVALID}")
def i11(spark, d):
    """Nodes to invalidate per refresh, written to a sink table."""
    out = fresh_path(spark, "notify")
    fx = Fixtures(spark, d)
    i = F.col("id")
    state = F.when(i % 5 == 0, "removed").when(i % 7 == 0, "added").otherwise("changed")
    hits = R.invalidated_nodes(*views(fx), changes=fx.tracks().select("id", state.alias("change")))
    hits.write.parquet(out)
    return spark.read.schema(hits.schema).parquet(out)


@query(
    "k6_refresh",
    f"""WITH {RENDERED}, {SEEN} SELECT * FROM r WHERE id IN (SELECT id FROM ids)
    UNION ALL SELECT id, content_version - CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END, format, CASE WHEN id % 2 = 0 THEN concat('old/', path) ELSE path END FROM r WHERE id NOT IN (SELECT id FROM ids) AND id % 5 <> 0""",
)
def k6(spark, d):
    fx, state = seeded(spark, d, 0)
    TL.apply_batch(state, fx.log().select("seq", "track_id"), lambda: (fx.tracks(), fx.tags()), TEMPLATE, default="Unknown")
    return state.read()


# Names of this template meet as equal file names only, so a rank by id settles them; the old half lies below one directory.
REFRESHED = f"""s AS (
    SELECT id, content_version, format, concat(COALESCE(al, 'Unknown'), '/', COALESCE(ar, 'Unknown')) AS stem FROM (SELECT f.*, t.content_version FROM f JOIN tracks_fx t ON t.id = f.id)),
  was AS (SELECT id, content_version - CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS content_version, format, CASE WHEN id % 2 = 0 THEN concat('old/', stem) ELSE stem END AS stem FROM s WHERE id % 5 <> 0),
  is_now AS (SELECT * FROM s WHERE id IN (SELECT id FROM ids) UNION ALL SELECT * FROM was WHERE id NOT IN (SELECT id FROM ids)),
  a AS (SELECT *, row_number() OVER (PARTITION BY stem, format ORDER BY id) AS k FROM was), b AS (SELECT *, row_number() OVER (PARTITION BY stem, format ORDER BY id) AS k FROM is_now),
  x AS (SELECT id, content_version, concat(stem, CASE WHEN k > 1 THEN concat(' (', k, ')') ELSE '' END, '.', format) AS final_path FROM a),
  y AS (SELECT id, content_version, concat(stem, CASE WHEN k > 1 THEN concat(' (', k, ')') ELSE '' END, '.', format) AS final_path FROM b)"""


@query(
    "k6_refresh_final_paths",
    f"""WITH {FIELDS}, {SEEN}, {REFRESHED} SELECT y.id, y.content_version, y.final_path, CASE WHEN x.final_path <> y.final_path THEN x.final_path WHEN x.content_version <> y.content_version THEN y.final_path END AS stale,
      CASE WHEN x.final_path <> y.final_path THEN 'moved' WHEN x.content_version <> y.content_version THEN 'content' END AS reason FROM y LEFT JOIN x ON x.id = y.id""",
)
def k6f(spark, d):
    """Final names after one batch, and the old node each track's change made stale; catalogue and state are read by bucket."""
    template = "$album/$artist"
    fx, state = seeded(spark, d, 0, template, places=True)
    tables = bucketed(spark, fx)
    TL.apply_batch(state, fx.log().select("seq", "track_id"), lambda: tables, template, default="Unknown")
    notes = state.notes(state.facts()["last_seq"]).select("id", F.col("node").alias("stale"), "reason")
    return state.read_places().select("id", "content_version", "final_path").join(notes, "id", "left")
