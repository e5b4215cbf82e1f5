"""D: aggregations. E: windows. F: sorts. G: set operations."""

from pyspark.sql import functions as F

from shelfmark.checks.fixtures import Fixtures, query
from shelfmark.checks.joins import CHANGED, COVER, OLD_SNAP, SEGS, changed, old_snapshot, segments
from shelfmark.functions import paths as P
from shelfmark.functions import values as V
from shelfmark.operators import catalog as C
from shelfmark.operators import ingest as I
from shelfmark.operators import layout as L
from shelfmark.operators import mapping as M
from shelfmark.operators import refresh as R
from shelfmark.operators import tree as T
from shelfmark.operators.ordered import id_bucket, ranked
from shelfmark.operators.rules import tracks_over_cap

LIST = "string_agg(concat(key, '#', ordinal, '=', value), '|' ORDER BY key, ordinal)"


@query("d01_grouped_tags", f"SELECT track_id, {LIST} AS tags FROM tags_fx GROUP BY track_id")
def d01(spark, d):
    listed = C.grouped_tags(Fixtures(spark, d).tags_with_blobs())
    text = F.transform("tags", lambda t: F.concat(t["key"], F.lit("#"), t["ordinal"].cast("string"), F.lit("="), t["value"]))
    return listed.select("track_id", F.array_join(text, "|").alias("tags"))


@query("d01_over_cap", f"SELECT track_id, CASE WHEN count(*) <= 9 THEN {LIST} END AS tags, CASE WHEN count(*) > 9 THEN 'row_cap' END AS error FROM tags_fx GROUP BY track_id")
def d01c(spark, d):
    """A cap of nine rows: tracks above it stay in the result, with an error."""
    listed = C.grouped_tags(Fixtures(spark, d).tags_with_blobs(), cap=9)
    text = F.transform("tags", lambda t: F.concat(t["key"], F.lit("#"), t["ordinal"].cast("string"), F.lit("="), t["value"]))
    return listed.select("track_id", F.array_join(text, "|").alias("tags"), "error")


@query("d02_first_values", "SELECT track_id, lower(key) AS field, arg_min(value, (key, ordinal)) AS value FROM tags_fx GROUP BY track_id, lower(key)")
def d02(spark, d):
    return C.first_values(Fixtures(spark, d).tags_with_blobs())


@query(
    "d03_field_columns",
    "SELECT track_id, arg_min(value, (key, ordinal)) FILTER (lower(key) = 'artist') AS artist, arg_min(value, (key, ordinal)) FILTER (lower(key) = 'disc') AS disc, arg_min(value, (key, ordinal)) FILTER (lower(key) = 'genre') AS genre FROM tags_fx WHERE lower(key) IN ('artist', 'disc', 'genre') GROUP BY track_id",
)
def d03(spark, d):
    cols = C.field_columns(Fixtures(spark, d).tags(), ["artist", "disc", "genre"])
    return cols.select("track_id", F.col("f_0").alias("artist"), F.col("f_1").alias("disc"), F.col("f_2").alias("genre"))


@query("d03_field_map", "SELECT track_id, string_agg(concat(field, '=', value), ',' ORDER BY field) AS fields FROM (SELECT track_id, lower(key) AS field, arg_min(value, (key, ordinal)) AS value FROM tags_fx GROUP BY track_id, lower(key)) f GROUP BY track_id")
def d03m(spark, d):
    fields = C.field_map(Fixtures(spark, d).tags())
    text = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return fields.select("track_id", F.array_join(text, ",").alias("fields"))


@query("d04_content_dedup", "SELECT sha256(text) AS sha256, arg_min(lang, doc_id) AS mime, CAST(strlen(any_value(text)) AS BIGINT) AS byte_len FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY sha256(text)")
def d04(spark, d):
    docs = Fixtures(spark, d).table("documents")
    stored = docs.where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("sha256"))
    images = docs.select(F.col("text").cast("binary").alias("data"), F.col("lang").alias("mime"), F.col("doc_id").alias("pos"))
    return C.dedup_art(images, stored).select("sha256", "mime", "byte_len")


@query("d05_tracks_over_cap", "SELECT track_id, count(*) AS n_rows FROM tags_fx GROUP BY track_id HAVING count(*) > 9")
def d05(spark, d):
    return tracks_over_cap(Fixtures(spark, d).tags(), 9)


EXT = "CASE WHEN path LIKE '%.%' THEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) ELSE '<none>' END"
SUPPORTED = "('flac','mp3','m4a','m4b','ogg','oga','opus','wav')"
TALLY = f"SELECT {EXT} AS ext, count(*) AS n FROM files_fx WHERE {EXT} NOT IN {SUPPORTED} GROUP BY 1"


@query("d06_skip_tally", TALLY)
def d06(spark, d):
    return I.skip_tally(Fixtures(spark, d).files())


@query(
    "d07_scan_stats",
    f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN {EXT} NOT IN {SUPPORTED} THEN 'skipped' WHEN path IN (SELECT backing_path FROM tracks_fx) THEN 'already_present' ELSE 'scanned' END AS status FROM files_fx) t GROUP BY status""",
)
def d07(spark, d):
    fx = Fixtures(spark, d)
    t = fx.tracks().select(F.col("backing_path").alias("path"), F.lit(True).alias("known"))
    f = fx.files().join(t, "path", "left")
    status = F.when(~P.extension_of("path").isin(*I.EXTENSIONS), "skipped").when(F.col("known"), "already_present").otherwise("scanned")
    return f.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "d08_revalidate_stats",
    """SELECT state, count(*) AS n FROM (SELECT CASE WHEN f.mtime_ns = t.backing_mtime_ns AND NOT (t.format = 'flac' AND t.id NOT IN (SELECT track_id FROM blocks_fx)) THEN 'unchanged' ELSE 'changed' END AS state FROM files_fx f JOIN tracks_fx t ON t.backing_path = f.path) s GROUP BY state""",
)
def d08(spark, d):
    fx = Fixtures(spark, d)
    return I.classify_known(fx.files(), fx.tracks(), fx.blocks()).groupBy("state").agg(F.count("*").alias("n"))


@query("d10_log_bounds", "SELECT COALESCE(min(seq), 0) AS min_seq, COALESCE(max(seq), 0) AS max_seq FROM log_fx")
def d10(spark, d):
    return R.log_bounds(Fixtures(spark, d).log())


@query("d10_log_bounds_empty", "SELECT COALESCE(min(seq), 0) AS min_seq, COALESCE(max(seq), 0) AS max_seq FROM log_fx WHERE seq < 0")
def d10e(spark, d):
    return R.log_bounds(Fixtures(spark, d).log().where("seq < 0"))


@query("d10_changed_ids", "SELECT DISTINCT track_id AS id FROM log_fx WHERE seq > 500")
def d10i(spark, d):
    return R.changed_ids(Fixtures(spark, d).log(), 500)


@query("d11_distinct_tracks", "SELECT (SELECT count(DISTINCT track_id) FROM tags_fx WHERE lower(key) = 'artist' AND value <> '') AS with_artist, (SELECT count(DISTINCT track_id) FROM track_art_fx) AS with_art")
def d11(spark, d):
    fx = Fixtures(spark, d)
    a = C.tags_for_keys(fx.tags(), ["artist"]).where("value <> ''").agg(F.countDistinct("track_id").alias("with_artist"))
    return a.withColumn("with_art", fx.track_art().agg(F.countDistinct("track_id")).scalar())


@query(
    "d12_tree_counts",
    "SELECT count(*) AS files, (SELECT count(*) FROM (SELECT DISTINCT regexp_extract(backing_path, '^/lib/c[0-9]+') FROM tracks_fx UNION ALL SELECT DISTINCT regexp_extract(backing_path, '^/lib/c[0-9]+/[A-Z]+') FROM tracks_fx) p) + 1 AS dirs FROM tracks_fx",
)
def d12(spark, d):
    t = Fixtures(spark, d).tracks()
    placed = _as_placed(t)
    return T.entry_counts(T.tree_nodes(placed))


def _as_placed(t):
    """Backing paths as a view that is already free of collisions."""
    path = F.ltrim("backing_path", F.lit("/"))
    name = F.element_at(F.split(path, "/"), -1)
    return t.select("id", path.alias("final_path"), F.left(path, F.length(path) - F.length(name) - 1).alias("parent_path"), name.alias("name"))


@query(
    "d13_introducing_id",
    """SELECT path, min(id) AS introducing_id FROM (SELECT '' AS path, id FROM tracks_fx UNION ALL SELECT 'lib', id FROM tracks_fx UNION ALL SELECT substr(regexp_extract(backing_path, '^/lib/c[0-9]+'), 2), id FROM tracks_fx
    UNION ALL SELECT substr(regexp_extract(backing_path, '^/lib/c[0-9]+/[A-Z]+'), 2), id FROM tracks_fx) p GROUP BY path""",
)
def d13(spark, d):
    return T.tree_nodes(_as_placed(Fixtures(spark, d).tracks())).where("kind = 'dir'").select("path", "introducing_id")


@query("d14_cover_choice", f"WITH {COVER} SELECT album_id, url FROM cover WHERE url IS NOT NULL")
def d14(spark, d):
    return M.cover_choice(Fixtures(spark, d).albums())


@query("d15_linked_tracks", "SELECT f.id AS file_id, f.path, t.id AS track_id FROM cfiles_fx f JOIN ctracks_fx t ON t.file_id = f.id")
def d15(spark, d):
    fx = Fixtures(spark, d)
    return M.linked_tracks(fx.collection_files(), fx.collection_tracks()).select("file_id", "path", "track_id")


@query("d16_normal_form", "SELECT track_id, key, value, count(*) AS n FROM tags_fx GROUP BY track_id, key, value")
def d16(spark, d):
    return M.normal_form(Fixtures(spark, d).tags(), "track_id")


@query(
    "d17_payload_weight",
    """SELECT track_id, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT track_id, a.byte_len AS n FROM track_art_fx t JOIN art_fx a ON a.sha256 = t.art_sha256 UNION ALL SELECT track_id, strlen(blob) FROM tagsb_fx WHERE blob IS NOT NULL UNION ALL SELECT track_id, strlen(body) FROM blocks_fx) w GROUP BY track_id""",
)
def d17(spark, d):
    fx = Fixtures(spark, d)
    links = fx.track_art().join(fx.art().select(F.col("sha256").alias("art_sha256"), "byte_len"), "art_sha256")
    binary = C.binary_tags(fx.tags_with_blobs()).select("track_id", F.octet_length("value_blob").alias("byte_len"))
    return C.payload_weight(links, binary, fx.blocks().select("track_id", F.octet_length("body").alias("byte_len")))


@query(
    "d18_layout_totals",
    "SELECT l_orderkey AS file_id, CAST(sum(l_quantity) AS BIGINT) AS total_len, CAST(COALESCE(sum(l_quantity) FILTER (l_returnflag <> 'A'), 0) AS BIGINT) AS header_len FROM lineitem GROUP BY l_orderkey",
)
def d18(spark, d):
    segs = Fixtures(spark, d).table("lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_quantity").cast("bigint").alias("len"), F.when(F.col("l_returnflag") == "A", "audio").otherwise("tag").alias("kind"))
    return L.layout_totals(segs)


@query("d19_candidates", "SELECT fingerprint, count(*) AS n FROM tracks_fx GROUP BY fingerprint HAVING count(*) > 1")
def d19(spark, d):
    return Fixtures(spark, d).tracks().where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "d20_ordered_genres",
    """SELECT f.id AS file_id, concat('Rock|', al.region, '|', CASE WHEN ar.segment <> 'Rock' THEN ar.segment END) AS genres FROM cfiles_fx f JOIN albums_fx al ON al.num = f.album_id JOIN artists_fx ar ON ar.num = f.artist_id""",
)
def d20(spark, d):
    fx = Fixtures(spark, d)
    al = fx.albums().select(F.col("id").alias("albumId"), F.col("genres").alias("ag"))
    ar = fx.artists().select(F.col("id").alias("artistId"), F.col("genres").alias("bg"))
    j = fx.collection_files().join(al, "albumId").join(ar, "artistId")
    return j.select(F.col("id").alias("file_id"), F.array_join(V.ordered_distinct_texts("ag", "bg"), "|").alias("genres"))


# E: windows


@query("e01_ordinals", "SELECT track_id, key, value, row_number() OVER (PARTITION BY track_id, key ORDER BY value) - 1 AS ordinal FROM tags_fx")
def e01(spark, d):
    rows = Fixtures(spark, d).tags().withColumnRenamed("ordinal", "pos")
    return C.with_ordinals(rows).select("track_id", "key", "value", "ordinal")


@query("e02_collision_rank", "SELECT id, dir, format, row_number() OVER (PARTITION BY dir, format ORDER BY id) AS rank FROM (SELECT id, format, regexp_extract(backing_path, '^(/lib/c[0-9]+)/', 1) AS dir FROM tracks_fx) t")
def e02(spark, d):
    t = Fixtures(spark, d).tracks().select("id", "format", F.regexp_extract("backing_path", "^(/lib/c[0-9]+)/", 1).alias("dir"))
    return ranked(t, ["dir", "format"], ["id"], id_bucket("id"))


@query("e02_collision_rank_hot", "SELECT id, format, row_number() OVER (PARTITION BY format ORDER BY id) AS rank FROM tracks_fx")
def e02h(spark, d):
    """The same rank with every group treated as hot: buckets of 64 ids and offsets."""
    t = Fixtures(spark, d).tracks().select("id", "format")
    return ranked(t, ["format"], ["id"], F.floor(F.col("id") / 64), hot_rows=10)


@query("e03_block_ordinals", "SELECT track_id, kind, pos, row_number() OVER (PARTITION BY track_id, kind ORDER BY pos) - 1 AS ordinal FROM (SELECT user_id AS track_id, CASE WHEN event_type = 'click' THEN 'STREAMINFO' ELSE 'SEEKTABLE' END AS kind, event_id AS pos FROM events) t")
def e03(spark, d):
    kind = F.when(F.col("event_type") == "click", "STREAMINFO").otherwise("SEEKTABLE")
    e = Fixtures(spark, d).table("events").select(F.col("user_id").alias("track_id"), kind.alias("kind"), F.col("event_id").alias("pos"))
    return C.with_ordinals(e, ("track_id", "kind")).select("track_id", "kind", "pos", "ordinal")


@query("e04_gap_free_ordinals", "SELECT track_id, art_sha256, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) - 1 AS ordinal FROM track_art_fx WHERE picture_type <= 20")
def e04(spark, d):
    kept = Fixtures(spark, d).track_art().where("picture_type <= 20").withColumnRenamed("ordinal", "pos")
    return C.with_ordinals(kept, ("track_id",)).select("track_id", "art_sha256", "ordinal")


@query("e05_first_and_last_by_path", "SELECT user_id, arg_min(event_type, event_id) AS first_wins, arg_max(event_type, event_id) AS last_wins FROM events GROUP BY user_id")
def e05(spark, d):
    e = Fixtures(spark, d).table("events")
    return e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_wins"), F.max_by("event_type", "event_id").alias("last_wins"))


@query("e06_segment_starts", f"WITH {SEGS} SELECT file_id, len, CAST(seg_start AS BIGINT) AS seg_start FROM starts")
def e06(spark, d):
    return L.segment_starts(segments(Fixtures(spark, d))).select("file_id", "len", "seg_start")


@query(
    "e07_geometry_changes",
    "SELECT seq, track_id AS id, COALESCE(lag(seq % 3) OVER (PARTITION BY track_id ORDER BY seq) <> seq % 3, false) AS geometry_changed FROM log_fx",
)
def e07(spark, d):
    z = F.lit(0).cast("bigint")
    h = Fixtures(spark, d).log().select("seq", F.col("track_id").alias("id"), F.lit("flac").alias("format"), (F.col("seq") % 3).alias("audio_offset"), z.alias("audio_length"), z.alias("backing_size"), z.alias("backing_mtime_ns"))
    return R.geometry_changes(h, hot_rows=1000).select("seq", "id", "geometry_changed")


@query("e08_running_versions", "SELECT seq, track_id, CAST(sum(bump) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS content_version FROM log_fx")
def e08(spark, d):
    return R.running_versions(Fixtures(spark, d).log_versions()).select("seq", "track_id", "content_version")


@query("e09_ring_retention", "SELECT seq, track_id FROM log_fx WHERE seq > (SELECT max(seq) FROM log_fx) - 8192")
def e09(spark, d):
    return R.retained_log(Fixtures(spark, d).log()).select("seq", "track_id")


@query(
    "e10_display_casing",
    "SELECT folded, arg_min(name, id) AS display, min(id) AS first_id FROM (SELECT id, lower(name) AS folded, name FROM (SELECT id, CASE WHEN id % 3 = 0 THEN upper(format) ELSE format END AS name FROM tracks_fx) n) t GROUP BY folded",
)
def e10(spark, d):
    t = Fixtures(spark, d).tracks().select("id", F.concat(F.when(F.col("id") % 3 == 0, F.upper("format")).otherwise(F.col("format")), F.lit("/x")).alias("path"))
    w = T.directory_wishes(T.split_names(t, folded=True))
    return w.select(F.col("key").alias("folded"), "display", F.col("dir_min").alias("first_id"))


# F: sorts


@query("f01_build_order", "SELECT id, format FROM tracks_fx ORDER BY id")
def f01(spark, d):
    return Fixtures(spark, d).tracks().select("id", "format").orderBy("id")


@query(
    "f02_skip_summary",
    f"WITH t AS ({TALLY}) SELECT concat('skipped ', (SELECT sum(n) FROM t), ': ', (SELECT string_agg(concat(ext, '=', n), ', ' ORDER BY n DESC, ext) FROM t)) AS summary",
)
def f02(spark, d):
    return I.skip_summary(I.skip_tally(Fixtures(spark, d).files()))


@query("f03_path_preview", "SELECT backing_path AS final_path FROM tracks_fx ORDER BY string_split(backing_path, '/') LIMIT 30")
def f03(spark, d):
    return T.preview_paths(Fixtures(spark, d).tracks().select(F.col("backing_path").alias("final_path")))


@query("f04_directory_listing", "SELECT DISTINCT regexp_extract(backing_path, '^/lib/(c[0-9]+)/', 1) AS name, 'dir' AS kind FROM tracks_fx ORDER BY name")
def f04(spark, d):
    return T.listing(T.tree_nodes(_as_placed(Fixtures(spark, d).tracks())), "lib").select("name", "kind")


# G: set operations


@query(
    "g01_managed_keys",
    """WITH p AS (SELECT track_id, string_agg(DISTINCT lower(key), ',' ORDER BY lower(key)) AS prev FROM tags_fx WHERE track_id % 2 = 0 OR key <> 'title' GROUP BY track_id)
    SELECT track_id, CASE WHEN contains(prev, 'disc') THEN 'disc,genre' ELSE 'genre' END AS delete_keys, concat('album,albumartist,artist,', CASE WHEN contains(prev, 'disc') THEN 'disc,' ELSE '' END, 'genre,title') AS managed
    FROM p WHERE contains(prev, 'genre') AND contains(prev, 'albumartist')""",
)
def g01(spark, d):
    t = Fixtures(spark, d).tags().where("track_id % 2 = 0 OR key <> 'title'")
    prev = t.groupBy("track_id").agg(F.collect_set(P.ascii_lower("key")).alias("prev"))
    prev = prev.where(F.array_contains("prev", "genre") & F.array_contains("prev", "albumartist"))
    now = F.array(*[F.lit(k) for k in ("title", "album", "artist", "albumartist", "title")])
    m = prev.select("track_id", V.managed_keys("prev", now).alias("m"))
    return m.select("track_id", V.keys_to_csv("m.delete_keys").alias("delete_keys"), V.keys_to_csv("m.managed").alias("managed"))


CHANGES = f"""o AS ({OLD_SNAP}), ch AS ({CHANGED}), c AS (SELECT ch.id, CASE WHEN o.id IS NOT NULL AND t.id IS NOT NULL AND (o.content_version <> t.content_version OR o.format <> t.format) THEN 'changed'
    WHEN o.id IS NULL AND t.id IS NOT NULL THEN 'added' WHEN o.id IS NOT NULL AND t.id IS NULL THEN 'removed' ELSE 'none' END AS change FROM ch LEFT JOIN o ON o.id = ch.id LEFT JOIN tracks_fx t ON t.id = ch.id)"""


def _changes(fx):
    return R.partition_changes(old_snapshot(fx), changed(fx), fx.tracks())


@query("g02_to_render", f"WITH {CHANGES} SELECT id FROM c WHERE change IN ('changed', 'added')")
def g02(spark, d):
    return R.to_render(_changes(Fixtures(spark, d)))


@query(
    "g03_object_diff",
    """WITH e AS (SELECT DISTINCT p_brand AS type, p_type AS name, 'v1' AS def FROM part WHERE p_partkey % 2 = 0), f AS (SELECT DISTINCT p_brand AS type, p_type AS name, CASE WHEN p_type = 'ECONOMY' THEN 'v2' ELSE 'v1' END AS def FROM part WHERE p_partkey % 3 = 0)
    SELECT COALESCE(e.type, f.type) AS type, COALESCE(e.name, f.name) AS name, CASE WHEN f.def IS NULL THEN 'missing' WHEN e.def IS NULL THEN 'unexpected' ELSE 'altered' END AS state
    FROM e FULL JOIN f ON f.type = e.type AND f.name = e.name WHERE f.def IS NULL OR e.def IS NULL OR e.def <> f.def""",
)
def g03(spark, d):
    p = Fixtures(spark, d).table("part").select("p_partkey", F.col("p_brand").alias("type"), F.col("p_type").alias("name"))
    e = p.where("p_partkey % 2 = 0").select("type", "name", F.lit("v1").alias("definition")).distinct()
    f = p.where("p_partkey % 3 = 0").select("type", "name", F.when(F.col("name") == "ECONOMY", "v2").otherwise("v1").alias("definition")).distinct()
    return C.object_diff(e, f)


@query("g04_managed_and_matched", "SELECT track_id FROM tags_fx WHERE key = 'disc' AND value = '1' INTERSECT SELECT track_id FROM tags_fx WHERE key = 'genre' AND value = 'PROMO'")
def g04(spark, d):
    t = Fixtures(spark, d).tags_with_blobs()
    return C.tracks_with_tag(t, "disc", "1").intersect(C.tracks_with_tag(t, "genre", "PROMO"))


@query("g05_reconcile_dropped", f"WITH {CHANGES} SELECT id, CASE WHEN id % 4 = 0 AND change = 'changed' THEN 'removed' ELSE change END AS change FROM c WHERE change <> 'none' AND NOT (change = 'added' AND id % 4 = 0)")
def g05(spark, d):
    fx = Fixtures(spark, d)
    rendered = fx.tracks().select("id", F.when(F.col("id") % 4 != 0, F.lit("p")).alias("path"))
    return R.reconcile_dropped(_changes(fx), rendered)


@query("g07_ordered_distinct_ints", "SELECT event_id, concat_ws(',', CAST(event_id % 7 AS VARCHAR), CASE WHEN user_id <> event_id % 7 THEN CAST(user_id AS VARCHAR) END) AS ids FROM events")
def g07(spark, d):
    e = Fixtures(spark, d).table("events")
    raw = F.array((F.col("event_id") % 7).cast("string"), F.lit("x1"), F.concat(F.lit(" "), F.col("user_id").cast("string")), (F.col("event_id") % 7).cast("string"), F.lit(None).cast("string"))
    ints = F.transform(V.ordered_distinct_ints(raw), lambda v: v.cast("string"))
    return e.select("event_id", F.array_join(ints, ",").alias("ids"))
