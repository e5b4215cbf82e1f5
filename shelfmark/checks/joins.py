"""C: joins, crosswalks, anti joins and the range join."""

from pyspark.sql import functions as F

from shelfmark.checks.fixtures import Fixtures, query
from shelfmark.functions import paths as P
from shelfmark.functions import vocab
from shelfmark.operators import catalog as C
from shelfmark.operators import ingest as I
from shelfmark.operators import layout as L
from shelfmark.operators import mapping as M
from shelfmark.operators import refresh as R
from shelfmark.operators import sync as S


@query(
    "c01_links_with_metadata",
    "SELECT track_id, ordinal, picture_type, art_sha256, mime, byte_len FROM track_art_fx t LEFT JOIN art_fx a ON a.sha256 = t.art_sha256",
)
def c01(spark, d):
    fx = Fixtures(spark, d)
    j = C.links_with_metadata(fx.track_art(), fx.art(), "art_sha256", "sha256")
    return j.select("track_id", "ordinal", "picture_type", "art_sha256", "mime", "byte_len")


@query("c02_orphan_links", "SELECT track_id, ordinal, art_sha256 FROM track_art_fx WHERE art_sha256 NOT IN (SELECT sha256 FROM art_fx)")
def c02(spark, d):
    fx = Fixtures(spark, d)
    return C.orphan_links(fx.track_art(), fx.art(), "art_sha256", "sha256").select("track_id", "ordinal", "art_sha256")


@query("c03_orphan_art", "SELECT sha256, mime FROM art_fx a WHERE NOT EXISTS (SELECT 1 FROM track_art_fx t WHERE t.art_sha256 = a.sha256)")
def c03(spark, d):
    fx = Fixtures(spark, d)
    return C.orphan_art(fx.art(), fx.track_art(), "art_sha256", "sha256").select("sha256", "mime")


@query("c04_unknown_files", "SELECT path, size FROM files_fx f WHERE NOT EXISTS (SELECT 1 FROM tracks_fx t WHERE t.backing_path = f.path)")
def c04(spark, d):
    fx = Fixtures(spark, d)
    return I.unknown_files(fx.files(), fx.tracks()).select("path", "size")


def _c05_sql(lacking):
    return f"""SELECT f.path, t.id, CASE WHEN f.size = t.backing_size AND f.mtime_ns = t.backing_mtime_ns AND f.ctime_ns = t.backing_ctime_ns
      AND NOT (t.format = 'flac' AND t.id NOT IN (SELECT track_id FROM blocks_fx)) AND NOT ({lacking}) THEN 'unchanged' ELSE 'changed' END AS state
    FROM files_fx f JOIN tracks_fx t ON t.backing_path = f.path"""


def _c05(tier):
    def run(spark, d):
        fx = Fixtures(spark, d)
        return I.classify_known(fx.files(), fx.tracks(), fx.blocks(), tier).select("path", "id", "state")

    return run


query("c05_revalidate_stamps", _c05_sql("false"))(_c05("none"))
query("c05_revalidate_full", _c05_sql("t.fingerprint IS NULL OR t.content_hash IS NULL"))(_c05("full"))


@query("c06_needs_backfill", "SELECT id FROM tracks_fx WHERE format = 'flac' AND id NOT IN (SELECT track_id FROM blocks_fx)")
def c06(spark, d):
    fx = Fixtures(spark, d)
    return I.needs_backfill(fx.tracks(), fx.blocks()).select("id")


@query(
    "c07_missing_under_root",
    """SELECT id, backing_path FROM tracks_fx t WHERE starts_with(backing_path, '/lib/') AND NOT EXISTS (SELECT 1 FROM files_fx f WHERE f.path = t.backing_path) AND id % 10 <> 0""",
)
def c07(spark, d):
    fx = Fixtures(spark, d)
    t = fx.tracks()
    # Every tenth track could not be looked at: unknown is not absent.
    seen = fx.files().select("path", F.lit("present").alias("presence"))
    seen = seen.unionByName(t.where("id % 10 = 0").select(F.col("backing_path").alias("path"), F.lit("unknown").alias("presence")))
    return I.missing_tracks(t, seen, "/lib").select("id", "backing_path")


def _c08_sql(confirm):
    return f"""WITH gone AS (SELECT * FROM tracks_fx t WHERE NOT EXISTS (SELECT 1 FROM files_fx f WHERE f.path = t.backing_path)),
    one AS (SELECT fingerprint, count(*) AS n, min(id) AS cid, min(content_hash) AS ch FROM gone GROUP BY fingerprint),
    j AS (SELECT f.path, t.id AS kid, one.cid, COALESCE(one.n, 0) AS n, t.id IS NULL AND COALESCE(one.n, 0) = 1 AND COALESCE({confirm}, false) AS claims FROM files_fx f LEFT JOIN tracks_fx t ON t.backing_path = f.path LEFT JOIN one ON one.fingerprint = f.fingerprint),
    w AS (SELECT *, claims AND row_number() OVER (PARTITION BY cid, claims ORDER BY path) = 1 AS wins FROM j)
    SELECT path, CASE WHEN kid IS NOT NULL THEN 'upsert' WHEN wins THEN 'retarget' ELSE 'insert' END AS action, CASE WHEN kid IS NOT NULL THEN kid WHEN wins THEN cid END AS track_id, n AS candidates FROM w"""


def _c08(strictness):
    def run(spark, d):
        fx = Fixtures(spark, d)
        f = fx.files()
        return I.match_moves(f, fx.tracks(), f, strictness, roots=["/"]).select("path", "action", "track_id", "candidates")

    return run


query("c08_moves_fast", _c08_sql("true"))(_c08("fast"))
query("c08_moves_auto", _c08_sql("one.ch IS NULL OR one.ch = f.content_hash"))(_c08("auto"))
query("c08_moves_strict", _c08_sql("one.ch = f.content_hash"))(_c08("strict"))


def old_snapshot(fx):
    """The view before the log: every fifth track unknown, some versions behind, some tracks gone since."""
    t = fx.tracks()
    i = F.col("id")
    kept = t.where(i % 5 != 0).select("id", (F.col("content_version") - F.when(i % 2 == 0, 1).otherwise(0)).alias("content_version"), "format", F.concat(F.lit("p/"), i.cast("string")).alias("path"))
    gone = t.where(i % 5 == 1).select((-i).alias("id"), F.lit(0).cast("bigint").alias("content_version"), F.lit("mp3").alias("format"), F.lit("gone").alias("path"))
    return kept.unionByName(gone)


OLD_SNAP = """SELECT id, content_version - CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS content_version, format, concat('p/', id) AS path FROM tracks_fx WHERE id % 5 <> 0
    UNION ALL SELECT -id, 0, 'mp3', 'gone' FROM tracks_fx WHERE id % 5 = 1"""


def changed(fx):
    ids = fx.tracks().where("id % 3 <> 2").select("id")
    return ids.unionByName(fx.tracks().where("id % 5 = 1").select((-F.col("id")).alias("id"))).unionByName(ids.where("id % 100 = 0").select((-F.col("id")).alias("id")))


CHANGED = """SELECT id FROM tracks_fx WHERE id % 3 <> 2 UNION ALL SELECT -id FROM tracks_fx WHERE id % 5 = 1 UNION ALL SELECT -id FROM tracks_fx WHERE id % 3 <> 2 AND id % 100 = 0"""


@query(
    "c09_change_partition",
    f"""WITH o AS ({OLD_SNAP}), ch AS ({CHANGED}) SELECT ch.id, CASE WHEN o.id IS NOT NULL AND t.id IS NOT NULL AND (o.content_version <> t.content_version OR o.format <> t.format) THEN 'changed'
    WHEN o.id IS NULL AND t.id IS NOT NULL THEN 'added' WHEN o.id IS NOT NULL AND t.id IS NULL THEN 'removed' ELSE 'none' END AS change
    FROM ch LEFT JOIN o ON o.id = ch.id LEFT JOIN tracks_fx t ON t.id = ch.id""",
)
def c09(spark, d):
    fx = Fixtures(spark, d)
    return R.partition_changes(old_snapshot(fx), changed(fx), fx.tracks())


@query("c10_match_records", "SELECT DISTINCT f.path AS record_key, t.id AS track_id, CASE WHEN t.id IS NULL THEN 'skipped' ELSE 'matched' END AS status FROM files_fx f LEFT JOIN tracks_fx t ON t.backing_path = f.path")
def c10(spark, d):
    fx = Fixtures(spark, d)
    return S.match_records(fx.files().select(F.col("path").alias("record_key")), fx.tracks())


def wanted_paths(fx):
    """Every file plus some that the collection does not know."""
    o = fx.table("orders")
    return o.select(F.concat(F.lit("/music/"), F.col("o_orderkey").cast("string")).alias("path")).unionByName(
        o.where("o_orderkey % 40 = 0").select(F.concat(F.lit("/lost/"), F.col("o_orderkey").cast("string")).alias("path"))
    )


def assembled(fx):
    return M.assemble_records(wanted_paths(fx), fx.collection_files(), fx.collection_tracks(), fx.albums(), fx.artists())


ASSEMBLED = """SELECT w.path, f.id AS file_id, f.album_id, f.artist_id, n.n_tracks, CASE WHEN f.id IS NULL THEN 'no matching track file' WHEN n.n_tracks IS NULL THEN 'multi-track metadata unavailable'
    WHEN al.num IS NULL OR ar.num IS NULL THEN 'album or artist metadata unavailable' ELSE 'ok' END AS status
    FROM (SELECT concat('/music/', o_orderkey) AS path FROM orders UNION ALL SELECT concat('/lost/', o_orderkey) FROM orders WHERE o_orderkey % 40 = 0) w
    LEFT JOIN cfiles_fx f ON f.path = w.path LEFT JOIN (SELECT file_id, count(*) AS n_tracks FROM ctracks_fx GROUP BY file_id) n ON n.file_id = f.id
    LEFT JOIN albums_fx al ON al.num = f.album_id LEFT JOIN artists_fx ar ON ar.num = f.artist_id"""


@query("c11_assemble_records", ASSEMBLED)
def c11(spark, d):
    return assembled(Fixtures(spark, d)).select("path", "file_id", "album_id", "artist_id", "n_tracks", "status")


VOCAB_VALUES = ", ".join("('" + "','".join([v[0], v[1], v[2], v[3], v[4]]) + "')" for v in vocab.VOCABULARY)
VOC = f"voc AS (SELECT * FROM (VALUES {VOCAB_VALUES}) v(key, ik, iname, mk, mname))"


def native_names(fx):
    """Native names in all dialects and cases, spread over the log."""
    voc = vocab.vocabulary_frame(fx.spark)
    e = fx.table("events").select("event_id", (F.col("event_id") % 25).alias("n"))
    numbered = F.broadcast(voc.select("*", F.expr("CAST(array_position(array(" + ",".join(f"'{v[0]}'" for v in vocab.VOCABULARY) + "), key) - 1 AS BIGINT)").alias("n")))
    j = e.join(numbered, "n")
    odd = F.col("event_id") % 2 == 1
    flip = lambda c: F.when(odd, F.lower(c)).otherwise(F.col(c))
    return j.select("event_id", "key", "id3_kind", flip("id3_name").alias("id3_name"), "mp4_kind", flip("mp4_name").alias("mp4_name"), flip("vorbis_name").alias("vorbis_name"))


@query(
    "c12_vocabulary_to_canonical",
    f"""WITH {VOC}, k AS (SELECT *, CAST(row_number() OVER () - 1 AS BIGINT) AS n FROM voc) SELECT event_id,
    CASE WHEN ik = 'txxx' OR (ik = 'text' AND event_id % 2 = 0) THEN key END AS from_id3,
    CASE WHEN mk = 'freeform' THEN key WHEN mk IN ('text', 'integer') AND (event_id % 2 = 0 OR mname = lower(mname)) THEN key END AS from_mp4, key AS from_vorbis
    FROM events JOIN k ON k.n = event_id % 25""",
)
def c12(spark, d):
    n = native_names(Fixtures(spark, d))
    return n.select(
        "event_id",
        vocab.canonical_key("id3", "id3_kind", "id3_name").alias("from_id3"),
        vocab.canonical_key("mp4", "mp4_kind", "mp4_name").alias("from_mp4"),
        vocab.canonical_key("vorbis", None, "vorbis_name").alias("from_vorbis"),
    )


@query(
    "c12_canonical_to_native",
    f"WITH {VOC} SELECT t.track_id, t.key, t.ordinal, concat(ik, ':', iname) AS id3, concat(mk, ':', mname) AS mp4, upper(v.key) AS vorbis, COALESCE(v.key, t.key) AS folded FROM tags_fx t LEFT JOIN voc v ON v.key = lower(t.key) WHERE v.key IS NOT NULL UNION ALL SELECT track_id, key, ordinal, NULL, NULL, NULL, key FROM tags_fx WHERE key = 'disc'",
)
def c12b(spark, d):
    t = Fixtures(spark, d).tags()
    return t.select(
        "track_id", "key", "ordinal", vocab.native_name("id3", "key").alias("id3"), vocab.native_name("mp4", "key").alias("mp4"),
        vocab.native_name("vorbis", "key").alias("vorbis"), vocab.fold_field("key").alias("folded"),
    )


RENAMES = ", ".join(f"('{k}','{v}')" for k, v in M.TAGGER_RENAME.items())


@query(
    "c13_rename_map",
    f"""WITH r AS (SELECT * FROM (VALUES {RENAMES}) r(name, key)), e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'movement' WHEN 1 THEN 'totaltracks' WHEN 2 THEN 'musicbrainz_trackid' WHEN 3 THEN 'movementnumber' ELSE event_type END AS name FROM events)
    SELECT event_id, e.name, COALESCE(r.key, e.name) AS key FROM e LEFT JOIN r ON r.name = e.name""",
)
def c13(spark, d):
    i = F.col("event_id")
    name = F.when(i % 5 == 0, "movement").when(i % 5 == 1, "totaltracks").when(i % 5 == 2, "musicbrainz_trackid").when(i % 5 == 3, "movementnumber").otherwise(F.col("event_type"))
    e = Fixtures(spark, d).table("events").select("event_id", name.alias("name"))
    return e.withColumn("key", M.rename_column("name", M.TAGGER_RENAME))


@query(
    "c14_fill_absent_keys",
    """WITH p AS (SELECT track_id, key, value FROM tags_fx WHERE track_id % 2 = 0 OR key <> 'disc'), f AS (SELECT track_id, upper(key) AS key, concat('fb ', value) AS value FROM tags_fx)
    SELECT track_id, key, value, CAST(0 AS INT) AS source FROM p UNION ALL SELECT track_id, key, value, CAST(1 AS INT) FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.track_id = f.track_id AND lower(p.key) = lower(f.key))""",
)
def c14(spark, d):
    t = Fixtures(spark, d).tags().select("track_id", "key", "value")
    primary = t.where("track_id % 2 = 0 OR key <> 'disc'")
    return I.fill_absent_keys(primary, t.select("track_id", F.upper("key").alias("key"), F.concat(F.lit("fb "), "value").alias("value")))


def owned_tags(fx):
    """Tags plus an ownership marker on two thirds of the tracks."""
    mark = fx.tracks().where("id % 3 > 0").select(F.col("id").alias("track_id"), F.lit(M.OWNER_KEY).alias("key"), F.lit("1").alias("value"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(None).cast("binary").alias("value_blob"))
    return fx.tags_with_blobs().unionByName(mark)


@query("c15_owned_delete", "SELECT DISTINCT track_id FROM tags_fx WHERE key = 'album' AND value = '1-URGENT' AND track_id % 3 > 0")
def c15(spark, d):
    return S.owned_tracks(owned_tags(Fixtures(spark, d)), "album", "1-URGENT", M.OWNER_KEY)


@query(
    "c16_cascade_delete",
    """SELECT 'tracks' AS tbl, count(*) AS n FROM tracks_fx WHERE id % 11 <> 0 UNION ALL SELECT 'tags', count(*) FROM tagsb_fx WHERE track_id % 11 <> 0
    UNION ALL SELECT 'track_art', count(*) FROM track_art_fx WHERE track_id % 11 <> 0 UNION ALL SELECT 'structural_blocks', count(*) FROM blocks_fx WHERE track_id % 11 <> 0""",
)
def c16(spark, d):
    fx = Fixtures(spark, d)
    cat = fx.catalogue()
    left = C.cascade_delete(cat, cat["tracks"].where("id % 11 = 0"))
    out = [left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t in ("tracks", "tags", "track_art", "structural_blocks")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "c17_dangling_references",
    """SELECT 'tags' AS child, track_id, 'tracks' AS parent, CAST(track_id AS VARCHAR) AS missing FROM tagsb_fx WHERE track_id % 50 = 0
    UNION ALL SELECT 'track_art', track_id, 'tracks', CAST(track_id AS VARCHAR) FROM track_art_fx WHERE track_id % 50 = 0
    UNION ALL SELECT 'structural_blocks', track_id, 'tracks', CAST(track_id AS VARCHAR) FROM blocks_fx WHERE track_id % 50 = 0
    UNION ALL SELECT 'track_art', track_id, 'art', art_sha256 FROM track_art_fx WHERE art_sha256 = sha256('gone')""",
)
def c17(spark, d):
    fx = Fixtures(spark, d)
    cat = {"tracks": fx.tracks().where("id % 50 <> 0"), "tags": fx.tags_with_blobs(), "track_art": fx.track_art(), "structural_blocks": fx.blocks(), "art": fx.art()}
    return C.dangling_references(cat, "sha256", "art_sha256")


SEGS = """segs AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS seq, len FROM (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS len FROM lineitem GROUP BY l_orderkey, l_partkey) x),
    starts AS (SELECT *, CAST(sum(len) OVER (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) - len AS seg_start FROM segs)"""


def segments(fx):
    """One segment per (order, part); the part key is the position."""
    return fx.table("lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("seq")).agg(F.sum("l_quantity").cast("bigint").alias("len"))


def requests(fx):
    """Byte ranges over all files of the catalogue."""
    e, n = fx.table("events"), fx.table("orders").agg(F.count("*")).scalar()
    return e.select(F.col("event_id").alias("request_id"), (F.col("event_id") % n).alias("file_id"), F.floor("value").cast("bigint").alias("req_offset"), (F.col("event_id") % 60).alias("req_len"))


@query(
    "c18_range_join",
    f"""WITH {SEGS}, r AS (SELECT event_id AS request_id, event_id % (SELECT count(*) FROM orders) AS file_id, CAST(floor(value) AS BIGINT) AS req_offset, event_id % 60 AS req_len FROM events)
    SELECT request_id, r.file_id, seg_start, greatest(seg_start, req_offset) - seg_start AS within, least(seg_start + len, req_offset + req_len) - greatest(seg_start, req_offset) AS n
    FROM r JOIN starts s ON s.file_id = r.file_id AND seg_start < req_offset + req_len AND seg_start + len > req_offset WHERE req_len > 0""",
)
def c18(spark, d):
    fx = Fixtures(spark, d)
    got = L.resolve_ranges(L.segment_starts(segments(fx)), requests(fx))
    return got.select("request_id", "file_id", "seg_start", "within", "n")


def views(fx):
    old = fx.tracks().where("id % 7 <> 0").select("id", "content_version", F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path"))
    i = F.col("id")
    new = fx.tracks().where(i % 5 != 0).select(
        "id", (F.col("content_version") + F.when(i % 3 == 0, 1).otherwise(0)).alias("content_version"), F.concat(F.when(i % 4 == 0, "b/").otherwise("a/"), i.cast("string")).alias("path")
    )
    return old, new, old.select("id", (i * 10).alias("node")), new.select("id", (i * 10 + 1).alias("node"))


VIEWS = """o AS (SELECT id, content_version, concat('a/', id) AS path FROM tracks_fx WHERE id % 7 <> 0),
    n AS (SELECT id, content_version + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS content_version, concat(CASE WHEN id % 4 = 0 THEN 'b/' ELSE 'a/' END, id) AS path FROM tracks_fx WHERE id % 5 <> 0)"""
INVALID = """SELECT CASE WHEN o.path = n.path THEN o.id * 10 + 1 ELSE o.id * 10 END AS node, o.id, CASE WHEN o.path = n.path THEN 'content' ELSE 'moved' END AS reason FROM o LEFT JOIN n ON n.id = o.id
    WHERE (o.path = n.path AND o.content_version <> n.content_version OR n.path IS NULL OR n.path <> o.path)"""


@query("c19_invalidate_snapshots", f"WITH {VIEWS} {INVALID}")
def c19(spark, d):
    return R.invalidated_nodes(*views(Fixtures(spark, d)))


@query("c20_invalidate_changes", f"WITH {VIEWS} {INVALID} AND o.id % 2 = 0")
def c20(spark, d):
    fx = Fixtures(spark, d)
    i = F.col("id")
    state = F.when(i % 5 == 0, "removed").when(i % 7 == 0, "added").otherwise("changed")
    return R.invalidated_nodes(*views(fx), changes=fx.tracks().where(i % 2 == 0).select("id", state.alias("change")))


COVER = """cover AS (SELECT num AS album_id, CASE num % 4 WHEN 0 THEN concat('/c/', num) WHEN 1 THEN concat('/d/', num) END AS url FROM albums_fx)"""


@query("c21_attach_cover", f"WITH {COVER}, a AS ({ASSEMBLED}) SELECT path, a.album_id, url FROM a LEFT JOIN cover c ON c.album_id = a.album_id WHERE status = 'ok'")
def c21(spark, d):
    fx = Fixtures(spark, d)
    return assembled(fx).where("status = 'ok'").join(M.cover_choice(fx.albums()), "album_id", "left").select("path", "album_id", "url")
