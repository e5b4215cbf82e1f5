"""A: sources, sinks, upserts. B: filters and rules."""

from pyspark.sql import functions as F

from shelfmark.checks.fixtures import Fixtures, query
from shelfmark.functions import paths as P
from shelfmark.functions import values as V
from shelfmark.operators import catalog as C
from shelfmark.operators import ingest as I
from shelfmark.operators import mapping as M
from shelfmark.operators import rules as R
from shelfmark.operators import sync as S
from shelfmark.sources import inventory
from shelfmark.sources.folders import folder_inventory
from shelfmark.sources.shared import fresh_path
from shelfmark.sources.versions import VersionStore

EXT_SQL = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"
SUPPORTED = "('flac','mp3','m4a','m4b','ogg','oga','opus','wav')"
VIOL = lambda *rules: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in rules) + ")"


@query("a01_file_inventory")
def a01(spark, d):
    return inventory.file_inventory(spark, [d])


@query(
    "a01_folder_inventory",
    "SELECT concat('o_orderstatus=', o_orderstatus) AS folder, 1 AS files, count(*) AS n_rows FROM orders GROUP BY o_orderstatus",
)
def a01f(spark, d):
    """Landed orders, one file per status folder, listed by executors; the rows are read through the listed paths."""
    root = fresh_path(spark, "landed").removeprefix("file:")
    Fixtures(spark, d).table("orders").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(root)
    found = folder_inventory(spark, [root]).where("presence = 'present' AND path LIKE '%.parquet' AND path NOT LIKE '%.crc'")
    folder = F.element_at(F.split("path", "/"), -2)
    sizes = found.groupBy(folder.alias("folder")).agg(F.count("*").cast("int").alias("files"))
    rows = spark.read.parquet(root).groupBy(F.concat(F.lit("o_orderstatus="), "o_orderstatus").alias("folder")).agg(F.count("*").alias("n_rows"))
    return sizes.join(rows, "folder")


@query("a02_extension_filter", f"SELECT path, size FROM files_fx WHERE {EXT_SQL} IN {SUPPORTED}")
def a02(spark, d):
    return I.supported_files(Fixtures(spark, d).files()).select("path", "size")


@query(
    "a03_physical_dedup",
    """SELECT path, size FROM (SELECT *, row_number() OVER (PARTITION BY size % 1000 ORDER BY path) AS rn FROM files_fx WHERE size % 7 <> 0) t WHERE rn = 1
    UNION ALL SELECT path, size FROM files_fx WHERE size % 7 = 0""",
)
def a03(spark, d):
    files = Fixtures(spark, d).files()
    ident = files.withColumn("device", F.lit(1)).withColumn("inode", F.when(F.col("size") % 7 != 0, F.col("size") % 1000))
    return I.distinct_physical_files(ident, ["device", "inode"]).select("path", "size")


@query("a04_list_tracks", "SELECT * FROM tracks_fx")
def a04(spark, d):
    return Fixtures(spark, d).tracks().orderBy("id")


@query("a05_paths_only", "SELECT backing_path FROM tracks_fx")
def a05a(spark, d):
    return Fixtures(spark, d).tracks().select("backing_path")


@query("a05_render_keys", "SELECT id, content_version, format FROM tracks_fx")
def a05b(spark, d):
    return Fixtures(spark, d).tracks().select("id", "content_version", "format")


@query("a05_version_and_path", "SELECT id, content_version, backing_path FROM tracks_fx")
def a05c(spark, d):
    return Fixtures(spark, d).tracks().select("id", "content_version", "backing_path")


@query(
    "a06_read_collection_json",
    """SELECT id, trim(title) AS title, CASE WHEN num % 2 = 0 THEN id END AS artist_id, CAST(n_regionkey AS VARCHAR) AS nested_id,
    CAST(3 AS INT) AS n_genres, CAST(CASE num % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS INT) AS n_images FROM albums_fx""",
)
def a06(spark, d):
    payloads = Fixtures(spark, d).albums().select(F.to_json(F.struct("*")).alias("payload"))
    a = inventory.parse_collection(payloads, "albums")
    n_images = F.when(F.col("images").isNotNull(), F.size("images"))
    return a.select("id", P.trim_to_null("title").alias("title"), F.col("artistId").alias("artist_id"), F.col("artist.id").alias("nested_id"), F.size("genres").alias("n_genres"), n_images.alias("n_images"))


@query(
    "a06_landed_files",
    """SELECT 'record' AS part, CAST(c_custkey AS VARCHAR) AS what, c_name AS name, CAST(1 AS BIGINT) AS n FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0
    UNION ALL SELECT 'reject', CASE WHEN c_custkey % 7 = 0 THEN 'cut' ELSE 'type' END, CAST(NULL AS VARCHAR), count(*) FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 GROUP BY 2
    UNION ALL SELECT 'drift', 'segment', CAST(NULL AS VARCHAR), count(*) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 HAVING count(*) > 0""",
)
def a06f(spark, d):
    """Landed lines of artists: objects and arrays, some cut off, some of a wrong type, all with a field the schema lacks."""
    k = F.col("c_custkey")
    name = F.concat(F.lit('"artistName": "'), "c_name", F.lit('", "segment": "'), "c_mktsegment", F.lit('"'))
    genres = F.when(k % 11 == 0, '"genres": {"a": 1}').otherwise('"genres": ["Rock"]')
    whole = F.concat(F.lit('{"id": "'), k.cast("string"), F.lit('", '), genres, F.lit(", "), name, F.lit("}"))
    line = F.when(k % 7 == 0, F.expr("substring(w, 1, length(w) - 2)")).when(k % 3 == 0, F.concat(F.lit(" ["), "w", F.lit("]"))).otherwise(F.col("w"))
    path = fresh_path(spark, "artists")
    Fixtures(spark, d).table("customer").withColumn("w", whole).select(line.alias("value")).write.text(path)
    got = inventory.read_landed(spark, path, "artists")
    null = F.lit(None).cast("string").alias("name")
    rejects = got.rejects.groupBy(F.when(F.col("text").endswith("}"), "type").otherwise("cut").alias("what")).agg(F.count("*").alias("n"))
    out = got.records.select(F.lit("record").alias("part"), F.col("id").alias("what"), F.col("artistName").alias("name"), F.lit(1).cast("bigint").alias("n"))
    out = out.unionByName(rejects.select(F.lit("reject").alias("part"), "what", null, "n"))
    return out.unionByName(got.drift.select(F.lit("drift").alias("part"), F.col("field").alias("what"), null, "n"))


@query(
    "a07_backfill_albums",
    "SELECT DISTINCT f.album_id FROM cfiles_fx f JOIN artists_fx a ON a.num = f.artist_id",
)
def a07(spark, d):
    fx = Fixtures(spark, d)
    files = fx.collection_files().join(fx.artists().select(F.col("id").alias("artistId")), "artistId", "left_semi")
    return M.distinct_albums(files)


SCOPED = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id % 25 END AS album_id, CASE WHEN event_id % 3 < 2 THEN user_id END AS artist_id FROM events"


def _scoped(fx):
    e = fx.table("events")
    i = F.col("event_id")
    return e.select("event_id", F.when(i % 3 == 0, F.col("user_id") % 25).alias("album_id"), F.when(i % 3 < 2, F.col("user_id")).alias("artist_id"))


@query(
    "a08_scoped_collect",
    f"""WITH e AS ({SCOPED}) SELECT event_id, n_files, first_file, last_file FROM e JOIN (SELECT album_id, count(*) AS n_files, min(id) AS first_file, max(id) AS last_file FROM cfiles_fx GROUP BY album_id) f ON f.album_id = e.album_id
    UNION ALL SELECT event_id, n_files, first_file, last_file FROM e JOIN (SELECT artist_id, count(*) AS n_files, min(id) AS first_file, max(id) AS last_file FROM cfiles_fx GROUP BY artist_id) f ON f.artist_id = e.artist_id WHERE e.album_id IS NULL""",
)
def a08(spark, d):
    fx = Fixtures(spark, d)
    return M.scope_summary(_scoped(fx), fx.collection_files())


@query("a08_scope_rejects", f"WITH e AS ({SCOPED}) SELECT event_id FROM e WHERE album_id IS NULL AND artist_id IS NULL")
def a08r(spark, d):
    fx = Fixtures(spark, d)
    return M.collect_scope(_scoped(fx), fx.collection_files())[2].select("event_id")


@query(
    "a09_blob_range_read",
    """SELECT sha256, off, CAST(CASE WHEN byte_len >= off + 4 THEN substr(data, off + 1, 4) END AS VARCHAR) AS piece, CASE WHEN byte_len >= off + 4 THEN 'ok' ELSE 'short_read' END AS status
    FROM art_fx, (SELECT unnest([0, 3, 7]) AS off) r""",
)
def a09(spark, d):
    blobs = Fixtures(spark, d).art().select("sha256", F.col("data").cast("binary").alias("data"), F.explode(F.array(*[F.lit(i) for i in (0, 3, 7)])).alias("off"))
    got = C.read_range(blobs.withColumn("len", F.lit(4)), offset="off")
    return got.select("sha256", "off", F.col("bytes").cast("string").alias("piece"), "status")


@query("a10_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def a10(spark, d):
    return inventory.content_hashes(Fixtures(spark, d).table("documents"), "text").select("doc_id", "content_hash")


TRACK_COLS = "id, backing_path, format, audio_offset, audio_length, backing_size, backing_mtime_ns, backing_ctime_ns, content_version, updated_at, fingerprint, content_hash"


def _rescan(t):
    """What a rescan would bring: every second track, a new mtime for every third, checksums for some."""
    i = F.col("id")
    return t.where(i % 2 == 0).withColumn("backing_mtime_ns", F.col("backing_mtime_ns") + F.when(i % 3 == 1, 5).otherwise(0)).withColumn(
        "fingerprint", F.when(i % 4 == 0, F.concat(F.lit("x"), "fingerprint"))
    )


@query(
    "a11_upsert_tracks",
    """WITH st AS (SELECT * FROM tracks_fx WHERE id % 3 <> 0),
    nw AS (SELECT * REPLACE (backing_mtime_ns + CASE WHEN id % 3 = 1 THEN 5 ELSE 0 END AS backing_mtime_ns, CASE WHEN id % 4 = 0 THEN concat('x', fingerprint) END AS fingerprint) FROM tracks_fx WHERE id % 2 = 0)
    SELECT st.id, st.backing_path, st.format, st.audio_offset, st.audio_length, st.backing_size, COALESCE(nw.backing_mtime_ns, st.backing_mtime_ns) AS backing_mtime_ns, st.backing_ctime_ns,
      st.content_version + CASE WHEN nw.id IS NOT NULL AND nw.backing_mtime_ns <> st.backing_mtime_ns THEN 1 ELSE 0 END AS content_version,
      CASE WHEN nw.id IS NULL THEN st.updated_at ELSE 1800000000 END AS updated_at, COALESCE(nw.fingerprint, st.fingerprint) AS fingerprint, COALESCE(nw.content_hash, st.content_hash) AS content_hash
    FROM st LEFT JOIN nw USING (backing_path)
    UNION ALL SELECT (SELECT max(id) FROM st) + row_number() OVER (ORDER BY sha256(backing_path)), backing_path, format, audio_offset, audio_length, backing_size, backing_mtime_ns, backing_ctime_ns, 0, 1800000000, fingerprint, content_hash
    FROM nw WHERE id % 3 = 0""",
)
def a11(spark, d):
    t = Fixtures(spark, d).tracks()
    return C.upsert_tracks(t.where(F.col("id") % 3 != 0), _rescan(t), F.lit(1800000000).cast("bigint"))


@query("a12_commit_and_read_back", f"SELECT 2 AS version, {TRACK_COLS} FROM tracks_fx WHERE id % 2 = 0")
def a12(spark, d):
    fx = Fixtures(spark, d)
    store = VersionStore(spark, fresh_path(spark, "catalogue"))
    store.commit({"tracks": fx.tracks(), "structural_blocks": fx.blocks()})
    store.commit({"tracks": fx.tracks().where("id % 2 = 0")})
    at = store.current()
    return store.read("tracks", at).withColumn("version", F.lit(at["version"]).cast("int"))


MOVES = "SELECT id, concat('/moved', backing_path) AS new_path, backing_mtime_ns + id % 2 AS mt, CASE WHEN id % 26 = 0 THEN 'newfp' END AS fp FROM tracks_fx WHERE id % 13 = 0"


@query(
    "a13_retarget",
    f"""WITH m AS ({MOVES}) SELECT t.id, COALESCE(m.new_path, t.backing_path) AS backing_path, t.format, t.audio_offset, t.audio_length, t.backing_size,
    COALESCE(m.mt, t.backing_mtime_ns) AS backing_mtime_ns, t.backing_ctime_ns, t.content_version + CASE WHEN m.mt <> t.backing_mtime_ns THEN 1 ELSE 0 END AS content_version,
    CASE WHEN m.id IS NULL THEN t.updated_at ELSE 1800000000 END AS updated_at, COALESCE(m.fp, t.fingerprint) AS fingerprint, t.content_hash FROM tracks_fx t LEFT JOIN m ON m.id = t.id""",
)
def a13(spark, d):
    t = Fixtures(spark, d).tracks()
    i = F.col("id")
    m = t.where(i % 13 == 0).select(
        "id", F.concat(F.lit("/moved"), "backing_path").alias("new_path"), "audio_offset", "audio_length", "backing_size",
        (F.col("backing_mtime_ns") + i % 2).alias("backing_mtime_ns"), "backing_ctime_ns", F.when(i % 26 == 0, "newfp").alias("fingerprint"), F.lit(None).cast("string").alias("content_hash"),
    )
    return C.retarget_tracks(t, m, F.lit(1800000000).cast("bigint"))


@query(
    "a14_set_checksums",
    "SELECT id, CASE WHEN id % 3 = 0 THEN concat('n', id) ELSE fingerprint END AS fingerprint, CASE WHEN id % 9 = 0 THEN concat('h', id) ELSE content_hash END AS content_hash FROM tracks_fx",
)
def a14(spark, d):
    t = Fixtures(spark, d).tracks()
    i = F.col("id")
    sums = t.where(i % 3 == 0).select("id", F.concat(F.lit("n"), i).alias("fingerprint"), F.when(i % 9 == 0, F.concat(F.lit("h"), i)).alias("content_hash"))
    return C.set_checksums(t, sums).select("id", "fingerprint", "content_hash")


@query("b01_lookup_by_id", "SELECT id, backing_path FROM tracks_fx WHERE id = 42")
def b01(spark, d):
    return Fixtures(spark, d).tracks().where(F.col("id") == 42).select("id", "backing_path")


@query("b01_lookup_by_path", "SELECT id, backing_path FROM tracks_fx WHERE backing_path LIKE '%/41.wav'")
def b01p(spark, d):
    return Fixtures(spark, d).tracks().where(F.col("backing_path").like("%/41.wav")).select("id", "backing_path")


@query("b02_bulk_lookup", "SELECT id, backing_path FROM tracks_fx WHERE id IN (SELECT user_id + 1 FROM events)")
def b02(spark, d):
    fx = Fixtures(spark, d)
    return C.by_keys(fx.tracks(), fx.log().select("track_id"), "id").select("id", "backing_path")


@query("b02_duplicate_paths", "SELECT backing_path, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT regexp_replace(backing_path, '/[0-9]+\\.', '/x.') AS backing_path, id FROM tracks_fx) t GROUP BY backing_path HAVING count(*) > 1")
def b02d(spark, d):
    t = Fixtures(spark, d).tracks().withColumn("backing_path", F.regexp_replace("backing_path", r"/[0-9]+\.", "/x."))
    return C.duplicate_paths(t)


@query("b03_text_tags", "SELECT track_id, key, value, ordinal FROM tagsb_fx WHERE blob IS NULL")
def b03(spark, d):
    return C.text_tags(Fixtures(spark, d).tags_with_blobs()).drop("value_blob")


@query("b03_binary_tags", "SELECT track_id, key, CAST(strlen(blob) AS INT) AS n_bytes FROM tagsb_fx WHERE blob IS NOT NULL")
def b03b(spark, d):
    return C.binary_tags(Fixtures(spark, d).tags_with_blobs()).select("track_id", "key", F.octet_length("value_blob").alias("n_bytes"))


@query("b04_tags_for_keys", "SELECT * FROM tags_fx WHERE lower(key) IN ('artist', 'disc')")
def b04(spark, d):
    return C.tags_for_keys(Fixtures(spark, d).tags(), ["artist", "disc"])


@query("b05_tracks_by_tag", "SELECT track_id FROM tags_fx WHERE key = 'genre' AND value = 'ECONOMY'")
def b05(spark, d):
    return C.tracks_with_tag(Fixtures(spark, d).tags_with_blobs(), "genre", "ECONOMY")


@query("b06_tracks_by_fingerprint", "SELECT t.id, f.fingerprint FROM tracks_fx t JOIN (SELECT DISTINCT fingerprint FROM files_fx) f ON f.fingerprint = t.fingerprint")
def b06(spark, d):
    fx = Fixtures(spark, d)
    return fx.tracks().join(fx.files().select("fingerprint").distinct(), "fingerprint").select("id", "fingerprint")


@query("b07_path_scope", "SELECT id, backing_path FROM tracks_fx WHERE backing_path = '/lib/c1' OR starts_with(backing_path, '/lib/c1/')")
def b07(spark, d):
    return Fixtures(spark, d).tracks().where(P.under_root("backing_path", "/lib/c1/")).select("id", "backing_path")


def _csv(df, table, keep):
    return R.with_violations(df, table).where(F.size("violations") > 0).select(*keep, F.array_join("violations", ",").alias("violations"))


@query(
    "b08_track_rules",
    "SELECT * FROM (SELECT id, " + VIOL(("format", "format <> 'wav'"), ("non_negative", "ao >= 0"), ("version", "content_version >= 0"), ("bounds", "ao >= 0 AND sz >= 0 AND al <= sz - ao"))
    + " AS violations FROM (SELECT id, format, content_version - CASE WHEN id % 31 = 0 THEN 9 ELSE 0 END AS content_version, audio_offset - CASE WHEN id % 19 = 0 THEN 5000 ELSE 0 END AS ao, audio_length AS al, backing_size - CASE WHEN id % 23 = 0 THEN 7 ELSE 0 END AS sz FROM tracks_fx) t) v WHERE violations <> ''",
)
def b08(spark, d):
    i = F.col("id")
    t = Fixtures(spark, d).tracks().withColumn("format", F.when(F.col("format") == "wav", "aiff").otherwise(F.col("format")))
    t = t.withColumn("content_version", F.col("content_version") - F.when(i % 31 == 0, 9).otherwise(0))
    t = t.withColumn("audio_offset", F.col("audio_offset") - F.when(i % 19 == 0, 5000).otherwise(0)).withColumn("backing_size", F.col("backing_size") - F.when(i % 23 == 0, 7).otherwise(0))
    return _csv(t, "tracks", ["id"])


@query(
    "b09_tag_rules",
    "SELECT * FROM (SELECT track_id, key, ord AS ordinal, " + VIOL(("ordinal", "ord >= 0"), ("blob_value", "blob IS NULL OR value = ''"), ("key_length", "length(k) BETWEEN 1 AND 256"), ("key_control", "NOT regexp_matches(k, '[\\x00-\\x1f]')"), ("value_bytes", "strlen(v) <= 262144"))
    + """ AS violations FROM (SELECT track_id, key, value, ordinal - CASE WHEN track_id % 41 = 0 THEN 3 ELSE 0 END AS ord, CASE WHEN track_id % 43 = 0 THEN 'x' END AS blob,
    CASE WHEN track_id % 37 = 0 THEN '' WHEN track_id % 37 = 1 THEN concat(key, chr(9)) WHEN track_id % 37 = 2 THEN repeat('é', 257) ELSE key END AS k,
    CASE WHEN track_id % 53 = 0 AND key = 'title' THEN repeat('é', 131073) ELSE value END AS v FROM tags_fx) t) x WHERE violations <> ''""",
)
def b09(spark, d):
    i, key = F.col("track_id"), F.col("key")
    t = Fixtures(spark, d).tags().withColumn("orig", key)
    t = t.withColumn("ordinal", F.col("ordinal") - F.when(i % 41 == 0, 3).otherwise(0)).withColumn("value_blob", F.when(i % 43 == 0, F.lit("x").cast("binary")))
    t = t.withColumn("value", F.when((i % 53 == 0) & (key == "title"), F.repeat(F.lit("é"), 131073)).otherwise(F.col("value")))
    t = t.withColumn("key", F.when(i % 37 == 0, "").when(i % 37 == 1, F.concat(key, F.lit("\t"))).when(i % 37 == 2, F.repeat(F.lit("é"), 257)).otherwise(key))
    return _csv(t, "tags", ["track_id", "orig", "ordinal"]).withColumnRenamed("orig", "key")


@query(
    "b10_art_rules",
    "SELECT * FROM (SELECT sha256, " + VIOL(("byte_len", "NOT (byte_len % 3 = 0)"), ("sha_length", "byte_len <> 10"), ("dimensions", "byte_len % 5 <> 0"), ("mime", "byte_len % 7 <> 0"), ("sha_content", "byte_len <> 10 AND byte_len % 2 = 0"))
    + " AS violations FROM art_fx) t WHERE violations <> ''",
)
def b10(spark, d):
    n = F.col("byte_len")
    a = Fixtures(spark, d).art().select(
        F.col("sha256").alias("orig"),
        F.when(n == 10, "short").when(n % 2 == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(n % 7 == 0, F.repeat(F.lit("m"), 256)).otherwise(F.col("mime")).alias("mime"),
        F.when(n % 5 == 0, -1).alias("width"), F.lit(None).cast("int").alias("height"),
        (n + F.when(n % 3 == 0, 1).otherwise(0)).alias("byte_len"), F.col("data").cast("binary").alias("data"),
    )
    return _csv(a, "art", ["orig"]).withColumnRenamed("orig", "sha256")


@query(
    "b11_link_rules",
    "SELECT * FROM (SELECT track_id, ordinal, " + VIOL(("picture_type", "picture_type <= 20"), ("ordinal", "ordinal < 5"), ("description", "description <> 'A'")) + " AS violations FROM track_art_fx) t WHERE violations <> ''",
)
def b11(spark, d):
    t = Fixtures(spark, d).track_art().withColumn("orig", F.col("ordinal"))
    t = t.withColumn("ordinal", F.when(F.col("ordinal") >= 5, -1).otherwise(F.col("ordinal"))).withColumn("description", F.when(F.col("description") == "A", F.repeat(F.lit("é"), 1025)).otherwise(F.col("description")))
    return _csv(t, "track_art", ["track_id", "orig"]).withColumnRenamed("orig", "ordinal")


@query(
    "b12_block_rules",
    "SELECT * FROM (SELECT track_id, " + VIOL(("kind", "track_id % 2 = 0"), ("ordinal", "track_id % 5 <> 0")) + " AS violations FROM blocks_fx) t WHERE violations <> ''",
)
def b12(spark, d):
    i = F.col("track_id")
    b = Fixtures(spark, d).blocks().withColumn("kind", F.when(i % 2 == 0, F.col("kind")).otherwise("PADDING")).withColumn("ordinal", F.when(i % 5 == 0, -1).otherwise(0))
    return _csv(b, "structural_blocks", ["track_id"])


KEYED = """SELECT track_id, value, CASE WHEN track_id % 5 = 0 THEN '' WHEN track_id % 5 = 1 THEN concat('a', chr(10), key) WHEN track_id % 5 = 2 THEN concat(key, '=', 'x') WHEN track_id % 5 = 3 THEN concat('é', key) ELSE key END AS key FROM tags_fx"""


def _keyed(fx):
    i, key = F.col("track_id"), F.col("key")
    k = F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat(F.lit("a\n"), key)).when(i % 5 == 2, F.concat(key, F.lit("=x"))).when(i % 5 == 3, F.concat(F.lit("é"), key)).otherwise(key)
    return fx.tags().select("track_id", "value", k.alias("key"))


@query("b14_key_floor", f"WITH k AS ({KEYED}) SELECT track_id, key, value FROM k WHERE track_id % 5 > 1")
def b14(spark, d):
    return _keyed(Fixtures(spark, d)).where(R.key_floor()).select("track_id", "key", "value")


@query("b15_field_grammar", f"WITH k AS ({KEYED}) SELECT track_id, key, value FROM k WHERE track_id % 5 = 4")
def b15(spark, d):
    return _keyed(Fixtures(spark, d)).where(R.field_name_ok()).select("track_id", "key", "value")


@query("b16_invalid_field_names", f"WITH k AS ({KEYED}) SELECT DISTINCT track_id, key FROM k WHERE track_id % 5 < 4")
def b16(spark, d):
    return R.invalid_field_names(_keyed(Fixtures(spark, d)))


LINKED_SIZE = "SELECT t.*, CASE WHEN picture_type = 7 THEN 16711681 ELSE COALESCE(byte_len, 0) END AS n FROM track_art_fx t LEFT JOIN art_fx a ON a.sha256 = t.art_sha256"


@query(
    "b17_drop_oversize_pictures",
    f"WITH x AS ({LINKED_SIZE}) SELECT track_id, art_sha256, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) - 1 AS ordinal FROM x WHERE n <= 16711680",
)
def b17(spark, d):
    fx = Fixtures(spark, d)
    x = fx.track_art().join(fx.art().select(F.col("sha256").alias("art_sha256"), "byte_len"), "art_sha256", "left")
    n = F.when(F.col("picture_type") == 7, 16711681).otherwise(F.coalesce("byte_len", F.lit(0)))
    kept = x.where(n <= 16711680).withColumnRenamed("ordinal", "pos")
    return C.with_ordinals(kept, ("track_id",)).select("track_id", "art_sha256", "ordinal")


@query(
    "b18_accept_binary_tags",
    f"WITH x AS ({LINKED_SIZE}) SELECT track_id, description AS key, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) - 1 AS ordinal FROM x WHERE n > 0 AND n <= 16711680",
)
def b18(spark, d):
    fx = Fixtures(spark, d)
    x = fx.track_art().join(fx.art().select(F.col("sha256").alias("art_sha256"), "byte_len"), "art_sha256", "left")
    n = F.when(F.col("picture_type") == 7, 16711681).otherwise(F.coalesce("byte_len", F.lit(0)))
    kept = x.where((n > 0) & (n <= 16711680)).select("track_id", F.col("description").alias("key"), F.col("ordinal").alias("pos"))
    return C.with_ordinals(kept, ("track_id",)).select("track_id", "key", "ordinal")


@query("b19_skip_empty_blobs", "SELECT sha256, byte_len % 4 AS byte_len FROM art_fx WHERE byte_len % 4 > 0")
def b19(spark, d):
    return Fixtures(spark, d).art().select("sha256", (F.col("byte_len") % 4).alias("byte_len")).where("byte_len > 0")


@query(
    "b20_serve_status",
    """SELECT track_id, ordinal, CASE WHEN byte_len IS NULL THEN 'orphan' WHEN byte_len = 10 THEN 'empty' WHEN byte_len = 11 THEN 'too_large' WHEN picture_type > 20 THEN 'invalid_picture_type' ELSE 'ok' END AS status
    FROM track_art_fx t LEFT JOIN art_fx a ON a.sha256 = t.art_sha256""",
)
def b20(spark, d):
    fx = Fixtures(spark, d)
    n = F.col("byte_len")
    art = fx.art().withColumn("byte_len", F.when(n == 10, 0).when(n == 11, 16711681).otherwise(n))
    links = C.links_with_metadata(fx.track_art(), art, "art_sha256", "sha256")
    return R.serve_status(links).select("track_id", "ordinal", "status")


@query(
    "b21_merge_delete",
    """SELECT track_id, key, value, ordinal FROM tags_fx t WHERE NOT (track_id % 2 = 0 AND lower(key) IN ('artist', 'disc')) AND NOT (track_id % 3 = 0 AND lower(key) = 'genre')""",
)
def b21(spark, d):
    fx = Fixtures(spark, d)
    t = fx.tracks()
    matched = t.select(F.col("backing_path").alias("record_key"), F.col("id").alias("track_id"))
    pairs = t.where("id % 2 = 0").select(F.col("backing_path").alias("record_key"), F.explode(F.array(F.lit("Artist"), F.lit("DISC"))).alias("key"))
    deletes = t.where("id % 3 = 0").select(F.col("backing_path").alias("record_key"), F.lit("GENRE").alias("key"))
    tags = fx.tags().withColumn("value_blob", F.lit(None).cast("binary"))
    return S.kept_tags(tags, matched, pairs, deletes, "merge").drop("value_blob")


@query("b22_hidden_fields", "SELECT event_id, name FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN concat('~', event_type) ELSE event_type END AS name FROM events) t WHERE NOT starts_with(name, '~')")
def b22(spark, d):
    e = Fixtures(spark, d).table("events")
    e = e.select("event_id", F.when(F.col("event_type") == "click", F.concat(F.lit("~"), "event_type")).otherwise(F.col("event_type")).alias("name"))
    return e.where(~F.col("name").startswith("~"))


@query(
    "b23_drop_zero_values",
    """SELECT event_id, key, value FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'bpm' ELSE 'mood' END AS key,
    CASE event_id % 6 WHEN 0 THEN '0' WHEN 1 THEN '0' WHEN 2 THEN '0.00' WHEN 3 THEN '1/12' WHEN 4 THEN '0/12' ELSE '0.5' END AS value FROM events) t WHERE NOT (key = 'bpm' AND value IN ('0', '0.00'))""",
)
def b23(spark, d):
    i = F.col("event_id")
    v = F.when(i % 6 == 0, "0").when(i % 6 == 1, "0").when(i % 6 == 2, "0.00").when(i % 6 == 3, "1/12").when(i % 6 == 4, "0/12").otherwise("0.5")
    rows = Fixtures(spark, d).table("events").select("event_id", F.when(i % 2 == 0, "bpm").otherwise("mood").alias("key"), v.alias("value"))
    return R.drop_zero_values(rows, M.IMPORTER_ZERO_KEYS)
