"""K: composite operators."""

from pyspark.sql import functions as F

from shelfmark.checks.fixtures import Fixtures, query
from shelfmark.checks.functions import FIELDS
from shelfmark.checks.joins import ASSEMBLED, SEGS, assembled, owned_tags, requests
from shelfmark.functions import paths as P
from shelfmark.functions import values as V
from shelfmark.operators import catalog as C
from shelfmark.operators import ingest as I
from shelfmark.operators import layout as L
from shelfmark.operators import mapping as M
from shelfmark.operators import sync as S
from shelfmark.operators import tree as T
from shelfmark.plans import scan as SC
from shelfmark.plans import view as VW

NOW = 1800000000
TEMPLATE = "$albumartist/$album/[$disc - ]$title"

# K1: the inventory brings one new-format group and moved files.
SUP = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('flac','mp3','m4a','m4b','ogg','oga','opus','wav')"
EXT_FMT = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'm4b' THEN 'm4a' WHEN 'ogg' THEN 'vorbis' WHEN 'oga' THEN 'vorbis' ELSE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) END"
SCAN = f"""todo AS (SELECT * FROM files_fx f WHERE {SUP} AND NOT EXISTS (SELECT 1 FROM tracks_fx t WHERE t.backing_path = f.path)),
    gone AS (SELECT * FROM tracks_fx t WHERE NOT EXISTS (SELECT 1 FROM files_fx f WHERE f.path = t.backing_path)),
    one AS (SELECT fingerprint, min(id) AS cid, min(content_hash) AS ch FROM gone GROUP BY fingerprint HAVING count(*) = 1),
    j AS (SELECT f.*, one.cid, one.cid IS NOT NULL AND (one.ch IS NULL OR COALESCE(one.ch = f.content_hash, false)) AS claims FROM todo f LEFT JOIN one ON one.fingerprint = f.fingerprint),
    acts AS (SELECT *, claims AND row_number() OVER (PARTITION BY cid, claims ORDER BY path) = 1 AS wins FROM j)"""


@query(
    "k1_scan_tracks",
    f"""WITH {SCAN} SELECT t.id, COALESCE(a.path, t.backing_path) AS backing_path, t.format, CASE WHEN a.path IS NULL THEN t.audio_offset ELSE 0 END AS audio_offset, COALESCE(a.size, t.audio_length) AS audio_length,
      COALESCE(a.size, t.backing_size) AS backing_size, COALESCE(a.mtime_ns, t.backing_mtime_ns) AS backing_mtime_ns, COALESCE(a.ctime_ns, t.backing_ctime_ns) AS backing_ctime_ns,
      t.content_version + CASE WHEN a.path IS NOT NULL AND (t.audio_offset <> 0 OR t.audio_length <> a.size OR t.backing_mtime_ns <> a.mtime_ns) THEN 1 ELSE 0 END AS content_version,
      CASE WHEN a.path IS NULL THEN t.updated_at ELSE {NOW} END AS updated_at, COALESCE(a.fingerprint, t.fingerprint) AS fingerprint, COALESCE(a.content_hash, t.content_hash) AS content_hash
    FROM tracks_fx t LEFT JOIN (SELECT * FROM acts WHERE wins) a ON a.cid = t.id
    UNION ALL SELECT (SELECT max(id) FROM tracks_fx) + row_number() OVER (ORDER BY sha256(path)), path, {EXT_FMT}, 0, size, size, mtime_ns, ctime_ns, 0, {NOW}, fingerprint, content_hash FROM acts WHERE NOT wins""",
)
def k1(spark, d):
    fx = Fixtures(spark, d)
    return SC.scan(fx.files(), {"tracks": fx.tracks()}, NOW, roots=["/"]).catalogue["tracks"]


@query(
    "k1_scan_stats",
    f"""WITH {SCAN} SELECT (SELECT count(*) FROM acts) AS scanned, (SELECT count(*) FROM acts WHERE NOT wins) AS inserted, (SELECT count(*) FROM acts WHERE wins) AS retargeted, CAST(0 AS BIGINT) AS updated,
    (SELECT count(*) FROM files_fx WHERE NOT ({SUP})) AS skipped, (SELECT count(*) FROM files_fx f WHERE {SUP} AND EXISTS (SELECT 1 FROM tracks_fx t WHERE t.backing_path = f.path)) AS already_present""",
)
def k1s(spark, d):
    fx = Fixtures(spark, d)
    return SC.scan(fx.files(), {"tracks": fx.tracks()}, NOW, roots=["/"]).stats


@query(
    "k1_forced_scan_tags",
    f"""SELECT t.track_id, t.key, t.value, t.ordinal FROM tags_fx t JOIN tracks_fx k ON k.id = t.track_id WHERE k.backing_path NOT IN (SELECT path FROM files_fx WHERE {SUP})
    UNION ALL SELECT k.id, 'title', CAST(k.backing_size AS VARCHAR), 0 FROM tracks_fx k WHERE k.backing_path IN (SELECT path FROM files_fx WHERE {SUP})""",
)
def k1f(spark, d):
    """Force: every supported known file is read again and its text tags replaced; new files are set aside here."""
    fx = Fixtures(spark, d)
    files = fx.files()
    tags = files.select("path", F.lit(0).cast("bigint").alias("pos"), F.explode(F.array(F.lit("title"), F.lit("bad\nkey"))).alias("key"), F.col("size").cast("string").alias("value"))
    tags = tags.withColumn("pos", F.when(F.col("key") == "title", 1).otherwise(0).cast("bigint"))
    text = fx.tags().withColumn("value_blob", F.lit(None).cast("binary"))
    out = SC.scan(files, {"tracks": fx.tracks(), "tags": text}, NOW, force=True, file_tags=tags).catalogue["tags"]
    return out.join(fx.tracks().select(F.col("id").alias("track_id")), "track_id", "left_semi").select("track_id", "key", "value", "ordinal")


@query(
    "k1_forced_scan_binary_tags",
    f"""SELECT track_id, key, value, ordinal, is_blob FROM (
      SELECT track_id, key, value, ordinal, false AS is_blob FROM tags_fx WHERE track_id NOT IN (SELECT id FROM tracks_fx WHERE backing_path IN (SELECT path FROM files_fx WHERE {SUP}))
      UNION ALL SELECT id, 'ARTIST', '', 0, true FROM tracks_fx WHERE id % 3 = 0
      UNION ALL SELECT id, 'title', CAST(backing_size AS VARCHAR), 0, false FROM tracks_fx WHERE backing_path IN (SELECT path FROM files_fx WHERE {SUP})) x""",
)
def k1b(spark, d):
    """A forced scan replaces text tags only: binary rows of the same tracks stay."""
    fx = Fixtures(spark, d)
    files = fx.files()
    tags = files.select("path", F.lit(0).cast("bigint").alias("pos"), F.lit("title").alias("key"), F.col("size").cast("string").alias("value"))
    blobs = fx.tracks().where("id % 3 = 0").select(F.col("id").alias("track_id"), F.lit("ARTIST").alias("key"), F.lit("").alias("value"), F.lit(0).alias("ordinal"), F.lit(b"x").alias("value_blob"))
    stored = fx.tags().select("track_id", "key", "value", "ordinal", F.lit(None).cast("binary").alias("value_blob")).unionByName(blobs)
    out = SC.scan(files, {"tracks": fx.tracks(), "tags": stored}, NOW, force=True, file_tags=tags, roots=["/"]).catalogue["tags"]
    out = out.join(fx.tracks().select(F.col("id").alias("track_id")), "track_id", "left_semi")
    return out.select("track_id", "key", "value", F.col("ordinal").cast("int").alias("ordinal"), F.col("value_blob").isNotNull().alias("is_blob"))


REVAL = f"""st AS (SELECT f.*, t.id, CASE WHEN f.size = t.backing_size AND f.mtime_ns = t.backing_mtime_ns AND f.ctime_ns = t.backing_ctime_ns AND NOT (t.format = 'flac' AND t.id NOT IN (SELECT track_id FROM blocks_fx))
      AND t.content_hash IS NOT NULL THEN 'unchanged' ELSE 'changed' END AS state FROM files_fx f JOIN tracks_fx t ON t.backing_path = f.path WHERE starts_with(f.path, '/lib/') AND {SUP}),
    gone AS (SELECT id FROM tracks_fx t WHERE starts_with(backing_path, '/lib/') AND NOT EXISTS (SELECT 1 FROM files_fx f WHERE f.path = t.backing_path))"""


@query(
    "k2_revalidate_stats",
    f"WITH {REVAL} SELECT (SELECT count(*) FROM st WHERE state = 'changed') AS updated, (SELECT count(*) FROM st WHERE state = 'unchanged') AS unchanged, (SELECT count(*) FROM gone) AS pruned",
)
def k2s(spark, d):
    fx = Fixtures(spark, d)
    return SC.revalidate(fx.files(), fx.catalogue(), NOW, "/lib", "full", prune=True).stats


@query(
    "k2_revalidate_tracks",
    f"""WITH {REVAL} SELECT t.id, t.backing_path, COALESCE({EXT_FMT.replace("path", "s.path")}, t.format) AS format, COALESCE(s.mtime_ns, t.backing_mtime_ns) AS backing_mtime_ns, CASE WHEN s.id IS NULL THEN t.audio_offset ELSE 0 END AS audio_offset,
    CASE WHEN s.id IS NULL THEN t.updated_at ELSE {NOW} END AS updated_at, t.fingerprint, COALESCE(s.content_hash, t.content_hash) AS content_hash
    FROM tracks_fx t LEFT JOIN (SELECT * FROM st WHERE state = 'changed') s ON s.id = t.id WHERE t.id NOT IN (SELECT id FROM gone)""",
)
def k2t(spark, d):
    fx = Fixtures(spark, d)
    out = SC.revalidate(fx.files(), fx.catalogue(), NOW, "/lib", "full", prune=True).catalogue["tracks"]
    return out.select("id", "backing_path", "format", "backing_mtime_ns", "audio_offset", "updated_at", "fingerprint", "content_hash")


@query(
    "k2_pruned_children",
    f"""WITH {REVAL} SELECT 'tags' AS tbl, count(*) AS n FROM tagsb_fx WHERE track_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'track_art', count(*) FROM track_art_fx WHERE track_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'art', count(*) FROM art_fx WHERE sha256 IN (SELECT art_sha256 FROM track_art_fx WHERE track_id NOT IN (SELECT id FROM gone))""",
)
def k2c(spark, d):
    fx = Fixtures(spark, d)
    out = SC.revalidate(fx.files(), fx.catalogue(), NOW, "/lib", "full", prune=True).catalogue
    n = [out[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t in ("tags", "track_art", "art")]
    return n[0].unionByName(n[1]).unionByName(n[2])


# What the files of a forced scan bring: three pictures, three binary tags (one of them empty) and up to two blocks each.
BROUGHT = f"""{SCAN}, ing AS (SELECT path, size, mtime_ns FROM files_fx f WHERE {SUP} AND EXISTS (SELECT 1 FROM tracks_fx t WHERE t.backing_path = f.path) UNION ALL SELECT path, size, mtime_ns FROM acts WHERE NOT wins),
    final AS (SELECT t.id, COALESCE(a.path, t.backing_path) AS path, t.backing_path FROM tracks_fx t LEFT JOIN (SELECT * FROM acts WHERE wins) a ON a.cid = t.id),
    rest AS (SELECT id, path FROM final WHERE backing_path NOT IN (SELECT path FROM ing))"""


def brought(files):
    """pictures, binary tags and blocks by path, derived from the listing."""
    pos = files.select("path", "size", "mtime_ns", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("pos"))
    n = F.col("size") + F.col("pos")
    pictures = pos.select(
        "path", "pos", F.when(F.col("mtime_ns") % 2 == 0, "image/png").otherwise("image/jpeg").alias("mime"), (n % 3).cast("int").alias("width"), F.lit(0).alias("height"),
        (n % 25).cast("int").alias("picture_type"), F.concat(F.lit("p"), F.col("pos").cast("string")).alias("description"), F.concat(F.lit("img"), (n % 50).cast("string")).cast("binary").alias("data"),
    )
    blobs = pos.select("path", "pos", F.when(F.col("pos") == 2, "id3:GEOB").otherwise("id3:PRIV").alias("key"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("b"), n.cast("string"))).cast("binary").alias("payload"))
    kind = F.when(F.col("pos") == 0, "STREAMINFO").when(F.col("pos") == 1, "SEEKTABLE").otherwise("PADDING")
    blocks = pos.select("path", "pos", kind.alias("kind"), F.concat(F.lit("body"), n.cast("string")).cast("binary").alias("body"))
    return pictures, blobs, blocks


def forced(spark, d, **wanted):
    fx = Fixtures(spark, d)
    files = fx.files()
    rows = dict(zip(("file_pictures", "file_binary_tags", "file_blocks"), brought(files)))
    return SC.scan(files, fx.catalogue(), NOW, force=True, roots=["/"], **{k: rows[k] for k in wanted})


@query(
    "k1_scan_art",
    f"""WITH {BROUGHT}, pics AS (SELECT path, p AS pos, sha256(concat('img', (size + p) % 50)) AS sha256, CASE WHEN mtime_ns % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime, CAST(NULLIF((size + p) % 3, 0) AS INT) AS width,
      CAST(CASE WHEN (size + p) % 25 > 20 THEN 0 ELSE (size + p) % 25 END AS INT) AS picture_type, concat('p', p) AS description, CAST(strlen(concat('img', (size + p) % 50)) AS BIGINT) AS byte_len FROM ing, (VALUES (0), (1), (2)) v(p)),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path, pos) AS k FROM pics) x WHERE k = 1)
    SELECT p.path, CAST(p.pos AS BIGINT) AS ordinal, p.picture_type, p.description, p.sha256, a.mime, a.width, a.byte_len FROM pics p JOIN firsts a ON a.sha256 = p.sha256
    UNION ALL SELECT r.path, l.ordinal, l.picture_type, l.description, a.sha256, a.mime, NULL, a.byte_len FROM track_art_fx l JOIN rest r ON r.id = l.track_id LEFT JOIN art_fx a ON a.sha256 = l.art_sha256""",
)
def k1art(spark, d):
    """Pictures of all files read, with the art they share; links of moved and missing tracks stay."""
    out = forced(spark, d, file_pictures=1).catalogue
    links = C.links_with_metadata(out["track_art"], out["art"]).join(out["tracks"].select(F.col("id").alias("track_id"), F.col("backing_path").alias("path")), "track_id")
    return links.select("path", "ordinal", "picture_type", "description", "sha256", "mime", "width", "byte_len")


@query(
    "k1_scan_binary_tags",
    f"""WITH {BROUGHT}, blobs AS (SELECT path, p, CASE WHEN p = 2 THEN 'id3:GEOB' ELSE 'id3:PRIV' END AS key, concat('b', size + p) AS body FROM ing, (VALUES (0), (1), (2)) v(p) WHERE (size + p) % 3 <> 0)
    SELECT path, key, row_number() OVER (PARTITION BY path ORDER BY p) - 1 AS ordinal, sha256(body) AS sha256 FROM blobs
    UNION ALL SELECT r.path, t.key, t.ordinal, sha256(t.blob) FROM tagsb_fx t JOIN rest r ON r.id = t.track_id WHERE t.blob IS NOT NULL""",
)
def k1bin(spark, d):
    """Empty payloads go, and ordinals run over all binary tags of a track."""
    out = forced(spark, d, file_binary_tags=1).catalogue
    rows = C.binary_tags(out["tags"]).join(out["tracks"].select(F.col("id").alias("track_id"), F.col("backing_path").alias("path")), "track_id")
    return rows.select("path", "key", "ordinal", F.sha2("value_blob", 256).alias("sha256"))


BLOCK_ROWS = "SELECT path, CASE p WHEN 0 THEN 'STREAMINFO' ELSE 'SEEKTABLE' END AS kind, CAST(0 AS BIGINT) AS ordinal, sha256(concat('body', size + p)) AS sha256"


@query(
    "k1_scan_blocks",
    f"""WITH {BROUGHT} {BLOCK_ROWS} FROM ing, (VALUES (0), (1)) v(p)
    UNION ALL SELECT r.path, b.kind, b.ordinal, sha256(b.body) FROM blocks_fx b JOIN rest r ON r.id = b.track_id""",
)
def k1blocks(spark, d):
    """Blocks of a kind that is not kept do not come in."""
    out = forced(spark, d, file_blocks=1).catalogue
    rows = out["structural_blocks"].join(out["tracks"].select(F.col("id").alias("track_id"), F.col("backing_path").alias("path")), "track_id")
    return rows.select("path", "kind", "ordinal", F.sha2("body", 256).alias("sha256"))


@query(
    "k1_scan_rejects",
    f"""WITH {BROUGHT} SELECT path, 'structural_blocks' AS "table", CAST(2 AS BIGINT) AS pos, 'kind' AS reason FROM ing""",
)
def k1rej(spark, d):
    return forced(spark, d, file_blocks=1).rejects


@query(
    "k2_structural_rows",
    f"""WITH {REVAL} SELECT * FROM ({BLOCK_ROWS} FROM st, (VALUES (0), (1)) v(p) WHERE state = 'changed'
    UNION ALL SELECT t.backing_path, b.kind, b.ordinal, sha256(b.body) FROM blocks_fx b JOIN tracks_fx t ON t.id = b.track_id WHERE t.id NOT IN (SELECT id FROM st WHERE state = 'changed') AND t.id NOT IN (SELECT id FROM gone)) x""",
)
def k2blocks(spark, d):
    fx = Fixtures(spark, d)
    out = SC.revalidate(fx.files(), fx.catalogue(), NOW, "/lib", "full", prune=True, file_blocks=brought(fx.files())[2]).catalogue
    rows = out["structural_blocks"].join(out["tracks"].select(F.col("id").alias("track_id"), F.col("backing_path").alias("path")), "track_id")
    return rows.select("path", "kind", "ordinal", F.sha2("body", 256).alias("sha256"))


# How reading went: every 19th size could not be looked at, every 23rd failed, every 29th changed meanwhile.
PROBED = "CASE WHEN size % 19 = 0 THEN 'unknown' ELSE 'present' END AS presence, CASE WHEN size % 23 = 0 THEN 'failed' WHEN size % 29 = 0 THEN 'raced' END AS probe"


def probed(files):
    unseen = F.when(F.col("size") % 19 == 0, "unknown").otherwise("present")
    return files.withColumn("presence", unseen).withColumn("probe", F.when(F.col("size") % 23 == 0, "failed").when(F.col("size") % 29 == 0, "raced"))


@query(
    "d07_failed_raced",
    f"""WITH f AS (SELECT *, {PROBED}, path IN (SELECT backing_path FROM tracks_fx) AS known FROM files_fx),
    s AS (SELECT *, CASE WHEN presence = 'unknown' THEN 'failed' WHEN NOT ({SUP}) THEN 'skipped' WHEN known THEN 'already_present' WHEN probe IS NOT NULL THEN probe ELSE 'todo' END AS state FROM f),
    gone AS (SELECT * FROM tracks_fx t WHERE NOT EXISTS (SELECT 1 FROM files_fx f WHERE f.path = t.backing_path)),
    one AS (SELECT fingerprint, min(id) AS cid, min(content_hash) AS ch FROM gone GROUP BY fingerprint HAVING count(*) = 1),
    m AS (SELECT count(DISTINCT one.cid) AS n FROM s JOIN one ON one.fingerprint = s.fingerprint WHERE s.state = 'todo' AND (one.ch IS NULL OR one.ch = s.content_hash))
    SELECT count_if(state = 'todo')::BIGINT AS scanned, count_if(state = 'todo')::BIGINT - (SELECT n FROM m) AS inserted, (SELECT n FROM m) AS retargeted, CAST(0 AS BIGINT) AS updated, count_if(state = 'skipped')::BIGINT AS skipped,
      count_if(state = 'already_present')::BIGINT AS already_present, count_if(state = 'failed')::BIGINT AS failed, count_if(state = 'raced')::BIGINT AS raced FROM s""",
)
def d07f(spark, d):
    fx = Fixtures(spark, d)
    return SC.scan(probed(fx.files()), {"tracks": fx.tracks()}, NOW, roots=["/"]).stats


@query(
    "d08_failed_raced",
    f"""WITH f AS (SELECT *, {PROBED} FROM files_fx WHERE starts_with(path, '/lib/')), j AS (SELECT f.*, t.id, f.size = t.backing_size AND f.mtime_ns = t.backing_mtime_ns AND f.ctime_ns = t.backing_ctime_ns
      AND NOT (t.format = 'flac' AND t.id NOT IN (SELECT track_id FROM blocks_fx)) AND t.content_hash IS NOT NULL AS calm FROM f LEFT JOIN tracks_fx t ON t.backing_path = f.path),
    s AS (SELECT CASE WHEN presence = 'unknown' THEN 'failed' WHEN id IS NULL OR NOT ({SUP}) THEN 'none' WHEN calm THEN 'unchanged' WHEN probe IS NOT NULL THEN probe ELSE 'changed' END AS state FROM j)
    SELECT count_if(state = 'changed')::BIGINT AS updated, count_if(state = 'unchanged')::BIGINT AS unchanged, (SELECT count(*) FROM tracks_fx t WHERE starts_with(backing_path, '/lib/') AND NOT EXISTS (SELECT 1 FROM files_fx f WHERE f.path = t.backing_path)) AS pruned,
      count_if(state = 'failed')::BIGINT AS failed, count_if(state = 'raced')::BIGINT AS raced FROM s""",
)
def d08f(spark, d):
    fx = Fixtures(spark, d)
    return SC.revalidate(probed(fx.files()), fx.catalogue(), NOW, "/lib", "full", prune=True).stats


# K3. One template without contested names, one with: titles such as `Take 7 (2)`.
PLAIN = "$album/$artist"
RANKED = f"""WITH {FIELDS}, p AS (SELECT id, COALESCE(al, '') AS dir, COALESCE(ar, '') AS stem, format FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY dir, stem, format ORDER BY id) AS k FROM p)
    SELECT id, concat(dir, '/', stem, CASE WHEN k > 1 THEN concat(' (', k, ')') ELSE '' END, '.', format) AS final_path FROM r"""
# The only contested number is 2: whoever comes first, the second plain title or the first `(2)` title, gets it.
CONTESTED = f"""WITH {FIELDS}, p AS (SELECT id, format, concat(COALESCE(aa, 'Unknown'), '/', COALESCE(al, 'Unknown')) AS dir, concat(CASE WHEN di IS NOT NULL THEN concat(di, ' - ') ELSE '' END, regexp_replace(ti, ' \\(2\\)$', '')) AS stem, ends_with(ti, ' (2)') AS two FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY dir, stem, format, two ORDER BY id) AS k FROM p),
    g AS (SELECT dir, stem, format, min(id) FILTER (two) AS t, min(id) FILTER (NOT two AND k = 2) AS a2 FROM r GROUP BY dir, stem, format),
    x AS (SELECT r.*, COALESCE(g.a2 < g.t, g.t IS NULL) AS plain_wins FROM r JOIN g USING (dir, stem, format))
    SELECT id, concat(dir, '/', stem, CASE WHEN NOT two THEN CASE WHEN k = 1 THEN '' WHEN plain_wins THEN concat(' (', k, ')') ELSE concat(' (', k + 1, ')') END
      ELSE concat(' (2)', CASE WHEN plain_wins THEN concat(' (', k + 1, ')') WHEN k > 1 THEN concat(' (', k, ')') ELSE '' END) END, '.', format) AS final_path FROM x"""


@query("k3_place_ranked", RANKED)
def k3r(spark, d):
    fx = Fixtures(spark, d)
    return VW.view(fx.tracks(), fx.tags(), PLAIN).select("id", "final_path")


def contested_view(fx):
    return VW.view(fx.tracks(), fx.tags(), TEMPLATE, default="Unknown")


@query("k3_place_contested", CONTESTED)
def k3c(spark, d):
    return contested_view(Fixtures(spark, d)).select("id", "final_path")


@query(
    "k3_case_insensitive",
    f"""WITH {FIELDS}, p AS (SELECT id, format, CASE WHEN id % 3 = 0 THEN upper(al) ELSE al END AS dir, CASE WHEN id % 2 = 0 THEN upper(ar) ELSE ar END AS stem FROM f),
    shown AS (SELECT lower(dir) AS ld, arg_min(dir, id) AS disp FROM p GROUP BY lower(dir)), r AS (SELECT *, row_number() OVER (PARTITION BY lower(dir), lower(stem), format ORDER BY id) AS k FROM p)
    SELECT id, concat(disp, '/', stem, CASE WHEN k > 1 THEN concat(' (', k, ')') ELSE '' END, '.', format) AS final_path FROM r JOIN shown ON ld = lower(dir)""",
)
def k3i(spark, d):
    fx = Fixtures(spark, d)
    shown = VW.render(fx.tracks(), fx.tags(), PLAIN).select("id", F.split("path", "/").alias("p"))
    i = F.col("id")
    leaf = F.when(i % 2 == 0, F.replace(F.upper(F.col("p")[1]), F.upper(P.dotted_extension(F.col("p")[1])), P.dotted_extension(F.col("p")[1]))).otherwise(F.col("p")[1])
    path = F.concat(F.when(i % 3 == 0, F.upper(F.col("p")[0])).otherwise(F.col("p")[0]), F.lit("/"), leaf)
    return T.place(shown.select("id", path.alias("path")), case_insensitive=True).select("id", "final_path")


@query(
    "k3_tree_nodes",
    f"""WITH leafs AS ({RANKED}) SELECT final_path AS path, 'file' AS kind, id AS introducing_id FROM leafs UNION ALL SELECT '', 'dir', min(id) FROM leafs
    UNION ALL SELECT string_split(final_path, '/')[1], 'dir', min(id) FROM leafs GROUP BY 1""",
)
def k3n(spark, d):
    fx = Fixtures(spark, d)
    return T.tree_nodes(VW.view(fx.tracks(), fx.tags(), PLAIN)).select("path", "kind", "introducing_id")


@query(
    "k4_node_ids",
    f"""WITH leafs AS ({RANKED}), n AS (SELECT final_path AS path, id AS intro, 2 AS depth FROM leafs UNION ALL SELECT string_split(final_path, '/')[1], min(id), 1 FROM leafs GROUP BY 1),
    old AS (SELECT path, row_number() OVER (ORDER BY intro, depth) + 1 AS inode FROM n WHERE intro % 2 = 0), mx AS (SELECT max(inode) AS m FROM old)
    SELECT '' AS path_key, 1 AS inode UNION ALL SELECT path, inode FROM old UNION ALL SELECT path, m + row_number() OVER (ORDER BY intro, depth) FROM n, mx WHERE intro % 2 <> 0""",
)
def k4(spark, d):
    """First the nodes with an even first track, then all: the old ids stay."""
    fx = Fixtures(spark, d)
    nodes = T.tree_nodes(VW.view(fx.tracks(), fx.tags(), PLAIN))
    before = T.assign_node_ids(nodes.where("introducing_id % 2 = 0"))
    return T.assign_node_ids(nodes, before).select("path_key", "inode")


@query("k5_render", f"WITH {FIELDS} SELECT id, concat(COALESCE(aa, 'Unknown'), '/', al, '/', CASE WHEN di IS NOT NULL THEN concat(di, ' - ') ELSE '' END, ti, '.', format) AS path FROM f")
def k5(spark, d):
    fx = Fixtures(spark, d)
    return VW.render(fx.tracks(), fx.tags_with_blobs(), TEMPLATE, default="Unknown").select("id", "path")


# K7. Records for every fourth known track (some with a bad row), new art and deletes.
RECS = """rec AS (SELECT id, backing_path AS rk, id % 60 = 0 AS bad, id % 8 = 0 AS has_art FROM tracks_fx WHERE id % 4 = 0)"""


def sync_inputs(fx):
    t = fx.tracks().where("id % 4 = 0").select("id", F.col("backing_path").alias("record_key"))
    i = F.col("id")
    vals = F.array(
        F.struct(F.lit("Artist").alias("key"), F.concat(F.lit("New "), i.cast("string")).alias("value")),
        F.struct(F.lit("genre").alias("key"), F.lit("G1").alias("value")),
        F.struct(F.lit("genre").alias("key"), F.lit("G0").alias("value")),
        F.struct(F.when(i % 60 == 0, "").otherwise("mood").alias("key"), F.lit("calm").alias("value")),
    )
    pairs = t.select("record_key", F.posexplode(vals).alias("pos", "p")).select("record_key", F.col("pos").cast("bigint").alias("pos"), "p.key", "p.value")
    art = t.where("id % 8 = 0").select(
        "record_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("pos"), "id"
    ).select("record_key", "pos", F.concat(F.lit("img"), F.when(F.col("pos") == 0, (i % 5).cast("string")).otherwise("")).cast("binary").alias("data"), F.lit("image/png").alias("mime"), F.lit(3).alias("picture_type"), F.lit("").alias("description"))
    lost = fx.tracks().where("id % 100 = 0").select(F.concat(F.lit("/lost"), "backing_path").alias("record_key"))
    deletes = t.where("id % 16 = 0").select("record_key", F.lit("DISC").alias("key"))
    records = t.select("record_key").unionByName(lost)
    return pairs, art, deletes, records


def _sync(fx, mode, **options):
    pairs, art, deletes, records = sync_inputs(fx)
    return S.sync_records(fx.catalogue(), pairs, art, deletes, records, mode, **options)


NEWTAGS = """SELECT id AS track_id, 'Artist' AS key, concat('New ', id) AS value, 0 AS ordinal, FALSE AS is_blob FROM rec WHERE NOT bad UNION ALL SELECT id, 'genre', 'G1', 0, FALSE FROM rec WHERE NOT bad UNION ALL SELECT id, 'genre', 'G0', 1, FALSE FROM rec WHERE NOT bad UNION ALL SELECT id, 'mood', 'calm', 0, FALSE FROM rec WHERE NOT bad"""


@query(
    "k7_sync_replace_tags",
    f"WITH {RECS} SELECT track_id, key, value, ordinal, blob IS NOT NULL AS is_blob FROM tagsb_fx WHERE blob IS NOT NULL OR track_id NOT IN (SELECT id FROM rec WHERE NOT bad) UNION ALL {NEWTAGS}",
)
def k7r(spark, d):
    out = _sync(Fixtures(spark, d), "replace")[0]["tags"]
    return out.select("track_id", "key", "value", "ordinal", F.col("value_blob").isNotNull().alias("is_blob"))


@query(
    "k7_sync_merge_tags",
    f"""WITH {RECS} SELECT track_id, key, value, ordinal, blob IS NOT NULL AS is_blob FROM tagsb_fx t WHERE blob IS NOT NULL OR NOT (track_id IN (SELECT id FROM rec WHERE NOT bad) AND (lower(key) IN ('artist', 'genre', 'mood') OR (track_id % 16 = 0 AND key = 'disc'))) UNION ALL {NEWTAGS}""",
)
def k7m(spark, d):
    out = _sync(Fixtures(spark, d), "merge")[0]["tags"]
    return out.select("track_id", "key", "value", "ordinal", F.col("value_blob").isNotNull().alias("is_blob"))


@query(
    "k7_sync_versions",
    f"""WITH {RECS}, d AS (SELECT track_id, count(*) AS n FROM tags_fx WHERE lower(key) IN ('artist', 'genre', 'mood') OR (track_id % 16 = 0 AND key = 'disc') GROUP BY track_id), l AS (SELECT track_id, count(*) AS n FROM track_art_fx GROUP BY track_id)
    SELECT t.id, t.content_version + CASE WHEN r.id IS NOT NULL THEN COALESCE(d.n, 0) + 4 + CASE WHEN r.has_art THEN 2 + COALESCE(l.n, 0) ELSE 0 END ELSE 0 END AS content_version FROM tracks_fx t LEFT JOIN (SELECT * FROM rec WHERE NOT bad) r ON r.id = t.id LEFT JOIN d ON d.track_id = t.id LEFT JOIN l ON l.track_id = t.id""",
)
def k7v(spark, d):
    return _sync(Fixtures(spark, d), "merge")[0]["tracks"].select("id", "content_version")


@query(
    "k7_sync_links",
    f"""WITH {RECS}, good AS (SELECT * FROM rec WHERE NOT bad AND has_art) SELECT track_id, art_sha256 AS sha256, ordinal FROM track_art_fx WHERE track_id NOT IN (SELECT id FROM good) AND art_sha256 <> sha256('gone')
    UNION ALL SELECT id, sha256(concat('img', id % 5)), 0 FROM good UNION ALL SELECT id, sha256('img'), 1 FROM good""",
)
def k7l(spark, d):
    out = _sync(Fixtures(spark, d), "merge")[0]
    sha = out["art"].select(F.col("id").alias("art_id"), "sha256")
    return out["track_art"].join(sha, "art_id").select("track_id", "sha256", "ordinal")


STATS = """SELECT (SELECT count(*) FROM rec WHERE NOT {b}) AS synced, (SELECT count(*) FROM tracks_fx WHERE id % 100 = 0) AS skipped, (SELECT count(*) FROM rec WHERE NOT {b} AND has_art) AS art_linked, CAST(0 AS BIGINT) AS skipped_art, (SELECT count(*) FROM rec WHERE {b}) AS skipped_invalid"""


@query("k7_sync_stats", f"WITH {RECS} " + STATS.format(b="bad"))
def k7s(spark, d):
    return _sync(Fixtures(spark, d), "merge")[1]


@query("d09_sync_stats_dry_run", f"WITH {RECS} " + STATS.format(b="false"))
def d09(spark, d):
    return _sync(Fixtures(spark, d), "merge", dry_run=True)[1]


@query("d09_sync_invalid", f"WITH {RECS} SELECT rk AS record_key, 'key_length' AS problem FROM rec WHERE bad")
def d09i(spark, d):
    return _sync(Fixtures(spark, d), "merge")[2]


# K8
ITEMS = """it AS (SELECT o_orderkey AS o, o_orderdate AS dt, o_orderpriority AS pr, o_orderstatus AS st, o_totalprice AS tp FROM orders)"""


def importer_items(fx):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    return fx.table("orders").select(
        F.concat(F.lit("/i/"), k.cast("string")).alias("path"),
        F.concat(F.lit(" T "), k.cast("string"), F.lit(" ")).alias("title"),
        F.when(k % 3 == 0, F.array(F.lit("A1"), F.lit(" "), F.lit("A2"))).when(k % 3 == 1, F.array(F.lit(""))).alias("artists"),
        F.when(k % 4 != 0, "Solo").alias("artist"),
        F.array(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("genres"),
        F.lit("Ignored").alias("genre"),
        (k % 20).alias("track"),
        (k % 3).cast("int").alias("disc"),
        (k % 2 == 0).alias("comp"),
        F.when(k % 5 != 0, (k % 7) / F.lit(2.0)).otherwise(0.0).alias("bpm"),
        F.when(k % 6 == 0, 0).otherwise(F.year(t)).alias("year"),
        F.when(k % 6 == 1, 0).otherwise(F.month(t)).alias("month"),
        F.dayofmonth(t).alias("day"),
        F.when(k % 10 == 0, "1999").alias("date"),
        ((k % 2000 - 1000) / F.lit(64.0)).alias("rg_track_gain"),
        F.when(k % 2 == 1, (k % 1000) / F.lit(1000.0)).alias("rg_track_peak"),
        F.when(k % 9 == 0, F.concat(F.lit("mb"), k.cast("string"))).alias("mb_trackid"),
        F.lit("  ").alias("comments"),
        F.when(k % 8 == 0, "deep").alias("mood"),
    )


@query(
    "k8_map_importer_items",
    f"""WITH {ITEMS} SELECT concat('/i/', o) AS record_key, key, value FROM (
    SELECT o, 'title' AS key, concat('T ', o) AS value FROM it UNION ALL SELECT o, 'artist', unnest(['A1', 'A2']) FROM it WHERE o % 3 = 0 UNION ALL SELECT o, 'artist', 'Solo' FROM it WHERE o % 3 <> 0 AND o % 4 <> 0
    UNION ALL SELECT o, 'genre', unnest([st, pr]) FROM it UNION ALL SELECT o, 'tracknumber', concat(o % 20) FROM it WHERE o % 20 > 0 UNION ALL SELECT o, 'discnumber', concat(o % 3) FROM it WHERE o % 3 > 0
    UNION ALL SELECT o, 'compilation', '1' FROM it WHERE o % 2 = 0 UNION ALL SELECT o, 'bpm', CASE WHEN o % 7 % 2 = 0 THEN concat(CAST(o % 7 // 2 AS BIGINT)) ELSE concat(CAST(o % 7 // 2 AS BIGINT), '.5') END FROM it WHERE o % 5 <> 0 AND o % 7 > 0
    UNION ALL SELECT o, 'date', '1999' FROM it WHERE o % 10 = 0 UNION ALL SELECT o, 'date', CASE WHEN o % 6 = 1 THEN concat(year(dt)) ELSE strftime(dt, '%Y-%m-%d') END FROM it WHERE o % 10 <> 0 AND o % 6 <> 0
    UNION ALL SELECT o, 'replaygain_track_gain', printf('%.2f dB', (o % 2000 - 1000) / 64.0::DOUBLE) FROM it UNION ALL SELECT o, 'replaygain_track_peak', printf('%.6f', (o % 1000) / 1000.0::DOUBLE) FROM it WHERE o % 2 = 1
    UNION ALL SELECT o, 'musicbrainz_trackid', concat('mb', o) FROM it WHERE o % 9 = 0 UNION ALL SELECT o, 'mood', CASE WHEN o % 8 = 0 THEN 'deep' END FROM it WHERE o % 8 = 0
    UNION ALL SELECT o, 'isgroup', CASE WHEN o % 2 = 0 THEN '1' ELSE '0' END FROM it) x""",
)
def k8(spark, d):
    out = M.map_importer_items(importer_items(Fixtures(spark, d)), extra={"comp": "isgroup"})
    return out.select("record_key", "key", "value")


# K9
def tagger_rows(fx):
    e, i = fx.table("events"), F.col("event_id")
    name = (
        F.when(i % 9 == 0, "performer:guitar").when(i % 9 == 1, "~length").when(i % 9 == 2, "totaltracks").when(i % 9 == 3, "movement").when(i % 9 == 4, "comment:eng")
        .when(i % 9 == 5, "musicbrainz_recordingid").when(i % 9 == 6, "movementnumber").when(i % 9 == 7, "lyrics").otherwise("My Tag")
    )
    value = F.when(i % 9 == 2, (i % 2).cast("string")).when(i % 9 == 6, "0.0").when(i % 18 == 7, "  ").otherwise(F.concat(F.lit(" "), "event_type"))
    return e.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("record_key"), i.alias("pos"), name.alias("name"), value.alias("value"))


@query(
    "k9_map_tagger_values",
    """WITH e AS (SELECT event_id AS i, concat('/u/', user_id) AS rk, event_type AS t FROM events), over_rk AS (SELECT DISTINCT rk FROM e WHERE i % 9 = 8)
    SELECT rk AS record_key, i AS pos, key, value FROM (SELECT rk, i, CASE i % 9 WHEN 0 THEN 'performer' WHEN 2 THEN 'tracktotal' WHEN 3 THEN 'movementname' WHEN 4 THEN 'comment' WHEN 5 THEN 'musicbrainz_trackid' WHEN 7 THEN 'lyrics' ELSE 'My Tag' END AS key,
      CASE WHEN i % 9 = 0 THEN concat(t, ' (guitar)') WHEN i % 9 = 2 THEN '1' ELSE t END AS value FROM e WHERE i % 9 NOT IN (1, 6) AND NOT (i % 9 = 2 AND i % 2 = 0) AND i % 18 <> 7) x
    WHERE NOT (key = 'comment' AND rk IN (SELECT rk FROM over_rk)) UNION ALL SELECT rk, i, 'comment', t FROM e WHERE i % 9 = 8""",
)
def k9(spark, d):
    return M.map_tagger_values(tagger_rows(Fixtures(spark, d)), {"My Tag": "comment"}).select("record_key", "pos", "key", "value")


@query(
    "k9_tagger_images",
    "SELECT concat('/u/', user_id) AS record_key, event_id AS pos, CAST(CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 0 END AS INT) AS picture_type, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS description FROM events WHERE event_id % 7 <> 0",
)
def k9i(spark, d):
    i = F.col("event_id")
    img = Fixtures(spark, d).table("events").select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("record_key"), i.alias("pos"), F.lit("x").cast("binary").alias("data"), F.lit("image/png").alias("mimetype"),
        F.when(i % 4 == 0, "front").when(i % 4 == 1, "back").when(i % 4 == 2, "poster").alias("maintype"), (i % 4 == 2).alias("is_front"), F.when(i % 2 == 0, F.col("event_type")).alias("comment"), F.when(i % 7 == 0, False).alias("can_save"),
    )
    return M.tagger_images(img).select("record_key", "pos", "picture_type", "description")


@query(
    "k10_map_collection_records",
    f"""WITH a AS ({ASSEMBLED}), ok AS (SELECT a.path, a.file_id, ar.*, al.title, al.foreignAlbumId, al.releaseDate, al.region FROM a JOIN artists_fx ar ON ar.num = a.artist_id JOIN albums_fx al ON al.num = a.album_id WHERE a.status = 'ok')
    SELECT path AS record_key, key, value FROM (
    SELECT path, unnest(['artist', 'albumartist']) AS key, CASE WHEN artistName <> '' THEN artistName ELSE name END AS value FROM ok
    UNION ALL SELECT path, 'album', trim(title) FROM ok UNION ALL SELECT path, 'date', left(releaseDate, 10) FROM ok WHERE releaseDate IS NOT NULL UNION ALL SELECT path, 'musicbrainz_artistid', COALESCE(foreignArtistId, mbId) FROM ok
    UNION ALL SELECT path, 'musicbrainz_albumid', foreignAlbumId FROM ok UNION ALL SELECT path, 'genre', unnest(['Rock', region, segment]) FROM ok UNION ALL SELECT path, 'collection_managed', '1' FROM ok
    UNION ALL SELECT path, 'title', concat('Part ', l_partkey) FROM ok JOIN ctracks_fx t USING (file_id) UNION ALL SELECT path, 'tracknumber', CAST(ln AS VARCHAR) FROM ok JOIN ctracks_fx t USING (file_id)
    UNION ALL SELECT path, 'discnumber', '1' FROM ok JOIN ctracks_fx t USING (file_id) WHERE rf = 'A' UNION ALL SELECT path, 'musicbrainz_trackid', concat('t', t.id) FROM ok JOIN ctracks_fx t USING (file_id)
    UNION ALL SELECT path, 'musicbrainz_releasetrackid', concat('r', t.id) FROM ok JOIN ctracks_fx t USING (file_id) WHERE l_partkey % 2 = 0) x""",
)
def k10(spark, d):
    fx = Fixtures(spark, d)
    return M.map_collection_records(assembled(fx), fx.collection_tracks(), ambiguous="skip").select("record_key", "key", "value")


@query(
    "k11_prune_deleted",
    "SELECT id FROM tracks_fx WHERE id NOT IN (SELECT track_id FROM tags_fx WHERE key = 'album' AND value IN ('1-URGENT', '5-LOW') AND track_id % 3 > 0)",
)
def k11(spark, d):
    fx = Fixtures(spark, d)
    events = fx.tags().where("key = 'album' AND value IN ('1-URGENT', '5-LOW')").select("key", "value").distinct()
    gone = S.owned_by_events(owned_tags(fx), events, M.OWNER_KEY).select(F.col("track_id").alias("id"))
    return C.cascade_delete({"tracks": fx.tracks()}, gone)["tracks"].select("id")


@query("k11_rename_prune", "SELECT id, backing_path FROM tracks_fx WHERE id % 2 = 0 AND backing_path NOT IN (SELECT path FROM files_fx)")
def k11r(spark, d):
    fx = Fixtures(spark, d)
    t = fx.tracks()
    return S.rename_prune(t, t.where("id % 2 = 0").select("backing_path"), fx.files())


@query(
    "k12_preview",
    f"""WITH leafs AS ({RANKED}), c AS (SELECT count(*) AS files, (SELECT count(DISTINCT string_split(final_path, '/')[1]) FROM leafs) AS dirs FROM leafs)
    SELECT final_path, files, dirs, greatest(files - 30, 0) AS more FROM (SELECT final_path FROM leafs ORDER BY string_split(final_path, '/') LIMIT 30) s, c""",
)
def k12(spark, d):
    fx = Fixtures(spark, d)
    return VW.preview(fx.tracks(), fx.tags(), PLAIN)


@query(
    "k13_check_catalogue",
    """SELECT 'rule' AS check, 'track_art.picture_type' AS object, count(*) AS n FROM track_art_fx WHERE picture_type > 20 UNION ALL SELECT 'reference', 'track_art->art', count(*) FROM track_art_fx WHERE art_sha256 = sha256('gone')
    UNION ALL SELECT 'rows', 'tracks', count(*) FROM tracks_fx UNION ALL SELECT 'rows', 'tags', count(*) FROM tagsb_fx UNION ALL SELECT 'rows', 'art', count(*) FROM art_fx UNION ALL SELECT 'rows', 'track_art', count(*) FROM track_art_fx UNION ALL SELECT 'rows', 'structural_blocks', count(*) FROM blocks_fx""",
)
def k13(spark, d):
    return SC.check_catalogue(Fixtures(spark, d).catalogue())


LAYOUT = """lay AS (SELECT track_id AS file_id, 0 AS part, kind AS sub, ordinal, strlen(body) AS len, 'block' AS kind FROM blocks_fx UNION ALL SELECT track_id, 1, key, ordinal, strlen(value), 'tag' FROM tags_fx
    UNION ALL SELECT track_id, 2, key, ordinal, strlen(blob), 'binary_tag' FROM tagsb_fx WHERE blob IS NOT NULL UNION ALL SELECT t.track_id, 3, '', t.ordinal, a.byte_len, 'picture' FROM track_art_fx t JOIN art_fx a ON a.sha256 = t.art_sha256
    UNION ALL SELECT id, 4, '', 0, audio_length, 'audio' FROM tracks_fx),
    ls AS (SELECT *, CAST(sum(len) OVER (PARTITION BY file_id ORDER BY part, sub, ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) - len AS seg_start FROM lay)"""


def layout(fx):
    tags = fx.tags_with_blobs().select("track_id", "key", "ordinal", F.coalesce(F.octet_length("value_blob"), F.octet_length("value")).alias("n_bytes"), F.col("value_blob").isNotNull().alias("is_binary"))
    links = fx.track_art().join(fx.art().select(F.col("sha256").alias("art_sha256"), F.col("byte_len").alias("n_bytes")), "art_sha256").select("track_id", F.col("art_sha256").alias("ref"), "ordinal", "n_bytes")
    blocks = fx.blocks().select("track_id", "kind", "ordinal", F.octet_length("body").alias("n_bytes"))
    return L.compose_layout(fx.tracks(), tags, links, blocks)


@query("k14_compose_layout", f"WITH {LAYOUT} SELECT file_id, kind, sub, ordinal, CAST(len AS BIGINT) AS len, seg_start FROM ls")
def k14(spark, d):
    return L.layout_starts(layout(Fixtures(spark, d))).select("file_id", "kind", "sub", "ordinal", "len", "seg_start")


@query(
    "k14_resolve_ranges",
    f"""WITH {LAYOUT}, r AS (SELECT event_id AS request_id, event_id % (SELECT count(*) FROM orders) AS file_id, CAST(floor(value) AS BIGINT) AS req_offset, event_id % 60 AS req_len FROM events)
    SELECT request_id, kind, sub, ordinal, greatest(seg_start, req_offset) - seg_start AS within, least(seg_start + len, req_offset + req_len) - greatest(seg_start, req_offset) AS n
    FROM r JOIN ls ON ls.file_id = r.file_id AND seg_start < req_offset + req_len AND seg_start + len > req_offset WHERE req_len > 0""",
)
def k14r(spark, d):
    fx = Fixtures(spark, d)
    got = L.resolve_layout(layout(fx), requests(fx))
    return got.select("request_id", "kind", "sub", "ordinal", "within", "n")


@query("k14_layout_errors", "SELECT track_id AS file_id, 'tag' AS kind, 'empty_segment' AS error FROM tags_fx WHERE key = 'disc'")
def k14e(spark, d):
    fx = Fixtures(spark, d)
    broken = layout(fx).withColumn("len", F.when(F.col("sub") == "disc", 0).otherwise(F.col("len")))
    return L.layout_errors(broken).select("file_id", "kind", "error")


@query(
    "k15_managed_keys",
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'disc' ELSE '' END AS delete_keys, CASE WHEN id % 2 = 0 THEN 'album,artist,disc,title' ELSE 'album,artist,title' END AS managed, 'album,artist,title' AS restored FROM tracks_fx""",
)
def k15(spark, d):
    t = Fixtures(spark, d).tracks()
    prev = V.csv_to_keys(F.when(F.col("id") % 2 == 0, "disc,title"))
    now = F.array(F.lit("title"), F.lit("artist"), F.lit("album"))
    m, r = V.managed_keys(prev, now), V.managed_keys(prev, now, restore=True)
    return t.select("id", V.keys_to_csv(m["delete_keys"]).alias("delete_keys"), V.keys_to_csv(m["managed"]).alias("managed"), V.keys_to_csv(r["managed"]).alias("restored"))
