"""The driver's tables projected onto catalogue schemas, in Spark and in SQL."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.ordered import HOT_ROWS, hot_and_rows, running_sums

REGISTRY = {}


def query(name: str, sql: str = None):
    """Register a query; `sql` is the statement DuckDB runs on the same tables."""

    def add(fn):
        REGISTRY[name] = (fn, with_fixtures(sql) if sql else None)
        return fn

    return add


def s(c):
    return F.col(c).cast("string")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tracks(self) -> DataFrame:
        k = F.col("o_orderkey")
        fmt = (
            F.when(k % 7 == 0, "flac").when(k % 7 == 1, "mp3").when(k % 7 == 2, "m4a").when(k % 7 == 3, "opus")
            .when(k % 7 == 4, "vorbis").when(k % 7 == 5, "oggflac").otherwise("wav")
        )
        n = F.floor("o_totalprice").cast("bigint")
        return self.table("orders").select(
            (k + 1).alias("id"),
            F.concat(F.lit("/lib/c"), s("o_custkey"), F.lit("/"), "o_orderstatus", F.lit("/"), s("o_orderkey"), F.lit("."), fmt).alias("backing_path"),
            fmt.alias("format"),
            (k % 4096).alias("audio_offset"),
            n.alias("audio_length"),
            (k % 4096 + n).alias("backing_size"),
            (F.lit(1700000000000000000) + k * 1000003).alias("backing_mtime_ns"),
            (F.lit(1700000000000000017) + k * 1000003).alias("backing_ctime_ns"),
            (k % 5).alias("content_version"),
            (F.lit(1700000000).cast("bigint") + k % 1000).alias("updated_at"),
            F.sha2(F.concat(F.lit("fp"), (k - F.when(k % 97 == 1, 1).otherwise(0)).cast("string")), 256).alias("fingerprint"),
            F.when(k % 5 == 0, F.sha2(F.concat(F.lit("full"), s("o_orderkey")), 256)).alias("content_hash"),
        )

    def genres(self) -> DataFrame:
        """Distinct part types per order; the set is as small as the list of types."""
        g = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        g = g.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_type")).alias("g"))
        return g.select((F.col("l_orderkey") + 1).alias("track_id"), F.lit("genre").alias("key"), F.posexplode("g").alias("ordinal", "value"))

    def tags(self) -> DataFrame:
        o = self.table("orders")
        c = self.table("customer")
        n = self.table("nation").select("n_nationkey", "n_name")
        oc = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        ocn = oc.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        k = F.col("o_orderkey")

        def part(df, key, value):
            return df.select((k + 1).alias("track_id"), (F.lit(key) if isinstance(key, str) else key).alias("key"), F.lit(0).alias("ordinal"), value.alias("value"))

        out = part(ocn.where(k % 10 != 3), "albumartist", F.col("n_name"))
        out = out.unionByName(part(oc, F.when(k % 4 == 0, "ARTIST").otherwise("artist"), F.col("c_name")))
        out = out.unionByName(part(o, "album", F.col("o_orderpriority")))
        take = F.concat(F.lit("Take "), (k % 20).cast("string"), F.when(k % 50 == 7, " (2)").otherwise(""))
        out = out.unionByName(part(o, "title", take))
        out = out.unionByName(part(o.where(k % 3 > 0), "disc", (k % 3).cast("string")))
        out = out.unionByName(self.genres())
        return out.select("track_id", "key", "value", F.col("ordinal").cast("bigint").alias("ordinal"))

    def tags_with_blobs(self) -> DataFrame:
        """Text tags plus one binary row per seventh track, half of them under a key that texts use too."""
        text = self.tags().withColumn("value_blob", F.lit(None).cast("binary"))
        o = self.table("orders").where(F.col("o_orderkey") % 7 == 0)
        blob = o.select(
            (F.col("o_orderkey") + 1).alias("track_id"), F.when(F.col("o_orderkey") % 14 == 0, "ARTIST").otherwise("id3:PRIV").alias("key"), F.lit("").alias("value"),
            F.lit(0).cast("bigint").alias("ordinal"), F.col("o_orderpriority").cast("binary").alias("value_blob"),
        )
        return text.unionByName(blob)

    def art(self) -> DataFrame:
        mime = F.when(F.col("p_partkey") % 2 == 0, "image/png").otherwise("image/jpeg")
        return self.table("part").groupBy("p_name").agg(F.min(mime).alias("mime")).select(
            F.sha2("p_name", 256).alias("sha256"), "mime", F.octet_length("p_name").cast("bigint").alias("byte_len"), F.col("p_name").alias("data")
        )

    def track_art(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_shipdate"]
        lines = self.table("lineitem").select((F.col("l_orderkey") + 1).alias("track_id"), *order, "l_returnflag")
        # The join only drops lines, so they are counted before it.
        hot, rows = hot_and_rows(lines, ["track_id"])
        j = lines.join(self.table("part").where(~F.col("p_name").like("red%")), F.col("l_partkey") == F.col("p_partkey"))
        j = j.select("track_id", *order, "l_returnflag", "p_name")
        # Line number above part key never decreases along the order, so a hot order can be cut there.
        coarse = F.col("l_linenumber") * F.lit(1 << 40) + F.col("l_partkey")
        j = running_sums(j, ["track_id"], order, coarse, {"rn": F.lit(1).cast("bigint")}, HOT_ROWS if hot else None, rows=rows)
        return j.select(
            "track_id",
            F.when(F.col("l_partkey") % 101 == 0, F.sha2(F.lit("gone"), 256)).otherwise(F.sha2("p_name", 256)).alias("art_sha256"),
            (F.col("l_partkey") % 22).cast("int").alias("picture_type"),
            F.col("l_returnflag").alias("description"),
            (F.col("rn") - 1).alias("ordinal"),
        )

    def blocks(self) -> DataFrame:
        """Structural rows for flac tracks, except for every 21st order."""
        o = self.table("orders").where((F.col("o_orderkey") % 7 == 0) & (F.col("o_orderkey") % 21 != 0))
        return o.select(
            (F.col("o_orderkey") + 1).alias("track_id"), F.lit("STREAMINFO").alias("kind"), F.lit(0).cast("bigint").alias("ordinal"),
            F.concat(F.col("o_orderstatus"), F.col("o_orderpriority")).cast("binary").alias("body"),
        )

    def files(self) -> DataFrame:
        t = self.tracks()
        i = F.col("id")
        known = t.where(i % 11 != 0).select(
            F.when(i % 13 == 0, F.concat(F.lit("/moved"), "backing_path")).otherwise(F.col("backing_path")).alias("path"),
            F.col("backing_size").alias("size"),
            F.when(i % 7 == 0, F.col("backing_mtime_ns") + 1).otherwise(F.col("backing_mtime_ns")).alias("mtime_ns"),
            F.col("backing_ctime_ns").alias("ctime_ns"),
            "fingerprint",
            "content_hash",
        )
        one = F.lit(1).cast("bigint")
        ext = F.when(i % 4 == 0, ".JPG").when(i % 4 == 1, ".cue").when(i % 4 == 2, "").otherwise(".FLAC")
        new = t.where(i % 17 == 0).select(
            F.concat(F.lit("/new/"), s("id"), ext).alias("path"), one.alias("size"), one.alias("mtime_ns"), one.alias("ctime_ns"),
            F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("string").alias("content_hash"),
        )
        return known.unionByName(new)

    def log(self) -> DataFrame:
        return self.table("events").select((F.col("event_id") + 1).alias("seq"), (F.col("user_id") + 1).alias("track_id"), F.col("event_type").alias("op"))

    def log_versions(self) -> DataFrame:
        """Log rows with the version step each one makes (errors change no version)."""
        return self.log().withColumn("bump", F.when(F.col("op") == "error", 0).otherwise(1).cast("bigint"))

    def catalogue(self) -> dict:
        """The six tables; art ids are the rank of the content hash among the few distinct blobs."""
        from shelfmark.operators.catalog import with_next_ids

        empty = self.spark.createDataFrame([], "id bigint")
        art = with_next_ids(self.art(), empty, "sha256").select(
            "id", "sha256", "mime", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), "byte_len", F.col("data").cast("binary").alias("data")
        )
        links = self.track_art().join(art.select(F.col("id").alias("art_id"), F.col("sha256").alias("art_sha256")), "art_sha256", "left")
        links = links.select("track_id", F.coalesce("art_id", F.lit(-1).cast("bigint")).alias("art_id"), "picture_type", "description", "ordinal")
        return {
            "tracks": self.tracks(), "tags": self.tags_with_blobs(), "art": art, "track_art": links, "structural_blocks": self.blocks(),
        }

    # Collection manager: customer is the artist, nation the album, orders the file, lineitem the track.
    def artists(self) -> DataFrame:
        c = self.table("customer")
        k = F.col("c_custkey")
        return c.where(k % 29 != 5).select(
            s("c_custkey").alias("id"),
            F.when(k % 6 == 0, "").otherwise(F.col("c_name")).alias("artistName"),
            F.concat(F.lit("Alias "), s("c_custkey")).alias("name"),
            F.when(k % 4 != 0, F.concat(F.lit("mb-a"), s("c_custkey"))).alias("foreignArtistId"),
            F.concat(F.lit("alt-a"), s("c_custkey")).alias("mbId"),
            F.array(F.col("c_mktsegment"), F.lit(" Rock "), F.lit("")).alias("genres"),
        )

    def albums(self) -> DataFrame:
        n = self.table("nation")
        k = F.col("n_nationkey")
        img = lambda kind, url, remote: F.struct(kind.alias("coverType"), url.alias("url"), remote.alias("remoteUrl"))
        nul = F.lit(None).cast("string")
        images = (
            F.when(k % 4 == 0, F.array(img(F.lit("poster"), F.concat(F.lit("/p/"), s("n_nationkey")), nul), img(F.lit("Cover"), nul, F.concat(F.lit("/c/"), s("n_nationkey")))))
            .when(k % 4 == 1, F.array(img(F.lit("cover"), nul, F.lit("")), img(F.lit("disc"), F.concat(F.lit("/d/"), s("n_nationkey")), nul)))
            .when(k % 4 == 2, F.array(img(F.lit("cover"), nul, nul)))
        )
        return n.where(k % 23 != 7).select(
            s("n_nationkey").alias("id"),
            F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("title"),
            F.concat(F.lit("mb-r"), s("n_nationkey")).alias("foreignAlbumId"),
            F.when(k % 3 != 0, F.concat(F.lit("19"), F.lpad(s("n_nationkey"), 2, "0"), F.lit("-05-17T00:00:00Z"))).alias("releaseDate"),
            F.array(F.lit("Rock"), F.concat(F.lit("Region "), s("n_regionkey")), F.lit("Rock")).alias("genres"),
            F.when(k % 2 == 0, s("n_nationkey")).alias("artistId"),
            nul.alias("artist_id"),
            F.struct(F.lit("0").alias("artistId"), s("n_regionkey").alias("id")).alias("artist"),
            images.alias("images"),
        )

    def collection_files(self) -> DataFrame:
        j = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return j.select(
            F.col("o_orderkey").alias("id"), s("o_custkey").alias("artistId"), s("c_nationkey").alias("albumId"),
            F.concat(F.lit("/music/"), s("o_orderkey")).alias("path"),
        )

    def collection_tracks(self) -> DataFrame:
        """Distinct (order, part) pairs, since line numbers repeat."""
        li = self.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("ln"), F.min("l_returnflag").alias("rf"))
        k = F.col("l_orderkey") * 1000000 + F.col("l_partkey")
        return li.select(
            k.alias("id"), s("l_orderkey").alias("artistId"), s("l_orderkey").alias("albumId"), F.col("l_orderkey").alias("trackFileId"),
            F.concat(F.lit("t"), k.cast("string")).alias("foreignTrackId"),
            F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("foreignRecordingId"),
            F.when(F.col("ln") > 2, s("ln")).otherwise("").alias("trackNumber"),
            s("ln").alias("absoluteTrackNumber"),
            F.when(F.col("rf") == "A", "1").alias("mediumNumber"),
            F.concat(F.lit("Part "), s("l_partkey")).alias("title"),
        )


# The same projections as SQL; a query gets the ones it names, with what they build on.
SQL = {
    "tracks_fx": """SELECT o_orderkey + 1 AS id,
  concat('/lib/c', CAST(o_custkey AS VARCHAR), '/', o_orderstatus, '/', CAST(o_orderkey AS VARCHAR), '.', fmt) AS backing_path,
  fmt AS format, o_orderkey % 4096 AS audio_offset, CAST(floor(o_totalprice) AS BIGINT) AS audio_length,
  o_orderkey % 4096 + CAST(floor(o_totalprice) AS BIGINT) AS backing_size,
  1700000000000000000 + o_orderkey * 1000003 AS backing_mtime_ns,
  1700000000000000000 + o_orderkey * 1000003 + 17 AS backing_ctime_ns,
  o_orderkey % 5 AS content_version, 1700000000 + o_orderkey % 1000 AS updated_at,
  sha256(concat('fp', CAST(o_orderkey - (CASE WHEN o_orderkey % 97 = 1 THEN 1 ELSE 0 END) AS VARCHAR))) AS fingerprint,
  CASE WHEN o_orderkey % 5 = 0 THEN sha256(concat('full', CAST(o_orderkey AS VARCHAR))) END AS content_hash
FROM (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN 'flac' WHEN 1 THEN 'mp3' WHEN 2 THEN 'm4a' WHEN 3 THEN 'opus' WHEN 4 THEN 'vorbis' WHEN 5 THEN 'oggflac' ELSE 'wav' END AS fmt FROM orders) t""",
    "tags_fx": """SELECT track_id, key, value, row_number() OVER (PARTITION BY track_id, key ORDER BY value) - 1 AS ordinal FROM (
  SELECT o_orderkey + 1 AS track_id, 'albumartist' AS key, n_name AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 10 <> 3
  UNION ALL SELECT o_orderkey + 1, CASE WHEN o_orderkey % 4 = 0 THEN 'ARTIST' ELSE 'artist' END, c_name FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey + 1, 'album', o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey + 1, 'title', concat('Take ', CAST(o_orderkey % 20 AS VARCHAR), CASE WHEN o_orderkey % 50 = 7 THEN ' (2)' ELSE '' END) FROM orders
  UNION ALL SELECT o_orderkey + 1, 'disc', CAST(o_orderkey % 3 AS VARCHAR) FROM orders WHERE o_orderkey % 3 > 0
  UNION ALL SELECT DISTINCT l_orderkey + 1, 'genre', p_type FROM lineitem JOIN part ON l_partkey = p_partkey
) u""",
    "tagsb_fx": """SELECT track_id, key, value, ordinal, CAST(NULL AS VARCHAR) AS blob FROM tags_fx
  UNION ALL SELECT o_orderkey + 1, CASE WHEN o_orderkey % 14 = 0 THEN 'ARTIST' ELSE 'id3:PRIV' END, '', 0, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0""",
    "art_fx": """SELECT sha256(p_name) AS sha256, min(CASE WHEN p_partkey % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END) AS mime, CAST(strlen(p_name) AS BIGINT) AS byte_len, p_name AS data
FROM part GROUP BY p_name""",
    "track_art_fx": """SELECT l_orderkey + 1 AS track_id, CASE WHEN l_partkey % 101 = 0 THEN sha256('gone') ELSE sha256(p_name) END AS art_sha256, CAST(l_partkey % 22 AS INT) AS picture_type, l_returnflag AS description,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_shipdate) - 1 AS ordinal
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name NOT LIKE 'red%'""",
    "blocks_fx": """SELECT o_orderkey + 1 AS track_id, 'STREAMINFO' AS kind, CAST(0 AS BIGINT) AS ordinal, concat(o_orderstatus, o_orderpriority) AS body FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 21 <> 0""",
    "files_fx": """SELECT CASE WHEN id % 13 = 0 THEN concat('/moved', backing_path) ELSE backing_path END AS path, backing_size AS size,
  CASE WHEN id % 7 = 0 THEN backing_mtime_ns + 1 ELSE backing_mtime_ns END AS mtime_ns, backing_ctime_ns AS ctime_ns, fingerprint, content_hash
FROM tracks_fx WHERE id % 11 <> 0
UNION ALL SELECT concat('/new/', CAST(id AS VARCHAR), CASE WHEN id % 4 = 0 THEN '.JPG' WHEN id % 4 = 1 THEN '.cue' WHEN id % 4 = 2 THEN '' ELSE '.FLAC' END), 1, 1, 1, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM tracks_fx WHERE id % 17 = 0""",
    "log_fx": "SELECT event_id + 1 AS seq, user_id + 1 AS track_id, event_type AS op, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS bump FROM events",
    "artists_fx": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS num, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS artistName, concat('Alias ', c_custkey) AS name,
  CASE WHEN c_custkey % 4 <> 0 THEN concat('mb-a', c_custkey) END AS foreignArtistId, concat('alt-a', c_custkey) AS mbId, c_mktsegment AS segment FROM customer WHERE c_custkey % 29 <> 5""",
    "albums_fx": """SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey AS BIGINT) AS num, concat(' ', n_name, ' ') AS title, concat('mb-r', n_nationkey) AS foreignAlbumId,
  CASE WHEN n_nationkey % 3 <> 0 THEN concat('19', lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), '-05-17T00:00:00Z') END AS releaseDate, concat('Region ', n_regionkey) AS region, n_regionkey FROM nation WHERE n_nationkey % 23 <> 7""",
    "cfiles_fx": "SELECT o_orderkey AS id, o_custkey AS artist_id, CAST(c_nationkey AS BIGINT) AS album_id, concat('/music/', o_orderkey) AS path FROM orders JOIN customer ON o_custkey = c_custkey",
    "ctracks_fx": """SELECT l_orderkey * 1000000 + l_partkey AS id, l_orderkey AS file_id, l_partkey, min(l_linenumber) AS ln, min(l_returnflag) AS rf FROM lineitem GROUP BY l_orderkey, l_partkey""",
}
_NEEDS = {"tagsb_fx": ["tags_fx"], "files_fx": ["tracks_fx"]}


def with_fixtures(sql: str) -> str:
    used = []

    def need(name):
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in used:
            used.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in used)
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
