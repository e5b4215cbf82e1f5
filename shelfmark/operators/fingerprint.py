"""A track's content fingerprint from its rows in the catalogue: bounds, tags, pictures and blocks, and no file stamp.

The rows of a kind go to their track once, with their bytes if those are fewer than a digest's, else with a digest; rows that are
there already stay. They are numbered along their order and digested in runs of RUN rows, and the runs of a track last. So equal
content in equal order gives an equal digest, wherever its rows are stored, and no track is one array: of n rows a group holds
RUN or n / RUN. All rows of a track pass one task, which sorts them on disk if they are many.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.values import record_fingerprint

RUN = 1024
KINDS = ("tag", "picture", "block")
#: Bytes of a digest; content of fewer bytes stands for itself.
WIDE = 32
#: Tracks that one task takes with all their rows; partitions hold no more on average and are not merged beyond.
TASK_TRACKS = 100_000


def _fold(rows: DataFrame, by: list, order: list, piece) -> DataFrame:
    """One digest of the ordered pieces of each group."""
    parts = F.sort_array(F.collect_list(F.struct(*order, "digest")))
    return rows.groupBy(*by).agg(F.unhex(F.sha2(F.array_join(F.transform(parts, piece), ","), 256)).alias("digest"))


def _children(tags: DataFrame, pictures: DataFrame, blocks: DataFrame) -> list[DataFrame]:
    """track_id, kind, key, ordinal, digest of every row that makes up a track, by kind; pictures stand with their metadata."""
    blob = F.sha2("value_blob", 256).alias("value_blob") if "value_blob" in tags.columns else F.lit(None).cast("string").alias("value_blob")
    digest = lambda kind, *of: F.unhex(record_fingerprint(F.lit(kind), *of))
    row = lambda kind, key, made: ("track_id", F.lit(KINDS.index(kind)).cast("tinyint").alias("kind"), key, "ordinal", made.alias("digest"))
    short = F.col("value_blob").isNull() & (F.octet_length("value") < WIDE)
    return [
        tags.select("track_id", "key", "ordinal", "value", blob).select(*row("tag", "key", F.when(short, F.col("value").cast("binary")).otherwise(digest("tag", "key", "value", "value_blob")))),
        pictures.select(*row("picture", F.lit("").alias("key"), digest("picture", "sha256", "mime", "width", "height", "picture_type", "description"))),
        blocks.select("track_id", "ordinal", F.col("kind").alias("what"), F.sha2("body", 256).alias("body")).select(*row("block", F.lit("").alias("key"), digest("block", "what", "body"))),
    ]


def _content(rows: DataFrame) -> DataFrame:
    """id, digest of the rows of each track. A window and both groupings by track take one shuffle, or none if the rows lie by track."""
    along = Window.partitionBy("track_id").orderBy("kind", "key", "ordinal", "digest")
    rows = rows.withColumn("at", F.row_number().over(along) - 1).withColumn("run", F.floor(F.col("at") / RUN))
    runs = _fold(rows, ["track_id", "run"], ["at", "kind", "key"], lambda p: F.concat_ws(":", p["kind"].cast("string"), F.hex(p["key"]), F.hex(p["digest"])))
    return _fold(runs, ["track_id"], ["run"], lambda p: F.hex(p["digest"])).withColumnRenamed("track_id", "id")


def _fingerprints(tracks: DataFrame, *kinds: DataFrame) -> DataFrame:
    own, n = tracks.select("id", "format", "audio_offset", "audio_length"), tracks.count()
    if n > TASK_TRACKS:
        # Rows of few bytes in a shuffle take many when they are sorted. What joins a numbered repartition is not merged either.
        at_hand = int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(at_hand, -(-n // TASK_TRACKS))
        own = own.repartition(parts, "id")
        kinds = [rows.repartition(parts, "track_id") for rows in kinds] if parts > at_hand else kinds
    of = [_content(rows).withColumnRenamed("digest", f"_{i}") for i, rows in enumerate(kinds)]
    joined = reduce(lambda df, more: df.join(more, "id", "left"), of, own)
    return joined.select("id", record_fingerprint("format", "audio_offset", "audio_length", *[F.hex(f"_{i}") for i in range(len(of))]).alias("fingerprint"))


def catalogue_fingerprints(catalogue: dict, tracks: DataFrame = None) -> DataFrame:
    """id, fingerprint of every track (or of the given ones) from its columns and child rows."""
    tracks = catalogue["tracks"] if tracks is None else tracks
    art = catalogue["art"].select(F.col("id").alias("art_id"), "sha256", "mime", "width", "height")
    pictures = catalogue["track_art"].join(art, "art_id", "left")
    return _fingerprints(tracks, *_children(catalogue["tags"], pictures, catalogue["structural_blocks"]))


def file_fingerprints(files: DataFrame, tags: DataFrame = None, binary_tags: DataFrame = None, pictures: DataFrame = None, blocks: DataFrame = None) -> DataFrame:
    """path, fingerprint of the given files from their bounds and the rows read from them: all rows, also those
    that the catalogue would not store, at their positions."""
    kind = lambda df, schema: files.sparkSession.createDataFrame([], schema) if df is None else df.join(files.select("path"), "path", "left_semi")
    at = [F.col("path").alias("track_id"), F.col("pos").alias("ordinal")]
    text = kind(tags, "path string, pos bigint, key string, value string").select(*at, "key", "value", F.lit(None).cast("binary").alias("value_blob"))
    blob = kind(binary_tags, "path string, pos bigint, key string, payload binary").select(*at, "key", F.lit("").alias("value"), F.col("payload").alias("value_blob"))
    art = kind(pictures, "path string, pos bigint, mime string, width int, height int, picture_type int, description string, data binary")
    art = art.select(*at, F.sha2("data", 256).alias("sha256"), "mime", "width", "height", "picture_type", "description")
    body = kind(blocks, "path string, pos bigint, kind string, body binary").select(*at, "kind", "body")
    own = files.select(F.col("path").alias("id"), "format", "audio_offset", "audio_length")
    return _fingerprints(own, *_children(text.unionByName(blob), art, body)).withColumnRenamed("id", "path")
