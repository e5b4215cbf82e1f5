"""Composed files as ordered segments, and byte ranges resolved against them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ordered import HOT_ROWS, any_hot, fullest_cell, id_bucket, running_sums
from shelfmark.schemas import MAX_ROWS_PER_TRACK

# Order of the parts of a composed file: metadata first, audio last.
PARTS = {"block": 0, "tag": 1, "binary_tag": 2, "picture": 3, "audio": 4}


def segment_starts(segments: DataFrame, group="file_id", seq="seq", length="len", hot_rows=None) -> DataFrame:
    """Add `seg_start` and `seg_end`, running byte offsets within each file."""
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    summed = running_sums(segments, [group], [seq], id_bucket(seq), {"seg_end": F.col(length)}, **extra)
    return summed.withColumn("seg_start", F.col("seg_end") - F.col(length))


def compose_layout(tracks: DataFrame, tags: DataFrame, links: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segment table of every track: non-empty metadata parts in fixed order, then the audio.

    tags: track_id, key, ordinal, n_bytes, is_binary; links: track_id, ref, ordinal, n_bytes;
    blocks: track_id, kind, ordinal, n_bytes. The position is a struct, so the order
    needs no sort until the starts are computed.
    """
    def part(df, kind, ref, sub, ordinal, n):
        return df.select(
            F.col("track_id").alias("file_id"),
            F.lit(kind).alias("kind"),
            F.lit(PARTS[kind]).alias("part"),
            sub.alias("sub"),
            ordinal.cast("bigint").alias("ordinal"),
            ref.cast("string").alias("ref"),
            F.lit(0).cast("bigint").alias("offset"),
            n.cast("bigint").alias("len"),
        )

    none = F.lit("")
    n = F.col("n_bytes")
    text, binary = tags.where(~F.col("is_binary")), tags.where(F.col("is_binary"))
    meta = (
        part(blocks, "block", F.col("kind"), F.col("kind"), F.col("ordinal"), n)
        .unionByName(part(text, "tag", F.col("key"), F.col("key"), F.col("ordinal"), n))
        .unionByName(part(binary, "binary_tag", F.col("key"), F.col("key"), F.col("ordinal"), n))
        .unionByName(part(links, "picture", F.col("ref"), none, F.col("ordinal"), n))
        .where(F.col("len") > 0)
    )
    audio = tracks.select(
        F.col("id").alias("file_id"),
        F.lit("audio").alias("kind"),
        F.lit(PARTS["audio"]).alias("part"),
        none.alias("sub"),
        F.lit(0).cast("bigint").alias("ordinal"),
        F.col("backing_path").alias("ref"),
        F.col("audio_offset").alias("offset"),
        F.col("audio_length").alias("len"),
    )
    return meta.unionByName(audio)


LAYOUT_ORDER = ("part", "sub", "ordinal")


def layout_starts(layout: DataFrame, hot_rows=None) -> DataFrame:
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    # Hot files are cut by part and, inside a part, by ordinal ranges of one key order.
    coarse = F.col("part").cast("bigint")
    summed = running_sums(layout, ["file_id"], list(LAYOUT_ORDER), coarse, {"seg_end": F.col("len")}, wide=True, **extra)
    return summed.withColumn("seg_start", F.col("seg_end") - F.col("len"))


def layout_totals(segments: DataFrame, group="file_id", length="len", audio=None) -> DataFrame:
    is_audio = (F.col("kind") == "audio") if audio is None else audio
    return segments.groupBy(group).agg(
        F.sum(length).alias("total_len"), F.coalesce(F.sum(F.when(~is_audio, F.col(length))), F.lit(0)).alias("header_len")
    )


def layout_errors(layout: DataFrame) -> DataFrame:
    bad = (
        F.when((F.col("len") == 0) & (F.col("kind") != "audio"), "empty_segment")
        .when((F.col("kind") == "audio") & (F.col("offset") > F.lit(9223372036854775807) - F.col("len")), "range_overflow")
    )
    return layout.withColumn("error", bad).where("error is not null")


def _overlap(pieces: DataFrame) -> DataFrame:
    """Pairs of segment and request that share bytes, with `within` and `n`."""
    begin, stop = F.greatest("seg_start", "req_offset"), F.least(F.col("seg_end") - 1, _request_end())
    return pieces.where(begin <= stop).withColumn("within", begin - F.col("seg_start")).withColumn("n", stop - begin + 1)


def _request_end() -> Column:
    """The last byte asked for."""
    return F.coalesce(F.try_add("req_offset", "req_len"), F.lit(9223372036854775807)) - 1


def resolve_layout(layout: DataFrame, requests: DataFrame, group="file_id", hot_rows: int = HOT_ROWS, few: int = MAX_ROWS_PER_TRACK) -> DataFrame:
    """`resolve_ranges` of a layout: its parts are shuffled once, and requests meet them where the running sums are made.

    A request is compared with the first `few` segments of its file; what lies behind them goes through the sweep of
    `resolve_ranges`, as do all segments if a file has more than `hot_rows` segments and requests.
    """
    asked = requests.where("req_len > 0")
    rows = layout.select(group).unionByName(asked.select(group))
    fullest, n = fullest_cell(rows, [group])
    if fullest > hot_rows and any_hot(rows, [group], hot_rows):
        return resolve_ranges(layout_starts(layout, hot_rows), requests, group, hot_rows)
    sums = {"seg_end": F.col("len"), "_place": F.lit(1).cast("bigint")}
    starts = running_sums(layout, [group], list(LAYOUT_ORDER), F.col("part").cast("bigint"), sums, None, wide=True, rows=n)
    starts = starts.withColumn("seg_start", F.col("seg_end") - F.col("len"))
    first = starts.where(F.col("_place") <= few).drop("_place").join(asked, group)
    pieces = _overlap(first.where(F.col("seg_end") > F.col("seg_start")))
    if fullest > few:
        pieces = pieces.unionByName(resolve_ranges(starts.where(F.col("_place") > few).drop("_place"), requests, group, None))
    return pieces


def resolve_ranges(starts: DataFrame, requests: DataFrame, group="file_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pieces of each request: the segments it overlaps, where in them, and how many bytes.

    Requests: request_id, <group>, req_offset, req_len; segments of a file do not overlap. One sweep along each file's
    bytes counts the segments that begin at or before a position: that numbers the segments, and gives the first and
    the last segment of each request. Requests then meet exactly the numbers in between, so the join makes the pieces
    and no other rows. Files with very many segments or requests are swept in buckets (`ordered.py`) and joined by number.
    """
    segments = starts.where(F.col("seg_end") > F.col("seg_start"))
    own = [c for c in segments.columns if c not in (group, "seg_start")]
    asked = requests.where("req_len > 0")
    theirs = [c for c in asked.columns if c != group]
    none = lambda df, columns: F.lit(None).cast(df.select(F.struct(*columns).alias("s")).schema["s"].dataType)
    begins = segments.select(group, F.col("seg_start").alias("_at"), F.lit(1).cast("bigint").alias("_one"), F.struct("seg_start", *own).alias("_s"), none(asked, theirs).alias("_r"), F.lit(0).alias("_end"))
    end = _request_end()
    edges = F.inline(F.array(F.struct(F.greatest("req_offset", F.lit(0)).alias("_at"), F.lit(1).alias("_end")), F.struct(end.alias("_at"), F.lit(2).alias("_end"))))
    ends = asked.select(group, F.struct(*theirs).alias("_r"), edges)
    swept = begins.unionByName(ends.select(group, "_at", F.lit(0).cast("bigint").alias("_one"), none(segments, ["seg_start", *own]).alias("_s"), "_r", "_end"))
    # Segments come before requests at the same byte.
    swept = running_sums(swept, [group], ["_at", "_end"], F.col("_at"), {"_n": F.col("_one")}, hot_rows)
    numbered = swept.where("_end = 0").select(group, "_n", "_s.*")
    met = swept.where("_end > 0").groupBy(group, "_r").agg(
        F.greatest(F.min(F.when(F.col("_end") == 1, F.col("_n"))), F.lit(1)).alias("_low"), F.max(F.when(F.col("_end") == 2, F.col("_n"))).alias("_high"), F.count_if(F.col("_end") == 1).alias("_times")
    )
    # Equal requests were one group; each gets its pieces.
    met = met.where("_high >= _low").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")))
    pieces = met.select(group, "_r.*", F.explode(F.sequence("_low", "_high")).alias("_n")).join(numbered, [group, "_n"])
    # Only a request that begins in a gap, or beyond the last segment, has a first segment it does not touch.
    return _overlap(pieces).drop("_n")
