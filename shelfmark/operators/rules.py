"""Quality rules: named boolean columns, collected as violations per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import values as V
from shelfmark.schemas import (
    BLOCK_KINDS,
    FORMATS,
    MAX_BLOB_BYTES,
    MAX_BLOCK_BYTES,
    MAX_DESCRIPTION_CHARS,
    MAX_KEY_CHARS,
    MAX_MIME_CHARS,
    MAX_PICTURE_TYPE,
    MAX_ROWS_PER_TRACK,
    MAX_VALUE_BYTES,
)

CONTROL = r"[\x00-\x1f]"
FIELD_GRAMMAR = r"^[\x20-\x3C\x3E-\x7D]+\z"


def key_floor(key="key") -> Column:
    return (F.length(P.col(key)) > 0) & ~P.col(key).rlike(CONTROL)


def field_name_ok(key="key") -> Column:
    return P.col(key).rlike(FIELD_GRAMMAR)


_COUNTS = ("audio_offset", "audio_length", "backing_size", "backing_mtime_ns", "backing_ctime_ns")

# Rules are callables, as columns need a running session.
TRACK_RULES = {
    "format": lambda: F.col("format").isin(*FORMATS),
    "non_negative": lambda: F.least(*[F.col(c) for c in _COUNTS]) >= 0,
    "version": lambda: (F.col("content_version") >= 0) & (F.col("updated_at") >= 0),
    "bounds": lambda: V.bounds_ok("audio_offset", "audio_length", "backing_size"),
}

TAG_RULES = {
    "ordinal": lambda: F.col("ordinal") >= 0,
    "blob_value": lambda: F.col("value_blob").isNull() | (F.col("value") == ""),
    "key_length": lambda: F.length("key").between(1, MAX_KEY_CHARS),
    "key_control": lambda: ~F.col("key").rlike(CONTROL),
    "value_bytes": lambda: F.octet_length("value") <= MAX_VALUE_BYTES,
    "blob_bytes": lambda: F.col("value_blob").isNull() | (F.octet_length("value_blob") <= MAX_BLOB_BYTES),
}

ART_RULES = {
    "byte_len": lambda: F.col("byte_len") == F.octet_length("data"),
    "sha_length": lambda: F.length("sha256") == 64,
    "dimensions": lambda: F.coalesce(F.col("width") >= 0, F.lit(True)) & F.coalesce(F.col("height") >= 0, F.lit(True)),
    "mime": lambda: F.length("mime") <= MAX_MIME_CHARS,
    "cap": lambda: F.col("byte_len") <= MAX_BLOB_BYTES,
    "sha_content": lambda: F.sha2("data", 256) == F.col("sha256"),
}

LINK_RULES = {
    "picture_type": lambda: F.col("picture_type").between(0, MAX_PICTURE_TYPE),
    "ordinal": lambda: F.col("ordinal") >= 0,
    "description": lambda: F.length("description") <= MAX_DESCRIPTION_CHARS,
}

BLOCK_RULES = {
    "kind": lambda: F.col("kind").isin(*BLOCK_KINDS),
    "ordinal": lambda: F.col("ordinal") >= 0,
    "body": lambda: F.octet_length("body") <= MAX_BLOCK_BYTES,
}

RULES = {
    "tracks": TRACK_RULES,
    "tags": TAG_RULES,
    "art": ART_RULES,
    "track_art": LINK_RULES,
    "structural_blocks": BLOCK_RULES,
}


def violations(rules: dict) -> Column:
    """Names of the broken rules; a rule that gives null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok(), F.lit(False)), F.lit(n)) for n, ok in rules.items()]))


def with_violations(df: DataFrame, table: str, only=None) -> DataFrame:
    rules = {n: c for n, c in RULES[table].items() if only is None or n in only}
    return df.withColumn("violations", violations(rules))


def split_rows(df: DataFrame, table: str):
    """(good rows, rejected rows with `violations`)."""
    checked = with_violations(df, table)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def tracks_over_cap(rows: DataFrame, cap: int = MAX_ROWS_PER_TRACK) -> DataFrame:
    """Tracks with more rows than a track may have. Text and binary tags are two sets with a cap each;
    n_rows is the size of the larger one.

    Rows go to their track first: counted before, a task would hold all tracks of its part of a table, and hardly any twice."""
    rows = rows.select("track_id", *[F.when(F.col(c).isNotNull(), True).alias(c) for c in ("value_blob",) if c in rows.columns]).repartition("track_id")
    if "value_blob" not in rows.columns:
        counted = rows.groupBy("track_id").agg(F.count("*").alias("n_rows"))
    else:
        n = F.greatest(F.count_if(F.col("value_blob").isNull()), F.count("value_blob"))
        counted = rows.groupBy("track_id").agg(n.alias("n_rows"))
    return counted.where(F.col("n_rows") > cap)


def invalid_field_names(tags: DataFrame) -> DataFrame:
    return tags.where(~field_name_ok()).select("track_id", "key").distinct()


def drop_oversize(rows: DataFrame, data="data") -> DataFrame:
    return rows.where(F.octet_length(data) <= MAX_BLOB_BYTES)


def drop_zero_values(rows: DataFrame, zero_keys, key="key", value="value") -> DataFrame:
    return rows.where(~(F.col(key).isin(*zero_keys) & V.is_zero_text(value)))


def serve_status(links: DataFrame) -> DataFrame:
    """Status of each link with blob metadata, in the order the checks are made."""
    return links.withColumn(
        "status",
        F.when(F.col("byte_len").isNull(), "orphan")
        .when(F.col("byte_len") == 0, "empty")
        .when(F.col("byte_len") > MAX_BLOB_BYTES, "too_large")
        .when(~F.col("picture_type").between(0, MAX_PICTURE_TYPE), "invalid_picture_type")
        .otherwise("ok"),
    )
