"""Catalogue reads, upserts, groupings and integrity checks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import ascii_lower
from shelfmark.operators.ordered import id_bucket, ranked, running_sums
from shelfmark.operators.rules import tracks_over_cap
from shelfmark.schemas import MAX_ROWS_PER_TRACK


class DuplicatePath(ValueError):
    """A backing path stands on more than one track."""


def by_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` is in a key list; repeated keys collapse."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")


def duplicate_paths(tracks: DataFrame) -> DataFrame:
    return (
        tracks.groupBy("backing_path")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        .where("n > 1")
    )


def require_unique_paths(tracks: DataFrame) -> None:
    row = duplicate_paths(tracks).select("backing_path", "first_id", "last_id").head()
    if row is not None:
        raise DuplicatePath(f"{row['backing_path']!r} stands on tracks {row['first_id']} and {row['last_id']}")


def text_tags(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("value_blob").isNull())


def binary_tags(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("value_blob").isNotNull())


def text_rows(tags: DataFrame) -> DataFrame:
    """Text tags of a table that may hold binary ones too."""
    return text_tags(tags) if "value_blob" in tags.columns else tags


def tags_for_keys(tags: DataFrame, keys) -> DataFrame:
    tags = text_rows(tags)
    return tags.where(ascii_lower("key").isin(*keys)) if keys else tags.where(F.lit(False))


def tracks_with_tag(tags: DataFrame, key: str, value) -> DataFrame:
    return text_tags(tags).where((F.col("key") == key) & (F.col("value") == value)).select("track_id")


def read_range(blobs: DataFrame, data="data", offset="offset", length="len") -> DataFrame:
    """Bytes of each requested range; a short read is an error row, never padded."""
    start, size = F.col(offset).cast("bigint"), F.col(length).cast("bigint")
    full = (start >= 0) & (size >= 0) & (start + size <= F.octet_length(data))
    # Inside `full` both numbers are below the blob's length and fit an int.
    piece = F.when(full, F.substring(F.col(data), F.when(full, start + 1).cast("int"), F.when(full, size).cast("int")))
    return blobs.withColumn("status", F.when(full, "ok").otherwise("short_read")).withColumn("bytes", piece)


def upsert_tracks(stored: DataFrame, new: DataFrame, now) -> DataFrame:
    """Upsert by path. A hit keeps id and checksums and takes format, bounds and stamp;
    a miss gets the next ids. `new` has the file columns and fingerprint/content_hash.
    The stored checksums are only replaced when the new row brings one."""
    taken = ("format", "audio_offset", "audio_length", "backing_size", "backing_mtime_ns", "backing_ctime_ns")
    n = new.select("backing_path", *[F.col(c).alias(f"n_{c}") for c in taken], F.col("fingerprint").alias("n_fp"), F.col("content_hash").alias("n_ch"))
    j = stored.join(n, "backing_path", "full")
    is_new, touched = F.col("id").isNull(), F.col("n_format").isNotNull()
    geometry = ("format", "audio_offset", "audio_length", "backing_size", "backing_mtime_ns")
    moved = ~F.struct(*[F.col(c) for c in geometry]).eqNullSafe(F.struct(*[F.col(f"n_{c}").alias(c) for c in geometry]))
    kept = j.where(~is_new).select(
        "id",
        "backing_path",
        *[F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c) for c in taken],
        (F.col("content_version") + F.when(touched & moved, 1).otherwise(0)).alias("content_version"),
        F.when(touched, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("n_fp", "fingerprint").alias("fingerprint"),
        F.coalesce("n_ch", "content_hash").alias("content_hash"),
    )
    fresh = j.where(is_new).select(
        "backing_path",
        *[F.col(f"n_{c}").alias(c) for c in taken],
        F.lit(0).cast("bigint").alias("content_version"),
        F.lit(now).cast("bigint").alias("updated_at"),
        F.col("n_fp").alias("fingerprint"),
        F.col("n_ch").alias("content_hash"),
    )
    return kept.unionByName(with_next_ids(fresh, stored, "backing_path").select(*kept.columns))


#: Ids of changed tracks that go to every task; above that, tracks are shuffled whole.
FEW_IDS = 4_000_000


def apply_actions(stored: DataFrame, acts: DataFrame, now) -> DataFrame:
    """Tracks after the written actions of a scan: `retarget` and `upsert` rows change the track of their `track_id`,
    `insert` rows get the next ids."""
    return changed_tracks(stored, acts, now).unionByName(inserted_tracks(stored, acts, now))


def changed_tracks(stored: DataFrame, acts: DataFrame, now) -> DataFrame:
    """The stored tracks after the `retarget` and `upsert` rows of a scan's actions, one join by id. If few tracks change, the others
    stay where they are: the numbers of the changed ones go to every task and only those tracks are shuffled."""
    changes = acts.where(F.col("track_id").isNotNull())
    few = changes.count() <= FEW_IDS
    rest, same = stored, None
    if few:
        ids = F.broadcast(changes.select(F.col("track_id").alias("id")).distinct())
        rest, same = stored.join(ids, "id", "left_semi"), stored.join(ids, "id", "left_anti")
    bounds = ("audio_offset", "audio_length", "backing_size", "backing_mtime_ns", "backing_ctime_ns")
    n = changes.select(F.col("track_id").alias("id"), "path", "action", *[F.col(c).alias(f"n_{c}") for c in ("format", *bounds, "fingerprint", "content_hash")])
    j = rest.join(n, "id", "left")
    hit, over = F.col("action").isNotNull(), F.coalesce(F.col("action") == "upsert", F.lit(False))
    # A moved track keeps its format, and its change time is no reason for a new version.
    was = ("audio_offset", "audio_length", "backing_size", "backing_mtime_ns")
    differs = lambda cs: ~F.struct(*[F.col(c) for c in cs]).eqNullSafe(F.struct(*[F.col(f"n_{c}").alias(c) for c in cs]))
    moved = F.lit(False)
    for c in was:
        moved = moved | F.coalesce(F.col(f"n_{c}") != F.col(c), F.lit(False))
    step = F.when(over & F.col("n_format").isNotNull() & differs(("format", *was)), 1).when(hit & ~over & moved, 1).otherwise(0)
    kept = j.select(
        "id",
        F.coalesce("path", "backing_path").alias("backing_path"),
        F.when(over, F.coalesce("n_format", "format")).otherwise(F.col("format")).alias("format"),
        *[F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c) for c in bounds],
        (F.col("content_version") + step).alias("content_version"),
        F.when(over & F.col("n_format").isNotNull() | hit & ~over, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("n_fingerprint", "fingerprint").alias("fingerprint"),
        F.coalesce("n_content_hash", "content_hash").alias("content_hash"),
    )
    if same is not None:
        kept = kept.unionByName(same.select(*kept.columns))
    return kept


def inserted_tracks(stored: DataFrame, acts: DataFrame, now) -> DataFrame:
    """The new tracks of a scan's `insert` actions, with the next ids."""
    bounds = ("audio_offset", "audio_length", "backing_size", "backing_mtime_ns", "backing_ctime_ns")
    fresh = acts.where("action = 'insert'").select(
        F.col("path").alias("backing_path"), "format", *bounds, F.lit(0).cast("bigint").alias("content_version"), F.lit(now).cast("bigint").alias("updated_at"), "fingerprint", "content_hash"
    )
    return with_next_ids(fresh, stored, "backing_path").select("id", "backing_path", "format", *bounds, "content_version", "updated_at", "fingerprint", "content_hash")


def with_next_ids(fresh: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Give `fresh` the ids after the largest stored one, in the hash order of a unique text column.

    Hash order cuts into even slices whatever the text looks like, so the numbering
    runs as 2**20 small windows plus one sum over the slice totals.
    """
    first = stored.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).scalar()
    hashed = fresh.withColumn("_hash", F.sha2(order, 256))
    slice_ = F.conv(F.left("_hash", F.lit(5)), 16, 10).cast("bigint")
    numbered = running_sums(hashed, [], ["_hash"], slice_, {"_n": F.lit(1).cast("bigint")})
    return numbered.withColumn("id", first + F.col("_n")).drop("_n", "_hash")


def retarget_tracks(stored: DataFrame, moves: DataFrame, now) -> DataFrame:
    """Move rows to new paths. `moves`: id, new_path, stamp and bounds, optional checksums.
    Id, format, tags and art stay; checksums change only when given."""
    bounds = ("audio_offset", "audio_length", "backing_size", "backing_mtime_ns", "backing_ctime_ns")
    m = moves.select("id", "new_path", *[F.col(c).alias(f"m_{c}") for c in bounds], F.col("fingerprint").alias("m_fp"), F.col("content_hash").alias("m_ch"))
    j = stored.join(m, "id", "left")
    hit = F.col("new_path").isNotNull()
    changed = hit & (
        (F.col("m_audio_offset") != F.col("audio_offset"))
        | (F.col("m_audio_length") != F.col("audio_length"))
        | (F.col("m_backing_size") != F.col("backing_size"))
        | (F.col("m_backing_mtime_ns") != F.col("backing_mtime_ns"))
    )
    return j.select(
        "id",
        F.coalesce("new_path", "backing_path").alias("backing_path"),
        "format",
        *[F.coalesce(F.col(f"m_{c}"), F.col(c)).alias(c) for c in bounds],
        (F.col("content_version") + F.when(changed, 1).otherwise(0)).alias("content_version"),
        F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("m_fp", "fingerprint").alias("fingerprint"),
        F.coalesce("m_ch", "content_hash").alias("content_hash"),
    )


def set_checksums(stored: DataFrame, sums: DataFrame) -> DataFrame:
    s = sums.select("id", F.col("fingerprint").alias("_fp"), F.col("content_hash").alias("_ch"))
    return stored.join(s, "id", "left").select(
        *[c for c in stored.columns if c not in ("fingerprint", "content_hash")],
        F.coalesce("_fp", "fingerprint").alias("fingerprint"),
        F.coalesce("_ch", "content_hash").alias("content_hash"),
    )


def grouped_tags(tags: DataFrame, cap: int = MAX_ROWS_PER_TRACK) -> DataFrame:
    """track_id, tags (ordered list), error. A track over the row cap has error `row_cap` and no list,
    so that every list is bounded and no track goes missing."""
    text = text_rows(tags)
    over = tracks_over_cap(text, cap).select("track_id")
    fit = text.join(over, "track_id", "left_anti")
    listed = fit.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("key", "ordinal", "value"))).alias("tags"))
    return _with_over_cap(listed, over, "tags")


def _with_over_cap(fit: DataFrame, over: DataFrame, column: str) -> DataFrame:
    good = fit.withColumn("error", F.lit(None).cast("string"))
    bad = over.withColumn(column, F.lit(None).cast(fit.schema[column].dataType)).withColumn("error", F.lit("row_cap"))
    return good.unionByName(bad)


def first_values(tags: DataFrame) -> DataFrame:
    """First text value of each ASCII-lowercase key: key order first, ordinal second."""
    return text_rows(tags).groupBy("track_id", ascii_lower("key").alias("field")).agg(
        F.min_by("value", F.struct("key", "ordinal")).alias("value")
    )


def field_columns(tags: DataFrame, fields) -> DataFrame:
    """One row per track with a column f_<i> per field: one aggregation, no pivot job."""
    name = ascii_lower("key")
    position = F.struct("key", "ordinal")
    return tags_for_keys(tags, fields).groupBy("track_id").agg(
        *[
            F.min_by(F.when(name == f, F.col("value")), F.when(name == f, position)).alias(f"f_{i}")
            for i, f in enumerate(fields)
        ]
    )


def field_map(tags: DataFrame, cap: int = MAX_ROWS_PER_TRACK) -> DataFrame:
    """track_id, fields (map of first values), error; a track over the row cap has error `row_cap` and no map."""
    text = text_rows(tags)
    over = tracks_over_cap(text, cap).select("track_id")
    first = first_values(text.join(over, "track_id", "left_anti"))
    maps = first.groupBy("track_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return _with_over_cap(maps, over, "fields")


def with_ordinals(rows: DataFrame, keys=("track_id", "key"), pos="pos", hot_rows=None) -> DataFrame:
    """0-based ordinal per group along an integer arrival position."""
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    return ranked(rows, keys, [pos], id_bucket(pos), "ordinal", **extra).withColumn("ordinal", F.col("ordinal") - 1)


def dedup_art(images: DataFrame, stored: DataFrame = None, pos="pos") -> DataFrame:
    """One row per content hash with the attributes of the first arrival; stored hashes are left out."""
    cols = [c for c in ("mime", "width", "height") if c in images.columns]
    hashed = images.withColumn("sha256", F.sha2("data", 256))
    if stored is not None:
        hashed = hashed.join(stored.select("sha256"), "sha256", "left_anti")
    first = hashed.groupBy("sha256").agg(
        F.min_by(F.struct(*cols), F.col(pos)).alias("a"),
        F.first(F.octet_length("data")).cast("bigint").alias("byte_len"),
        F.first("data").alias("data"),
    )
    return first.select("sha256", *[F.col(f"a.{c}").alias(c) for c in cols], "byte_len", "data")


def links_with_metadata(links: DataFrame, art: DataFrame, key="art_id", art_key="id") -> DataFrame:
    """Every link with its blob's metadata, null when the blob is gone; payload bytes are not read."""
    meta = art.drop("data").withColumnRenamed(art_key, "_art_key")
    return links.join(meta, F.col(key) == F.col("_art_key"), "left").drop("_art_key")


def orphan_links(links: DataFrame, art: DataFrame, key="art_id", art_key="id") -> DataFrame:
    return links.join(art.select(F.col(art_key).alias(key)), key, "left_anti")


def orphan_art(art: DataFrame, links: DataFrame, key="art_id", art_key="id") -> DataFrame:
    used = links.select(F.col(key).alias(art_key)).distinct()
    return art.join(used, art_key, "left_anti")


def live_art(art: DataFrame, links: DataFrame, key="art_id", art_key="id") -> DataFrame:
    return art.join(links.select(F.col(key).alias(art_key)).distinct(), art_key, "left_semi")


def cascade_delete(catalogue: dict, deleted: DataFrame) -> dict:
    """Catalogue without the tracks in `deleted` (column id) and their child rows."""
    gone = deleted.select(F.col("id")).distinct()
    child = gone.withColumnRenamed("id", "track_id")
    out = dict(catalogue)
    for name, df in catalogue.items():
        if name == "tracks":
            out[name] = df.join(gone, "id", "left_anti")
        elif name in ("tags", "track_art", "structural_blocks"):
            out[name] = df.join(child, "track_id", "left_anti")
    return out


def dangling_references(catalogue: dict, art_key="id", link_key="art_id") -> DataFrame:
    """(child table, child row, missing parent) over all foreign keys.

    Child rows stream past the hashed ids of tracks and are not sorted: a task holds one partition of the ids,
    each of them once, however many rows a track has."""
    edges = [(t, "track_id", "tracks", "id") for t in ("tags", "track_art", "structural_blocks") if t in catalogue]
    if "track_art" in catalogue and "art" in catalogue:
        edges.append(("track_art", link_key, "art", art_key))
    found = []
    for child, fk, parent, pk in edges:
        ids = catalogue[parent].select(F.col(pk).alias(fk))
        lost = catalogue[child].join(ids.hint("shuffle_hash") if parent == "tracks" else ids, fk, "left_anti")
        found.append(
            lost.select(
                F.lit(child).alias("child"),
                F.col("track_id").cast("bigint").alias("track_id"),
                F.lit(parent).alias("parent"),
                F.col(fk).cast("string").alias("missing"),
            )
        )
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def object_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Schema objects (type, name, definition) that are missing, unexpected or altered."""
    e = expected.select("type", "name", F.col("definition").alias("_e"))
    f = found.select("type", "name", F.col("definition").alias("_f"))
    state = (
        F.when(F.col("_f").isNull(), "missing")
        .when(F.col("_e").isNull(), "unexpected")
        .when(F.col("_e") != F.col("_f"), "altered")
    )
    return e.join(f, ["type", "name"], "full").select("type", "name", state.alias("state")).where("state is not null")


def payload_weight(art_links: DataFrame, binary: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bytes of pictures, binary tags and structural blocks per track."""
    parts = [d.select("track_id", F.col(c).cast("bigint").alias("n")) for d, c in ((art_links, "byte_len"), (binary, "byte_len"), (blocks, "byte_len"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("track_id").agg(F.sum("n").alias("weight"))
