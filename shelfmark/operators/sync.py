"""External records written into the catalogue, with quarantine of bad records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import ascii_lower
from shelfmark.operators.catalog import text_tags, tracks_with_tag, with_next_ids, with_ordinals
from shelfmark.operators.ingest import missing_tracks
from shelfmark.operators.ordered import spread
from shelfmark.operators.rules import LINK_RULES, TAG_RULES, violations
from shelfmark.sources.shared import materialize
from shelfmark.schemas import MAX_BLOB_BYTES, MAX_MIME_CHARS

MODES = ("replace", "merge")
#: Rows of the narrow side of a join that go to every task; above that, both sides are shuffled.
FEW_ROWS = 500_000


def _meet(rows: DataFrame, narrow: DataFrame, n: int, on, how: str) -> DataFrame:
    """rows joined with a narrow side of at most n rows, which is held as a hash table: whole by every task if it is small,
    else in as many partitions as it needs. The rows themselves, many and wide, stream past it and are not sorted."""
    if n <= FEW_ROWS:
        return rows.join(F.broadcast(narrow), on, how)
    return spread(rows, n, *on).join(spread(narrow, n, *on).hint("shuffle_hash"), on, how)


def match_records(keys: DataFrame, tracks: DataFrame) -> DataFrame:
    """record_key with track_id, status `matched` or `skipped`."""
    t = tracks.select(F.col("backing_path").alias("record_key"), F.col("id").alias("track_id"))
    return keys.select("record_key").distinct().join(t, "record_key", "left").withColumn(
        "status", F.when(F.col("track_id").isNull(), "skipped").otherwise("matched")
    )


def kept_tags(tags: DataFrame, matched: DataFrame, pairs: DataFrame, deletes: DataFrame, mode: str) -> DataFrame:
    """Stored tag rows that a sync leaves in place; binary rows always stay."""
    named = pairs.select("record_key", "key").unionByName(deletes.select("record_key", "key"))
    named = named.join(matched.select("record_key", "track_id"), "record_key")
    ids = matched if mode == "replace" else named
    text = _replaceable(tags, mode).join(_replaced(ids, mode), _replace_on(mode), "left_anti")
    return text.select(*tags.columns).unionByName(tags.where(F.col("value_blob").isNotNull()))


def _replace_on(mode: str) -> list[str]:
    return ["track_id"] if mode == "replace" else ["track_id", "_k"]


def _replaceable(tags: DataFrame, mode: str) -> DataFrame:
    """Stored text rows, in mode `merge` with the key that names are compared by."""
    text = text_tags(tags)
    return text if mode == "replace" else text.withColumn("_k", ascii_lower("key"))


def _replaced(named: DataFrame, mode: str) -> DataFrame:
    """What a sync replaces: tracks, or keys of tracks (`named` then has track_id and key)."""
    return (named.select("track_id") if mode == "replace" else named.select("track_id", ascii_lower("key").alias("_k"))).distinct()


def _problems(rows: DataFrame, rules: dict) -> DataFrame:
    """rows with `problems`, the names of broken rules, null if there are none."""
    found = violations(rules)
    return rows.withColumn("problems", F.when(F.size(found) > 0, found))


def sync_records(catalogue: dict, pairs: DataFrame, art: DataFrame = None, deletes: DataFrame = None, records: DataFrame = None, mode: str = "replace", dry_run: bool = False):
    """Write records into tags, art and links.

    pairs: record_key, pos, key, value. art: record_key, pos, data, mime, picture_type,
    description. deletes: record_key, key. records: all record keys (defaults to those
    with pairs, art or deletes). One bad row rejects its whole record.
    Returns (catalogue, stats, problems, new_versions).

    Incoming rows meet their tracks once and are written with track ids, pictures by their digests. All results are
    derived from that when they are read, so none pays for another; bytes are read again only for the new pictures of `art`.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    spark = pairs.sparkSession
    art = art if art is not None else spark.createDataFrame([], "record_key string, pos bigint, data binary, mime string, picture_type int, description string")
    deletes = deletes if deletes is not None else spark.createDataFrame([], "record_key string, key string")
    if records is None:
        records = pairs.select("record_key").unionByName(art.select("record_key")).unionByName(deletes.select("record_key")).distinct()
    tags, links, blobs = catalogue["tags"], catalogue["track_art"], catalogue["art"]

    matched = materialize(match_records(records, catalogue["tracks"]), "sync-matches")
    n = matched.count()
    hits = matched.where("status = 'matched'").select("record_key", "track_id")
    at_tracks = lambda rows: _meet(rows, hits, n, ["record_key"], "inner").drop("record_key")

    size = F.octet_length("data")
    fits = F.col("byte_len") <= MAX_BLOB_BYTES
    digested = art.select(
        "record_key", "pos", F.when(size <= MAX_BLOB_BYTES, F.sha2("data", 256)).alias("sha256"), size.cast("bigint").alias("byte_len"), "mime", "picture_type", "description"
    )
    pictures = at_tracks(digested)
    if dry_run:
        nothing = spark.createDataFrame([], "record_key string, track_id bigint, problem string")
        return catalogue, _sync_stats(matched, pictures, nothing), nothing.select("record_key", "problem"), None
    rules = {rule: ok for rule, ok in LINK_RULES.items() if rule != "ordinal"} | {"mime": lambda: F.length("mime") <= MAX_MIME_CHARS}
    pictures = materialize(_problems(pictures, rules), "sync-pictures")
    checked = at_tracks(pairs.select("record_key", "pos", "key", "value")).withColumns({"ordinal": F.lit(0), "value_blob": F.lit(None).cast("binary")})
    given = materialize(_problems(checked, TAG_RULES).drop("ordinal", "value_blob"), "sync-pairs")

    broken = given.select("track_id", F.explode("problems").alias("problem")).unionByName(pictures.where(fits).select("track_id", F.explode("problems").alias("problem")))
    faults = materialize(hits.join(broken.distinct(), "track_id"), "sync-problems")
    bad, n_bad = faults.select("track_id").distinct(), faults.count()
    of_good = lambda rows: _meet(rows, bad, n_bad, ["track_id"], "left_anti")
    stats = _sync_stats(matched, pictures, faults)

    added, good_art = of_good(given), of_good(pictures.where(fits))
    if mode == "replace":
        named, n_named = hits, n
    else:
        doomed = materialize(at_tracks(deletes.select("record_key", "key")), "sync-deletes")
        named, n_named = given.select("track_id", "key").unionByName(doomed), given.count() + doomed.count()
    meet_tags = lambda how: _meet(_replaceable(tags, mode), _replaced(of_good(named), mode), n_named, _replace_on(mode), how)
    kept = meet_tags("left_anti").select(*tags.columns).unionByName(tags.where(F.col("value_blob").isNotNull()))
    new_tags = with_ordinals(added.select("track_id", "pos", "key", "value")).withColumn("value_blob", F.lit(None).cast("binary"))

    first = good_art.join(blobs.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(
        F.min_by("mime", F.struct("track_id", "pos")).alias("mime"), F.first("byte_len").alias("byte_len")
    )
    first = materialize(first.select("sha256", "mime", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), "byte_len"), "sync-art")
    fresh = with_next_ids(first, blobs, "sha256")
    small = art.where(size <= MAX_BLOB_BYTES).select(F.sha2("data", 256).alias("sha256"), "data")
    bytes_ = small.join(first.select("sha256"), "sha256", "left_semi").groupBy("sha256").agg(F.first("data").alias("data"))
    ids = blobs.select(F.col("id").alias("art_id"), "sha256").unionByName(fresh.select(F.col("id").alias("art_id"), "sha256"))
    linked = with_ordinals(good_art.select("track_id", "pos", "sha256", F.col("picture_type").cast("int").alias("picture_type"), "description"), ("track_id",))
    relinked, n_pictures = good_art.select("track_id").distinct(), pictures.count()
    meet_links = lambda how: _meet(links, relinked, n_pictures, ["track_id"], how)

    out = {
        **catalogue,
        "tags": kept.unionByName(new_tags.select(*tags.columns)),
        "art": blobs.unionByName(fresh.join(bytes_, "sha256").select(*blobs.columns)),
        "track_art": meet_links("left_anti").select(*links.columns).unionByName(linked.join(ids, "sha256").select(*links.columns)),
    }
    bumps = version_steps((meet_tags("left_semi"), 1), (added, 1), (meet_links("left_semi"), 1), (good_art, 1))
    out["tracks"] = bump_versions(catalogue["tracks"], bumps)
    return out, stats, faults.select("record_key", "problem").distinct(), bumps


def _sync_stats(matched: DataFrame, pictures: DataFrame, faults: DataFrame) -> DataFrame:
    """One row of counts. Skipped records have no track to be joined by and are laid beside the others."""
    n_bytes = F.col("byte_len")
    per_track = pictures.groupBy("track_id").agg(F.count_if(n_bytes <= MAX_BLOB_BYTES).alias("fit"), F.count_if(n_bytes > MAX_BLOB_BYTES).alias("over"))
    flags = matched.where("status = 'matched'").select("track_id", "status").join(per_track, "track_id", "left").join(
        faults.select("track_id").distinct().withColumn("bad", F.lit(True)), "track_id", "left"
    )
    flags = flags.unionByName(matched.where("status <> 'matched'").select("status"), allowMissingColumns=True)
    hit, bad = F.col("status") == "matched", F.coalesce(F.col("bad"), F.lit(False))
    return flags.agg(
        F.count_if(hit & ~bad).alias("synced"),
        F.count_if(~hit).alias("skipped"),
        F.count_if(hit & ~bad & (F.col("fit") > 0)).alias("art_linked"),
        F.coalesce(F.sum(F.when(hit, F.col("over"))), F.lit(0)).cast("bigint").alias("skipped_art"),
        F.count_if(hit & bad).alias("skipped_invalid"),
    )


def version_steps(*parts) -> DataFrame:
    """Version steps per track from (rows, weight) parts: every row removed or added
    is one step, so a replaced row counts twice even when its value stays."""
    rows = [df.select("track_id", F.lit(w).alias("w")) for df, w in parts]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("track_id").agg(F.sum("w").alias("steps")).where("steps > 0")


def bump_versions(tracks: DataFrame, bumps: DataFrame) -> DataFrame:
    b = bumps.select(F.col("track_id").alias("id"), "steps")
    return tracks.join(b, "id", "left").withColumn("content_version", F.col("content_version") + F.coalesce("steps", F.lit(0))).select(*tracks.columns)


def owned_tracks(tags: DataFrame, key: str, value, owner_key: str, owner_value: str = "1") -> DataFrame:
    """Tracks with an id tag that also carry the ownership marker."""
    owned = tracks_with_tag(tags, owner_key, owner_value)
    return tracks_with_tag(tags, key, value).join(owned, "track_id", "left_semi").distinct()


def owned_by_events(tags: DataFrame, events: DataFrame, owner_key: str, owner_value: str = "1") -> DataFrame:
    """Tracks to delete for many delete events at once. events: key, value."""
    named = text_tags(tags).join(events.select("key", "value").distinct(), ["key", "value"], "left_semi").select("track_id").distinct()
    return named.join(tracks_with_tag(tags, owner_key, owner_value), "track_id", "left_semi")


def rename_prune(tracks: DataFrame, previous_paths: DataFrame, inventory: DataFrame, symlinked: bool = False) -> DataFrame:
    """Tracks at the old paths of a rename whose file is gone; none when links are symbolic."""
    if symlinked:
        return tracks.where(F.lit(False)).select("id", "backing_path")
    old = previous_paths.select(F.col(previous_paths.columns[0]).alias("backing_path")).distinct()
    return missing_tracks(tracks.join(old, "backing_path", "left_semi"), inventory).select("id", "backing_path")
