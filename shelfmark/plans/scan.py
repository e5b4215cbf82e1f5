"""Scan and revalidate: inventory against catalogue, written as new catalogue tables.

Besides the listing, an inventory may say how its files fared: `presence` (`present`, `absent`, or `unknown` after an
error) and `probe` (`ok`, `failed`, or `raced` for a file that changed while it was read). Such files are not ingested,
their tracks stay as they are, and the statistics get the columns `failed` and `raced`. Null means `present` and `ok`.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import values as V
from shelfmark.operators import catalog as C
from shelfmark.operators import children as CH
from shelfmark.operators import ingest as I
from shelfmark.operators.fingerprint import file_fingerprints
from shelfmark.operators.ordered import spread
from shelfmark.operators.sync import bump_versions, version_steps
from shelfmark.sources.shared import materialize

# Format of a file when no probe said otherwise.
EXTENSION_FORMAT = {"flac": "flac", "mp3": "mp3", "m4a": "m4a", "m4b": "m4a", "ogg": "vorbis", "oga": "vorbis", "opus": "opus", "wav": "wav"}


#: Columns of the written states that tell which tracks are gone.
GONE = ("gone_id", "gone_fingerprint", "gone_hash")


@dataclass
class Outcome:
    catalogue: dict
    actions: DataFrame
    stats: DataFrame
    rejects: DataFrame = None  # child rows of files that were not stored: path, table, pos, reason


def file_rows(files: DataFrame) -> DataFrame:
    """Inventory rows in the shape of a track; columns a probe would add default from the listing."""
    have = set(files.columns)
    pick = lambda c, default: F.col(c) if c in have else default
    ext = P.extension_of("path")
    guessed = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSION_FORMAT.items() for x in kv]), ext)
    return files.select(
        "path",
        F.coalesce(pick("format", F.lit(None).cast("string")), guessed).alias("format"),
        F.coalesce(pick("audio_offset", F.lit(None).cast("bigint")), F.lit(0)).cast("bigint").alias("audio_offset"),
        F.coalesce(pick("audio_length", F.lit(None).cast("bigint")), F.col("size")).cast("bigint").alias("audio_length"),
        F.col("size").alias("backing_size"),
        F.col("mtime_ns").alias("backing_mtime_ns"),
        pick("ctime_ns", F.col("mtime_ns")).alias("backing_ctime_ns"),
        pick("fingerprint", F.lit(None).cast("string")).alias("fingerprint"),
        pick("content_hash", F.lit(None).cast("string")).alias("content_hash"),
        *(["known_id"] if "known_id" in have else []),
    )


def _by_tier(rows: DataFrame, tier: str) -> DataFrame:
    none = F.lit(None).cast("string")
    if tier == "none":
        rows = rows.withColumn("fingerprint", none)
    return rows if tier == "full" else rows.withColumn("content_hash", none)


def read_result(files: DataFrame) -> Column:
    """How reading a file went: ok, failed, raced or absent."""
    have = set(files.columns)
    presence = F.coalesce("presence", F.lit("present")) if "presence" in have else F.lit("present")
    probe = F.col("probe") if "probe" in have else F.lit("ok")
    return F.when(presence == "absent", "absent").when(presence != "present", "failed").when(probe.isin("failed", "raced"), probe).otherwise("ok")


def _reports(files: DataFrame) -> bool:
    return bool({"presence", "probe"} & set(files.columns))


def scan_states(files: DataFrame, tracks: DataFrame, force: bool = False, identity=(), roots=()) -> DataFrame:
    """Inventory rows with `state` (todo, already_present, skipped, failed or raced) and `known_id`, the track at their path.
    Absent files fall out.

    The same join tells which tracks are gone (as `ingest.gone_tracks` does): their `gone_id`, `gone_fingerprint` and `gone_hash`
    stand on a row of state `gone`, or beside a file that is listed both as absent and as present.

    A known file is not read unless forced, so it cannot fail or race; an entry that could not be
    looked at fails whatever its name. Paths that name one physical file count once."""
    listed = files.withColumn("_read", read_result(files)).where("_read <> 'absent'")
    unseen = F.lit(False) if "presence" not in files.columns else F.coalesce(F.col("presence"), F.lit("present")) != "present"
    listed = listed.withColumn("_kind", F.when(unseen, "failed").when(~P.extension_of("path").isin(*I.EXTENSIONS), "skipped").otherwise("file"))
    if identity:
        # Further paths of a physical file are listed, but no files of their own.
        once = I.distinct_physical_files(listed.where("_kind = 'file'"), identity).unionByName(listed.where("_kind <> 'file'"))
        others = listed.join(once.select("path"), "path", "left_anti").withColumn("_kind", F.lit("other path"))
        listed = once.unionByName(others.select(*once.columns))
    known = tracks.select(
        F.col("backing_path").alias("path"), F.col("id").alias("known_id"), F.col("fingerprint").alias("_fingerprint"), F.col("content_hash").alias("_hash"), I.below("backing_path", roots).alias("_below")
    )
    named = F.lit(False)
    if "presence" in files.columns:
        absent = files.where("presence = 'absent'").select("path").distinct().withColumn("_named", F.lit(True))
        known, named = known.join(absent, "path", "left"), F.coalesce("_named", F.lit(False))
    gone = F.col("_fingerprint").isNotNull() & F.when(F.col("_below"), F.col("_kind").isNull()).otherwise(named)
    state = (
        F.when(F.col("_kind").isNull(), F.when(gone, "gone"))
        .when(F.col("_kind") == "other path", F.when(gone, "gone"))
        .when(F.col("_kind") != "file", F.col("_kind"))
        .when(F.col("known_id").isNotNull() & F.lit(not force), "already_present")
        .when(F.col("_read") != "ok", F.col("_read"))
        .otherwise("todo")
    )
    lost = [F.when(gone, F.col(c)).alias(n) for c, n in (("known_id", "gone_id"), ("_fingerprint", "gone_fingerprint"), ("_hash", "gone_hash"))]
    return listed.join(known, "path", "full").withColumn("state", state).where("state IS NOT NULL").select(*files.columns, "known_id", "state", *lost)


def scan(
    files: DataFrame, catalogue: dict, now: int, tier: str = "full", strictness: str = "auto", force: bool = False, identity=(), file_tags: DataFrame = None, roots=(),
    file_pictures: DataFrame = None, file_binary_tags: DataFrame = None, file_blocks: DataFrame = None, content_fingerprints: bool = False,
) -> Outcome:
    """Add what is new: unknown files are inserted, or taken over by the one missing
    track with their fingerprint; known files are only touched with `force`.

    roots: the folders that `files` lists in full. A track is missing if its path lies
    below one of them and is not listed, or is listed as absent; no other track moves.

    What was read from the files, by path and position; each replaces the rows of its
    kind on inserted and upserted tracks, and what is not given stays. A retargeted
    track keeps all its own. Rows that may not be stored are in `rejects`.
    file_tags: path, pos, key, value. file_binary_tags: path, pos, key, payload.
    file_pictures: path, pos, mime, width, height, picture_type, description, data.
    file_blocks: path, pos, kind, body.
    content_fingerprints: files that bring no fingerprint get one from these rows.
    """
    if tier not in I.TIERS:
        raise ValueError(f"tier is one of {I.TIERS}")
    tracks = catalogue["tracks"]
    # One join of the inventory with the catalogue, for what is known and what is gone; only files to read are written with their columns.
    states = scan_states(files, tracks, force, identity, roots)
    todo_only = lambda c: F.when(F.col("state") == "todo", F.col(c)).alias(c)
    states = materialize(states.select(*[todo_only(c) for c in (*files.columns, "known_id")], "state", *GONE), "scan-states")
    # A path that is listed twice may name its track twice.
    gone = states.where("gone_id IS NOT NULL").select(*[F.col(c).alias(n) for c, n in zip(GONE, ("id", "fingerprint", "content_hash"))]).dropDuplicates(["id"])
    rows = file_rows(states.where("state = 'todo'").drop("state", *GONE))
    if content_fingerprints and tier != "none":
        made = materialize(file_fingerprints(rows.where("fingerprint IS NULL"), file_tags, file_binary_tags, file_pictures, file_blocks), "scan-fingerprints")
        rows = rows.join(made.withColumnRenamed("fingerprint", "_made"), "path", "left").withColumn("fingerprint", F.coalesce("fingerprint", "_made")).drop("_made")
    # A full hash is still at hand for confirming a move when the tier does not store it.
    # The decisions feed tracks, child rows and statistics: work them out once.
    acts = materialize(I.match_moves(rows, tracks, files, strictness, roots, gone), "scan-actions")
    stored_sums = lambda df: df.withColumn("content_hash", F.when((F.col("action") == "retarget") | F.lit(tier == "full"), F.col("content_hash"))).withColumn(
        "fingerprint", F.col("fingerprint") if tier != "none" else F.lit(None).cast("string")
    )
    acts_stored = stored_sums(acts)
    given = {"tags": file_tags, "binary_tags": file_binary_tags, "pictures": file_pictures, "blocks": file_blocks}
    reads = any(df is not None for df in given.values())
    # Child rows need the ids of inserted tracks; those of all others stand in the actions.
    fresh = C.inserted_tracks(tracks, acts_stored, now)
    fresh = materialize(fresh, "scan-inserted") if reads else fresh
    new_tracks = C.changed_tracks(tracks, acts_stored, now).unionByName(fresh)
    out, rejects = {**catalogue, "tracks": new_tracks}, None
    if reads:
        ids = acts.where("action = 'upsert'").select("path", "track_id", F.lit(True).alias("known"))
        ids = ids.unionByName(fresh.select(F.col("backing_path").alias("path"), F.col("id").alias("track_id"), F.lit(False).alias("known")))
        out, steps, rejects = CH.replace_children({**catalogue, "tracks": new_tracks}, ids, **given)
        out["tracks"] = bump_versions(new_tracks, version_steps(*steps))
    return Outcome(out, acts, scan_stats(states, acts, _reports(files)), rejects)


def scan_stats(states: DataFrame, acts: DataFrame, reports: bool = False) -> DataFrame:
    """scanned, inserted, retargeted, updated, skipped, already_present, and with `reports` failed and raced:
    one aggregation over the two written columns `state` and `action`."""
    marks = states.select(F.col("state").alias("s")).unionByName(acts.select(F.col("action").alias("s")))
    n = lambda *names: F.count_if(F.col("s").isin(*names))
    return marks.agg(
        n("insert", "retarget", "upsert").alias("scanned"),
        n("insert").alias("inserted"),
        n("retarget").alias("retargeted"),
        n("upsert").alias("updated"),
        n("skipped").alias("skipped"),
        n("already_present").alias("already_present"),
        *([n("failed").alias("failed"), n("raced").alias("raced")] if reports else []),
    )


def known_states(files: DataFrame, tracks: DataFrame, blocks: DataFrame, tier: str = "none", root=None, prune: bool = False) -> DataFrame:
    """Inventory rows with `id` and `state`: changed, unchanged, failed or raced, and with `prune` a row with
    id and `pruned` for each track below the root without a file. One join by path; other files fall out."""
    if tier not in I.TIERS:
        raise ValueError(f"tier is one of {I.TIERS}")
    scoped = files if root is None else files.where(P.under_root("path", root))
    tracks = tracks if root is None else tracks.where(P.under_root("backing_path", root))
    listed = scoped.withColumn("_read", read_result(files)).where("_read <> 'absent'")
    unseen = F.lit(False) if "presence" not in files.columns else F.coalesce(F.col("presence"), F.lit("present")) != "present"
    listed = listed.withColumn("_kind", F.when(unseen, "failed").when(P.extension_of("path").isin(*I.EXTENSIONS), "file").otherwise("other"))
    have = blocks.select(F.col("track_id").alias("id")).distinct().withColumn("_blocks", F.lit(True))
    lacking = {
        "none": F.lit(False),
        "fingerprint": F.col("fingerprint").isNull(),
        "full": F.col("fingerprint").isNull() | F.col("content_hash").isNull(),
    }[tier]
    side = tracks.join(have, "id", "left").select(
        "id",
        F.col("backing_path").alias("path"),
        V.stamp("backing_size", "backing_mtime_ns", "backing_ctime_ns").alias("_stamp"),
        (lacking | ((F.col("format") == "flac") & F.col("_blocks").isNull())).alias("_lacks"),
    )
    # The narrow side is held as a hash table, in as many partitions as it needs; the wide rows of files are not sorted.
    n = tracks.count()
    j = spread(listed, n, "path").join(spread(side, n, "path").hint("shuffle_hash"), "path", "full" if prune else "left")
    same = V.stamp("size", "mtime_ns", "ctime_ns").eqNullSafe(F.col("_stamp")) & ~F.col("_lacks")
    state = (
        F.when(F.col("_kind").isNull(), "pruned")
        .when(F.col("_kind") == "failed", "failed")
        .when((F.col("_kind") == "other") | F.col("id").isNull(), None)
        .when(same, "unchanged")
        .when(F.col("_read") != "ok", F.col("_read"))
        .otherwise("changed")
    )
    return j.withColumn("state", state).where("state IS NOT NULL").select(*files.columns, "id", "state")


def revalidate(files: DataFrame, catalogue: dict, now: int, root=None, tier: str = "none", prune: bool = False, file_blocks: DataFrame = None) -> Outcome:
    """Refresh stamps, bounds and checksums of known files that changed, and with
    `file_blocks` (path, pos, kind, body) their structural rows; with `prune`, delete
    tracks below the root whose file is absent and the art nobody uses then. No track
    is added and tags and links of the remaining tracks stay."""
    if prune and root is None:
        raise ValueError("pruning needs the root that the files were listed from")
    tracks = catalogue["tracks"]
    # The decisions feed tracks, blocks, pruning and statistics: work them out once.
    states = materialize(known_states(files, tracks, catalogue["structural_blocks"], tier, root, prune), "known-states")
    changed = states.where("state = 'changed'")
    rows = _by_tier(file_rows(changed), tier)
    out, rejects = {**catalogue, "tracks": C.upsert_tracks(tracks, rows.withColumnRenamed("path", "backing_path"), now)}, None
    if file_blocks is not None:
        ids = changed.select("path", F.col("id").alias("track_id"), F.lit(True).alias("known"))
        out, steps, rejects = CH.replace_children(out, ids, blocks=file_blocks)
        out["tracks"] = bump_versions(out["tracks"], version_steps(*steps))
    if prune:
        out = C.cascade_delete(out, states.where("state = 'pruned'").select("id"))
        out["art"] = C.live_art(out["art"], out["track_art"])
    n = lambda name: F.count_if(F.col("state") == name)
    stats = states.agg(
        n("changed").alias("updated"),
        n("unchanged").alias("unchanged"),
        n("pruned").alias("pruned"),
        *([n("failed").alias("failed"), n("raced").alias("raced")] if _reports(files) else []),
    )
    return Outcome(out, states.where("state <> 'pruned'"), stats, rejects)


def check_catalogue(catalogue: dict) -> DataFrame:
    """check, object, n: broken rules per table, lost references, tracks over the row cap, table sizes."""
    from shelfmark.operators.rules import RULES, tracks_over_cap, violations

    found = []
    for table, rules in RULES.items():
        if table in catalogue:
            bad = catalogue[table].select(F.explode(violations(rules)).alias("rule"))
            found.append(bad.groupBy(F.concat(F.lit(f"{table}."), "rule").alias("object")).agg(F.count("*").alias("n")).select(F.lit("rule").alias("check"), "object", "n"))
    lost = C.dangling_references(catalogue).groupBy(F.concat("child", F.lit("->"), "parent").alias("object")).agg(F.count("*").alias("n"))
    found.append(lost.select(F.lit("reference").alias("check"), "object", "n"))
    for table in ("tags", "track_art"):
        if table in catalogue:
            over = tracks_over_cap(catalogue[table]).agg(F.count("*").alias("n")).where("n > 0")
            found.append(over.select(F.lit("row_cap").alias("check"), F.lit(table).alias("object"), "n"))
    for table, df in catalogue.items():
        found.append(df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("check"), F.lit(table).alias("object"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
