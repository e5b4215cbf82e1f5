"""File inventory against catalogue: what is new, changed, missing or moved."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions.values import stamp
from shelfmark.schemas import EXTENSIONS

TIERS = ("none", "fingerprint", "full")
STRICTNESS = ("fast", "auto", "strict")


def supported_files(files: DataFrame) -> DataFrame:
    return files.where(P.extension_of("path").isin(*EXTENSIONS))


def distinct_physical_files(files: DataFrame, identity) -> DataFrame:
    """One path per (device, inode): the smallest. Files without identity are all kept."""
    ident = [F.col(c) for c in identity]
    known = ident[0].isNotNull()
    for c in ident[1:]:
        known = known & c.isNotNull()
    rest = [c for c in files.columns if c not in identity]
    kept = (
        files.where(known)
        .groupBy(*identity)
        .agg(F.min_by(F.struct(*rest), F.col("path")).alias("r"))
        .select(*[F.col(c) if c in identity else F.col(f"r.{c}").alias(c) for c in files.columns])
    )
    return kept.unionByName(files.where(~known))


def skip_tally(files: DataFrame) -> DataFrame:
    """Count of unsupported files per lowercase extension."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    bucket = F.when(P.has_extension(name), P.extension_of("path")).otherwise("<none>")
    return files.where(~P.extension_of("path").isin(*EXTENSIONS)).groupBy(bucket.alias("ext")).agg(F.count("*").alias("n"))


def skip_summary(tally: DataFrame) -> DataFrame:
    """One line, most frequent first; no row when nothing was skipped. One entry per distinct extension."""
    entries = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "ext")))
    return (
        tally.agg(F.sum("n").alias("total"), entries.alias("e"))
        .where("total > 0")
        .select(
            F.concat(
                F.lit("skipped "),
                F.col("total").cast("string"),
                F.lit(": "),
                F.array_join(F.transform("e", lambda x: F.concat(x["ext"], F.lit("="), (-x["neg"]).cast("string"))), ", "),
            ).alias("summary")
        )
    )


def unknown_files(files: DataFrame, tracks: DataFrame) -> DataFrame:
    return files.join(tracks.select(F.col("backing_path").alias("path")), "path", "left_anti")


def needs_backfill(tracks: DataFrame, blocks: DataFrame) -> DataFrame:
    """flac tracks without any structural row."""
    have = blocks.select(F.col("track_id").alias("id")).distinct()
    return tracks.where(F.col("format") == "flac").join(have, "id", "left_anti")


def classify_known(files: DataFrame, tracks: DataFrame, blocks: DataFrame, tier: str = "none") -> DataFrame:
    """Known files as `unchanged` or `changed`; files without a track are left out."""
    if tier not in TIERS:
        raise ValueError(f"tier is one of {TIERS}")
    backfill = needs_backfill(tracks, blocks).select("id", F.lit(True).alias("backfill"))
    t = tracks.select(
        F.col("id"),
        F.col("backing_path").alias("path"),
        stamp("backing_size", "backing_mtime_ns", "backing_ctime_ns").alias("known_stamp"),
        F.col("fingerprint").isNotNull().alias("has_fp"),
        F.col("content_hash").isNotNull().alias("has_hash"),
    ).join(backfill, "id", "left")
    lacking = {
        "none": F.lit(False),
        "fingerprint": ~F.col("has_fp"),
        "full": ~F.col("has_fp") | ~F.col("has_hash"),
    }[tier]
    same = stamp("size", "mtime_ns", "ctime_ns").eqNullSafe(F.col("known_stamp"))
    calm = same & F.col("backfill").isNull() & ~lacking
    return files.join(t, "path").withColumn("state", F.when(calm, "unchanged").otherwise("changed")).drop(
        "known_stamp", "has_fp", "has_hash", "backfill"
    )


def missing_tracks(tracks: DataFrame, inventory: DataFrame, root=None) -> DataFrame:
    """Tracks whose file is absent, below `root` (one or several) if given. A path listed with any
    presence but `absent` (`present`, or `unknown` after an error) does not count as missing."""
    seen = inventory
    if "presence" in inventory.columns:
        seen = inventory.where(F.coalesce(F.col("presence"), F.lit("present")) != "absent")
    scoped = tracks if root is None else tracks.where(below("backing_path", [root] if isinstance(root, str) else root))
    return scoped.join(seen.select(F.col("path").alias("backing_path")), "backing_path", "left_anti")


def below(path: str, roots) -> Column:
    """Whether a path lies below one of the roots."""
    out = F.lit(False)
    for root in roots:
        out = out | P.under_root(path, root)
    return out


def gone_tracks(tracks: DataFrame, inventory: DataFrame, roots=()) -> DataFrame:
    """Tracks whose own file is known to be gone: not found below a root that was listed in full,
    or listed as `absent`. What lies elsewhere was not looked for and counts as live."""
    gone = missing_tracks(tracks, inventory, list(roots))
    if "presence" not in inventory.columns:
        return gone
    absent = inventory.where(F.col("presence") == "absent").select(F.col("path").alias("backing_path")).distinct()
    named = tracks.where(~below("backing_path", roots)).join(absent, "backing_path", "left_semi")
    return gone.unionByName(named.select(*gone.columns))


def match_moves(new_files: DataFrame, tracks: DataFrame, inventory: DataFrame, strictness: str = "auto", roots=(), gone: DataFrame = None) -> DataFrame:
    """Action per file: `upsert` for a known path, `retarget` to a missing track with
    the same fingerprint, else `insert`. `roots` are the folders that the inventory lists in full.
    Files that bring a column `known_id` (the track at their path, or null) are not looked up again: those with a track
    are upserts, for which no candidates are looked for or counted. `gone` (id, fingerprint, content_hash), the tracks that
    are known to be gone and have a fingerprint, spares looking for them.

    Candidates are counted with a combining aggregation, not a window, so one
    fingerprint shared by a third of the rows costs nothing extra; the join sees
    one row per fingerprint on the candidate side. Checksums travel once, to that join.
    """
    if strictness not in STRICTNESS:
        raise ValueError(f"strictness is one of {STRICTNESS}")
    known = None
    if "known_id" in new_files.columns:
        known, new_files = new_files.where("known_id IS NOT NULL"), new_files.where("known_id IS NULL")
    gone = gone if gone is not None else gone_tracks(tracks.where(F.col("fingerprint").isNotNull()), inventory, roots)
    alone = (
        gone.groupBy("fingerprint")
        .agg(F.count("*").alias("candidates"), F.min("id").alias("cand_id"), F.min("content_hash").alias("cand_hash"))
    )
    # Files without a fingerprint match nothing; their own path spreads them over the join.
    wanted = F.coalesce(F.col("fingerprint"), F.concat(F.lit("none:"), F.col("path")))
    alone = alone.withColumnRenamed("fingerprint", "_wanted")
    agrees = F.coalesce(F.col("content_hash") == F.col("cand_hash"), F.lit(False))
    confirmed = {
        "fast": F.lit(True),
        "auto": F.col("cand_hash").isNull() | agrees,
        "strict": agrees,
    }[strictness]
    single = (F.coalesce(F.col("candidates"), F.lit(0)) == 1) & F.coalesce(confirmed, F.lit(False))
    j = new_files.withColumn("_wanted", wanted).join(alone, "_wanted", "left").withColumn("_single", single).drop("_wanted", "cand_hash")
    if "known_id" not in new_files.columns:
        j = j.join(tracks.select(F.col("backing_path").alias("path"), F.col("id").alias("known_id")), "path", "left")
    claims = j.withColumn("claims", F.col("known_id").isNull() & F.col("_single"))
    # One track can move once: the smallest path wins, the others are inserted. All that claim nothing are one more group
    # without a path: a filter instead would be pushed below the joins and have them done twice.
    winners = claims.groupBy(F.when(F.col("claims"), F.col("cand_id"))).agg(F.min(F.when(F.col("claims"), F.col("path"))).alias("path")).select("path", F.lit(True).alias("wins"))
    action = F.when(F.col("known_id").isNotNull(), "upsert").when(F.col("claims") & F.col("wins"), "retarget").otherwise("insert")
    out = claims.join(winners, "path", "left").withColumn("action", action)
    track = F.when(F.col("action") == "upsert", F.col("known_id")).when(F.col("action") == "retarget", F.col("cand_id"))
    theirs = [c for c in new_files.columns if c != "known_id"]
    out = out.select(*theirs, "action", track.alias("track_id"), F.coalesce(F.col("candidates"), F.lit(0)).alias("candidates"))
    if known is None:
        return out
    return out.unionByName(known.select(*theirs, F.lit("upsert").alias("action"), F.col("known_id").alias("track_id"), F.lit(0).cast("bigint").alias("candidates")))


def accepted_tags(pairs: DataFrame) -> DataFrame:
    """Scanned (track_id, pos, key, value) rows: bad keys go before ordinals are given."""
    from shelfmark.operators.catalog import with_ordinals
    from shelfmark.operators.rules import key_floor

    return with_ordinals(pairs.where(key_floor()))


def fill_absent_keys(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Fallback pairs only for keys the primary has no value of, ignoring ASCII case."""
    have = primary.select("track_id", P.ascii_lower("key").alias("_k")).distinct()
    extra = fallback.withColumn("_k", P.ascii_lower("key")).join(have, ["track_id", "_k"], "left_anti").drop("_k")
    return primary.withColumn("source", F.lit(0)).unionByName(extra.withColumn("source", F.lit(1)))
