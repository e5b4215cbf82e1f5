"""Child rows of tracks as files bring them: text tags, binary tags, pictures and structural blocks.

Rows come by path and position. Those that may not be stored become reject rows (path, table, pos, reason) before
ordinals are given, so ordinals have no gaps. Empty binary tags go without a reject: they carry nothing.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values as V
from shelfmark.operators.catalog import binary_tags as stored_binary
from shelfmark.operators.catalog import text_tags, with_next_ids, with_ordinals
from shelfmark.operators.ordered import any_hot, id_bucket, ranked, running_sums
from shelfmark.operators.rules import BLOCK_RULES, LINK_RULES, TAG_RULES, key_floor, violations
from shelfmark.schemas import MAX_BLOB_BYTES, MAX_MIME_CHARS
from shelfmark.sources.shared import materialize

# Rules of a row before it has an ordinal; the size comes from the listing of bytes, not from their digest.
PICTURE_RULES = {n: c for n, c in LINK_RULES.items() if n != "ordinal"} | {
    "oversize": lambda: F.col("byte_len") <= MAX_BLOB_BYTES,
    "mime": lambda: F.length("mime") <= MAX_MIME_CHARS,
}
PAYLOAD_RULES = {"oversize": lambda: F.octet_length("payload") <= MAX_BLOB_BYTES, "key_length": TAG_RULES["key_length"], "key_control": TAG_RULES["key_control"]}
#: Contents of pictures whose ids (some 100 bytes each) go to every task.
FEW_CONTENTS = 500_000
FILE_BLOCK_RULES = {n: c for n, c in BLOCK_RULES.items() if n != "ordinal"}


def _checked(rows: DataFrame, rules: dict) -> DataFrame:
    return rows.withColumn("violations", violations(rules))


def _good(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("violations") == 0).drop("violations")


def _rejects(rows: DataFrame, table: str) -> DataFrame:
    return rows.select("path", F.lit(table).alias("table"), F.col("pos").cast("bigint").alias("pos"), F.explode("violations").alias("reason"))


def _numbered(rows: DataFrame, given: DataFrame, keys=()) -> DataFrame:
    """0-based `ordinal` per track and keys. Rows that were joined by path are numbered where they are, since a track has one
    path; only if a file brings very many rows are they dealt anew. Counted on what is given, before any join."""
    if given is None or any_hot(given, ["path"]):
        return with_ordinals(rows, ("track_id", *keys))
    return ranked(rows, ["path", "track_id", *keys], ["pos"], id_bucket("pos"), "ordinal", None).withColumn("ordinal", F.col("ordinal") - 1)


def file_text_tags(rows: DataFrame, given: DataFrame) -> DataFrame:
    """Accepted text tags: track_id, key, value, ordinal, value_blob. Ordinals run per key."""
    return _numbered(rows.where(key_floor()), given, ["key"]).withColumn("value_blob", F.lit(None).cast("binary"))


def file_binary_tags(rows: DataFrame, given: DataFrame) -> DataFrame:
    """Accepted binary tags: track_id, key, value, ordinal, value_blob. Ordinals run over all of a track's, not per key."""
    kept = _good(_checked(rows, PAYLOAD_RULES)).where(F.octet_length("payload") > 0)
    numbered = _numbered(kept, given)
    return numbered.select("track_id", "key", F.lit("").alias("value"), "ordinal", F.col("payload").alias("value_blob"))


def file_blocks(rows: DataFrame, given: DataFrame = None) -> DataFrame:
    """Accepted structural blocks: track_id, kind, ordinal, body. Ordinals run per kind."""
    return _numbered(_good(_checked(rows, FILE_BLOCK_RULES)), given, ["kind"]).select("track_id", "kind", "ordinal", "body")


def file_art(pictures: DataFrame, ids: DataFrame, stored: DataFrame):
    """(checked picture rows without their bytes, art with what is new, links).

    Bytes travel once: rows are hashed where they are read, everything but the bytes of new art goes on as digests.
    One content is one art row; a stored one stays, a new one has the attributes of its first row by path and position.
    Zero dimensions mean unknown; picture types out of range become `other`."""
    digest = F.sha2("data", 256)
    narrow = pictures.select(
        "path", "pos", digest.alias("sha256"), F.octet_length("data").cast("bigint").alias("byte_len"), "mime", V.zero_to_null("width").cast("int").alias("width"),
        V.zero_to_null("height").cast("int").alias("height"), V.clamp_picture_type("picture_type").cast("int").alias("picture_type"), F.coalesce("description", F.lit("")).alias("description"),
    )
    checked = _checked(narrow.join(ids.select("path", "track_id"), "path"), PICTURE_RULES)
    # Pictures are numbered where the join by path has brought them; only good ones count.
    counts = {"ordinal": F.when(F.size("violations") == 0, 1).otherwise(0).cast("bigint")}
    if any_hot(pictures, ["path"]):
        checked = running_sums(checked, ["track_id"], ["pos"], id_bucket("pos"), counts)
    else:
        checked = running_sums(checked, ["path", "track_id"], ["pos"], id_bucket("pos"), counts, None)
    checked = materialize(checked.withColumn("ordinal", F.col("ordinal") - 1), "scan-pictures")
    good = _good(checked)
    first = good.groupBy("sha256").agg(F.min_by(F.struct("mime", "width", "height", "byte_len"), F.struct("path", "pos")).alias("a"))
    first = first.join(stored.select("sha256"), "sha256", "left_anti").select("sha256", "a.*")
    # Equal bytes combine before they are shuffled.
    bodies = pictures.where(F.octet_length("data") <= MAX_BLOB_BYTES).groupBy(digest.alias("sha256")).agg(F.first("data").alias("data"))
    fresh = materialize(with_next_ids(first.join(bodies, "sha256"), stored, "sha256").select(*stored.columns), "scan-art")
    art = stored.unionByName(fresh)
    # Few contents go to every task, however many links they have.
    used = art.select(F.col("id").alias("art_id"), "sha256").join(good.select("sha256").distinct(), "sha256", "left_semi")
    used = materialize(used, "scan-art-ids")
    used = F.broadcast(used) if used.count() <= FEW_CONTENTS else used
    links = good.join(used, "sha256").select("track_id", "art_id", "picture_type", "description", "ordinal")
    return checked, art, links


def replace_children(catalogue: dict, ids: DataFrame, tags: DataFrame = None, binary_tags: DataFrame = None, pictures: DataFrame = None, blocks: DataFrame = None):
    """(catalogue, version steps, rejects) with the given kinds of child rows replaced on the tracks of `ids`
    (path, track_id, known: had rows before). Kinds that are not given stay, as do all other tracks."""
    out, steps, rejects = dict(catalogue), [], []
    known = ids.where("known").select("track_id")
    owned = lambda df: df.join(ids.select("path", "track_id"), "path")
    lost = lambda df: df.join(known, "track_id", "left_semi")
    kept = lambda df: df.join(known, "track_id", "left_anti")
    if tags is not None or binary_tags is not None:
        table = catalogue["tags"]
        sides = []
        for given, stored in ((tags, text_tags(table)), (binary_tags, stored_binary(table))):
            if given is None:
                sides.append(stored)
                continue
            if given is tags:
                rows = owned(tags)
                new = file_text_tags(rows.select("path", "track_id", "pos", "key", "value"), tags)
                rejects.append(_rejects(_checked(rows, {"key": key_floor}), "tags"))
            else:
                rows = owned(binary_tags)
                new = file_binary_tags(rows, binary_tags)
                rejects.append(_rejects(_checked(rows, PAYLOAD_RULES), "binary_tags"))
            sides += [kept(stored), new]
            steps += [(lost(stored), 1), (new, 1)]
        out["tags"] = reduce(DataFrame.unionByName, [s.select(*table.columns) for s in sides])
    if pictures is not None:
        links = catalogue["track_art"]
        checked, out["art"], new = file_art(pictures, ids, catalogue["art"])
        out["track_art"] = kept(links).select(*links.columns).unionByName(new.select(*links.columns))
        steps += [(lost(links), 1), (new, 1)]
        rejects.append(_rejects(checked, "track_art"))
    if blocks is not None:
        stored = catalogue["structural_blocks"]
        rows = owned(blocks)
        new = file_blocks(rows, blocks)
        out["structural_blocks"] = kept(stored).select(*stored.columns).unionByName(new.select(*stored.columns))
        steps += [(lost(stored), 1), (new, 1)]
        rejects.append(_rejects(_checked(rows, FILE_BLOCK_RULES), "structural_blocks"))
    return out, steps, reduce(DataFrame.unionByName, rejects)
