"""Directory view: collision-free final paths, nodes and stable node ids.

The rule is sequential: tracks arrive by ascending id. A file takes its name, or
the first free ` (k)` from 2 up. A directory is shared by all tracks that name it;
if a file got the name first, every such track opens its own suffixed directory.

The work is done on sets. Where no two wishes inside a directory can meet except
for equal file names, the k of a file is its rank by id (one shuffle). Names that
can meet otherwise form a *contested unit* (a directory plus a name family) and
go through `settle_names`, which finds the sequential outcome by a fixpoint of
ranks and running sums. Nothing is ever handled as one group in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.operators.ordered import HOT_ROWS, dense_index, id_bucket, ranked, running_sums
from shelfmark.schemas import MAX_SUFFIX, NAME_BYTES
from shelfmark.sources.shared import materialize

# A name this short is never cut when a suffix of up to ten digits is added.
_SAFE_BYTES = NAME_BYTES - 17
_MARK = "\x00"


def _key(name: Column, folded: bool) -> Column:
    return P.fold(name) if folded else name


def split_names(rendered: DataFrame, folded: bool = False) -> DataFrame:
    """id, path -> id, names (final component texts before any suffix), keys, depth."""
    parts = P.components("path")
    dirs = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), P.truncate_directory)
    leaf = P.truncate_leaf(F.try_element_at(parts, F.lit(-1)))
    out = rendered.select("id", parts.alias("_p"), F.concat(dirs, F.array(leaf)).alias("names")).where(F.size("_p") > 0)
    keys = F.transform("names", lambda n: _key(n, folded))
    return out.select("id", "names", keys.alias("keys"), F.size("names").alias("depth"))


def _prefix(keys, n) -> Column:
    return F.array_join(F.slice(P.col(keys), F.lit(1), n), "/")


def _directory_rows(names: DataFrame) -> DataFrame:
    """One row per track and directory on its path."""
    at = names.where("depth > 1").select(
        "id", "names", "keys", "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("d")
    )
    return at.select(
        "id",
        _prefix("keys", F.col("d") - 1).alias("parent"),
        F.col("keys")[F.col("d") - 1].alias("key"),
        F.col("names")[F.col("d") - 1].alias("name"),
        "depth",
        "d",
    )


def directory_wishes(names: DataFrame) -> DataFrame:
    """One row per base directory: parent, key, first track and its spelling."""
    return _directory_rows(names).groupBy("parent", "key").agg(F.min("id").alias("dir_min"), F.min_by("name", "id").alias("display"))


def wished_names(names: DataFrame) -> DataFrame:
    """Every name wished for in a directory: how many files, the first file and directory track."""
    rows = leaf_wishes(names).select("parent", "key", "id", F.lit(False).alias("is_dir"))
    rows = rows.unionByName(_directory_rows(names).select("parent", "key", "id", F.lit(True).alias("is_dir")))
    return rows.groupBy("parent", "key").agg(
        F.count_if(~F.col("is_dir")).alias("n_files"), F.min(F.when(F.col("is_dir"), F.col("id"))).alias("dir_min")
    )


def leaf_wishes(names: DataFrame) -> DataFrame:
    return names.select(
        "id",
        _prefix("keys", F.col("depth") - 1).alias("parent"),
        F.element_at("keys", -1).alias("key"),
        F.element_at("names", -1).alias("name"),
        "depth",
    )


def _with_parts(df: DataFrame) -> DataFrame:
    """Stem and extension of the key, worked out once."""
    return df.withColumn("stem", P.stem("key")).withColumn("ext", P.dotted_extension("key"))


def _family(stem: Column, ext: Column, crowded: Column) -> Column:
    """Names that can ever meet share it: the stem without generated suffixes.
    A directory with names near the byte limit is one family, as cutting mixes stems."""
    root = F.regexp_replace(stem, r"( \([1-9][0-9]*\))+\z", "")
    return F.when(crowded, F.lit("")).otherwise(F.concat(root, F.lit(_MARK), ext))


def _pool_rows(groups: DataFrame, any_long: bool) -> DataFrame:
    """(parent, key, pool stem, extension) for names that may hand out suffixes."""
    short = groups.where(F.octet_length("key") <= _SAFE_BYTES).select("parent", "key", F.col("stem").alias("pool"), "ext")
    if not any_long:
        return short
    digits = F.explode(F.sequence(F.lit(1), F.lit(10)))
    long = groups.where(F.octet_length("key") > _SAFE_BYTES).select("parent", "key", "ext", digits.alias("digits"))
    cut = P.suffix_stem("key", F.pow(F.lit(10), F.col("digits") - 1).cast("bigint"))
    return short.unionByName(long.select("parent", "key", cut.alias("pool"), "ext").distinct())


def contested_units(groups: DataFrame, any_long: bool) -> DataFrame:
    """(parent, family, crowded, with_dirs) units whose outcome the rank alone cannot give."""
    if any_long:
        crowded = groups.groupBy("parent").agg((F.max(F.octet_length("key")) > _SAFE_BYTES).alias("crowded"))
        groups = groups.join(crowded, "parent")
    else:
        groups = groups.withColumn("crowded", F.lit(False))
    both = (F.col("n_files") > 0) & F.col("dir_min").isNotNull()
    pools = _pool_rows(groups.where((F.col("n_files") > 1) | both), any_long)
    unit = ["parent", "family", "crowded"]
    family = _family(F.col("stem"), F.col("ext"), F.col("crowded")).alias("family")
    suffixed = groups.where(P.suffix_number("stem").isNotNull()).select("parent", "crowded", family, P.suffix_base("stem").alias("pool"), "ext")
    units = suffixed.join(pools, ["parent", "pool", "ext"], "left_semi").select(*unit)
    units = units.unionByName(groups.where(both).select("parent", family, "crowded"))
    if any_long:
        shared = pools.groupBy("parent", "pool", "ext").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b")
        units = units.unionByName(shared.select("parent", F.lit("").alias("family"), F.lit(True).alias("crowded")))
    dirs = groups.where(F.col("dir_min").isNotNull()).select("parent", family).distinct().withColumn("dirs", F.lit(True))
    return units.distinct().join(dirs, ["parent", "family"], "left").select(*unit, F.coalesce("dirs", F.lit(False)).alias("with_dirs"))


def contested_tracks(names: DataFrame, units: DataFrame, facts) -> DataFrame:
    """id, depth, first_depth: where the path of a track first enters a contested unit."""
    def hit(at: DataFrame, some_units: DataFrame) -> DataFrame:
        out = None
        for crowded, n in ((False, facts["plain"]), (True, facts["crowded"])):
            if n:
                u = some_units.where(F.col("crowded") == F.lit(crowded)).select("parent", "family")
                j = _with_parts(at).withColumn("family", _family(F.col("stem"), F.col("ext"), F.lit(crowded))).join(u, ["parent", "family"], "left_semi")
                out = j if out is None else out.unionByName(j)
        return out.select("id", "depth", "d")

    found = hit(leaf_wishes(names).withColumn("d", F.col("depth")).select("id", "depth", "d", "parent", "key"), units)
    if facts["with_dirs"]:
        found = found.unionByName(hit(_directory_rows(names).drop("name"), units.where("with_dirs")))
    return found.groupBy("id", "depth").agg(F.min("d").alias("first_depth"))


# --------------------------------------------------------------------------
# Contested names


def _pool_pass(arrivals, specials, taken, low: int, high, hot_rows: int):
    """One level of suffix numbers [low, high].

    arrivals: parent, pool, ext, id, is_dir. specials: names someone asks for
    outright: parent, pool, ext, k, key, first_id. taken: parent, key, by_id, by_dir,
    the pool's wins over specials as far as known.
    Returns (placed: id, k; overflow ids; wins: parent, key, by_id, by_dir).
    """
    pool = ["parent", "pool", "ext"]
    order = ranked(arrivals, pool, ["id"], id_bucket("id"), "r", hot_rows)
    sp = specials.join(taken.select("parent", "key", F.lit(1).alias("won")), ["parent", "key"], "left")
    sp = sp.withColumn("lost", F.when(F.col("won").isNull(), 1).otherwise(0))
    sp = running_sums(sp, pool, ["k"], id_bucket("k"), {"lost_upto": F.col("lost")}, hot_rows)
    sp = sp.withColumn("reach", F.col("k") - F.lit(low - 1) - (F.col("lost_upto") - F.col("lost")))
    at = order.select(*pool, F.col("r").alias("reach"), F.col("id").alias("by_id"), F.col("is_dir").alias("by_dir"))
    wins = sp.join(at, [*pool, "reach"]).where(F.col("by_id") < F.col("first_id")).select("parent", "key", "by_id", "by_dir")
    shifts = sp.where("lost = 1").select(*pool, F.col("reach").alias("r"), F.lit(0).alias("turn"), F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("id"))
    both = shifts.unionByName(order.select(*pool, "r", F.lit(1).alias("turn"), F.lit(0).alias("one"), "id"))
    summed = running_sums(both, pool, ["r", "turn", "one", "id"], id_bucket("r"), {"shift": F.col("one")}, hot_rows)
    k = F.col("r") + F.lit(low - 1) + F.col("shift")
    numbered = summed.where("turn = 1").select("id", k.alias("k"))
    if high is None:
        return numbered, None, wins
    return numbered.where(F.col("k") <= high), numbered.where(F.col("k") > high).select("id"), wins


def settle_names(wishes: DataFrame, folded: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sequential outcome for all wishes in their directories.

    wishes: id, parent (final parent key), key, name, is_dir; returns id, final_name.
    The unknown is which plainly wished names a suffix sequence took first. Every
    such decision depends only on earlier ids, so the fixpoint is unique and is the
    sequential result; repeating the pass reaches it.
    """
    wishes = materialize(wishes, "wishes")
    spark = wishes.sparkSession
    groups = wishes.groupBy("parent", "key").agg(
        F.min(F.when(~F.col("is_dir"), F.col("id"))).alias("file_min"),
        F.min(F.when(F.col("is_dir"), F.col("id"))).alias("dir_min"),
        F.min_by(F.when(F.col("is_dir"), F.col("name")), F.when(F.col("is_dir"), F.col("id"))).alias("dir_name"),
        F.min("id").alias("first_id"),
        F.count("*").alias("n"),
    )
    groups = _with_parts(groups)
    groups = materialize(groups.withColumn("k", P.suffix_number("stem")), "wished-names")
    k = F.col("k")
    specials = groups.where(k.isNotNull()).select("parent", "key", "first_id", "k", P.suffix_base("stem").alias("pool"), "ext")
    facts = groups.agg(F.max(F.octet_length("key")).alias("longest"), F.count_if(k.isNotNull()).alias("specials"), F.sum("n").alias("rows")).head()
    if (facts["rows"] or 0) <= hot_rows:
        hot_rows = None
    long_names = (facts["longest"] or 0) > _SAFE_BYTES
    taken = spark.createDataFrame([], "parent string, key string, by_id bigint, by_dir boolean")

    def one_round(taken):
        file_first = F.col("file_min").isNotNull() & (F.col("dir_min").isNull() | (F.col("file_min") < F.col("dir_min")))
        g = groups.join(taken, ["parent", "key"], "left").select(
            "parent",
            "key",
            "stem",
            "ext",
            "by_id",
            "dir_name",
            F.when(F.col("by_id").isNull() & file_first, F.col("file_min")).alias("file_owner"),
            F.coalesce(F.col("by_dir"), ~file_first).alias("shared_dir"),
        )
        w = wishes.join(g, ["parent", "key"])
        settled = F.when(F.col("is_dir"), F.col("shared_dir")).otherwise(F.coalesce(F.col("id") == F.col("file_owner"), F.lit(False)))
        w = w.withColumn("settled", settled)
        arrivals = w.where(~F.col("settled")).select("id", "parent", "key", "stem", "ext", "is_dir")
        placed, wins = [], []
        short = arrivals.where(F.octet_length("key") <= _SAFE_BYTES).select(
            "parent", F.col("stem").alias("pool"), "ext", "id", "is_dir"
        )
        p, _, v = _pool_pass(short, specials, taken, 2, None, hot_rows)
        placed.append(p)
        wins.append(v)
        if long_names:
            rest, digits = arrivals.where(F.octet_length("key") > _SAFE_BYTES), 1
            while digits <= 10 and not rest.isEmpty():
                low, high = max(2, 10 ** (digits - 1)), min(10**digits - 1, MAX_SUFFIX)
                level = rest.select(
                    "parent", P.suffix_stem("key", F.lit(low)).alias("pool"), "ext", "id", "is_dir"
                )
                p, over, v = _pool_pass(level, specials.where(F.col("k").between(low, high)), taken, low, high, hot_rows)
                placed.append(p)
                wins.append(v)
                rest = materialize(rest.join(over, "id", "left_semi"), "overflow")
                digits += 1
        all_placed, all_wins = placed[0], wins[0]
        for p, v in zip(placed[1:], wins[1:]):
            all_placed, all_wins = all_placed.unionByName(p), all_wins.unionByName(v)
        return w, all_placed, all_wins

    w, placed, wins = one_round(taken)
    while facts["specials"]:
        wins = materialize(wins, "suffix-wins")
        both = wins.withColumn("w", F.lit(1)).unionByName(taken.withColumn("w", F.lit(-1)))
        if both.groupBy(*wins.columns).agg(F.sum("w").alias("w")).where("w <> 0").isEmpty():
            break
        taken = wins
        w, placed, wins = one_round(taken)
    numbered = w.where(~F.col("settled")).select("id", "name").join(placed, "id").select("id", P.suffix_candidate("name", "k").alias("final_name"))
    # A shared directory is spelled by whoever opened it, a suffix sequence included.
    opener = wishes.select(F.col("id").alias("by_id"), F.col("name").alias("opener_name"))
    at_base = w.where("settled").join(opener, "by_id", "left")
    spelled = (
        F.when(~F.col("is_dir"), F.col("name"))
        .when(F.col("by_id").isNotNull(), P.suffix_candidate("opener_name", P.canonical_suffix("key")))
        .otherwise(F.col("dir_name"))
    )
    return numbered.unionByName(at_base.select("id", spelled.alias("final_name")))


# --------------------------------------------------------------------------
# Whole tree


def place(rendered: DataFrame, case_insensitive: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Final place of every track: id, final_path, parent_path, name, rendered_name.

    rendered: id, path (unique ids). Tracks whose path has no usable component are left out.
    """
    folded = case_insensitive
    names = materialize(split_names(rendered.where(F.col("path").isNotNull()), folded), "names")
    leaves = leaf_wishes(names)
    wishes = materialize(directory_wishes(names), "directories") if folded else None
    groups = materialize(_with_parts(wished_names(names)), "name-groups")
    sizes = groups.agg(F.max(F.octet_length("key")).alias("longest"), F.max("n_files").alias("largest")).head()
    longest = sizes["longest"] or 0
    units = materialize(contested_units(groups, longest > _SAFE_BYTES), "contested-units")
    facts = units.agg(F.count_if(~F.col("crowded")).alias("plain"), F.count_if("crowded").alias("crowded"), F.count_if("with_dirs").alias("with_dirs")).head()
    contested = None
    if facts["plain"] or facts["crowded"]:
        contested = materialize(contested_tracks(names, units, facts), "contested")
    calm = leaves if contested is None else leaves.join(contested, "id", "left_anti")
    free = ranked(calm, ["parent", "key"], ["id"], id_bucket("id"), "r", hot_rows if (sizes["largest"] or 0) > hot_rows else None)
    free = free.select(
        "id",
        F.lit(None).cast("string").alias("moved_parent"),
        F.when(F.col("r") > 1, P.suffix_candidate("name", "r")).otherwise(F.col("name")).alias("name"),
    )
    spelled = _spelled_parents(names, wishes) if folded else names.select("id", _prefix("names", F.col("depth") - 1).alias("spelled"), F.element_at("names", -1).alias("rendered_name"))
    placed = free
    if contested is not None:
        span = contested.agg(F.min("first_depth").alias("lo"), F.max("depth").alias("hi")).head()
        here = names.join(contested.select("id", "first_depth"), "id").join(spelled.select("id", F.split("spelled", "/").alias("shown_dirs")), "id").withColumn("at", F.lit(None).cast("string")).withColumn("at_name", F.lit(None).cast("string"))
        for d in range(span["lo"], span["hi"] + 1):
            here = materialize(here, "walk")
            live = here.where((F.col("first_depth") <= d) & (F.col("depth") >= d))
            parent = F.coalesce(F.col("at"), _prefix("keys", F.lit(d - 1)))
            asked = live.select(
                "id", parent.alias("parent"), F.col("keys")[d - 1].alias("key"), F.col("names")[d - 1].alias("name"), (F.col("depth") > d).alias("is_dir")
            )
            got = settle_names(asked, folded, hot_rows)
            ends = got.join(here.where(F.col("depth") == d).select("id", F.coalesce(F.col("at_name"), _prefix("shown_dirs", F.lit(d - 1))).alias("moved_parent")), "id")
            placed = placed.unionByName(ends.select("id", "moved_parent", F.col("final_name").alias("name")))
            if d < span["hi"]:
                base = F.coalesce(F.col("at"), _prefix("keys", F.lit(d - 1)))
                shown = F.coalesce(F.col("at_name"), _prefix("shown_dirs", F.lit(d - 1)))
                here = (
                    here.where(F.col("depth") > d)
                    .join(got, "id", "left")
                    .withColumn("at_new", F.when(F.col("final_name").isNotNull(), P.join_path(base, _key(F.col("final_name"), folded))).otherwise(F.col("at")))
                    .withColumn("at_name_new", F.when(F.col("final_name").isNotNull(), P.join_path(shown, "final_name")).otherwise(F.col("at_name")))
                    .drop("at", "at_name", "final_name")
                    .withColumnsRenamed({"at_new": "at", "at_name_new": "at_name"})
                )
    out = placed.join(spelled, "id").withColumn("parent_path", F.coalesce("moved_parent", "spelled"))
    return out.select("id", P.join_path("parent_path", "name").alias("final_path"), "parent_path", "name", "rendered_name")


def top_family(path: Column, case_insensitive: bool = False) -> Column:
    """The family of a rendered path's first component; null if the path has no usable one."""
    root = F.try_element_at(P.components(path), F.lit(1))
    root = _key(F.when(F.size(P.components(path)) > 1, P.truncate_directory(root)).otherwise(P.truncate_leaf(root)), case_insensitive)
    return _family(P.stem(root), P.dotted_extension(root), F.lit(False))


def is_long(path: Column, case_insensitive: bool = False) -> Column:
    """Whether a path's first component is near the byte limit: then names of other families may meet it."""
    root = F.try_element_at(P.components(path), F.lit(1))
    return F.coalesce(F.greatest(F.octet_length(root), F.octet_length(_key(root, case_insensitive))) > _SAFE_BYTES, F.lit(False))


def place_touched(rendered: DataFrame, touched: DataFrame, case_insensitive: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Places of the top-level name families that `touched` paths (old and new) fall into.

    Names in different top-level families never meet, so all other tracks keep the
    place they had. The whole library costs one scan of its paths; only the touched
    families are placed anew.
    """
    paths = rendered.where(F.col("path").isNotNull())
    roots = lambda df: split_names(df, case_insensitive).select("id", F.col("keys")[0].alias("root"))
    parts = lambda df: df.withColumn("stem", P.stem("root")).withColumn("ext", P.dotted_extension("root"))
    crowded = roots(paths).agg(F.coalesce(F.max(F.octet_length("root")) > _SAFE_BYTES, F.lit(False))).scalar()
    family = _family(F.col("stem"), F.col("ext"), crowded).alias("family")
    some = touched.where(F.col("path").isNotNull()).select(F.lit(0).cast("bigint").alias("id"), "path")
    hit = parts(roots(some)).select(family).distinct()
    ids = parts(roots(paths)).select("id", family).join(hit, "family", "left_semi").select("id")
    return place(paths.join(ids, "id", "left_semi"), case_insensitive, hot_rows)


def _spelled_parents(names: DataFrame, wishes: DataFrame) -> DataFrame:
    """Parent path with each merged directory spelled as its first track spelled it."""
    steps = names.where("depth > 1").select("id", "keys", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("d"))
    shown = (
        steps.select("id", "d", _prefix("keys", F.col("d") - 1).alias("parent"), F.col("keys")[F.col("d") - 1].alias("key"))
        .join(wishes.select("parent", "key", "display"), ["parent", "key"])
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("d", "display"))).alias("s"))
    )
    return names.select("id", F.element_at("names", -1).alias("rendered_name")).join(shown, "id", "left").select(
        "id", "rendered_name", F.coalesce(F.array_join(F.col("s.display"), "/"), F.lit("")).alias("spelled")
    )


def tree_nodes(placed: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """path, parent_path, name, kind, track_id, introducing_id; the root has path ''."""
    parts = F.split("parent_path", "/")
    depth = F.when(F.col("parent_path") == "", 0).otherwise(F.size(parts))
    above = placed.select("id", parts.alias("p"), F.explode(F.sequence(F.lit(0), depth)).alias("d"))
    dirs = (
        above.select("id", F.array_join(F.slice("p", F.lit(1), F.col("d")), "/").alias("path"), "d")
        .groupBy("path", "d")
        .agg(F.min("id").alias("introducing_id"))
    )
    cut = F.split("path", "/")
    dirs = dirs.select(
        "path",
        F.array_join(F.slice(cut, F.lit(1), F.greatest(F.col("d") - 1, F.lit(0))), "/").alias("parent_path"),
        F.when(F.col("d") == 0, "").otherwise(F.element_at(cut, -1)).alias("name"),
        F.lit("dir").alias("kind"),
        F.lit(None).cast("bigint").alias("track_id"),
        "introducing_id",
        F.col("d").alias("depth"),
    )
    files = placed.select(
        F.col("final_path").alias("path"), "parent_path", "name", F.lit("file").alias("kind"), F.col("id").alias("track_id"), F.col("id").alias("introducing_id"),
        (depth + 1).alias("depth"),
    )
    return dirs.unionByName(files)


def entry_counts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count_if(F.col("kind") == "file").alias("files"), F.count_if((F.col("kind") == "dir") & (F.col("path") != "")).alias("dirs")
    )


def listing(nodes: DataFrame, parent_path: str) -> DataFrame:
    """Children of one directory ordered by name."""
    return nodes.where((F.col("parent_path") == parent_path) & (F.col("path") != "")).orderBy("name")


def preview_paths(placed: DataFrame, limit: int = 30) -> DataFrame:
    """First paths of a depth-first walk in name order: compare by components, not by text."""
    return placed.select("final_path").orderBy(F.split("final_path", "/")).limit(limit)


def assign_node_ids(nodes: DataFrame, previous: DataFrame = None, case_insensitive: bool = False) -> DataFrame:
    """Stable ids: a known path keeps its id, new paths get the next ids in insertion
    order (introducing track, then depth); ids are never reused; the root is 1.

    previous: path_key, inode, live. Returns path_key, inode, live for the new state:
    retired entries stay until the map holds more than twice the live nodes.
    """
    now = nodes.select(_key(F.col("path"), case_insensitive).alias("path_key"), "introducing_id", "depth").where("path_key <> ''")
    now = materialize(now, "nodes")
    spark = nodes.sparkSession
    root = spark.createDataFrame([("", 1)], "path_key string, inode bigint")
    if previous is None:
        previous = root.withColumn("live", F.lit(True)).withColumn("next_inode", F.lit(2).cast("bigint"))
    known = previous.select("path_key", "inode")
    # next_inode survives pruning of the largest ids, so no id comes back.
    start = previous.agg(F.greatest(F.max("inode") + 1, F.max("next_inode"))).scalar()
    fresh = dense_index(now.join(known, "path_key", "left_anti"), "introducing_id", ["depth"], "n")
    fresh = fresh.select("path_key", (start + F.col("n") - 1).alias("inode"))
    kept = now.select("path_key").join(known, "path_key").select("path_key", "inode")
    live = kept.unionByName(fresh).unionByName(root).withColumn("live", F.lit(True))
    retired = known.where("path_key <> ''").join(now.select("path_key"), "path_key", "left_anti").withColumn("live", F.lit(False))
    every = live.unionByName(retired)
    every = materialize(every, "node-ids")
    top = F.greatest(every.agg(F.max("inode") + 1).scalar(), start, F.lit(2).cast("bigint"))
    keep_retired = every.agg(F.count("*") <= 2 * F.count_if("live")).scalar()
    return every.where(F.col("live") | keep_retired).withColumn("next_inode", top)
