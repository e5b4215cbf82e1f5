"""String and path functions as Spark columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.schemas import MAX_SUFFIX, NAME_BYTES, PATH_FIELD_SEGMENTS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.when(col(c) != "", col(c))


def ascii_lower(c) -> Column:
    """Lowercase A-Z only; `lower` would also fold letters such as É or İ."""
    return F.translate(col(c), UPPER, UPPER.lower())


def ascii_upper(c) -> Column:
    return F.translate(col(c), UPPER.lower(), UPPER)


def fold(c) -> Column:
    """Case fold used for every case-insensitive name comparison."""
    return F.lower(col(c))


def sanitize(c) -> Column:
    return F.regexp_replace(col(c), r"[/\x00-\x1f]", "_")


def components(path) -> Column:
    """Parts of a path that become directories or files."""
    return F.filter(F.split(col(path), "/"), lambda x: ~x.isin("", ".", ".."))


def sanitize_path(c) -> Column:
    kept = F.slice(components(c), 1, PATH_FIELD_SEGMENTS)
    return F.array_join(F.transform(kept, sanitize), "/")


_LAST_DOT = r"(?s)^(.+)\.([^.]*)\z"


def has_extension(name) -> Column:
    return col(name).rlike(_LAST_DOT)


def stem(name) -> Column:
    return F.when(has_extension(name), F.regexp_extract(col(name), _LAST_DOT, 1)).otherwise(col(name))


def dotted_extension(name) -> Column:
    """The last dot and what follows; empty when there is no extension."""
    return F.when(
        has_extension(name), F.concat(F.lit("."), F.regexp_extract(col(name), _LAST_DOT, 2))
    ).otherwise(F.lit(""))


def truncate_bytes(c, limit) -> Column:
    """Longest prefix of whole characters within `limit` bytes (UTF-8 needs at most 3 steps back)."""
    text, n = col(c), (F.lit(limit) if isinstance(limit, int) else limit)
    raw = text.cast("binary")
    cuts = [
        F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(n - back, F.lit(0))).cast("string"))
        for back in range(4)
    ]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*cuts))


def truncate_directory(name) -> Column:
    return truncate_bytes(name, NAME_BYTES)


def truncate_leaf(name) -> Column:
    """Shorten the stem so that the extension survives, if there is room for any stem at all."""
    ext = dotted_extension(name)
    budget = F.lit(NAME_BYTES) - F.octet_length(ext)
    return (
        F.when(F.octet_length(col(name)) <= NAME_BYTES, col(name))
        .when(has_extension(name) & (budget > 0), F.concat(truncate_bytes(stem(name), budget), ext))
        .otherwise(truncate_bytes(name, NAME_BYTES))
    )


def _cut_for_suffix(stem_, ext, k) -> Column:
    room = F.lit(NAME_BYTES - 3) - F.length(col(k).cast("string")) - F.octet_length(ext)
    return truncate_bytes(stem_, F.greatest(room, F.lit(0)))


def suffix_stem(name, k) -> Column:
    """The stem as it appears in front of ` (k)`."""
    return _cut_for_suffix(stem(name), dotted_extension(name), k)


def suffixed(stem_, ext, k) -> Column:
    """The candidate ` (k)` of a name whose parts are known."""
    return F.concat(_cut_for_suffix(stem_, ext, k), F.lit(" ("), col(k).cast("string"), F.lit(")"), ext)


def suffix_candidate(name, k) -> Column:
    return suffixed(stem(name), dotted_extension(name), k)


def is_suffix_shaped(name) -> Column:
    number = F.regexp_extract(stem(name), r" \((\+?[0-9]+)\)\z", 1).try_cast("bigint")
    return F.coalesce(number.between(2, MAX_SUFFIX), F.lit(False))


def suffix_number(stem_) -> Column:
    """k when a stem reads exactly as a generated `stem (k)` would, else null."""
    number = F.regexp_extract(col(stem_), r" \(([1-9][0-9]{0,9})\)\z", 1).try_cast("bigint")
    return F.when(number.between(2, MAX_SUFFIX), number)


def suffix_base(stem_) -> Column:
    """What stands before the ` (k)` of such a stem."""
    return F.regexp_extract(col(stem_), r"(?s)^(.*) \([0-9]+\)\z", 1)


def canonical_suffix(name) -> Column:
    return suffix_number(stem(name))


def join_path(parent, child) -> Column:
    return F.concat_ws("/", blank_to_null(parent), col(child))


def under_root(path, root) -> Column:
    """Whole-component containment; the root itself counts."""
    base = F.regexp_replace(root if isinstance(root, Column) else F.lit(root), "/+$", "")
    p = col(path)
    return (p == base) | p.startswith(F.concat(base, F.lit("/")))


def extension_of(path) -> Column:
    """Lowercase extension of the last component, empty when there is none."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return ascii_lower(F.substring(dotted_extension(name), 2, 2147483647))


def split_list(c, sep=r"\|") -> Column:
    return F.filter(F.split(col(c), sep), lambda x: x != "")


def split_values(c) -> Column:
    return split_list(c, r"\x00")


def pair_field(c) -> Column:
    """KEY of KEY=VALUE, or null when there is no `=` or no key."""
    at = F.instr(col(c), "=")
    return F.when(at > 1, F.substring(col(c), F.lit(1), at - 1))


def pair_value(c) -> Column:
    at = F.instr(col(c), "=")
    return F.when(at > 1, F.substring(col(c), at + 1, F.length(col(c))))


def field_map_entries(text) -> Column:
    """array<struct<key,value>> of the `k=v` lines of a text."""
    lines = F.transform(F.split(col(text), r"\R"), lambda s: F.trim(s))
    parsed = F.transform(
        lines,
        lambda s: F.struct(
            F.trim(F.coalesce(pair_field(s), F.lit(""))).alias("key"),
            F.trim(F.coalesce(pair_value(s), F.lit(""))).alias("value"),
        ),
    )
    return F.filter(parsed, lambda e: (e["key"] != "") & (e["value"] != ""))


def language_key(frame, lang, description, default_key) -> Column:
    neutral = (col(description) == "") & ascii_lower(lang).isin("", "xxx", "und")
    return F.when(neutral, col(default_key)).otherwise(
        F.concat(F.lit("id3:"), col(frame), F.lit(":"), col(lang), F.lit(":"), col(description))
    )


def language_key_parts(key) -> Column:
    """struct<frame,lang,description>, null when the key is not of that form."""
    rx = r"(?s)^id3:(COMM|USLT):([^:]*):(.*)\z"
    return F.when(
        col(key).rlike(rx),
        F.struct(*[F.regexp_extract(col(key), rx, i + 1).alias(n) for i, n in enumerate(("frame", "lang", "description"))]),
    )


def trim_to_null(c) -> Column:
    """Strip white space at both ends; nothing left gives null."""
    return blank_to_null(F.regexp_replace(col(c).cast("string"), r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", ""))


def first_text(*cs) -> Column:
    return F.coalesce(*[trim_to_null(c) for c in cs])


def readable_path(raw) -> Column:
    """Bytes to text with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(col(raw).cast("string"))


def relative_path(path) -> Column:
    """Library-relative path: no extension on the last component, no leading slash."""
    no_ext = F.regexp_replace(col(path), r"(?s)^((?:.*/)?\.*[^/.][^/]*)\.[^/.]*\z", "$1")
    return F.ltrim(no_ext, F.lit("/"))


def truthy(c, default: bool) -> Column:
    return F.when(col(c).isNull(), F.lit(default)).otherwise(
        ~F.lower(F.trim(col(c))).isin("0", "false", "no", "off")
    )
