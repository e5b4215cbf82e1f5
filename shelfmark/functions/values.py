"""Number, date, hash, array and map functions as Spark columns."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import ascii_lower, blank_to_null, col, dotted_extension, trim_to_null
from shelfmark.schemas import MAX_PICTURE_TYPE


def safe_int(c) -> Column:
    return F.trim(col(c).cast("string")).try_cast("bigint")


def int_or_zero(c) -> Column:
    return F.coalesce(safe_int(c), F.lit(0).cast("bigint"))


def date_from_parts(year, month, day) -> Column:
    y, m, d = int_or_zero(year), int_or_zero(month), int_or_zero(day)
    return (
        F.when(y == 0, None)
        .when((m != 0) & (d != 0), F.format_string("%04d-%02d-%02d", y, m, d))
        .otherwise(F.format_string("%04d", y))
    )


def date_prefix(c) -> Column:
    return F.left(trim_to_null(c), F.lit(10))


def number_of_total(n, total) -> Column:
    return F.when(F.coalesce(col(total), F.lit(0)) != 0, F.concat(col(n).cast("string"), F.lit("/"), col(total).cast("string"))).otherwise(
        col(n).cast("string")
    )


def fixed_decimals(c, digits: int) -> Column:
    """Round the exact binary value half-even to `digits` decimals, as C printf does.

    The fraction is exact in a double; its product with 10^digits is split into a rounded part
    and the exact error, so the comparison with one half is decided on the true value. The whole
    part is a bigint, or from 2^63 up the exact sum of two parts; 1e37 and above is no number here.
    """
    x, scale = col(c).cast("double"), float(10**digits)
    a = F.abs(x)
    fraction = a % F.lit(1.0)
    whole = a - fraction
    wide = fraction * 134217729.0
    high = wide - (wide - fraction)
    product = fraction * scale
    error = (high * scale - product) + (fraction - high) * scale
    below = F.floor(product)
    over = (product - below.cast("double") - 0.5) + error
    n = F.when(over > 0, below + 1).when(over < 0, below).otherwise(below + below % 2)
    unit, part = F.lit(10**digits).cast("bigint"), float(2**62)
    upper = whole / part - (whole / part) % F.lit(1.0)
    dec = lambda v: v.cast("bigint").cast("decimal(19,0)")
    large = (dec(upper).cast("decimal(38,0)") * F.lit(2**62).cast("decimal(19,0)")).cast("decimal(38,0)") + dec(whole - upper * part)
    text = F.concat(
        F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit("")),
        F.when(a < 9e18, (whole.cast("bigint") + F.floor(n / unit).cast("bigint")).cast("string")).otherwise(large.cast("decimal(38,0)").cast("string")),
        F.lit("."),
        F.lpad((n % unit).cast("string"), digits, "0"),
    )
    return F.when(a < 1e37, text)


def gain_text(c) -> Column:
    return F.concat(fixed_decimals(c, 2), F.lit(" dB"))


def peak_text(c) -> Column:
    return fixed_decimals(c, 6)


def float_text(c) -> Column:
    """Whole numbers without `.0`; others in shortest form, exponents from 1e16 up and below 1e-4."""
    x = col(c).cast("double")
    short = x.cast("string")
    plain = F.regexp_replace(short.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    mantissa = F.regexp_replace(F.split(short, "E")[0], r"\.0$", "")
    exponent = F.lpad(F.regexp_replace(F.split(short, "E")[1], "^-", ""), 2, "0")
    return (
        F.when(x.isNull(), None)
        .when((F.abs(x) < 9e18) & (x == F.floor(x)), x.cast("bigint").cast("string"))
        .when(~short.contains("E"), short)
        .when(F.abs(x) >= 1e-4, plain)
        .otherwise(F.concat(mantissa, F.lit("e-"), exponent))
    )


def value_text(c, kind: str) -> Column:
    """Host value to stored text; `kind` is the Spark type of the source column."""
    if kind == "boolean":
        return F.when(col(c), F.lit("1")).when(~col(c), F.lit("0"))
    if kind in ("double", "float"):
        return float_text(c)
    if kind in ("int", "bigint", "long"):
        return col(c).cast("string")
    return trim_to_null(c)


def is_zero_text(c) -> Column:
    """Text that reads as the number zero; anything else, null included, is not zero."""
    number = col(c).rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")  # a cast alone takes 0d and 0f too
    return F.coalesce(number & (col(c).try_cast("double") == 0.0), F.lit(False))


def display_seconds(ns) -> Column:
    return F.floor(col(ns).cast("decimal(20,0)") / F.lit(1000000000)).cast("bigint")


def effective_mtime(mtime_ns, updated_at) -> Column:
    return F.greatest(display_seconds(mtime_ns), col(updated_at))


def stamp(size, mtime_ns, ctime_ns) -> Column:
    return F.struct(col(size).alias("size"), col(mtime_ns).alias("mtime_ns"), col(ctime_ns).alias("ctime_ns"))


def bounds_ok(offset, length, size) -> Column:
    """offset + length <= size without the sum overflowing."""
    o, n, s = col(offset), col(length), col(size)
    return (o >= 0) & (n >= 0) & (s >= 0) & (o <= s) & (n <= s - F.greatest(F.least(o, s), F.lit(0)))


def sha256_hex(c) -> Column:
    return F.sha2(col(c), 256)


def record_fingerprint(*parts) -> Column:
    """SHA-256 over a JSON array of the parts: lengths and nulls cannot alias."""
    return F.sha2(F.to_json(F.struct(*[col(p).alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def sniff_image_type(data, name) -> Column:
    # Magic bytes and extensions of the known image types.
    raw = col(data)
    ext = ascii_lower(dotted_extension(F.element_at(F.split(col(name), "/"), -1)))
    return (
        F.when(F.substring(raw, 1, 3) == F.unhex(F.lit("FFD8FF")), "image/jpeg")
        .when(F.substring(raw, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A")), "image/png")
        .when((F.substring(raw, 1, 4) == F.lit("RIFF").cast("binary")) & (F.substring(raw, 9, 4) == F.lit("WEBP").cast("binary")), "image/webp")
        .when(ext.isin(".jpg", ".jpeg"), "image/jpeg")
        .when(ext == ".png", "image/png")
        .when(ext == ".webp", "image/webp")
        .otherwise("application/octet-stream")
    )


# Picture type numbers by image role.
PICTURE_ROLES = {"front": 3, "back": 4, "booklet": 5, "medium": 6}


def picture_type(role, is_front) -> Column:
    named = reduce(lambda acc, kv: acc.when(col(role) == kv[0], kv[1]), PICTURE_ROLES.items(), F.when(F.lit(False), 0))
    return F.coalesce(named, F.when(col(is_front), 3), F.lit(0))


def clamp_picture_type(c) -> Column:
    return F.when(col(c).between(0, MAX_PICTURE_TYPE), col(c)).otherwise(F.lit(0))


def zero_to_null(c) -> Column:
    return F.when(col(c) != 0, col(c))


def ordered_distinct_ints(values) -> Column:
    ints = F.transform(col(values), lambda v: F.trim(v).try_cast("bigint"))
    return F.array_distinct(F.filter(ints, lambda v: v.isNotNull()))


def ordered_distinct_texts(*arrays) -> Column:
    merged = F.concat(*[F.coalesce(col(a), F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(F.transform(merged, trim_to_null), lambda v: v.isNotNull()))


def clean_texts(values) -> Column:
    return F.filter(F.transform(col(values), trim_to_null), lambda v: v.isNotNull())


def twin_values(plural, singular) -> Column:
    """The list field wins when it holds anything usable, else the single field."""
    many, one = clean_texts(plural), clean_texts(F.array(col(singular)))
    return F.when(F.size(many) > 0, many).otherwise(one)


def keys_to_csv(keys) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(col(keys))), ",")


def csv_to_keys(c) -> Column:
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), ","), lambda k: k != "")


def managed_keys(previous, now, restore: bool = False) -> Column:
    """struct<delete_keys, managed>: what to clear now and what to remember."""
    prev, cur = F.coalesce(col(previous), F.array().cast("array<string>")), col(now)
    if restore:
        return F.struct(F.array().cast("array<string>").alias("delete_keys"), F.array_sort(F.array_distinct(cur)).alias("managed"))
    return F.struct(
        F.array_sort(F.array_except(prev, cur)).alias("delete_keys"),
        F.array_sort(F.array_union(prev, cur)).alias("managed"),
    )


def json_first(doc, *paths) -> Column:
    """First usable of several alternative locations; empty text and 0 count as missing."""
    found = [F.get_json_object(col(doc), p) for p in paths]
    return F.coalesce(*[F.when(~v.isin("", "0", "false"), v) for v in found])


def json_text(doc, path) -> Column:
    return blank_to_null(F.get_json_object(col(doc), path))
