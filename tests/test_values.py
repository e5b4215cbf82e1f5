
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import values as V


def one(spark, c):
    return spark.range(1).select(c).head()[0]


def test_fixed_decimals_is_exact(spark):
    xs = [0.125, 0.375, 2.675, 1.005, -0.125, -3.5, 0.0, -0.0, 1e-9, 123456.785, 8.5e-7, 2.5e-6, 0.1, 99.995, 1 / 3, 1000000000.125, 9e15 + 1, 2.0**62, 2.0**63, -(2.0**70) - 2.0**20, 1.5e30, 4503599627370495.5, 0.999999999, 7.9999999]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", V.fixed_decimals("x", 2).alias("a"), V.fixed_decimals("x", 6).alias("b")).collect()
    for r in rows:
        assert (r.a, r.b) == (f"{r.x:.2f}", f"{r.x:.6f}"), r
    assert one(spark, V.gain_text(F.lit(None).cast("double"))) is None


def test_float_text_reads_like_the_hosts(spark):
    xs = [1.0, 1.5, -0.25, 1e7, 12345678.5, 0.001, 0.00025, 0.00001, 1.5e-7, 1e15, 123456789.125]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", V.float_text("x").alias("t")).collect()
    for r in rows:
        want = str(int(r.x)) if r.x.is_integer() else str(r.x)
        assert r.t == want


def test_zero_text(spark):
    for text, want in [("0", True), ("0.0", True), ("-0", True), ("0/12", False), ("0d", False), ("0f", False), (" 0.00 ", True), ("0e5", True), ("x", False), ("0.5", False), ("", False), (None, False)]:
        assert one(spark, V.is_zero_text(F.lit(text).cast("string"))) is want


def test_date_from_parts(spark):
    cases = [((2001, 2, 3), "2001-02-03"), ((2001, 0, 3), "2001"), ((2001, 2, None), "2001"), ((0, 1, 1), None), (("98x", 1, 1), None), ((987, None, None), "0987")]
    for (y, m, d), want in cases:
        assert one(spark, V.date_from_parts(*[F.lit(v).cast("string") for v in (y, m, d)])) == want


def test_bounds_do_not_overflow(spark):
    top = (1 << 63) - 1
    for o, n, s, want in [(0, 0, 0, True), (5, 5, 10, True), (5, 6, 10, False), (top, top, 10, False), (-1, 1, 10, False), (1, top, top, False), (0, top, top, True)]:
        assert one(spark, V.bounds_ok(F.lit(o).cast("bigint"), F.lit(n).cast("bigint"), F.lit(s).cast("bigint"))) is want


def test_names(spark):
    for name, stem, ext in [("a.flac", "a", ".flac"), (".hidden", ".hidden", ""), ("a.", "a", "."), ("a.b.c", "a.b", ".c"), ("plain", "plain", ""), ("a\n.b", "a\n", ".b")]:
        assert (one(spark, P.stem(F.lit(name))), one(spark, P.dotted_extension(F.lit(name)))) == (stem, ext)
    long = "é" * 200 + ".flac"
    cut = one(spark, P.truncate_leaf(F.lit(long)))
    assert cut == "é" * 125 + ".flac" and len(cut.encode()) == 255
    assert one(spark, P.truncate_directory(F.lit("😀" * 100))) == "😀" * 63
    huge_ext = "a." + "x" * 300
    assert one(spark, P.truncate_leaf(F.lit(huge_ext))) == huge_ext[:255]
    assert one(spark, P.suffix_candidate(F.lit("x" * 251 + ".mp3"), F.lit(10))) == "x" * 246 + " (10).mp3"


def test_scope_is_by_component(spark):
    f = lambda p, r: one(spark, P.under_root(F.lit(p), r))
    assert f("/a/b", "/a/b") and f("/a/b/c", "/a/b/") and not f("/a/bc", "/a/b")


def test_relative_path(spark):
    for p, want in [("/a/b.flac", "a/b"), ("x/.hidden", "x/.hidden"), ("a.b/c", "a.b/c"), ("//z.tar.gz", "z.tar")]:
        assert one(spark, P.relative_path(F.lit(p))) == want


def test_fingerprint_is_injective(spark):
    pairs = [("ab", "c"), ("a", "bc"), (None, "abc"), ("abc", None), ("", "abc"), ('a","', "b")]
    got = {one(spark, V.record_fingerprint(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in pairs}
    assert len(got) == len(pairs)


def test_sniff(spark):
    f = lambda d, n: one(spark, V.sniff_image_type(F.lit(bytearray(d)), F.lit(n)))
    assert f(b"\xff\xd8\xff\xe0", "x.png") == "image/jpeg"
    assert f(b"RIFF0000WEBP", "x") == "image/webp"
    assert f(b"nope", "/a.b/c.JPG") == "image/jpeg"
    assert f(b"nope", "/a.png/c") == "application/octet-stream"
