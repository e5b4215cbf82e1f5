import pytest
from pyspark.sql import functions as F

from shelfmark.functions.template import TemplateError, read_template, referenced_fields, template_column

# template, fields, fallbacks, default, expected path
CASES = [
    ("$artist/$title", {"artist": "A", "title": "T"}, {}, "Unknown", "A/T.flac"),
    ("${ARTIST} - $Title", {"artist": "A", "title": "T"}, {}, "", "A - T.flac"),
    ("$artist/$title", {"title": "T"}, {}, "Unknown", "Unknown/T.flac"),
    ("$artist", {"artist": ""}, {"artist": "F"}, "D", "F.flac"),
    ("${a|b|c}", {"b": "", "c": "C"}, {}, "D", "C.flac"),
    ("${a|b}", {"b": "B"}, {"a": "FA"}, "D", "FA.flac"),
    ("$artist", {"artist": "AC/DC\n"}, {}, "", "AC_DC_.flac"),
    ("$!{dir}/x", {"dir": "/a//./b/../c/"}, {}, "", "a/b/c/x.flac"),
    ("$!{dir|t}", {"dir": "/./..", "t": "T"}, {}, "", "T.flac"),
    ("$!{dir}", {"dir": ""}, {"dir": "hidden"}, "D", "D.flac"),
    ("$t[ ($d)]", {"t": "T"}, {}, "D", "T.flac"),
    ("$t[ ($d)]", {"t": "T", "d": "2"}, {}, "D", "T (2).flac"),
    ("$t[ x[ $d]$e]", {"t": "T", "d": "2"}, {}, "D", "T x 2.flac"),
    ("$t[only text]", {"t": "T"}, {}, "D", "T.flac"),
    ("$[$t$] ] $ $! $$t", {"t": "T"}, {}, "", "[T] ] $ $! $T.flac"),
    ("a$", {}, {}, "", "a$.flac"),
    ("$missing", {}, {}, "a/b", "a_b.flac"),
]


def test_golden(spark):
    for template, fields, fallbacks, default, want in CASES:
        lookup = lambda n: F.lit(fields.get(n)).cast("string")
        got = spark.range(1).select(template_column(template, lookup, fallbacks, default, F.lit("flac"))).head()[0]
        assert got == want, template


def test_skip_missing(spark):
    lookup = lambda n: F.lit({"a": "A"}.get(n)).cast("string")
    pick = lambda t: spark.range(1).select(template_column(t, lookup, {"c": "C"}, "D", F.lit("x"), skip_missing=True)).head()[0]
    assert pick("$a/$b") is None
    assert pick("$a[/$b]/$c") == "A/C.x"


@pytest.mark.parametrize("bad", ["${a", "$!{a", "a[b", "[[a]", "tab\there", "[" * 65 + "$a" + "]" * 65])
def test_errors(bad):
    with pytest.raises(TemplateError):
        read_template(bad)


def test_deepest_allowed_section_and_fields():
    assert referenced_fields("[" * 64 + "$Deep" + "]" * 64 + "${B|a}$!{c}") == ["a", "b", "c", "deep"]


def test_path_field_is_capped_at_64_segments(spark):
    value = F.lit("/".join(["s"] * 100))
    got = spark.range(1).select(template_column("$!{p}", lambda n: value)).head()[0]
    assert got.count("/") == 63
