"""Rows of a track are shuffled once, short ones as they are; order is what counts, wherever and in whatever partitions the rows lie."""

from pyspark.sql import functions as F

from shelfmark.operators import fingerprint as FP
from test_fingerprint import prints


def tracks(spark, n=4):
    return spark.range(n).selectExpr("id", "'mp3' AS format", "0L AS audio_offset", "1L AS audio_length")


def rows(spark, n=4):
    return spark.range(n).selectExpr("id AS track_id", "CAST(0 AS tinyint) AS kind", "'k' AS key", "0L AS ordinal", "CAST('d' AS binary) AS digest")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_shuffled_once_or_not_at_all(spark):
    stored = spark.createDataFrame(rows(spark).collect(), rows(spark).schema)  # a range lies by its id
    for kept in (stored, stored.repartition("track_id")):
        p = plan(FP._fingerprints(tracks(spark), kept))
        assert p.count("Exchange hashpartitioning(track_id") == 1 and p.count("Exchange hashpartitioning") <= 2


def test_links_of_the_fixture_lie_by_track(spark, fx):
    p = plan(fx.track_art().groupBy("track_id").count())
    assert p.count("Exchange hashpartitioning(track_id") == 1 and "Exchange hashpartitioning(l_orderkey" not in p


def test_short_values_stand_for_themselves(spark):
    tags = spark.createDataFrame([(1, "a", "x" * n, 0, None) for n in (0, 31, 32, 3000)] + [(1, "a", "", 0, b"1"), (1, "a", None, 0, None)], "track_id bigint, key string, value string, ordinal bigint, value_blob binary")
    none = spark.range(0)
    pictures = none.selectExpr("id AS track_id", "id AS ordinal", "'' AS sha256", "'' AS mime", "0 AS width", "0 AS height", "0 AS picture_type", "'' AS description")
    made = FP._children(tags, pictures, none.selectExpr("id AS track_id", "id AS ordinal", "'' AS kind", "X'00' AS body"))[0]
    assert [r.n for r in made.select(F.octet_length("digest").alias("n")).collect()] == [0, 31, 32, 32, 32, 32]


def test_neither_keys_values_nor_kinds_run_together(spark):
    sides = [("ab", "c", 0, None)], [("a", "bc", 0, None)], [("a", "b", 0, None), ("a", "c", 1, None)], [("a", "b,0:61:63", 0, None)], [("a", "", 0, None)], [("a", None, 0, None)], [("", "a", 0, None)], [(None, "a", 0, None)]
    got = prints(spark, [(i, *t) for i, side in enumerate(sides) for t in side], tracks=[(i, "flac", 0, 5) for i in range(len(sides) + 1)])
    assert len(set(got.values())) == len(sides) + 1


def test_gaps_between_ordinals_are_not_content(spark):
    got = prints(spark, [(1, "a", "x", 0, None), (1, "a", "y", 1, None), (2, "a", "x", -7, None), (2, "a", "y", 5 * FP.RUN, None)])
    assert got[1] == got[2]


def test_partitions_follow_the_tracks_and_change_no_digest(spark, monkeypatch):
    tags = [(i, k, f"v{i % 5}", 0, None) for i in range(60) for k in "abc"]
    of = [(i, "flac", 0, 5) for i in range(60)]
    merged = prints(spark, tags, tracks=of)
    for limit in (59, 6):
        monkeypatch.setattr(FP, "TASK_TRACKS", limit)
        assert prints(spark, tags, tracks=of) == merged
    p = plan(FP._fingerprints(tracks(spark, 60), rows(spark, 60)))
    assert p.count("10), REPARTITION_BY_NUM") == 2 and p.count("Exchange hashpartitioning(") == 2


def test_lines_are_counted_before_their_join_and_numbered_as_before(spark, fx):
    got = {(r.track_id, r.ordinal) for r in fx.track_art().select("track_id", "ordinal").collect()}
    ends = fx.track_art().groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("top")).collect()
    assert len(got) == sum(r.n for r in ends) and all(r.top == r.n - 1 for r in ends)
