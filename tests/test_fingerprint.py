from shelfmark.operators import fingerprint as FP

TAGS = "track_id bigint, key string, value string, ordinal bigint, value_blob binary"


def prints(spark, tags, tracks=((1, "flac", 0, 5), (2, "flac", 0, 5)), links=(), blocks=()):
    catalogue = {
        "tracks": spark.createDataFrame(list(tracks), "id bigint, format string, audio_offset bigint, audio_length bigint"),
        "tags": spark.createDataFrame(list(tags), TAGS),
        "art": spark.createDataFrame([(7, "aa", "image/png", None, None), (8, "bb", "image/png", None, None)], "id bigint, sha256 string, mime string, width int, height int"),
        "track_art": spark.createDataFrame(list(links), "track_id bigint, art_id bigint, picture_type int, description string, ordinal bigint"),
        "structural_blocks": spark.createDataFrame(list(blocks), "track_id bigint, kind string, ordinal bigint, body binary"),
    }
    return {r.id: r.fingerprint for r in FP.catalogue_fingerprints(catalogue).collect()}


def test_equal_content_and_every_difference(spark):
    base = [("a", "x", 0, None), ("a", "y", 1, None), ("b", "", 0, b"1")]
    mine = [(1, *t) for t in base]
    for other in ([*base[:2]], [("a", "y", 0, None), ("a", "x", 1, None), base[2]], [("a", "x", 0, None), ("a", "y", 1, None), ("b", "", 0, b"2")], [("a", "x,y", 0, None), base[2]], [("b", "x", 0, None), ("a", "y", 1, None), ("b", "", 0, b"1")]):
        got = prints(spark, mine + [(2, *t) for t in other])
        assert got[1] != got[2]
    same = prints(spark, [(2, *t) for t in base] + mine[::-1])
    assert same[1] == same[2]
    links = [(1, 7, 3, "", 0), (1, 8, 4, "", 1), (2, 8, 4, "", 0), (2, 7, 3, "", 1)]
    assert len(set(prints(spark, [], links=links).values())) == 2
    assert len(set(prints(spark, [], blocks=[(1, "A", 0, b"x"), (2, "B", 0, b"x")]).values())) == 2
    assert len(set(prints(spark, [], tracks=[(1, "flac", 0, 5), (2, "mp3", 0, 5)]).values())) == 2
    assert len(set(prints(spark, []).values())) == 1


def test_a_track_of_many_rows_is_digested_in_runs(spark, monkeypatch):
    monkeypatch.setattr(FP, "RUN", 4)
    rows = [("k", f"v{i}", i, None) for i in range(100)]
    swapped = rows[:50] + [("k", "v51", 50, None), ("k", "v50", 51, None)] + rows[52:]
    got = prints(spark, [(1, *t) for t in rows] + [(2, *t) for t in swapped])
    assert got[1] != got[2]
    got = prints(spark, [(1, *t) for t in rows] + [(2, *t) for t in rows[::-1]])
    assert got[1] == got[2]


def test_a_key_is_content_and_digests_are_shuffled_twice(spark):
    got = prints(spark, [(1, "title", "x", 0, None), (2, "album", "x", 0, None)])
    assert got[1] != got[2]
    rows = spark.range(4).selectExpr("id AS track_id", "CAST(0 AS tinyint) AS kind", "'k' AS key", "0L AS ordinal", "CAST('d' AS binary) AS digest")
    tracks = spark.range(4).selectExpr("id", "'mp3' AS format", "0L AS audio_offset", "1L AS audio_length")
    plan = FP._fingerprints(tracks, rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") + plan.count("SortAggregate") == 4 and plan.count("hashpartitioning(track_id") <= 2
