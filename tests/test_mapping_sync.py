
import hashlib
import re

from shelfmark.operators import catalog as C
from shelfmark.operators import mapping as M
from shelfmark.operators import ordered as O
from shelfmark.operators import sync as S
from shelfmark.schemas import ART, TAGS, TRACK_ART, TRACKS

# Rows every host mapper must give for the same metadata.
CONTRACT = sorted([("album", "Low Tide"), ("albumartist", "The Fens"), ("artist", "M. Okoro"), ("composer", "N. Lind"), ("genre", "dub"), ("genre", "folk"), ("genre", "noise"), ("title", "Reeds")])


def test_contract_of_the_importer(spark):
    items = spark.createDataFrame(
        [("/p", "Reeds", "M. Okoro", "The Fens", "Low Tide", ["noise", "dub", "folk"], ["N. Lind"])],
        "path string, title string, artist string, albumartist string, album string, genres array<string>, composers array<string>",
    )
    assert sorted((r.key, r.value) for r in M.map_importer_items(items).collect()) == CONTRACT


def test_contract_of_the_tagger(spark):
    rows = [("/p", n, k, v) for n, (k, v) in enumerate(CONTRACT)]
    got = M.map_tagger_values(spark.createDataFrame(rows, "record_key string, pos bigint, name string, value string"))
    assert sorted((r.key, r.value) for r in got.collect()) == CONTRACT


def catalogue(spark):
    return {
        "tracks": spark.createDataFrame([(1, "/a", "flac", 0, 1, 1, 1, 1, 10, 0, None, None), (2, "/b", "flac", 0, 1, 1, 1, 1, 20, 0, None, None)], TRACKS),
        "tags": spark.createDataFrame(
            [(1, "LABEL", "old", 0, None), (1, "title", "old", 0, None), (1, "bin", "", 0, bytearray(b"x")), (2, "title", "keep", 0, None)], TAGS
        ),
        "art": spark.createDataFrame([(1, "s" * 64, "image/png", None, None, 1, bytearray(b"z"))], ART),
        "track_art": spark.createDataFrame([(1, 1, 3, "", 0)], TRACK_ART),
    }


PAIRS = "record_key string, pos bigint, key string, value string"
IMAGES = "record_key string, pos bigint, data binary, mime string, picture_type int, description string"


def tags_of(cat):
    return sorted((r.track_id, r.key, r.value, r.ordinal) for r in cat["tags"].collect())


def test_replace_and_merge(spark):
    pairs = spark.createDataFrame([("/a", 0, "label", "new"), ("/a", 1, "genre", "g1"), ("/a", 2, "genre", "g0"), ("/lost", 0, "title", "x")], PAIRS)
    out, stats, _, bumps = S.sync_records(catalogue(spark), pairs)
    assert tags_of(out) == [(1, "bin", "", 0), (1, "genre", "g0", 1), (1, "genre", "g1", 0), (1, "label", "new", 0), (2, "title", "keep", 0)]
    assert tuple(stats.head()) == (1, 1, 0, 0, 0)
    assert {r.track_id: r.steps for r in bumps.collect()} == {1: 5}
    out, _, _, bumps = S.sync_records(catalogue(spark), pairs, mode="merge")
    assert tags_of(out) == [(1, "bin", "", 0), (1, "genre", "g0", 1), (1, "genre", "g1", 0), (1, "label", "new", 0), (1, "title", "old", 0), (2, "title", "keep", 0)]
    assert {r.id: r.content_version for r in out["tracks"].collect()} == {1: 14, 2: 20}


def test_merge_deletes_named_keys_only(spark):
    pairs = spark.createDataFrame([], PAIRS)
    deletes = spark.createDataFrame([("/a", "TITLE")], "record_key string, key string")
    out, _, _, _ = S.sync_records(catalogue(spark), pairs, deletes=deletes, mode="merge")
    assert tags_of(out) == [(1, "LABEL", "old", 0), (1, "bin", "", 0), (2, "title", "keep", 0)]


def test_one_bad_row_rejects_its_record_whole(spark):
    pairs = spark.createDataFrame([("/a", 0, "ok", "v"), ("/a", 1, "bad\nkey", "v"), ("/b", 0, "title", "new")], PAIRS)
    art = spark.createDataFrame([("/a", 0, bytearray(b"img"), "image/png", 3, "")], IMAGES)
    out, stats, problems, _ = S.sync_records(catalogue(spark), pairs, art)
    assert tags_of(out) == [(1, "LABEL", "old", 0), (1, "bin", "", 0), (1, "title", "old", 0), (2, "title", "new", 0)]
    assert tuple(stats.head()) == (1, 0, 0, 0, 1)
    assert [tuple(r) for r in problems.collect()] == [("/a", "key_control")]
    dry = S.sync_records(catalogue(spark), pairs, art, dry_run=True)
    assert tuple(dry[1].head()) == (2, 0, 1, 0, 0)


def test_oversize_art_keeps_the_old_links(spark):
    big = bytearray(16711681)
    none = spark.createDataFrame([], PAIRS)
    art = spark.createDataFrame([("/a", 0, big, "image/png", 3, "")], IMAGES)
    out, stats, _, _ = S.sync_records(catalogue(spark), none, art)
    assert [(r.track_id, r.art_id) for r in out["track_art"].collect()] == [(1, 1)]
    assert tuple(stats.head()) == (1, 0, 0, 1, 0)
    art = art.unionByName(spark.createDataFrame([("/a", 1, bytearray(b"ok"), "image/png", 4, "d")], IMAGES))
    out, stats, _, _ = S.sync_records(catalogue(spark), none, art)
    assert [(r.track_id, r.art_id, r.picture_type, r.ordinal) for r in out["track_art"].collect()] == [(1, 2, 4, 0)]
    assert tuple(stats.head()) == (1, 0, 1, 1, 0)
    assert C.orphan_art(out["art"], out["track_art"]).count() == 1
    left = C.live_art(out["art"], out["track_art"])
    assert C.orphan_links(out["track_art"], left).count() == 0


def test_sync_twice_is_sync_once(spark):
    pairs = spark.createDataFrame([("/a", 0, "title", "n")], PAIRS)
    once = S.sync_records(catalogue(spark), pairs, mode="merge")[0]
    twice = S.sync_records(once, pairs, mode="merge")[0]
    assert tags_of(once) == tags_of(twice)
    assert {r.content_version for r in twice["tracks"].where("id = 1").collect()} == {14}


def test_ambiguous_file_is_an_error(spark):
    import pytest

    with pytest.raises(M.AmbiguousFile):
        M.require_unambiguous(spark.createDataFrame([("/p", "ambiguous")], "path string, status string"))


def sync_case(spark):
    """A good record with replaced, new and deleted keys and pictures old and new, one with a bad row, one without a track."""
    cat = catalogue(spark)
    stored = bytearray(b"stored")
    cat["art"] = spark.createDataFrame([(7, hashlib.sha256(stored).hexdigest(), "image/png", None, None, 6, stored)], ART)
    cat["track_art"] = spark.createDataFrame([(1, 7, 3, "a", 0), (1, 7, 4, "b", 1), (2, 7, 3, "", 0)], TRACK_ART)
    pairs = spark.createDataFrame([("/a", 0, "Label", "l1"), ("/a", 1, "label", "l0"), ("/a", 2, "label", "l2"), ("/b", 0, "", "bad"), ("/lost", 0, "title", "x")], PAIRS)
    art = spark.createDataFrame(
        [("/a", 1, bytearray(b"new"), "image/gif", 3, "n"), ("/a", 0, stored, "image/png", 5, "s"), ("/a", 2, bytearray(b"new"), "image/png", 3, "again"), ("/b", 0, bytearray(b"other"), "image/png", 3, "")], IMAGES
    )
    deletes = spark.createDataFrame([("/a", "TITLE"), ("/b", "title")], "record_key string, key string")
    return cat, pairs, art, deletes


def rows_of(out, stats, problems, bumps):
    frames = {**{t: out[t] for t in ("tracks", "tags", "art", "track_art")}, "stats": stats, "problems": problems, "bumps": bumps}
    return {name: sorted(map(str, df.collect())) for name, df in frames.items()}


def test_large_and_small_sides_of_a_sync_give_the_same(spark, monkeypatch):
    for mode in S.MODES:
        few = rows_of(*S.sync_records(*sync_case(spark), mode=mode))
        with monkeypatch.context() as m:
            m.setattr(S, "FEW_ROWS", 0)
            m.setattr(O, "TASK_ROWS", 1)
            assert rows_of(*S.sync_records(*sync_case(spark), mode=mode)) == few
    out, stats, problems, bumps = S.sync_records(*sync_case(spark), mode="merge")
    assert tags_of(out) == [(1, "Label", "l1", 0), (1, "bin", "", 0), (1, "label", "l0", 0), (1, "label", "l2", 1), (2, "title", "keep", 0)]
    assert sorted((r.id, r.mime, r.byte_len, bytes(r.data)) for r in out["art"].collect()) == [(7, "image/png", 6, b"stored"), (8, "image/gif", 3, b"new")]
    assert sorted(map(tuple, out["track_art"].collect())) == [(1, 7, 5, "s", 0), (1, 8, 3, "again", 2), (1, 8, 3, "n", 1), (2, 7, 3, "", 0)]
    # Two tags and two links go, three tags and three links come.
    assert [tuple(r) for r in bumps.collect()] == [(1, 10)] and tuple(stats.head()) == (1, 1, 1, 0, 1)
    assert [tuple(r) for r in problems.collect()] == [("/b", "key_length")]


def test_versions_pass_stored_tags_once_and_do_not_sort_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FEW_ROWS", 0)
    cat, pairs, art, deletes = sync_case(spark)
    cat["tags"].write.parquet(str(tmp_path / "tags"))
    cat["tags"] = spark.read.parquet(str(tmp_path / "tags"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.sync_records(cat, pairs, art, deletes, mode="merge")[0]
        run = out["tracks"].select("id", "content_version")._jdf.queryExecution()
        assert len(re.findall(r"Relation \[[^\]]*value_blob", run.optimizedPlan().toString())) == 1
        assert "ShuffledHashJoin [track_id" in run.executedPlan().toString() and "SortMergeJoin [track_id" not in run.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
