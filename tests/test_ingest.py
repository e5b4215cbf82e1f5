import pytest

from shelfmark.operators import catalog as C
from shelfmark.operators import ingest as I
from shelfmark.plans import scan as SC
from shelfmark.schemas import STRUCTURAL_BLOCKS, TRACKS

TRACK = "id bigint, backing_path string, format string, audio_offset bigint, audio_length bigint, backing_size bigint, backing_mtime_ns bigint, backing_ctime_ns bigint, content_version bigint, updated_at bigint, fingerprint string, content_hash string"
FILES = "path string, size bigint, mtime_ns bigint, ctime_ns bigint, fingerprint string, content_hash string"


def track(i, path, fp=None, ch=None, mtime=1):
    return (i, path, "flac", 0, 10, 10, mtime, mtime, 0, 5, fp, ch)


# What stands on disk, what is stored, strictness -> action of /new.flac
MOVES = {
    "no candidate": ([], [("/here.flac", "f0", None)], "auto", ("insert", None)),
    "missing candidate": ([], [("/old.flac", "fp", None)], "auto", ("retarget", 1)),
    "candidate still there": (["/old.flac"], [("/old.flac", "fp", None)], "auto", ("insert", None)),
    "hash agrees": ([], [("/old.flac", "fp", "h")], "auto", ("retarget", 1)),
    "hash differs": ([], [("/old.flac", "fp", "other")], "auto", ("insert", None)),
    "fast ignores hash": ([], [("/old.flac", "fp", "other")], "fast", ("retarget", 1)),
    "strict needs a hash": ([], [("/old.flac", "fp", None)], "strict", ("insert", None)),
    "strict with hash": ([], [("/old.flac", "fp", "h")], "strict", ("retarget", 1)),
    "two candidates": ([], [("/old.flac", "fp", None), ("/old2.flac", "fp", None)], "auto", ("insert", None)),
    "one of two there": (["/old2.flac"], [("/old.flac", "fp", None), ("/old2.flac", "fp", None)], "auto", ("retarget", 1)),
}


@pytest.mark.parametrize("case", MOVES)
def test_move_matrix(spark, case):
    disk, stored, strictness, want = MOVES[case]
    files = spark.createDataFrame([("/new.flac", 10, 1, 1, "fp", "h")] + [(p, 10, 1, 1, "fp", "h") for p in disk], FILES)
    tracks = spark.createDataFrame([track(n + 1, p, fp, ch) for n, (p, fp, ch) in enumerate(stored)], TRACK)
    rows = I.match_moves(files, tracks, files, strictness, roots=["/"]).where("path = '/new.flac'").collect()
    assert [(r.action, r.track_id) for r in rows] == [want]


def test_two_files_one_orphan_and_unknown_presence(spark):
    files = spark.createDataFrame([("/b.flac", 10, 1, 1, "fp", None), ("/a.flac", 10, 1, 1, "fp", None)], FILES)
    tracks = spark.createDataFrame([track(1, "/old.flac", "fp")], TRACK)
    got = {r.path: r.action for r in I.match_moves(files, tracks, files, roots=["/"]).collect()}
    assert got == {"/a.flac": "retarget", "/b.flac": "insert"}
    seen = spark.createDataFrame([("/old.flac", "unknown")], "path string, presence string")
    got = {r.action for r in I.match_moves(files, tracks, seen, roots=["/"]).collect()}
    assert got == {"insert"}


def test_moves_only_from_listed_roots(spark):
    files = spark.createDataFrame([("/A/copy.flac", 10, 1, 1, "fp", None)], FILES)
    tracks = spark.createDataFrame([track(1, "/B/x.flac", "fp")], TRACK)
    action = lambda seen, **kw: I.match_moves(files, tracks, seen, **kw).head().action
    assert action(files, roots=["/A"]) == "insert" and action(files) == "insert"
    assert action(files, roots=["/A", "/B"]) == "retarget"
    gone = spark.createDataFrame([("/A/copy.flac", "present"), ("/B/x.flac", "absent")], "path string, presence string")
    assert action(gone, roots=["/A"]) == "retarget"
    with pytest.raises(ValueError):
        SC.revalidate(files, {"tracks": tracks}, 1, prune=True)


def test_scan_is_additive_and_repeatable(spark):
    files = spark.createDataFrame([("/m/a.flac", 10, 1, 1, "f1", None), ("/m/b.txt", 1, 1, 1, None, None), ("/m/c.ogg", 10, 1, 1, "f3", None)], FILES)
    cat = {"tracks": spark.createDataFrame([track(3, "/m/a.flac", "f1")], TRACK)}
    out = SC.scan(files, cat, 99)
    assert tuple(out.stats.head()) == (1, 1, 0, 0, 1, 1)
    got = {(r.id, r.backing_path, r.format) for r in out.catalogue["tracks"].collect()}
    assert got == {(3, "/m/a.flac", "flac"), (4, "/m/c.ogg", "vorbis")}
    again = SC.scan(files, out.catalogue, 100)
    assert tuple(again.stats.head()) == (0, 0, 0, 0, 1, 2)


def test_revalidate_settles(spark):
    files = spark.createDataFrame([("/m/a.mp3", 10, 2, 2, "f1", "h1"), ("/m/b.mp3", 10, 1, 1, "f2", "h2")], FILES)
    empty = lambda s: spark.createDataFrame([], s)
    cat = {
        "tracks": spark.createDataFrame([(1, "/m/a.mp3", "mp3", 0, 10, 10, 1, 1, 0, 5, None, None), (2, "/m/b.mp3", "mp3", 0, 10, 10, 1, 1, 0, 5, "f2", "h2"), (3, "/m/gone.mp3", "mp3", 0, 10, 10, 1, 1, 0, 5, None, None), (4, "/elsewhere/x.mp3", "mp3", 0, 10, 10, 1, 1, 0, 5, None, None)], TRACKS),
        "structural_blocks": empty(STRUCTURAL_BLOCKS),
        "tags": spark.createDataFrame([(3, "title", "t", 0, None), (1, "title", "t", 0, None)], "track_id bigint, key string, value string, ordinal bigint, value_blob binary"),
        "track_art": empty("track_id bigint, art_id bigint, picture_type int, description string, ordinal bigint"),
        "art": empty("id bigint, sha256 string"),
    }
    out = SC.revalidate(files, cat, 9, "/m", "full", prune=True)
    assert tuple(out.stats.head()) == (1, 1, 1)
    assert {r.id for r in out.catalogue["tracks"].collect()} == {1, 2, 4}
    assert {r.track_id for r in out.catalogue["tags"].collect()} == {1}
    again = SC.revalidate(files, out.catalogue, 10, "/m", "full", prune=True)
    assert tuple(again.stats.head()) == (0, 2, 0)


def test_duplicate_paths_fail(spark):
    with pytest.raises(C.DuplicatePath):
        C.require_unique_paths(spark.createDataFrame([track(1, "/a"), track(2, "/a")], TRACK))


def test_inventory_reads_no_content(spark, tmp_path):
    from shelfmark.sources.inventory import file_inventory

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.flac").write_bytes(b"12345")
    inv = file_inventory(spark, [str(tmp_path)])
    assert [(r.path, r.size) for r in inv.collect()] == [(str(tmp_path / "d" / "a.flac"), 5)]
    assert "content" not in inv._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
