"""What a scan and a log move and write, however long the input."""

import os

from shelfmark.operators import children as CH
from shelfmark.operators import ingest as I
from shelfmark.plans import scan as SC
from shelfmark.schemas import TRACKS
from shelfmark.streaming.log import ChangeLog

from test_children import BLOCKS, stored


def test_a_long_batch_writes_the_segments_that_stay(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ring=8, span=2)
    written = []
    log._drop_before = lambda segment: written.append(sorted(n for n in os.listdir(log.path) if n.startswith("segment=")))
    log.append(spark.range(1, 101).selectExpr("id AS seq", "id % 3 AS track_id"))
    assert written == [[f"segment={n}" for n in (46, 47, 48, 49, 50)]]
    assert log.head() == (93, 100) and sorted(r.seq for r in log.read().collect()) == list(range(93, 101))


def test_rows_are_numbered_where_the_join_has_brought_them(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = spark.createDataFrame([("/a", 3, "SEEKTABLE", b"y"), ("/a", 1, "SEEKTABLE", b"x"), ("/a", 2, "PADDING", b"p")], BLOCKS)
        ids = spark.createDataFrame([("/a", 7)], "path string, track_id bigint")
        out = CH.file_blocks(given.join(ids, "path"), given)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted((r.track_id, r.ordinal, bytes(r.body)) for r in out.collect()) == [(7, 0, b"x"), (7, 1, b"y")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_states_tell_which_tracks_are_gone(spark):
    """As `gone_tracks` does, also for a path listed as absent and as present, and for further paths of one file."""
    tracks = spark.createDataFrame([stored(n, p, fp=f) for n, p, f in [(1, "/m/a.flac", "f1"), (2, "/m/b.flac", "f2"), (3, "/x/c.flac", "f3"), (4, "/x/d.flac", "f4"), (5, "/m/e.flac", None), (6, "/m/f.flac", "f6"), (7, "/x/g.flac", "f7")]], TRACKS)
    rows = [("/m/a.flac", "present", 1), ("/x/c.flac", "absent", 2), ("/x/g.flac", "absent", 3), ("/x/g.flac", "present", 4), ("/m/0.flac", "present", 5), ("/m/f.flac", "present", 5)]
    files = spark.createDataFrame([(p, 10, 1, 1, seen, 1, n) for p, seen, n in rows], "path string, size bigint, mtime_ns bigint, ctime_ns bigint, presence string, device bigint, inode bigint")
    for inventory, identity in ((files, ()), (files, ("device", "inode")), (files.drop("presence"), ("device", "inode"))):
        got = SC.scan_states(inventory, tracks, identity=identity, roots=["/m"]).where("gone_id IS NOT NULL").select("gone_id").distinct()
        want = I.gone_tracks(tracks.where("fingerprint IS NOT NULL"), inventory, ["/m"])
        assert sorted(r.gone_id for r in got.collect()) == sorted(r.id for r in want.collect())
