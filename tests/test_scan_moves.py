from pyspark.sql import functions as F

from shelfmark.operators import catalog as C
from shelfmark.operators import ingest as I

TRACK = "id bigint, backing_path string, format string, audio_offset bigint, audio_length bigint, backing_size bigint, backing_mtime_ns bigint, backing_ctime_ns bigint, content_version bigint, updated_at bigint, fingerprint string, content_hash string"
FILE = "path string, format string, audio_offset bigint, audio_length bigint, backing_size bigint, backing_mtime_ns bigint, backing_ctime_ns bigint, fingerprint string, content_hash string"


def test_files_that_bring_their_track_are_not_looked_up_again(spark):
    tracks = spark.createDataFrame([(1, "/a", "mp3", 0, 1, 1, 1, 1, 0, 0, "x", None), (2, "/b", "mp3", 0, 1, 1, 1, 1, 0, 0, "y", None)], TRACK)
    files = spark.createDataFrame([("/a", "x", None), ("/c", "y", None), ("/d", "y", None)], "path string, fingerprint string, content_hash string")
    known = files.withColumn("known_id", F.when(F.col("path") == "/a", 1).cast("bigint"))
    for given in (files, known):
        got = I.match_moves(given, tracks, files, roots=["/"])
        assert got.columns == ["path", "fingerprint", "content_hash", "action", "track_id", "candidates"]
        assert sorted(map(tuple, got.select("path", "action", "track_id", "candidates").collect())) == [("/a", "upsert", 1, 0), ("/c", "retarget", 2, 1), ("/d", "insert", None, 1)]


def test_actions_change_tracks_as_a_move_and_an_upsert_do(spark, monkeypatch):
    tracks = spark.createDataFrame([(i, f"/{i}", "mp3", i, 1, 1, i, i, i, 3, f"f{i}", None) for i in range(1, 9)], TRACK)
    row = lambda path, fmt, i, v, fp: (path, fmt, i, 1, 1, v, v + 1, fp, "h")
    rows = [row("/1", "mp3", 1, 1, None), row("/2", "flac", 2, 2, "n"), row("/3", None, 3, 9, None), row("/m4", "wav", 4, 4, "f4"), row("/m5", "mp3", 0, 5, None), row("/n", "mp3", 0, 1, "q"), row("/o", "wav", 0, 1, None)]
    does = {"/1": ("upsert", 1), "/2": ("upsert", 2), "/3": ("upsert", 3), "/m4": ("retarget", 4), "/m5": ("retarget", 5)}
    acts = spark.createDataFrame([(*r, *does.get(r[0], ("insert", None))) for r in rows], FILE + ", action string, track_id bigint")
    moves = acts.where("action = 'retarget'").withColumnsRenamed({"track_id": "id", "path": "new_path"})
    want = C.upsert_tracks(C.retarget_tracks(tracks, moves, 7), acts.where("action <> 'retarget'").withColumnRenamed("path", "backing_path"), 7)
    want = sorted(map(str, want.select(*tracks.columns).collect()))
    for few in (C.FEW_IDS, 0):
        monkeypatch.setattr(C, "FEW_IDS", few)
        assert sorted(map(str, C.apply_actions(tracks, acts, 7).select(*tracks.columns).collect())) == want
