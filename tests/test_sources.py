import os

from shelfmark.operators.ingest import missing_tracks
from shelfmark.sources import folders
from shelfmark.sources.folders import folder_inventory
from shelfmark.sources.inventory import read_landed


def test_folders_are_partitions_and_failures_are_rows(spark, tmp_path, monkeypatch):
    for name in ("a/x.flac", "a/b/y.mp3", "c/z.flac", "top.flac"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    os.symlink(tmp_path / "nowhere", tmp_path / "c/lost.flac")
    os.symlink("loop.flac", tmp_path / "c/loop.flac")
    df = folder_inventory(spark, [str(tmp_path), str(tmp_path / "no such root")])
    assert df.rdd.getNumPartitions() == 4
    rows = {os.path.relpath(r.path, tmp_path): r for r in df.collect()}
    assert {p for p, r in rows.items() if r.presence == "present"} == {"a/x.flac", "a/b/y.mp3", "c/z.flac", "top.flac"}
    assert rows["top.flac"].size == 5 and rows["top.flac"].mtime_ns == os.stat(tmp_path / "top.flac").st_mtime_ns
    assert rows["c/lost.flac"].presence == "absent" and rows["no such root"].presence == "absent"
    assert (rows["c/loop.flac"].presence, rows["c/loop.flac"].error) == ("unknown", "OSError")
    one = folder_inventory(spark, [str(tmp_path / "top.flac")]).collect()
    assert [(r.size, r.presence) for r in one] == [(5, "present")]
    # A file that could not be looked at is no missing track; one that went away is.
    tracks = spark.createDataFrame([(1, str(tmp_path / "c/loop.flac")), (2, str(tmp_path / "c/lost.flac")), (3, str(tmp_path / "a/x.flac"))], "id bigint, backing_path string")
    assert [r.id for r in missing_tracks(tracks, df, str(tmp_path)).collect()] == [2]


def test_an_unreadable_folder_is_a_row(tmp_path, monkeypatch):
    def refuse(path):
        raise PermissionError(path)

    monkeypatch.setattr(folders.os, "scandir", refuse)
    assert list(folders._walk(str(tmp_path), True)) == [(str(tmp_path), None, None, None, "unknown", "PermissionError")]


def test_landed_lines(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": "1", "title": "A", "new": 1}\n[{"id": "2"}, {"id": "3", "images": "none"}, 7]\n\n{"id": "4"\n[{"id": "5"}, {"id"\nnot json\n')
    got = read_landed(spark, str(tmp_path), "albums")
    assert sorted((r.id, r.title) for r in got.records.collect()) == [("1", "A"), ("2", None)]
    assert sorted(r.text for r in got.rejects.collect()) == sorted(['{"id":"3","images":"none"}', "7", '{"id": "4"', '[{"id": "5"}, {"id"', "not json"])
    assert all(r.file.endswith("one.json") for r in got.rejects.collect())
    assert [tuple(r) for r in got.drift.collect()] == [("new", 1)]
