import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import refresh as R
from shelfmark.plans.view import render
from shelfmark.sources.versions import VersionStore
from shelfmark.streaming import tail as TL

TEMPLATE = "$album/$title"
LOG = "seq bigint, track_id bigint"


class Library:
    """Tracks and tags on the driver with a change log, as the tests edit them."""

    def __init__(self, spark):
        self.spark, self.tracks, self.log, self.next_id = spark, {}, [], 1

    def touch(self, i):
        self.log.append((len(self.log) + 1, i))

    def add(self, album, title):
        self.tracks[self.next_id] = [0, album, title]
        self.touch(self.next_id)
        self.next_id += 1

    def retag(self, i, album, title):
        self.tracks[i] = [self.tracks[i][0] + 1, album, title]
        self.touch(i)

    def delete(self, i):
        del self.tracks[i]
        self.touch(i)

    def load(self):
        t = self.spark.createDataFrame([(i, v, "flac") for i, (v, _, _) in self.tracks.items()], "id bigint, content_version bigint, format string")
        tags = [(i, k, x, 0) for i, (_, a, b) in self.tracks.items() for k, x in (("album", a), ("title", b)) if x]
        return t, self.spark.createDataFrame(tags, "track_id bigint, key string, value string, ordinal bigint")

    def log_frame(self, after=0):
        return self.spark.createDataFrame([r for r in self.log if r[0] > after], LOG)


def shown(df):
    return sorted((r.id, r.content_version, r.path) for r in df.collect())


def test_random_edits_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    lib = Library(spark)
    state = TL.SnapshotState(spark, str(tmp_path / "s"))
    for step in range(5):
        for _ in range(rng.randint(1, 6)):
            act = rng.choice(["add", "add", "retag", "delete"]) if lib.tracks else "add"
            i = rng.choice(list(lib.tracks)) if lib.tracks else None
            if act == "add":
                lib.add(rng.choice("AB"), rng.choice("xyz"))
            elif act == "retag":
                lib.retag(i, rng.choice(["A", "B", ""]), rng.choice("xyz"))
            else:
                lib.delete(i)
        TL.apply_batch(state, lib.log_frame(), lib.load, TEMPLATE, skip_missing=True)
        want = render(*lib.load(), TEMPLATE, skip_missing=True).where("path is not null")
        assert shown(state.read()) == shown(want)


def test_gap_replay_and_watermark(spark, tmp_path):
    lib = Library(spark)
    for n in range(6):
        lib.add("A", f"t{n}")
    state = TL.SnapshotState(spark, str(tmp_path / "s"))
    # The log no longer reaches back to the watermark 0.
    assert TL.apply_batch(state, lib.log_frame(after=3), lib.load, TEMPLATE, batch_id=0) == "rebuild"
    assert state.facts() == {"last_seq": 6, "gaps": 1, "batch_id": 0}
    assert len(shown(state.read())) == 6
    assert TL.apply_batch(state, lib.log_frame(after=3), lib.load, TEMPLATE, batch_id=0) == "skip"
    assert TL.apply_batch(state, lib.log_frame(), lib.load, TEMPLATE, batch_id=1) == "idle"
    lib.retag(2, "B", "new")
    assert TL.apply_batch(state, lib.log_frame(after=6), lib.load, TEMPLATE, batch_id=2) == "delta"
    assert state.facts()["last_seq"] == 7
    # An emptied log behind a watermark is a gap as well.
    assert TL.apply_batch(state, spark.createDataFrame([], LOG), lib.load, TEMPLATE, batch_id=3) == "rebuild"
    assert state.facts() == {"last_seq": 7, "gaps": 2, "batch_id": 3}


@pytest.mark.parametrize("lost", [0, 3])
def test_stream_over_log_files(spark, fx, tmp_path, lost):
    """Ten files by sequence, one per micro-batch; with the first three gone the gap fires once."""
    log = fx.log().select("seq", "track_id")
    top = log.agg(F.max("seq")).head()[0]
    folder = str(tmp_path / "log")
    for n in range(lost, 10):
        log.where((F.col("seq") > top * n // 10) & (F.col("seq") <= top * (n + 1) // 10)).coalesce(1).write.mode("append").parquet(folder)
    state = TL.SnapshotState(spark, str(tmp_path / "s"))
    tracks, tags = fx.tracks(), fx.tags()
    stream = TL.read_log_stream(spark, folder, log.schema, files_per_trigger=1)
    query = TL.tail_log(stream, state, lambda: (tracks, tags), "$artist/$title", str(tmp_path / "c"))
    want = render(tracks, tags, "$artist/$title")
    if not lost:
        want = want.join(R.changed_ids(log), "id", "left_semi")
    assert shown(state.read()) == shown(want)
    assert state.facts()["last_seq"] == top and state.facts().get("gaps", 0) == (1 if lost else 0)
    assert len(query.recentProgress) >= 10 - lost


def test_versions_pin_unchanged_tables(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "v"))
    assert store.current()["version"] == 0
    store.commit({"a": spark.range(3), "b": spark.range(2)})
    first = store.current()
    store.commit({"a": spark.range(5)}, {"last_seq": 7})
    second = store.current()
    assert (store.read("a", first).count(), store.read("a", second).count(), store.read("b", second).count()) == (3, 5, 2)
    assert dict(second["facts"]) == {"last_seq": 7}


def test_event_actions(spark):
    from shelfmark.schemas import LIBRARY_EVENT
    from shelfmark.streaming.events import parse_events, route_events

    raw = [
        (1, "Test", None, None, None, None, None, None, None),
        (2, "AlbumDownload", "/a||/b", None, None, "7", None, None, None),
        (3, "Rename", None, "/n", "/o", None, "5", None, None),
        (4, "Rename", None, "/n", "", "x", None, None, None),
        (5, "AlbumDeleted", None, None, None, None, None, " mb ", None),
        (6, "ArtistDeleted", None, None, None, None, None, "mb", " "),
        (7, "Odd", None, None, None, "1", None, None, None),
        (8, "TrackRetag", "/a", None, None, "1", None, None, None),
    ]
    events = parse_events(spark.createDataFrame(raw, LIBRARY_EVENT))
    got = {r.event_id: (r.action, r.paths, r.delete_value) for r in route_events(events).collect()}
    assert got == {
        1: ("none", [], None), 2: ("sync", ["/a", "/b"], None), 3: ("sync_prune", ["/n"], None), 4: ("reject", ["/n"], None),
        5: ("delete", [], "mb"), 6: ("none", [], None), 7: ("none", [], None), 8: ("none", [], None),
    }
    assert {r.event_id: r.action for r in route_events(events, symlinked=True).collect()}[3] == "sync"
