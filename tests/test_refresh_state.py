"""State in buckets: work follows the change, names equal a full run, breaks and gaps lead to one rebuild."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.plans.view import view
from shelfmark.sources.bucketed import BucketedTable, Marks
from shelfmark.streaming import tail as TL
from shelfmark.streaming.log import ChangeLog
from test_streaming import LOG, TEMPLATE, Library, shown


def pruned(df):
    return re.search(r"PartitionFilters: \[[^\]]*bucket", df._jdf.queryExecution().executedPlan().toString())


def in_buckets(spark, root, lib, buckets=16):
    tables = []
    for name, rows, key in zip(("tracks", "tags"), lib.load(), ("id", "track_id")):
        tables.append(BucketedTable(spark, f"{root}/{name}", rows.schema.toDDL(), key, buckets))
        tables[-1].replace(rows)
    return tables


def test_buckets_are_replaced_and_pruned(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id bigint, x string", "id", 8)
    assert table.read().count() == 0
    table.replace(spark.range(100).select("id", F.lit("a").alias("x")))
    ids = spark.createDataFrame([(3,), (4,), (500,)], "id bigint")
    only = table.buckets_of(ids)
    here = table.read(only)
    assert pruned(here) and len(only) < 4
    gone, n = {r.id for r in here.collect()}, table.read().count()
    table.replace(table.read(only).where("id = 3").withColumn("x", F.lit("b")), only)
    left = {r.id: r.x for r in table.read().collect()}
    assert left == {**{i: "a" for i in range(100) if i not in gone}, 3: "b"} and n == 100
    table.replace(table.read(only).where("false"), only)
    assert {r.id for r in table.read().collect()} == set(range(100)) - gone
    assert pruned(table.matching(ids))


def test_marks_survive_a_write_that_breaks_off(spark, tmp_path):
    marks = Marks(spark, str(tmp_path / "m"))
    assert marks.read() == {}
    for n in range(3):
        marks.write({"n": n})
    assert marks.read() == {"n": 2} and sorted(x for x in os.listdir(tmp_path / "m") if "slot" in x) == ["slot=0", "slot=1"]


@pytest.mark.parametrize("folded", [False, True])
def test_final_names_follow_random_edits(spark, tmp_path, folded):
    rng = random.Random(6 + folded)
    lib = Library(spark)
    state = TL.SnapshotState(spark, str(tmp_path / "s"), buckets=8, places=True, case_insensitive=folded)
    names = ["A", "a", "B", "A (2)", "C", "", "É"]
    now = lambda: {r.id: r.final_path for r in state.read_places().collect()}
    for step in range(3):
        before, last = now(), len(lib.log)
        for _ in range(12 if not step else 3):
            act = rng.choice(["add", "retag", "delete"]) if lib.tracks and step else "add"
            i = rng.choice(list(lib.tracks)) if lib.tracks else None
            if act == "add":
                lib.add(rng.choice(names), rng.choice(["x", "x (2)", "y"]))
            elif act == "retag":
                lib.retag(i, rng.choice(names), rng.choice(["x", "x (2)"]))
            else:
                lib.delete(i)
        tables = in_buckets(spark, str(tmp_path / f"c{step}"), lib)
        TL.apply_batch(state, lib.log_frame(after=last), lambda: tables, TEMPLATE, step, head=(1, len(lib.log)), default="U")
        want = {r.id: r.final_path for r in view(*lib.load(), TEMPLATE, folded, default="U").collect()}
        assert now() == want
        notes = {(r.id, r.reason): r.node for r in state.notes(len(lib.log)).collect()}
        assert {i for i, why in notes if why == "moved"} == {i for i in before if before[i] != want.get(i)}
        assert all(node == before[i] for (i, why), node in notes.items() if why == "moved")


def test_names_near_the_byte_limit_are_placed_as_a_whole(spark, tmp_path):
    lib = Library(spark)
    state = TL.SnapshotState(spark, str(tmp_path / "s"), places=True)
    lib.add("A", "x")
    TL.apply_batch(state, lib.log_frame(), lib.load, TEMPLATE, 0)
    for title in ("q" * 245, "q" * 245, "q" * 250):
        lib.add("", title)
    template = "[$album/]$title"
    TL.apply_batch(state, lib.log_frame(after=1), lib.load, template, 1, head=(1, 4))
    lib.add("", "q" * 248)
    TL.apply_batch(state, lib.log_frame(after=4), lib.load, template, 2, head=(1, 5))
    assert {r.id: r.final_path for r in state.read_places().collect()} == {r.id: r.final_path for r in view(*lib.load(), template).collect()}


def test_rows_read_follow_the_touched_buckets(spark, tmp_path):
    """One track of 400 changes: catalogue and snapshot are read with partition filters on one of 16 buckets."""
    lib = Library(spark)
    for n in range(400):
        lib.add(f"A{n}", "t")
    tables = in_buckets(spark, str(tmp_path / "c"), lib)
    ids = spark.createDataFrame([(7,)], "id bigint")
    for table, key in zip(tables, ("id", "track_id")):
        assert pruned(TL.rows_of(table, ids, key))
        only = table.buckets_of(ids.select(F.col("id").alias(key)))
        assert len(only) == 1 and table.read(only).count() < table.read().count() / 8


def test_log_head_tells_an_emptied_log_from_an_empty_batch(spark, tmp_path):
    lib = Library(spark)
    for n in range(6):
        lib.add("A", f"t{n}")
    log = ChangeLog(spark, str(tmp_path / "log"), ring=4, span=2)
    log.append(lib.log_frame())
    log.append(lib.log_frame(after=4))
    assert log.head() == (3, 6) and sorted(r.seq for r in log.read().collect()) == [3, 4, 5, 6]
    assert sorted(x for x in os.listdir(tmp_path / "log/segments") if "segment" in x) == ["segment=1", "segment=2", "segment=3"]
    state, none = TL.SnapshotState(spark, str(tmp_path / "s")), spark.createDataFrame([], LOG)
    step = lambda rows, batch: TL.apply_batch(state, rows, lib.load, TEMPLATE, batch, head=log.head())
    assert step(log.read(), 0) == "rebuild" and step(none, 1) == "idle"
    lib.retag(1, "B", "x")
    lib.retag(2, "B", "x")
    log.append(lib.log_frame(after=6))
    # A part of the log that begins beyond the watermark is no gap while the log reaches back to it.
    assert step(lib.log_frame(after=7), 2) == "delta"
    log.clear()
    lib.retag(3, "C", "z")
    assert step(none, 3) == "rebuild" and (3, 1, "C/z.flac") in shown(state.read())
    assert step(none, 4) == "idle" and state.facts() == {"last_seq": 8, "gaps": 2, "batch_id": 3}
    lib.log.append((10, 4))
    log.append(spark.createDataFrame([(10, 4)], LOG))
    assert step(log.read(), 5) == "rebuild" and state.facts()["gaps"] == 3


def test_a_broken_batch_is_rebuilt(spark, tmp_path):
    lib = Library(spark)
    lib.add("A", "x")
    state = TL.SnapshotState(spark, str(tmp_path / "s"))
    assert TL.apply_batch(state, lib.log_frame(), lib.load, TEMPLATE, 0) == "delta"
    state.marks.write({**state.marks.read(), "open": 1})
    state.rows.replace(state.rows.read().where("false"))
    lib.add("A", "y")
    assert TL.apply_batch(state, lib.log_frame(after=1), lib.load, TEMPLATE, 1, head=(1, 2)) == "rebuild"
    assert [r[0] for r in shown(state.read())] == [1, 2] and state.facts() == {"last_seq": 2, "gaps": 0, "batch_id": 1}


def test_counters_live_in_the_state_store(spark, tmp_path):
    """Fifty batches; the files of the store stay bounded, and nothing is written beside it."""
    folder, kept = tmp_path / "in", spark.conf.get("spark.sql.shuffle.partitions")
    spark.range(200).select((F.col("id") % 7).alias("track_id"), F.lit(1).cast("bigint").alias("bump"), (F.col("id") % 50).alias("n")).repartition(50, "n").write.partitionBy("n").parquet(str(folder))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "500ms")
    try:
        stream = TL.read_log_stream(spark, f"{folder}/*", "track_id bigint, bump bigint", files_per_trigger=1)
        query = TL.version_counters(stream, str(tmp_path / "c"))
        assert query.lastProgress["batchId"] >= 49
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.streaming.stateStore.maintenanceInterval")
    got = {r.track_id: r.content_version for r in TL.current_counters(spark, str(tmp_path / "c")).collect()}
    assert got == {i: len(range(i, 200, 7)) for i in range(7)}
    stores = [d for d, _, files in os.walk(tmp_path / "c/state") if any(f.endswith(".zip") for f in files)]
    assert stores and all(sum(f.endswith(".zip") for f in os.listdir(d)) < 40 for d in stores)
