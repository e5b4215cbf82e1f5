from pyspark.sql import functions as F

from shelfmark.operators import catalog as C
from shelfmark.operators import layout as L
from shelfmark.operators import ordered as O
from shelfmark.operators import rules as RU
from shelfmark.plans import scan as SC
from shelfmark.sources import bucketed as B
from shelfmark.sources.shared import materialize


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_child_rows_are_not_sorted_to_find_lost_tracks(spark, monkeypatch):
    tracks = spark.range(10).withColumn("id", F.col("id"))
    tags = spark.range(12).select(F.col("id").alias("track_id"), F.lit("k").alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lost = C.dangling_references({"tracks": tracks, "tags": tags})
        assert "ShuffledHashJoin" in plan_of(lost) and "SortMergeJoin" not in plan_of(lost)
        assert sorted(map(tuple, lost.collect())) == [("tags", 10, "tracks", "10"), ("tags", 11, "tracks", "11")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layouts_are_summed_in_all_shuffle_partitions(spark):
    lay = spark.range(40).select((F.col("id") % 8).alias("file_id"), F.lit("tag").alias("kind"), F.lit(1).alias("part"), F.lit("k").alias("sub"), F.floor(F.col("id") / 8).alias("ordinal"), F.lit(2).cast("bigint").alias("len"))
    got = L.layout_starts(lay)
    assert "REPARTITION_BY_NUM" in plan_of(got)
    assert {(r.ordinal, r.seg_start) for r in got.collect()} == {(i, 2 * i) for i in range(5)}


def test_files_are_not_sorted_to_meet_their_tracks(spark, fx):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        states = SC.known_states(fx.files(), fx.tracks(), fx.blocks(), "full", "/lib", True)
        plan = plan_of(states)
        assert "ShuffledHashJoin [path" in plan and "SortMergeJoin [path" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitions_follow_the_rows_that_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(O, "TASK_ROWS", 10)
    df = spark.range(95).select((F.col("id") % 19).alias("g"), "id")
    for out in (O.ranked(df, ["g"], ["id"], F.col("id")), O.with_previous(df, ["g"], ["id"], F.col("id"), F.col("id"), "p")):
        assert "hashpartitioning(g" in plan_of(out) and ", 10), REPARTITION_BY_NUM" in plan_of(out) and out.count() == 95
    assert O.partitions_for(spark, 40) is None and O.partitions_for(spark, 41) == 5


def test_tracks_over_the_cap_are_counted_after_the_shuffle(spark):
    rows = spark.range(60).select((F.col("id") % 20).alias("track_id"), F.when(F.col("id") >= 40, F.lit(b"x")).alias("value_blob"))
    rows = rows.unionByName(spark.range(3).select(F.lit(7).cast("bigint").alias("track_id"), F.lit(None).cast("binary").alias("value_blob")))
    over = RU.tracks_over_cap(rows, 4)
    plan = plan_of(over)
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")
    assert [tuple(r) for r in over.collect()] == [(7, 5)]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """All rows under one key: a first write puts nothing aside, and one task does not write it all."""
    aside = []
    monkeypatch.setattr(B, "materialize", lambda df, name: aside.append(name) or materialize(df, name))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        table = B.BucketedTable(spark, str(tmp_path / "t"), "family string, id bigint", "family", 8)
        rows = spark.range(0, 40_000, 1, 8).select(F.lit("a").alias("family"), "id")
        table.replace(rows)
        assert aside == [] and len(list((tmp_path / "t").glob("bucket=*/*.parquet"))) > 1
        table.replace(table.read().where("id < 9"), table.buckets_of(rows))
        assert aside == ["bucketed"] and sorted(r.id for r in table.read().collect()) == list(range(9))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
