import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import layout as L
from shelfmark.operators import ordered as O
from shelfmark.operators.ordered import ranked, running_sums, with_previous


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    ids = rng.sample(range(1, 5000), 900)
    return [(rng.choice(["hot", "hot", "hot", None, "x", "y"]), i, rng.randint(0, 9)) for i in ids]


@pytest.mark.parametrize("hot", [10, 1_000_000])
def test_rank_sum_and_previous(spark, rows, hot):
    df = spark.createDataFrame(rows, "g string, id bigint, v int")
    coarse = F.floor(F.col("id") / 100)
    got = {r.id: (r.rank, r.total) for r in running_sums(df, ["g"], ["id"], coarse, {"rank": F.lit(1), "total": F.col("v")}, hot).collect()}
    prev = {r.id: r.p for r in with_previous(df, ["g"], ["id"], coarse, F.col("v"), "p", hot).collect()}
    seen = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        n, total, last = seen.get(g, (0, 0, None))
        assert got[i] == (n + 1, total + v) and prev[i] == last
        seen[g] = (n + 1, total + v, v)
    assert len(got) == len(rows)


def test_sparse_ids_are_cut_by_rows(spark):
    """Ids 2^40 apart: as many buckets as quantiles, none above twice the mean."""
    df = spark.range(40_000).select((F.col("id") % 10 < 9).alias("g"), (F.col("id") * F.lit(2**40)).alias("id"))
    marked = O._mark(df, ["g"], O.id_bucket("id"), 10_000)
    sizes = [r["count"] for r in marked.where("_hot").groupBy("_bucket").count().collect()]
    assert sum(sizes) == 36_000 and len(sizes) > 900 and max(sizes) <= 2 * 36_000 / len(sizes) + 5
    got = ranked(df, ["g"], ["id"], O.id_bucket("id"), "r", 10_000)
    assert got.where("g").agg(F.count_if(F.col("r") != F.expr("id / pow(2, 40) - floor(id / pow(2, 40) / 10) + 1"))).head()[0] == 0


def test_hot_group_is_cut_in_the_plan(spark, rows):
    df = spark.createDataFrame(rows, "g string, id bigint, v int")
    plan = ranked(df.groupBy("g", "id").count(), ["g"], ["id"], F.floor(F.col("id") / 100), hot_rows=2)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert "hashpartitioning(g" in plan and any("g#" in w and "_bucket#" in w for w in windows) and not any("windowspecdefinition(id" in w for w in windows)


def test_no_hot_group_takes_the_plain_window(spark, rows):
    df = spark.createDataFrame(rows, "g string, id bigint, v int")
    for out in (ranked(df, ["g"], ["id"], F.col("id")), with_previous(df, ["g"], ["id"], F.col("id"), F.col("v"), "p")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_bucket" not in plan and plan.count("Exchange") == 1


def test_ranges_of_a_file_of_many_segments(spark):
    """A million segments of one file: the join makes the pieces and nothing else, and is spread by segment."""
    starts = spark.range(10**6).select(F.lit(1).alias("file_id"), F.col("id").alias("seq"), (F.col("id") * 10).alias("seg_start"), (F.col("id") * 10 + 10).alias("seg_end"))
    reqs = spark.range(2000).select(F.col("id").alias("request_id"), F.lit(1).alias("file_id"), (F.col("id") * 4999 + 5).alias("req_offset"), F.lit(30).cast("bigint").alias("req_len"))
    got = L.resolve_ranges(starts, reqs)
    pieces = {(r.request_id, r.seq): (r.within, r.n) for r in got.where("request_id < 500").collect()}
    want = {}
    for q in range(500):
        o = q * 4999 + 5
        for seq in range(o // 10, (o + 29) // 10 + 1):
            lo, hi = max(o, seq * 10), min(o + 30, seq * 10 + 10)
            want[(q, seq)] = (lo - seq * 10, hi - lo)
    assert pieces == want
    # Each byte asked for is in one piece.
    assert got.groupBy("request_id").agg(F.sum("n").alias("n")).where("n <> 30").count() == 0


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_range_join_against_brute_force(spark, hot_rows):
    rng = random.Random(2)
    segs = [(f, s, rng.randint(0, 40)) for f in range(3) for s in range(30)]
    reqs = [(n, rng.randrange(3), rng.randint(0, 900), rng.randint(0, 200)) for n in range(200)] + [(7, 0, 5, 90), (7, 0, 5, 90), (900, 1, 10**6, 5), (901, 2, 0, 2**63 - 1), (902, 2, 7, 2**63 - 1)]
    starts = L.segment_starts(spark.createDataFrame(segs, "file_id int, seq bigint, len bigint"))
    got = L.resolve_ranges(starts, spark.createDataFrame(reqs, "request_id int, file_id int, req_offset bigint, req_len bigint"), hot_rows=hot_rows)
    found = sorted((r.request_id, r.seq, r.within, r.n) for r in got.collect())
    want, at = [], {}
    for f, s, n in segs:
        at[(f, s)] = sum(x for g, t, x in segs if g == f and t < s)
    for q, f, o, n in reqs:
        for g, s, ln in segs:
            lo, hi = max(o, at[(g, s)]), min(o + n, at[(g, s)] + ln)
            if g == f and lo < hi:
                want.append((q, s, lo - at[(g, s)], hi - lo))
    assert found == sorted(want)


def test_groups_are_counted_in_a_bounded_number_of_cells(spark):
    """Many groups: what the count holds does not grow with them, and a hot one is still found."""
    many = spark.range(200_000).select((F.col("id") % 150_000).alias("g"))
    assert O._cells(many, ["g"]).count() <= O.CELLS
    assert O.fullest_cell(many, ["g"])[0] >= 2 and O.fullest_cell(many, ["g"])[1] == 200_000 and O.fullest_cell(many.limit(0), ["g"]) == (0, 0)
    assert not O.any_hot(many, ["g"], 2) and O.any_hot(many, ["g"], 1)
    hot = many.unionByName(spark.range(50).select(F.lit(7).cast("bigint").alias("g")))
    assert O.any_hot(hot, ["g"], 40) and not O.any_hot(hot, ["g"], 60)


@pytest.mark.parametrize(("hot_rows", "few"), [(1_000_000, 4096), (1_000_000, 4), (5, 4)])
def test_ranges_of_layouts_against_brute_force(spark, hot_rows, few):
    rng = random.Random(3)
    lay = [(f, "tag", p, "k", o, rng.randint(0, 9)) for f in range(4) for p in range(2) for o in range(12)]
    reqs = [(n, rng.randrange(5), rng.randint(-3, 120), rng.randint(0, 40)) for n in range(150)] + [(7, 0, 5, 30), (7, 0, 5, 30), (900, 1, 3, 2**63 - 1)]
    layout = spark.createDataFrame(lay, "file_id bigint, kind string, part int, sub string, ordinal bigint, len bigint")
    got = L.resolve_layout(layout, spark.createDataFrame(reqs, "request_id int, file_id bigint, req_offset bigint, req_len bigint"), hot_rows=hot_rows, few=few)
    found = sorted((r.request_id, r.part, r.ordinal, r.within, r.n) for r in got.collect())
    want = []
    for q, f, o, n in reqs:
        at = 0
        for g, _, p, _, k, ln in lay:
            if g == f:
                lo, hi = max(o, at), min(o + n, at + ln)
                if lo < hi:
                    want.append((q, p, k, lo - at, hi - lo))
                at += ln
    assert found == sorted(want)


def test_a_layout_is_shuffled_once_to_resolve_ranges(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lay = spark.range(40).select((F.col("id") % 8).alias("file_id"), F.lit("tag").alias("kind"), F.lit(1).alias("part"), F.lit("k").alias("sub"), F.floor(F.col("id") / 8).alias("ordinal"), F.lit(2).cast("bigint").alias("len"))
        reqs = spark.range(8).select(F.col("id").alias("request_id"), F.col("id").alias("file_id"), F.lit(1).cast("bigint").alias("req_offset"), F.lit(2).cast("bigint").alias("req_len"))
        got = L.resolve_layout(lay, reqs)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # parts and requests
        assert got.agg(F.sum("n")).head()[0] == 16
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
