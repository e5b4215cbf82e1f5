import math
import zlib
from collections import Counter

from shelfmark.llm import sharding
from shelfmark.llm.sharding import assign, shard, write_shards

from .helpers import AWKWARD, documents, words


def test_law_and_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 50)
    rows = AWKWARD + [(i, words(3, i)) for i in range(1000, 5000)]
    out = shard(documents(spark, rows), [1.0] * 40).collect()
    assert len(out) == len(rows)
    for s in range(40):
        mine = sorted(r["slot"] for r in out if r["shard"] == s)
        assert mine == list(range(len(mine))) and len(mine) > 50
    assert all(r["grown_shard"] in (r["shard"], 40) for r in out)
    assert 40 < sum(r["grown_shard"] == 40 for r in out) < 180
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    assert all((r["size"], r["text_crc32"]) in texts[r["doc_id"]] for r in out)
    where = {}
    for r in out:
        where.setdefault(r["doc_id"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_one_shard_more_is_grown_shard(spark):
    df = documents(spark, [(i, "x") for i in range(2000)])
    grown = {r["doc_id"]: r["grown_shard"] for r in assign(df, [1.0] * 7).collect()}
    assert grown == {r["doc_id"]: r["shard"] for r in assign(df, [1.0] * 8).collect()}


def test_weights(spark):
    n = Counter(r["shard"] for r in assign(documents(spark, [(i, "x") for i in range(6000)]), [1.0, 2.0, 3.0]).collect())
    assert all(abs(n[s] - 1000 * (s + 1)) < 5 * math.sqrt(1000 * (s + 1)) for s in range(3))


def test_native_plan_and_empty(spark):
    assert shard(documents(spark, []), [1.0] * 40).count() == 0
    plan = shard(documents(spark, AWKWARD), [1.0] * 40)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_files(spark, tmp_path):
    df = documents(spark, AWKWARD)
    write_shards(df, str(tmp_path / "out"), [1.0] * 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(AWKWARD)
