from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm import mixing
from shelfmark.llm.mixing import apply_mix, fly, land, mixed, plan

from .helpers import AWKWARD, WORD, documents, words


def test_plan():
    sizes = {"b": 100, "a": 1000, None: 10, "c": 500}
    got = plan(sizes)
    assert sum(got.values()) == 1610 and all(got[s] <= 3 * sizes[s] for s in sizes)
    # a, b, c, null weigh 1, 2, 3, 1: null stops at 30 and b at 300, a and c share the rest 1 : 3.
    assert got == {None: 30, "b": 300, "a": Fraction(320), "c": Fraction(960)}
    assert plan({}) == {} and plan({"a": 0}) == {"a": 0}


@pytest.mark.parametrize("n", [1, 2, 3, 50, 400])
def test_flight_keeps_totals(n):
    rng = np.random.default_rng(n)
    size, count, p = rng.integers(0, 500, n).astype(float), rng.integers(1, 3, n).astype(float), np.full(n, 0.37)
    out = fly(size, count, p, rng.random(n))
    assert ((out > 0) & (out < 1)).sum() <= 2 and ((out >= 0) & (out <= 1)).all()
    if n > 3:
        assert abs(out @ size - p @ size) < 1e-3 and abs(out @ count - p @ count) < 1e-6


def test_flight_is_unbiased():
    size, count, p = np.array([5.0, 9, 14, 20, 33, 2, 7, 41]), np.ones(8), np.array([0.3] * 8)
    rng = np.random.default_rng(0)
    mean = np.mean([fly(size, count, p, rng.random(8)) for _ in range(3000)], 0)
    assert np.abs(mean - 0.3).max() < 0.04


def test_landing():
    assert land(np.array([10.0, 3.0]), np.ones(2), np.array([0.5, 0.5]), 3.2).tolist() == [0, 1]


def corpus(n):
    return [(i, words(20 + i * 37 % 300, i), "en", "abcdefg"[i % 3 * 2] if i % 11 else None) for i in range(n)]


@pytest.mark.parametrize("block", [8, 4096])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = corpus(300)
    df = documents(spark, docs)
    rows = [r.asDict() for r in mixed(df).collect()]
    assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mixed(df.repartition(5)).collect())
    size = {d[0]: len(WORD.findall(d[1])) for d in docs}
    source = {d[0]: d[3] for d in docs}
    totals = {}
    for i, s in source.items():
        totals[s] = totals.get(s, 0) + size[i]
    target, taken = plan(totals), {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[s] and r["target"] == pytest.approx(float(target[s]))
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - float(target[s])) <= 40 for s in totals)


def test_apply(spark):
    df = documents(spark, corpus(60) + AWKWARD)
    out = apply_mix(df)
    assert out.columns == df.columns
    taken = {}
    for r in mixed(df).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(WORD.findall(r["text"] or ""))
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}


def test_awkward(spark):
    assert mixed(documents(spark, [])).count() == 0 and apply_mix(documents(spark, [])).count() == 0
    assert mixed(documents(spark, AWKWARD)).count() == len(AWKWARD)
    only_null = mixed(documents(spark, [(1, None), (2, "")])).collect()
    assert [r["taken"] for r in only_null] == [0, 0]
