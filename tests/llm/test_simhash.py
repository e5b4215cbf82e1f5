import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import simhash
from shelfmark.llm.common import Scratch
from shelfmark.llm.components import components
from shelfmark.llm.simhash import anchors, blocks, compare, deduplicate, fingerprint, links, near_duplicates

from .helpers import AWKWARD, WORD, documents, words


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    if not ws:
        return 0
    shingles = [" ".join(ws)] if len(ws) < 3 else [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, threshold=3):
    """Component of each value, by comparing all."""
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= threshold:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprint():
    for t in ["", "  ", "One", "A b", "A b C", "É É x x x", words(200), words(50) + "\x0b\x1c " + words(9).upper()]:
        assert fingerprint(t.encode()) == plain_fingerprint(t)
    assert fingerprint(None) == 0


def test_codes_are_perfect():
    rng = np.random.default_rng(1)
    for b in blocks(2):
        points = rng.integers(0, 1 << 63, 500).astype(np.uint64)
        s = b.syndrome(points)
        assert all((b.excess[b.starts[x] : b.starts[x + 1]] == 0).sum() == 1 for x in s)  # one anchor within the radius


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_no_pair_is_missed(bits):
    rng = random.Random(bits)
    for _ in range(150):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), bits):
            y ^= 1 << b
        anchor, at = anchors(np.array([x, y], np.uint64), 2)
        assert set(anchor[at == 0].tolist()) & set(anchor[at == 1].tolist())


@pytest.mark.parametrize("size", [2, 20, 200])
def test_compare_keeps_components(size):
    rng = random.Random(size)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for _ in range(size)} | {rng.getrandbits(64) for _ in range(size)})
    a, b = compare(np.zeros(len(values)), np.array(values, np.uint64), 3)
    assert len(a) < len(values)  # a forest, not all pairs
    label = list(range(len(values)))
    for _ in range(len(values)):
        for i, j in zip(a, b):
            label[i] = label[j] = min(label[i], label[j])
    assert label == groups(values)


def test_links_against_all_pairs(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(60):
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 60])):
            values.add(v)
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(4)).collect()
    place = {v: i for i, v in enumerate(signed)}
    label = list(range(len(values)))
    for _ in range(80):
        for r in found:
            i, j = place[r["u"]], place[r["v"]]
            label[i] = label[j] = min(label[i], label[j])
    assert label == groups(values)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 60)] + [(rng.randint(201, 260), 200) for _ in range(40)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {v: (0 if v <= 40 else 100 if v < 200 else 200) for e in edges for v in e if v not in (0, 100, 200)}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0


def test_near_duplicates(spark):
    base = [words(300, s) for s in range(5)]
    docs = list(AWKWARD)
    for i, t in enumerate(base):
        ws = t.split()
        docs += [(100 + 10 * i, t), (101 + 10 * i, t.upper()), (102 + 10 * i, " ".join(ws[:150] + ["extra"] + ws[150:]))]
    rows = near_duplicates(documents(spark, docs)).select("doc_id", F.col("fp").alias("f"), "component_id").collect()
    assert len(rows) == len(docs)
    values = [plain_fingerprint(d[1]) for d in docs]
    label = groups(values)
    want = {}
    for d, g in zip(docs, label):
        if d[0] is not None:
            want[g] = min(want.get(g, d[0]), d[0])
    expected = sorted([(d[0], v if v < 1 << 63 else v - (1 << 64), want.get(g)) for d, v, g in zip(docs, values, label)], key=str)
    assert sorted(map(tuple, rows), key=str) == expected
    assert near_duplicates(documents(spark, [])).count() == 0


def test_deduplicate(spark):
    docs = documents(spark, [*AWKWARD, (5, "another text under a used id"), (8, None)])
    out = deduplicate(docs)
    assert out.columns == docs.columns
    # 1, 2, 3 and 8 have no words; 5 and 6 are copies; the null id's two rows are one.
    assert sorted((r["doc_id"], r["text"][:7] if r["text"] else r["text"]) for r in out.where("doc_id IS NOT NULL").collect()) == [(-9, "12345 !"), (1, None), (4, "Überall"), (5, "another"), (5, words(4)[:7]), (7, "one")]
    assert out.where("doc_id IS NULL").count() == 1
    assert deduplicate(documents(spark, [])).count() == 0


def test_large_groups_are_searched(monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_GROUP", 2)
    test_compare_keeps_components(200)
