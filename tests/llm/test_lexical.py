import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import lexical
from shelfmark.llm.lexical import Index, QuerySet, search

from .helpers import AWKWARD, documents, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(text):
    return Counter(TERM.findall((text or "").translate(CASE)))


def brute(rows, queries, k):
    docs = [(r[0], counts(r[1])) for r in rows]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in queries:
        asked, scores = counts(text), []
        for d, c in docs:
            m = 25 + 75 * c.total() * n // total
            s = sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, a in asked.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def found(df, queries, k):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in search(Index(df), queries, k).collect()), key=repr)


def corpus(n, seed=2):
    rng = random.Random(seed)
    pool = [f"{w}{i % 7}" for i, w in enumerate(words(500).split())]
    rows = [(i, " ".join(rng.choice(pool[: rng.choice([20, 200, 500])]) for _ in range(rng.choice([1, 5, 30, 200, 900])))) for i in range(n)]
    return rows + AWKWARD + [(n + i, "Tie TIE tie, equal ÉTÉ") for i in range(15)] + [(None, "tie equal"), (3, "tie tie"), (3, "tie tie")], pool


@pytest.mark.parametrize("room, query_terms, seeds", [(1024, 4096, 32), (16, 10, 1)])
def test_brute_force(spark, monkeypatch, room, query_terms, seeds):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", room)
    monkeypatch.setattr(lexical, "QUERY_TERMS", query_terms)
    monkeypatch.setattr(lexical, "SEEDS", seeds)
    monkeypatch.setattr(lexical, "HELD", 100)
    rows, pool = corpus(400)
    rng = random.Random(4)
    queries = [(i, " ".join(rng.choice(pool[: 50 * i + 5]) for _ in range(3 + 4 * i))) for i in range(8)] + [(50, "tie"), (51, None), (52, "?!"), (53, "nowhere"), (54, "one ONE tie"), (55, "équal ÉTÉ")]
    table = spark.createDataFrame(queries, "item_id long, text string")
    for k in (3, 10):
        assert found(documents(spark, rows), table, k) == brute(rows, queries, k)


def test_bounds_are_never_too_low_and_exclude_most():
    rows, pool = corpus(300)
    docs = [(i, counts(r[1])) for i, r in enumerate(rows) if counts(r[1])]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t.encode() for _, c in docs for t in c)
    asked = QuerySet([(i, Counter(w.encode() for w in pool[i * 9 : i * 9 + 6] if w.encode() in df)) for i in range(12)], df, n, total)
    above = 0
    for width in (256, 1024, 16384):
        block = lexical._Block(width)
        for i, c in docs:
            block.add(i, c.total(), [lexical.places(e) for e in lexical.entries(Counter({t.encode(): k for t, k in c.items()}))])
        _, keys, lengths, slices = block.row()
        got = asked.bounds(width, np.array(lengths), np.frombuffer(slices, np.uint8).reshape(width, -1))
        for j, (_, c) in enumerate(docs):
            m = lexical.scale(c.total(), n, total)
            for q in range(12):
                exact = sum(int(asked.weights[t]) * int(asked.asks[q, t]) * lexical.factor(c[w.decode()], m) for t, w in enumerate(asked.words) if c[w.decode()])
                assert got[q, j] >= exact
                above += width == 16384 and got[q, j] > 0 and exact == 0
    assert above < 0.02 * 12 * len(docs)


def test_common_word_long_text_and_empty(spark):
    rows = [(i, f"the the w{i % 9} x{i}") for i in range(900)] + [(-5, "the long text " * 60_000)]
    queries = [(1, "the"), (2, "the w3 x12 x12"), (3, "long the")]
    table = spark.createDataFrame(queries, "item_id long, text string")
    assert found(documents(spark, rows), table, 10) == brute(rows, queries, 10)
    assert found(documents(spark, []), table, 10) == [] and found(documents(spark, rows), table.where("false"), 10) == []
