import random
import re
from collections import Counter

import pytest

from shelfmark.llm import divergence
from shelfmark.llm.divergence import audit

from .helpers import AWKWARD, documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, least_docs=3):
    docs = [((r[2] if len(r) > 2 else None) or "", (r[3] if len(r) > 3 else None) or "", Counter(TERM.findall((r[1] or "").translate(CASE)))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in held.items() if n >= least_docs]
        count = {g: Counter() for _, g, _ in mine}
        for _, g, c in mine:
            count[g].update(c)
        whole = sum(count.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {g: shares(c) for g, c in count.items()}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // y
        for g in p:
            pairs = [("pair", h, sum(f(p[g][t], p[h][t]) for t in kept)) for h in p if h != g]
            over = [("term", t, f(p[g][t], q[t])) for t in kept if count[g][t] and p[g][t] > q[t]]
            for part in (pairs, over):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, g, *x, i + 1) for i, x in enumerate(ranked if part is pairs else ranked[:top])]
    return sorted(out)


def found(df, top):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in audit(df, top=top).collect())


def corpus(sources, terms, n, seed=1):
    rng = random.Random(seed)
    pool = [f"{chr(97 + i % 26)}{'xyz'[i % 3]}{'É' if i % 5 == 0 else ''}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(terms)]
    rows = []
    for i in range(n):
        g = rng.randrange(sources)
        mine = [pool[min(int(rng.expovariate(1 / (20 + 3 * g))), terms - 1)] for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", ", ", " 9 "]).join(w.upper() if rng.random() < 0.2 else w for w in mine), rng.choice(["en", "de", None]), f"s{g}"))
    return rows


@pytest.mark.parametrize("chunk, block, cells, sources", [(4096, 64, 1 << 21, 7), (50, 3, 64, 11)])
def test_brute_force(spark, monkeypatch, chunk, block, cells, sources):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD", 500)
    rows = corpus(sources, 400, 300) + AWKWARD + [(900 + i, "rare tie", "fr", s) for i, s in enumerate(["b", "a", "c"])] + [(950, None, "it", s) for s in "xyz"]
    assert found(documents(spark, rows), 20) == brute(rows, 20)


def test_one_hot_word_and_long_text(spark):
    rows = [(i, "the " * (i + 1) + "end", "en", f"s{i % 4}") for i in range(60)] + [(99, "the and of " * 50_000, "en", "s9")]
    assert found(documents(spark, rows), 200) == brute(rows, 200)


def test_empty(spark):
    df = audit(documents(spark, []))
    assert df.count() == 0 and df.columns == ["lang", "source", "part", "item", "value", "rank"]
