from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.quality import BITS, MEASURES, POLICIES, RULES, ablation, judge, ledger, measure

from .helpers import AWKWARD, WORD, documents, words


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    triples = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(triples)
    hit = {i + k for i, t in enumerate(triples) if n[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@given(st.lists(st.sampled_from(["a", "b", "é", "#x", " ", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "B!!", "|"]), max_size=60).map("".join))
@settings(max_examples=400, deadline=None)
def test_measures(text):
    assert measure(text.encode())[:5] == brute(text)


def test_awkward_and_ledger(spark):
    rows = ledger(documents(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    texts = {r[0]: r[1] for r in AWKWARD}
    for r in rows:
        assert tuple(r[m] for m in MEASURES[:5]) == brute(texts[r["doc_id"]])
    assert ledger(documents(spark, [])).count() == 0


def test_policies_and_ablation(spark):
    docs = [(i, words(60 + i, i)) for i in range(8)] + [(20, "short"), (21, "same same same " * 60), (22, words(80, 3) + " ###" * 40), (23, "A B C ### ###")]
    rows = ledger(documents(spark, docs))
    kept = {r["doc_id"] for r in judge(documents(spark, docs)).where("kept").collect()}
    assert kept == set(range(8))
    failures = [r["failures"] for r in rows.collect()]
    mask = POLICIES["v1"]
    for r in ablation(rows, "v1").collect():
        bit = BITS[r["rule"]]
        assert r["failed"] == sum(bool(f & bit) for f in failures)
        assert r["only"] == sum(f & mask == bit for f in failures)
        assert r["kept_without"] == sum(not f & mask & ~bit for f in failures)
    assert len({r.name for r in RULES}) == len(RULES)
