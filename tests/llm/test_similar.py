import random
from itertools import combinations

import numpy as np
import pytest

from shelfmark.llm import similar
from shelfmark.llm.similar import deduplicate_similar, near_duplicates

from .helpers import AWKWARD, WORD, documents, words


def plain_set(text):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}


def plain_components(texts):
    """Smallest index of each text's component, by comparing all."""
    label, sets = list(range(len(texts))), [plain_set(t) for t in texts]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def edited(text, n, rng):
    ws = text.split()
    for i in rng.sample(range(len(ws)), n):
        ws[i] = f"z{rng.random()}"
    return " ".join(ws)


def corpus(n_groups, size, seed):
    """Groups of chained copies, one to five words of 150 changed each time."""
    rng, out = random.Random(seed), []
    for g in range(n_groups):
        base = " ".join(f"g{g}w{rng.randrange(5000)}" for _ in range(150))
        for _ in range(size):
            out.append(base)
            base = edited(rng.choice(out[-5:] if rng.random() < 0.5 else [base]), rng.randint(1, 5), rng)
    return out


@pytest.mark.parametrize(("n_groups", "size", "bucket"), [(12, 8, 32), (2, 60, 4)])
def test_against_all_pairs(spark, monkeypatch, n_groups, size, bucket):
    monkeypatch.setattr(similar, "SMALL_BUCKET", bucket)
    texts = corpus(n_groups, size, bucket)
    want = plain_components(texts)
    assert n_groups < len(set(want)) < len(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("chunk", [512, 7])
def test_copies_below_the_threshold_in_a_hot_bucket(spark, monkeypatch, chunk):
    """Near copies of one text, most of them not similar to most others: as all pairs, whatever the chunks."""
    monkeypatch.setattr(similar, "SMALL_BUCKET", 4)
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(similar, "COLUMNS", 32)
    rng = random.Random(8)
    base = " ".join(f"h{rng.randrange(9000)}" for _ in range(120))
    texts = [edited(base, rng.randint(1, 4), rng) for _ in range(150)] + [base + " " + " ".join(f"t{rng.random()}" for _ in range(n)) for n in range(5, 60, 6)]
    want = plain_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, list(enumerate(texts)))).collect()}
    assert 40 < len(set(want)) < len(texts) and [got[i] for i in range(len(texts))] == want


def test_rows_follow_the_size_of_a_group(spark):
    """Outside nodes leave a task as links only: rows per doubling of a group of unlinked copies."""
    counts = []
    for size in (100, 200):
        rng = random.Random(9)
        base = " ".join(f"h{rng.randrange(9000)}" for _ in range(120))
        sets = [sorted(similar.shingles(edited(base, 3, rng).encode())) for _ in range(size)]
        held = [(0, True, i, i, np.array(x, np.uint64)) for i, x in enumerate(sets)]
        counts.append(similar._links((0, 0, 0, 0), held).num_rows)
        assert counts[-1] < size
    assert counts[1] < 3 * max(counts[0], 20)


def test_common_sizes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, n)) for n in (0, 1, 30, 200, 300)]
    got = similar._common(sets[:3], sets[1:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets[:3]]


def test_pipeline_stage_finds_near_copies(spark):
    """One changed word in a hundred: more than 3 bits of a fingerprint for most, Jaccard about 0.9."""
    from corpus_pipeline import drop_near_duplicates

    rng = random.Random(3)
    base = [" ".join(f"b{i}w{rng.randrange(9000)}" for _ in range(100)) for i in range(20)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(t, 1, rng)) for i, t in enumerate(base)] + [(200 + i, edited(t, 30, rng)) for i, t in enumerate(base)]
    assert sorted(r["doc_id"] for r in drop_near_duplicates(spark, documents(spark, docs), "").collect()) == [*range(20), *range(200, 220)]


def test_pipeline_stage_links_by_simhash(spark):
    """A line repeated over most of two texts: fingerprints 0 bits apart, sets far from similar. Both rules link, also across each other."""
    from corpus_pipeline import drop_near_duplicates

    from shelfmark.llm.simhash import fingerprint

    rng = random.Random(5)
    alone = lambda i: " ".join(f"q{i}w{rng.randrange(9000)}" for _ in range(40))
    ads = [("buy this now " * 60) + alone(i) for i in range(2)]
    assert fingerprint(ads[0].encode()) == fingerprint(ads[1].encode()) and plain_components(ads) == [0, 1]
    base = " ".join(f"b{rng.randrange(9000)}" for _ in range(100))
    docs = [(1, ads[0]), (2, alone(2)), (3, ads[1]), (4, base), (5, edited(base, 1, rng)), (6, ads[1] + " end"), (None, ads[0])]
    assert sorted(r["doc_id"] for r in drop_near_duplicates(spark, documents(spark, docs), "").collect()) == [1, 2, 4]


def test_awkward(spark):
    docs = documents(spark, [*AWKWARD, (5, "another text under a used id"), (8, None)])
    out = deduplicate_similar(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"][:7] if r["text"] else r["text"]) for r in out.where("doc_id IS NOT NULL").collect())
    assert got == [(-9, "12345 !"), (1, None), (4, "Überall"), (5, "another"), (5, words(4)[:7]), (7, "one")]
    assert out.where("doc_id IS NULL").count() == 1
    assert deduplicate_similar(documents(spark, [])).count() == 0
