from shelfmark.llm.decontam import contaminated, decontaminate

from .helpers import AWKWARD, documents, words

ITEM = "The train leaves the old station at 7 o'clock and carries 35 kg of mail for Mr Weber before it turns around in the valley."


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, hash string")


def found(spark, docs, texts):
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(documents(spark, docs), items(spark, texts)).collect()}


def test_exact_and_reparameterised(spark):
    other = ITEM.replace("7 ", "19 ").replace("35 kg", "210 kg").replace("Weber", "Okafor")
    got = found(spark, [(1, f"Some text before. {ITEM} And after."), (2, f"Intro here: {other}"), (3, "Nothing of that kind in this text, which only has 7 trains and 35 kg."), (4, ITEM.upper())], [ITEM])
    assert set(got) >= {(1, 0), (2, 0)} and (3, 0) not in got
    assert not got[1, 0]["changed"] and got[2, 0]["changed"]


def test_slots_must_be_consistent(spark):
    item = "If 3 red boxes and 3 blue boxes stand on the long table then how many boxes stand there"
    got = found(spark, [(1, item.replace("3", "8")), (2, item.replace("3", "8", 1).replace("3", "5"))], [item])
    assert set(got) == {(1, 0)}


def test_punctuation_and_case(spark):
    assert set(found(spark, [(1, "a line | " + " | ".join(ITEM.lower().split()))], [ITEM])) == {(1, 0)}


def test_brute_force_on_windows(spark):
    texts = [words(40, s, 5000).replace("w", "q") for s in range(6)]
    plain = [t.translate(str.maketrans("0123456789", "abcdefghij")) for t in texts]
    docs = [(i, " ".join(plain[i % 6].split()[a : a + n])) for i, (a, n) in enumerate([(0, 40), (3, 20), (10, 9), (0, 8), (5, 30), (20, 20), (39, 1)])]
    want = set()
    for i, t in docs:
        d = t.split()
        for k, x in enumerate(plain):
            w = x.split()
            hits = [a for a in range(len(w) - 7) if any(d[b : b + 8] == w[a : a + 8] for b in range(len(d)))]
            run = best = 0
            for a in range(len(w)):
                run = run + 1 if a in hits else 0
                best = max(best, run)
            if hits and (len(hits) >= (len(w) - 7) / 2 or best >= 6):
                want.add((i, k))
    assert set(found(spark, docs, plain)) == want and want


def test_awkward(spark):
    assert found(spark, AWKWARD, [None, "", "a b"]) == {}
    assert found(spark, [], [ITEM]) == {} and found(spark, AWKWARD, []) == {}
    docs = documents(spark, [*AWKWARD, (50, ITEM), (None, ITEM)])
    left = decontaminate(docs, items(spark, [ITEM, ITEM, "no id here at all"]))
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r[0] for r in AWKWARD if r[0] is not None)
