import random

from shelfmark.llm import common
from shelfmark.llm.lines import drop_common_lines

from .helpers import AWKWARD, documents, words

BLANKS = " \t\n\x0b\x0c\r"
CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_chars, least_docs):
    """(doc, n_lines, n_dropped, kept) of each row, one document an id, null ids one document below all others."""
    order = lambda d: (d is not None, d or 0)
    key = lambda line: line.strip(BLANKS).translate(CASE)
    held = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(doc)
    last = {k: max(d, key=order) for k, d in held.items() if len(d) >= least_docs}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), text if len(kept) == len(lines) else "\n".join(kept)))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in drop_common_lines(df, **options).collect()), key=repr)


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    pool = [words(12, i) for i in range(40)] + ["", "short", "É" * 39 + "x", "İstanbul " * 6, words(12, 1).upper()]
    ends = ["", " ", "\t", "\r", "\x0b \x0c", " "]
    rows = [(i, "\n".join(rng.choice(ends) + rng.choice(pool) + rng.choice(ends) for _ in range(rng.randint(1, 9)))) for i in range(n)]
    return rows + AWKWARD + [(7, words(12, 1) + "\n" + words(12, 1)), (7, words(12, 1)), (None, words(12, 2)), (None, words(12, 2)), (9000, words(12, 3) + "\n\n" + words(12, 3) + "\n")]


def test_brute_force(spark):
    for least_docs in (2, 5, 40):
        rows = corpus()
        assert found(documents(spark, rows), least_docs=least_docs) == brute(rows, 40, least_docs)


def test_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    rows = corpus(80, 5)
    assert found(documents(spark, rows)) == brute(rows, 40, 5)


def test_common_line_and_long_text(spark):
    """One line in every document, and one text of many lines that loses most of them."""
    line = words(12, 4)
    rows = [(i, f"{line}\n{i}") for i in range(400)] + [(-1, "\n".join([line, words(12, 5)] * 60_000))]
    out = {r[0]: r[1:] for r in found(documents(spark, rows))}
    assert out[399] == (2, 0, f"{line}\n399") and all(out[i] == (2, 1, str(i)) for i in range(399))
    assert out[-1][:2] == (120_000, 60_000) and out[-1][2] == "\n".join([words(12, 5)] * 60_000)


def test_columns_empty_and_plan(spark):
    df = documents(spark, AWKWARD)
    clash = df.selectExpr("*", "1 AS n_lines", "'x' AS row_1", "'y' AS gone", "0 AS lines", "2 AS h1", "3 AS r1", "4 AS at", "5 AS last", "6 AS salt", "7 AS line")
    out = drop_common_lines(clash)
    assert out.columns == [c for c in clash.columns if c != "n_lines"] + ["n_lines", "n_dropped"] and out.count() == len(AWKWARD)
    assert drop_common_lines(documents(spark, [])).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
