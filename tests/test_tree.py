import random

import pytest

from sequential import places
from shelfmark.operators import tree


def compare(spark, libraries, folded=False, hot_rows=1_000_000):
    """Many small libraries in one run, each below its own top directory."""
    rows = [(n * 1000 + i, f"L{n}/{p}") for n, lib in enumerate(libraries) for i, p in lib]
    want = {}
    for n, lib in enumerate(libraries):
        want.update({n * 1000 + i: p for i, p in places([(i, f"L{n}/{p}") for i, p in lib], folded).items()})
    got = {r.id: r.final_path for r in tree.place(spark.createDataFrame(rows, "id bigint, path string"), folded, hot_rows).collect()}
    assert got == want


def nasty(rng, n):
    dirs = ["a", "a (2)", "a (3)", "a (2) (2)", "A", "b", "a (2) (3)", "B (2)", "a.x", "a (2).x"]
    leaves = dirs[:8]
    pick = lambda: [rng.choice(dirs) for _ in range(rng.choice([0, 0, 1]))] + [rng.choice(leaves) + rng.choice([".x", ".x", "", ".y"])]
    return [(i, "/".join(pick())) for i in rng.sample(range(1, 300), n)]


@pytest.mark.parametrize("folded,hot", [(False, 1_000_000), (True, 1_000_000)])
def test_contested_names(spark, folded, hot):
    rng = random.Random(7 + hot + folded)
    compare(spark, [nasty(rng, rng.choice([5, 12, 25])) for _ in range(16)], folded, hot)


def test_names_near_the_byte_limit(spark):
    rng = random.Random(3)
    base = "é" * 60 + "x" * 100
    names = [base + "q" * k for k in (25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 40)] + [base + "q" * k + " (2)" for k in (24, 27, 28, 29, 30, 31)] + [base + "q" * 27 + " (10)"]
    lib = lambda n: [(i, rng.choice(names) + rng.choice([".x", ".flac"])) for i in rng.sample(range(1, 300), n)]
    compare(spark, [lib(n) for n in (10, 60)])


def test_one_hot_name(spark):
    """A third of all rows want one name, another third its suffixed form; buckets are tiny."""
    rng = random.Random(5)
    lib = [(i, rng.choice(["Unknown.x", "Unknown (2).x", f"t{i}.x"])) for i in range(1, 500)]
    compare(spark, [lib], hot_rows=50)


def test_unusable_paths_are_left_out(spark):
    df = spark.createDataFrame([(1, "/../."), (2, None), (3, "//a/./b.x")], "id bigint, path string")
    assert [tuple(r) for r in tree.place(df).select("id", "final_path").collect()] == [(3, "a/b.x")]


def test_touched_families_equal_a_full_run(spark):
    rng = random.Random(11)
    paths = lambda seed: [(i, rng.choice(["A", "B", "C", "A (2)"]) + "/" + rng.choice(["t", "t (2)"]) + ".x") for i in range(1, 60)]
    before = dict(paths(0))
    after = {**before, 5: "B/t.x", 9: "D/new.x"}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id bigint, path string")
    touched = spark.createDataFrame([(before[5],), (before[9],), ("B/t.x",), ("D/new.x",)], "path string")
    old = places(sorted(before.items()))
    redone = {r.id: r.final_path for r in tree.place_touched(frame(after), touched).collect()}
    assert {**old, **redone} == places(sorted(after.items()))


def test_node_ids_are_stable_and_never_reused(spark):
    def nodes(d):
        rows = [(i, p, p.rpartition("/")[0], p.rpartition("/")[2]) for i, p in d.items()]
        return tree.tree_nodes(spark.createDataFrame(rows, "id bigint, final_path string, parent_path string, name string"))

    read = lambda df: {r.path_key: (r.inode, r.live) for r in df.collect()}
    first = tree.assign_node_ids(nodes({1: "a/x", 2: "b/y"}))
    assert read(first) == {"": (1, True), "a": (2, True), "a/x": (3, True), "b": (4, True), "b/y": (5, True)}
    second = tree.assign_node_ids(nodes({1: "a/x", 3: "a/z"}), first)
    assert read(second) == {"": (1, True), "a": (2, True), "a/x": (3, True), "a/z": (6, True), "b": (4, False), "b/y": (5, False)}
    third = tree.assign_node_ids(nodes({1: "a/x"}), second)
    # Six entries against three live ones: kept. One more round drops the retired ones.
    assert read(third)["b"] == (4, False)
    fourth = tree.assign_node_ids(nodes({7: "c"}), third)
    assert read(fourth) == {"": (1, True), "c": (7, True)}
    fifth = tree.assign_node_ids(nodes({7: "c", 8: "b/y"}), fourth)
    assert read(fifth)["b"] == (8, True) and read(fifth)["b/y"] == (9, True)


def test_preview_orders_by_component(spark):
    df = spark.createDataFrame([(1, "a b/x"), (2, "a/x"), (3, "a/b/c")], "id bigint, path string")
    got = [r.final_path for r in tree.preview_paths(tree.place(df), 2).collect()]
    assert got == ["a/b/c", "a/x"]


def test_entry_counts(spark):
    df = spark.createDataFrame([(1, "a/b/x"), (2, "a/x"), (3, "y")], "id bigint, path string")
    assert tuple(tree.entry_counts(tree.tree_nodes(tree.place(df))).head()) == (3, 2)
