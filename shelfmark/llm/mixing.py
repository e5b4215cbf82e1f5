"""Mixing sources to target weights by the cube method.

Each source has a target number of words. A document is taken floor(r) or floor(r) + 1 times, r being target / size
of its source, and the fractional parts are an inclusion probability that all documents of a source share. The cube
method turns those probabilities into 0 or 1: in the flight phase, three undecided documents at a time move along the
direction that keeps the source's number of words and number of documents (the null space of the two constraints)
until one of them is decided. Sources are flown in many blocks at once; what a block leaves undecided, two documents
at most, flies again in blocks of a source's leftovers, until a source is one block. Its last LANDING undecided
documents land: of all their outcomes the one is chosen that comes closest to the target.

Rows with the same id, source and size are one unit, flown together. A unit's random number comes from its id, so
reruns agree.

Cases: a null text has no words, a null source is a source of its own (the last), a null id is an id, repeated rows
share their unit's copies, an empty table gives an empty result; words are counted in whole texts; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, Scratch, small, spare_name

#: Units that fly together, and the most sources that may be planned (their table is handled on the driver).
BLOCK, MAX_SOURCES = 4096, 1_000_000
#: Units a source that are decided by the landing phase.
LANDING = 12
CAP = 3


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def plan(sizes: dict[str | None, int], weights: list[int] = (1, 2, 3), cap: int = CAP) -> dict[str | None, Fraction]:
    """Target words a source: shares of the total by weight, none above cap times its size, the excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > cap * sizes[s]]
        if not full:
            return out | {s: weight[s] * share for s in open_}
        for s in full:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        open_.difference_update(full)
    return out


def fly(size: np.ndarray, count: np.ndarray, p: np.ndarray, draw: np.ndarray, keep: int = 2) -> np.ndarray:
    """Flight phase over one block; at most `keep` entries (two or more) of the result are strictly between 0 and 1.

    Keeps sum(p * size) and sum(p * count). `draw` has one uniform number a unit, used when the unit joins. The last
    undecided units stay on the ground.
    """
    p, eps = p.copy(), 1e-9
    held: list[int] = []
    undecided = np.flatnonzero((p > eps) & (p < 1 - eps))
    grounded = set(undecided[max(0, len(undecided) - (keep - 2)) :].tolist())
    for i in range(len(p)):
        if i in grounded:
            continue
        if not eps < p[i] < 1 - eps:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # The direction that changes neither constraint: the cross product of their rows.
        u = [size[b] * count[c] - size[c] * count[b], size[c] * count[a] - size[a] * count[c], size[a] * count[b] - size[b] * count[a]]
        top = max(map(abs, u))
        if top == 0:  # the rows are parallel: a pair can move alone
            u, top = [float(count[b] or size[b] or 1), -float(count[a] or size[a] or 1), 0.0], 1.0
        u = [x / top for x in u]
        ups = min([(1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(held, u) if abs(x) > 1e-15])
        downs = min([p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(held, u) if abs(x) > 1e-15])
        step = ups if draw[i] * (ups + downs) < downs else -downs
        for k, x in zip(held, u):
            p[k] += step * x
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = round(p[k])
        held = [k for k in held if 0 < p[k] < 1]
        while len(held) > 2:  # rounding left all three inside: decide the one that is nearest to a bound
            k = min(held, key=lambda j: min(p[j], 1 - p[j]))
            p[k] = round(p[k])
            held.remove(k)
    return p


def land(size: np.ndarray, count: np.ndarray, p: np.ndarray, missing: float) -> np.ndarray:
    """Decide the last units of a source: of all outcomes the one whose words are nearest to `missing`.

    A document too many or too few counts as a twentieth of a mean document's words.
    """
    chosen = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    off = np.abs(chosen @ size - missing) + np.abs(chosen @ count - p @ count) * (size.mean() / 20)
    return chosen[int(np.argmin(off))].astype(np.float64)


UNIT = "doc_id long, source string, size long, n long, sid int, p double, draw double, block long"


def _flight(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Fly every block of the sorted rows; a block may span batches."""
    held: list[pa.RecordBatch] = []

    def done(part: pa.Table) -> pa.RecordBatch:
        size, n = part["size"].to_numpy().astype(float), part["n"].to_numpy().astype(float)
        p = fly(size * n, n, part["p"].to_numpy(), part["draw"].to_numpy(), keep)
        return part.set_column(part.schema.get_field_index("p"), "p", pa.array(p)).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        sid, block = rows["sid"].to_numpy(), rows["block"].to_numpy()
        cuts = np.flatnonzero((sid[1:] != sid[:-1]) | (block[1:] != block[:-1])) + 1
        begins = [0, *cuts.tolist()]
        for i, j in zip(begins, begins[1:]):
            yield done(rows.slice(i, j - i))
        held = rows.slice(begins[-1]).combine_chunks().to_batches()
    if held:
        yield done(pa.Table.from_batches(held))


def mix(df: DataFrame, weights: list[int] = (1, 2, 3), cap: int = CAP, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(units, sources). units: doc_id, source, size, n (rows of the unit), copies (times to take each of its rows);
    sources: sid, source, source_size, target. Units join rows null-safely by id, source and words(text)."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "mixing")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words(text).alias("size"))
    units = scratch.write(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = plan({r["source"]: r["source_size"] for r in found}, list(weights), cap)
    planned = []
    for sid, r in enumerate(found):
        ratio = targets[r["source"]] / r["source_size"] if r["source_size"] else Fraction(0)
        whole = min(int(ratio), cap)
        planned.append((sid, r["source"], r["source_size"], float(targets[r["source"]]), whole, float(ratio - whole), max(1, -(-r["units"] // BLOCK)), float(targets[r["source"]] - whole * r["source_size"])))
    sources = spark.createDataFrame(planned, "sid int, source string, source_size long, target double, whole int, p double, blocks long, rest double")
    sources = scratch.write(sources, "sources")
    hashed = F.xxhash64("doc_id", "size", F.lit("cube"))
    open_ = units.join(sources.select(F.col("source").alias("s"), "sid", "p", "blocks"), F.col("source").eqNullSafe(F.col("s")))
    open_ = open_.withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit("draw")), 11) * F.lit(2.0**-53))
    open_ = open_.withColumn("block", F.pmod(hashed, F.col("blocks"))).select(*[c.split()[0] for c in UNIT.split(", ")])
    decided, most, undecided = [], max([r[6] for r in planned], default=1), None
    while True:
        keep = 2 if most > 1 else LANDING
        flown = open_.repartition("sid", "block").sortWithinPartitions("sid", "block", "draw", "doc_id", "size")
        flown = flown.mapInArrow(lambda batches, keep=keep: _flight(batches, keep), UNIT)
        flown = scratch.write(flown, "flown")
        undecided = flown.where("p > 0 AND p < 1")
        decided.append(flown.where("p = 0 OR p = 1"))
        if most == 1:
            break
        # At most two units are left of each block; a source's blocks become fewer by BLOCK / 2.
        most = -(-2 * most // BLOCK)
        open_ = undecided.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(most)), F.lit(most)))
    last = landed(undecided, decided, sources)
    every = last
    for part in decided:
        every = every.unionByName(part)
    out = every.join(sources.select("sid", "whole"), "sid").select("doc_id", "source", "size", "n", (F.col("whole") + F.col("p").cast("int")).alias("copies"))
    return scratch.write(out, "copies"), sources.select("sid", "source", "source_size", "target")


def landed(undecided: DataFrame, decided: list[DataFrame], sources: DataFrame) -> DataFrame:
    """The last units of all sources, LANDING a source at most, decided."""
    taken = None
    for part in decided:
        sums = part.groupBy("sid").agg(F.sum(F.col("p") * F.col("size") * F.col("n")).alias("w"))
        taken = sums if taken is None else taken.unionByName(sums)
    missing = sources.join(taken.groupBy("sid").agg(F.sum("w").alias("w")), "sid", "left").select("sid", (F.col("rest") - F.coalesce("w", F.lit(0.0))).alias("missing"))

    def run(_, part):
        part = part.sort_by([("doc_id", "ascending"), ("size", "ascending")])
        n = part["n"].to_numpy().astype(float)
        p = land(part["size"].to_numpy() * n, n, part["p"].to_numpy(), part["missing"][0].as_py())
        names = [c.split()[0] for c in UNIT.split(", ")]
        return part.set_column(part.schema.get_field_index("p"), "p", pa.array(p)).select(names)

    return undecided.join(missing, "sid").groupBy("sid").applyInArrow(run, UNIT)


def mixed(df: DataFrame, weights: list[int] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; a taken word counts as often as its document is taken."""
    units, sources = mix(df, weights, cap)
    rows = units.join(sources.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(df: DataFrame, weights: list[int] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """The rows of df, each as often as the mix takes it, all columns."""
    units, _ = mix(df, weights, cap)
    size = spare_name(df, "row_size")
    chosen = units.where("copies > 0").select(F.col("doc_id").alias("u_id"), F.col("source").alias("u_source"), F.col("size").alias("u_size"), "copies")
    rows = df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns], words().alias("r_" + size), F.col("doc_id").cast("long").alias("k_id"), F.col("source").cast("string").alias("k_source"))
    same = F.col("k_id").eqNullSafe(F.col("u_id")) & F.col("k_source").eqNullSafe(F.col("u_source")) & (F.col("r_" + size) == F.col("u_size"))
    taken = rows.join(small(chosen), same)
    taken = taken.withColumn("k_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"r_{c}").alias(c) for c in df.columns])
