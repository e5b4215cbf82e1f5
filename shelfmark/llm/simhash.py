"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: every fingerprint is within the covering radius of an anchor, its home.
The code is a product of perfect codes over disjoint bit blocks, two binary Golay codes of 23 bits (covering radius
3 each) and a Hamming code of 15 bits (radius 1): 2^35 anchors, some 150 of them in reach of a fingerprint. Two fingerprints that differ in d <= 3
bits have a point z between them, at most 1 bit from one and 2 bits from the other; the home of z is then within the
covering radius plus 2 of both. So each fingerprint is replicated to all anchors within the covering radius plus
ceil(threshold / 2), counted per block, and fingerprints are compared per anchor. No link can be missed, and no
rule caps an anchor: in a small group all pairs are compared at once, a large group is searched breadth first, where
each fingerprint that has been reached leaves the rest, so that a group of near copies costs little more than its
size. A group hands on at most one link a member, never its pairs.

Cases: null or wordless texts have fingerprint 0 and link like any other; a null key shares its component but never
names it (a component of null keys only has a null id); repeated rows stay; an empty table gives an empty result;
texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, as_bytes, bound_batches, small, spare_name, tidy
from shelfmark.llm.components import components

#: Fixed values of the fingerprint: hash seed, words in a shingle, bits.
SEED, SHINGLE, BITS = 42, 3, 64
#: Groups up to this size are compared by offsets, many groups at once; larger ones are searched one by one.
SMALL_GROUP = 32
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_POWERS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Unsigned SimHash over the XXH64 of all word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
    else:
        words = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in words), np.uint64, len(words))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(_POWERS[2 * counts > len(words)].sum())


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as a signed long. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], [key, "fp"])

    return df.select(F.col(key), as_bytes(text).alias("body")).mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, fp long")


class Block:
    """A perfect code over `width` bits from bit `shift` on, given by the syndrome of each bit.

    `reach` lists, for a syndrome, the difference patterns that lead from a point with it to an anchor within the
    covering radius plus `slack`, and how far beyond the radius each lies.
    """

    def __init__(self, shift: int, columns: list[int], radius: int, slack: int):
        self.shift, self.width = np.uint64(shift), len(columns)
        patterns, syndromes, weights = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        layers, top = [(patterns, syndromes, np.full(1, -1))], np.full(1, -1)
        for _ in range(radius + slack):
            grown = [(p | np.uint64(1 << i), s ^ columns[i], np.full(len(p), i)) for i in range(self.width) for p, s in [(patterns[top < i], syndromes[top < i])]]
            patterns, syndromes, top = (np.concatenate(x) for x in zip(*grown))
            layers.append((patterns, syndromes, top))
        patterns, syndromes = np.concatenate([x[0] for x in layers]), np.concatenate([x[1] for x in layers])
        weights = np.bitwise_count(patterns).astype(np.int64)
        order = np.lexsort((weights, syndromes))
        self.patterns, self.excess = patterns[order] << self.shift, np.maximum(weights[order] - radius, 0)
        size = int(max(columns)).bit_length()
        self.starts = np.searchsorted(syndromes[order], np.arange((1 << size) + 1))
        self.columns = np.array(columns, np.int64)
        self.mask = np.uint64(((1 << self.width) - 1) << shift)

    def syndrome(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for i in range(self.width):
            out ^= ((points >> (self.shift + np.uint64(i))) & np.uint64(1)).astype(np.int64) * self.columns[i]
        return out


def golay_columns() -> list[int]:
    """Syndromes of the 23 bits: powers of x modulo the Golay generator x^11+x^10+x^6+x^5+x^4+x^2+1 (fixed value)."""
    out, v = [], 1
    for _ in range(23):
        out.append(v)
        v = v << 1 ^ (0xC75 if v >> 10 else 0)
    return out


@cache
def blocks(slack: int) -> tuple[Block, ...]:
    return (Block(0, golay_columns(), 3, slack), Block(23, golay_columns(), 3, slack), Block(46, list(range(1, 16)), 1, slack))


def anchors(points: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the point) for every anchor within the covering radius plus slack of each point."""
    at, anchor, excess = np.arange(len(points)), np.zeros(len(points), np.uint64), np.zeros(len(points), np.int64)
    for b in blocks(slack):
        s = b.syndrome(points)[at]
        n = b.starts[s + 1] - b.starts[s]
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pick = np.repeat(b.starts[s], n) + rank
        at, anchor, excess = np.repeat(at, n), np.repeat(anchor, n), np.repeat(excess, n)
        excess = excess + b.excess[pick]
        ok = excess <= slack
        at, excess = at[ok], excess[ok]
        anchor = anchor[ok] | ((points[at] & b.mask) ^ b.patterns[pick[ok]])
    return anchor, at


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member of its component) among n members; at most one a member."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while (label != (deeper := label[label])).any():
            label = deeper
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def search(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (reached, reached from) of a breadth-first search; what has been reached is not compared again."""
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= threshold
            if near.any():
                reached = rest[near]
                a.append(reached)
                b.append(np.full(len(reached), at))
                frontier.extend(reached)
                rest = rest[~near]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def compare(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of equal, adjacent anchors, as row numbers."""
    if len(anchor) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, len(anchor)])
    left = np.repeat(size, size)
    small = np.flatnonzero((left > 1) & (left <= SMALL_GROUP))
    a, b = [], []
    for k in range(1, min(SMALL_GROUP, int(size.max()))):
        i = small[small + k < len(anchor)]
        i = i[(left[i] > k) & (anchor[i + k] == anchor[i])]
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= threshold]
        a.append(i)
        b.append(i + k)
    if a:
        linked, back = np.unique(np.concatenate(a + b), return_inverse=True)
        half = len(back) // 2
        child, root = forest(len(linked), back[:half], back[half:])
        a, b = [linked[child]], [linked[root]]
    for f, n in zip(first[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        child, parent = search(fp[f : f + n], threshold)
        a.append(child + f)
        b.append(parent + f)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(distinct: DataFrame, threshold: int = 3, at_once: int = 4096) -> DataFrame:
    """(u, v), u > v: links between the distinct values of `fp` that connect all at `threshold` or fewer bits.

    at_once: fingerprints whose replicas a task makes together; fewer take less memory."""
    slack = math.ceil(threshold / 2)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy().astype(np.uint64)
            for i in range(0, len(points), at_once):
                part = points[i : i + at_once]
                anchor, at = anchors(part, slack)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(part[at].astype(np.int64))], ["anchor", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = compare(anchor, fp.astype(np.uint64), threshold)
            u, v = np.maximum(fp[a], fp[b]), np.minimum(fp[a], fp[b])
            pairs = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            anchor, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(anchor):
                continue
            cut = int(np.searchsorted(anchor, anchor[-1]))  # rows are sorted; the last group may go on
            if cut or (held and held[-1][0][-1] != anchor[0]):
                held.append((anchor[:cut], fp[:cut]))
                yield found(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append((anchor[cut:], fp[cut:]))
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held)))

    replicas = distinct.select("fp").mapInArrow(tidy(replicate), "anchor long, fp long")
    return replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(meet), "u long, v long").distinct()


def near_duplicates(df: DataFrame, threshold: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id (the smallest key that is reachable through links, itself included) of every row."""
    bound_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.write(fingerprints(df, key, text), "fingerprints")
    distinct = scratch.write(docs.groupBy("fp").agg(F.min(key).alias("low")), "distinct")
    return labelled(docs, distinct, components(links(distinct, threshold), scratch), scratch, key)


def labelled(docs: DataFrame, distinct: DataFrame, labels: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """key, fp and component_id of docs (key, fp), from distinct (fp, low) and labels (node, label) of the linked fp."""
    linked = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    linked = scratch.write(linked.join(distinct, linked["node"] == distinct["fp"]).select("fp", "label", "low"), "linked")
    lows = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    of_linked = linked.join(lows, "label").select("fp", "component_id")
    ids = distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return docs.join(ids, "fp").select(key, "fp", "component_id")


def deduplicate(
    df: DataFrame,
    threshold: int = 3,
    key: str = "doc_id",
    text: str = "text",
    find: Callable[[DataFrame, str, str], DataFrame] | None = None,
    mark: Callable[[bytes | None], int] = fingerprint,
) -> DataFrame:
    """One row of each component, all columns: that of the smallest id.

    A null id is replaced, for the choice only, by a number above 2^62 made from the row's columns. Where an id is
    repeated, its rows are told apart by their fingerprints: of equal ones a single row stays.
    `find` and `mark` put another rule in the place of `near_duplicates` at `threshold` bits and of `fingerprint`.
    """
    bound_batches(df.sparkSession)
    scratch, name = Scratch(df.sparkSession, "deduplicate"), spare_name(df, "row_key")
    made = F.shiftrightunsigned(F.xxhash64(*df.columns), 2) + F.lit(2**62)
    keyed = df.withColumn(name, F.coalesce(F.col(key).cast("long"), made))
    found = find(keyed, name, text) if find else near_duplicates(keyed, threshold, name, text)
    chosen = F.col(name) == F.col("component_id")
    counts = found.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.count_if(chosen).alias("n_chosen")).where("n > 1 OR n_chosen = 0")
    other = scratch.write(counts.select(name, (F.col("n_chosen") > 0).alias("repeated")), "other")
    out = keyed.join(small(other.select(name)), name, "left_anti")
    repeated = other.where("repeated").select(name)
    if not repeated.isEmpty():
        fp = spare_name(keyed, "row_fp")
        rows = keyed.join(repeated, name, "left_semi").withColumn(fp, _fingerprint(as_bytes(text), mark))
        rows = rows.join(found.where(chosen).select(name, F.col("fp").alias(fp)).distinct(), [name, fp], "left_semi")
        out = out.unionByName(rows.dropDuplicates([name, fp]).drop(fp))
    return out.select(*df.columns)


def _fingerprint(body: Column, mark: Callable[[bytes | None], int]) -> Column:
    """`fp` of a column of bytes."""

    @F.pandas_udf("long")
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series(np.array([mark(t) for t in bodies], np.uint64).astype(np.int64))

    return run(body)


def hex_fingerprint() -> Column:
    return F.lpad(F.lower(F.hex("fp")), 16, "0")
