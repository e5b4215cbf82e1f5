"""Near-duplicates by SimHash and by Jaccard similarity.

The pipeline's stage links texts by the rule of `simhash.py` (fingerprints at BITS_APART or fewer differing bits, found by
anchor points) and, beside it, texts whose sets of word shingles agree in SIMILAR or more of their union. Either link is
enough; components are taken once, over both. Without `bits` only the second rule holds. The rest is about that one.

Candidates are texts that meet in one of BANDS buckets, a bucket being ROWS MinHash values in a row; each is then
verified exactly on the whole sets, in integers. A pair of similarity 0.8 meets in no bucket with a probability of
(1 - 0.8^5)^32 = 3 in a million, of 0.85 in 2 in a hundred million; what meets nowhere escapes, unless other links
connect it. Equal sets always link: they are one node.

Why both: a pair of similarity 0.8 differs in some ten of 64 bits, which would take too many anchors, while texts within
three bits need not be similar as sets (a repeated shingle counts each time in a fingerprint, once in a set).

No rule caps a bucket. In one of up to SMALL_BUCKET nodes all pairs are verified. A larger one is first verified
against one node of it, then what is not in its main component against GUIDES nodes of that component. What is still
outside then meets all of the bucket that it is not connected with, in chunks of at most CHUNK nodes and CHUNK_BYTES: a
task holds two chunks and counts the common shingles of all their pairs as a product of two incidence matrices. Only
links leave it, at most one a node, so no row stands for a pair that is not similar. A group of near copies costs
little more than its size; members that link with nothing are compared with all, CHUNK squared at a time.

Cases: null or wordless texts have an empty set (and fingerprint 0) and link with each other only; texts shorter than SHINGLE words are
one shingle; case is ignored in ASCII; a null key shares its component but never names it; repeated rows stay; an
empty table gives an empty result; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, as_bytes, bound_batches, small, tidy
from shelfmark.llm.components import components
from shelfmark.llm.simhash import deduplicate, fingerprint, labelled
from shelfmark.llm.simhash import links as anchor_links

#: Words in a shingle, and the least similarity as a fraction (0.8).
SHINGLE, SIMILAR = 5, (4, 5)
BANDS, ROWS, SEED = 32, 5, 43
#: Differing bits of two SimHash fingerprints that the pipeline's stage links.
BITS_APART = 3
SMALL_BUCKET, GUIDES = 32, 8
#: Nodes and bytes of sets in a chunk (on average), and columns of an incidence matrix.
CHUNK, CHUNK_BYTES, COLUMNS = 512, 16 << 20, 4096
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
    else:
        words = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in words), np.uint64, len(words)))


def set_hash(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def buckets(found: np.ndarray) -> np.ndarray:
    """The buckets of a set: a hash of ROWS MinHash values for each band."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(found), 2048):
        h = _FACTORS[:, None] * found[None, i : i + 2048]
        h ^= h >> np.uint64(31)
        h *= _MIX
        least = np.minimum(least, h.min(1))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).astype(np.int64))


def sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp, mark, bands): fp stands for the whole set, mark is the SimHash fingerprint. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [shingles(t) for t in texts]
            bands = pa.array([buckets(x) for x in found], pa.list_(pa.int64()))
            columns = [b.column(0), _signed([set_hash(x) for x in found]), _signed([fingerprint(t) for t in texts]), bands]
            yield pa.RecordBatch.from_arrays(columns, [key, "fp", "mark", "bands"])

    return df.select(F.col(key), as_bytes(text).alias("body")).mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, fp long, mark long, bands array<long>")


def marked_links(docs: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """(u, v), u > v: links between sets (fp) whose texts have SimHash fingerprints (mark) at `bits` or fewer differing bits."""
    marks = scratch.write(docs.select("mark", "fp").distinct(), "marks")
    lows = scratch.write(marks.groupBy("mark").agg(F.min("fp").alias("low")), "lows")
    # A fingerprint becomes some 150 replicas: spread the few bytes of all fingerprints first.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = anchor_links(lows.select(F.col("mark").alias("fp")).repartition(parts, "fp"), bits, at_once=256)
    end = lambda x: lows.select(F.col("mark").alias(x), F.col("low").alias(f"low_{x}"))
    across = near.join(end("u"), "u").join(end("v"), "v").select(F.col("low_u").alias("a"), F.col("low_v").alias("b"))
    within = marks.join(lows, "mark").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return across.unionByName(within).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def candidates(nodes: DataFrame) -> DataFrame:
    """(u, v, bucket) of (fp, bands): all pairs of small buckets, with a null bucket; of a large one each node with the smallest."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, first, held = None, None, []

        def pairs() -> list[tuple[int, int, None]]:
            return [(held[i], held[j], None) for i in range(len(held)) for j in range(i)]

        for b in batches:
            out: list[tuple] = []
            for at, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if at != bucket:
                    out += pairs()
                    bucket, first, held = at, fp, []
                if len(held) < SMALL_BUCKET and (held or fp == first):
                    held.append(fp)
                else:
                    out += [(x, first, bucket) for x in held[1:]] + [(fp, first, bucket)]
                    held = []
            yield batch(out)
        yield batch(pairs())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v", "bucket"])

    rows = nodes.select(F.explode("bands").alias("bucket"), "fp")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(tidy(meet), "u long, v long, bucket long")


def whole_sets(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(fp, size, found) of the nodes in wanted (fp, low), read from the rows of their smallest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t) for t in b.column(0).to_pylist()]
            sizes = pa.array([len(x) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([_signed([set_hash(x) for x in found]), sizes, pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))], ["fp", "size", "found"])

    lows = small(wanted.select("low").distinct())
    bodies = df.select(F.col(key).alias("own"), as_bytes(text).alias("body")).join(lows, F.col("own").eqNullSafe(F.col("low")), "left_semi").select("body")
    sets = bodies.mapInArrow(tidy(run), "fp long, size int, found array<long>")
    return sets.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (u, v), u > v, of pairs whose sets are similar."""
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("size").alias(f"size_{x}"), F.col("found").alias(f"found_{x}"))
    common, (n, d) = F.size(F.array_intersect("found_u", "found_v")), SIMILAR
    sizes = (d * F.least("size_u", "size_v") >= n * F.greatest("size_u", "size_v"))
    return pairs.join(side("v"), "v").join(side("u"), "u").where(sizes).where(d * common >= n * (F.col("size_u") + F.col("size_v") - common)).select("u", "v")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """key, fp and component_id (the smallest key that is reachable through links, itself included) of every row.

    With `bits`, SimHash fingerprints at that many or fewer differing bits link as well."""
    bound_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "similar")
    docs = scratch.write(sketches(df, key, text), "sketches")
    # Equal sets have equal bands.
    distinct = scratch.write(docs.groupBy("fp").agg(F.min(key).alias("low"), F.any_value("bands").alias("bands")), "distinct")
    met = scratch.write(candidates(distinct), "candidates")
    distinct = distinct.drop("bands")
    pairs = scratch.write(met.select("u", "v").distinct(), "pairs")
    large = met.where("bucket IS NOT NULL")
    large = scratch.write(large.select("bucket", F.col("u").alias("node")).unionByName(large.select("bucket", F.col("v").alias("node")).distinct()), "large")
    nodes = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    wanted = scratch.write(distinct.join(nodes, "fp", "left_semi"), "wanted")
    sets = scratch.write(whole_sets(df, wanted, key, text), "sets")
    found = verified(pairs, sets)
    if bits is not None:
        found = found.unionByName(marked_links(docs, bits, scratch))
    labels = components(found, scratch)
    if not large.isEmpty():
        for find in (_guided, _outside):
            links = scratch.write(find(large, labels, sets, scratch), "links")
            labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(links), scratch)
    return labelled(docs.select(key, "fp"), distinct, labels, scratch, key)


def _marked(large: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node, label, main): the nodes of buckets with more than one component, and the largest component of each."""
    now = scratch.write(large.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "labelled")
    counts = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1").drop("components")
    return now.join(main, "bucket")


def _guided(large: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) between nodes outside the main component of a bucket and GUIDES nodes inside."""
    marked = _marked(large, labels, scratch)
    part = F.pmod(F.xxhash64("node"), F.lit(GUIDES))
    guides = marked.where("label = main").groupBy("bucket", part.alias("part")).agg(F.min("node").alias("b"))
    met = marked.where("label <> main").select("bucket", F.col("node").alias("a")).join(guides.select("bucket", "b"), "bucket")
    return verified(met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), sets)


def _outside(large: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) between nodes outside the main component of a bucket and all of other components."""
    marked = _marked(large, labels, scratch).select("bucket", "node", "label", (F.col("label") == F.col("main")).alias("inside"))
    sized = marked.join(sets.select(F.col("fp").alias("node"), "size"), "node")
    # Sets whose sizes are not within 4 : 5 are never similar: classes are that wide, so only neighbours meet.
    level = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)) / 1.0) / math.log(SIMILAR[1] / SIMILAR[0]) + 1e-9).cast("int")
    sized = scratch.write(sized.withColumn("level", F.explode(F.array(level, level + 1))).withColumn("own", F.col("level") == level), "sized")
    room = lambda x: F.greatest(F.ceil(F.count_if(x) / CHUNK), F.ceil(F.sum(F.when(x, F.col("size")).otherwise(0)) * 8 / CHUNK_BYTES), F.lit(1)).cast("int")
    rooms = sized.groupBy("bucket", "level").agg(room(~F.col("inside")).alias("n_out"), room(F.col("inside")).alias("n_in"), F.count_if(~F.col("inside")).alias("outside")).where("outside > 0").drop("outside")
    deal = lambda n: F.pmod(F.xxhash64("node", "bucket"), F.col(n)).cast("int")
    seats = sized.join(rooms, ["bucket", "level"])
    mine, all_out = deal("n_out"), F.sequence(F.lit(0), F.col("n_out") - 1)
    # Chunks outside meet each other and all chunks inside, numbered after them.
    inner = F.transform(all_out, lambda o: F.struct(o.alias("i"), (F.col("n_out") + deal("n_in")).alias("j"), F.lit(1).alias("side")))
    same = F.transform(all_out, lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), F.when(mine > o, 1).otherwise(0).alias("side")))
    cross = F.transform(F.sequence(F.lit(0), F.col("n_in") - 1), lambda c: F.struct(mine.alias("i"), (F.col("n_out") + c).alias("j"), F.lit(0).alias("side")))
    seats = seats.select("bucket", "level", "own", "node", "label", F.inline(F.when(F.col("inside"), inner).otherwise(F.concat(same, cross))))
    rows = seats.join(sets.select(F.col("fp").alias("node"), "found"), "node")
    names = ["bucket", "level", "i", "j"]
    rows = rows.select(*names, "side", "own", "node", "label", "found").repartition(*names).sortWithinPartitions(*names)
    return rows.mapInArrow(tidy(_compare), "u long, v long").distinct()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []
    for b in batches:
        ats = list(zip(*(b.column(k).to_pylist() for k in range(4))))
        facts = [b.column(k).to_pylist() for k in range(4, 8)]
        for n, at in enumerate(ats):
            if at != now:
                if held:
                    yield _links(now, held)
                now, held = at, []
            held.append((*(f[n] for f in facts), b.column(8)[n].values.to_numpy()))
    if held:
        yield _links(now, held)


def _links(at: tuple, held: list[tuple]) -> pa.RecordBatch:
    """A forest of the links between the two sides of a chunk pair, between different labels only."""
    sides, own, nodes, labels, sets = (list(x) for x in zip(*held))
    left, right = ([k for k, s in enumerate(sides) if s == side] for side in (0, 1))
    if at[2] == at[3]:
        right = left
    out = []
    if left and right:
        common = _common([sets[k] for k in left], [sets[k] for k in right])
        a, b = (np.array([len(sets[k]) for k in side], np.int64) for side in (left, right))
        n, d = SIMILAR
        similar = d * common >= n * (a[:, None] + b[None, :] - common)
        group: dict[int, int] = {}

        def root(x: int) -> int:
            while group.get(x, x) != x:
                group[x] = x = group.get(group[x], group[x])
            return x

        for x, y in zip(*np.nonzero(similar)):
            x, y = left[x], right[y]
            # Two nodes that are both guests from the level below meet there.
            if own[x] or own[y]:
                p, q = root(labels[x]), root(labels[y])
                if p != q:
                    group[p] = q
                    out.append((max(nodes[x], nodes[y]), min(nodes[x], nodes[y])))
    columns = zip(*out) if out else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v"])


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of left with each of right (sorted distinct values)."""
    values, at = np.unique(np.concatenate(left + right), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    cut = int(sum(map(len, left)))
    # Only values on both sides count; they are numbered anew and taken in strips.
    both = np.bincount(at[:cut], minlength=len(values)).astype(bool) & np.bincount(at[cut:], minlength=len(values)).astype(bool)
    number, use = np.cumsum(both) - 1, both[at]
    at, rows = number[at[use]], rows[use]
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, int(both.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [c, c + COLUMNS])
        strip = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        strip[rows[lo:hi], at[lo:hi] - c] = 1
        out += (strip[: len(left)] @ strip[len(left) :].T).astype(np.int64)
    return out


def deduplicate_similar(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, all columns, chosen as `simhash.deduplicate` does."""
    return deduplicate(df, key=key, text=text, find=near_duplicates, mark=lambda body: set_hash(shingles(body)))


def deduplicate_near(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS_APART) -> DataFrame:
    """One row of each component that SimHash at `bits` and Jaccard similarity link, all columns, chosen as `simhash.deduplicate` does."""
    find = lambda rows, name, body: near_duplicates(rows, name, body, bits)
    return deduplicate(df, key=key, text=text, find=find, mark=lambda body: set_hash(shingles(body)))
