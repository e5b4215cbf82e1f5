"""Audit of how far the sources of a language differ in their use of words.

Within a language every group, a source, gives each kept term a smoothed share p of parts in a billion, which hangs on
the term's count in the group alone. So the sum of f(p, q) over all terms needs only the joint cells of two groups: how
many terms have count a in one and b in the other. The terms are numbered, and each (group, count) keeps the set of its
terms as a bitmap, stored as 64-bit words that are not zero. AND and popcount of the words of two groups give their
cells; cells with a count of zero follow by complement from the sizes of the sets, so absent terms cost nothing.

The numbers come in chunks of about CHUNK terms, dealt by hash and ordered by frequency, so that terms of like counts
share words. A task holds one chunk of two blocks of at most BLOCK groups, whatever the corpus. Counts are combined
in the tasks that read the texts, and again before each shuffle. Sums of cells are taken modulo 2^64, which is exact
because every result fits a long; quotients are of numbers below 10^18.

Cases: a null text, language or source is an empty one; a group without terms has count 0 for each; repeated rows count
as documents of their own; a language without kept terms gives value 0 for every pair; ties are ordered by the item's
UTF-8 bytes; texts are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, bound_batches, tidy

#: Parts in a billion, added to each count, documents that hold a kept term.
PARTS, PRIOR, LEAST_DOCS = 1_000_000_000, 1, 3
#: Terms in a chunk (about), groups in a block, and words whose cells are reckoned in one matrix.
CHUNK, BLOCK = 4096, 64
#: Distinct (language, source, term) that a task holds before it hands its counts on.
HELD = 200_000
#: Most cells of one matrix; more rows in a word are taken in strips.
CELLS = 1 << 21

#: Bytes of terms: ASCII letters in lower case, bytes of other characters as they are; the rest parts terms.
_FOLD = bytes(c if c >= 0x80 else c | 0x20 if chr(c).isalpha() else 0x20 for c in range(256))


def terms(body: bytes | None) -> list[bytes]:
    return body.translate(_FOLD).split() if body else []


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def counted(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs), partly summed: occurrences and documents of each term; an empty term for each row's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(g[0], g[1], t.decode("utf-8", "replace"), n[t], d) for g, (n, docs) in held.items() for t, d in docs.items()]
            held.clear()
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for g, s, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                n, docs = held.setdefault((g, s), (Counter(), Counter()))
                size -= len(docs)
                found = Counter(terms(body))
                n.update(found)
                docs.update(found.keys())
                docs[b""] += 1
                size += len(docs)
                if size > HELD:
                    yield flush()
                    size = 0
        yield flush()

    rows = df.select(_text(lang), _text(source), _text(text).cast("binary").alias("body"))
    return rows.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count: 1 + floor(PARTS * (count + 1) / (total + kept)), in exact decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(count) + F.lit(PRIOR).cast("decimal(1,0)")) * F.lit(PARTS).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, (wide(total) + wide(kept * PRIOR))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); the square is at most 10^18."""
    return F.call_function("div", (p - q) * (p - q), q)


class Counts:
    """The written tables of one audit: what each group and each language gives each kept term."""

    def __init__(self, df: DataFrame, scratch: Scratch, least_docs: int, lang: str, source: str, text: str):
        raw = counted(df, lang, source, text).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        raw = scratch.write(raw, "counts")
        seen = raw.where("term <> ''")
        vocab = seen.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        sizes = scratch.write(vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n")), "sizes")
        groups = raw.where("term = ''").select("lang", "source").join(F.broadcast(sizes), "lang", "left")
        # A language's chunks are as many as its kept terms ask for, at least one.
        chunks = F.ceil(F.coalesce("kept", F.lit(0)) / CHUNK)
        self.langs = sizes
        bucket = F.pmod(F.xxhash64("term"), F.greatest(F.ceil(F.col("kept") / CHUNK), F.lit(1)))
        dealt = vocab.join(F.broadcast(sizes), "lang").withColumn("chunk", bucket.cast("int"))
        at = F.row_number().over(W.partitionBy("lang", "chunk").orderBy(F.desc("total"), "term")) - 1
        self.vocab = scratch.write(dealt.select("lang", "term", "total", "kept", "lang_n", "chunk", at.alias("at")), "vocab")
        self.cells = scratch.write(seen.select("lang", "source", "term", "n").join(self.vocab, ["lang", "term"]), "cells")
        sums = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
        number = F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("int") - 1
        rows = groups.withColumn("chunks", F.greatest(chunks, F.lit(1)).cast("int")).join(sums, ["lang", "source"], "left").withColumn("number", number)
        self.groups = scratch.write(rows.fillna(0, ["kept", "lang_n", "source_n"]), "groups")


def bitmaps(c: Counts) -> DataFrame:
    """(lang, chunk, number, p, word, bits): the terms of each (group, count) in a word of a chunk, and per (group, chunk) a row of word -1
    with the p of count 0 whose bits are the number of terms in the chunk."""
    word, bit = F.floor(F.col("at") / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    sets = c.cells.groupBy("lang", "source", "n", "chunk", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    facts = c.groups.select("lang", "source", "number", "source_n", "kept")
    rows = sets.join(facts, ["lang", "source"]).select("lang", "chunk", "number", share(F.col("n"), F.col("source_n"), F.col("kept")).alias("p"), "word", "bits")
    sizes = c.vocab.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("bits"))
    none = c.groups.where("kept > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    none = none.join(sizes, ["lang", "chunk"]).select("lang", "chunk", "number", share(F.lit(0), F.col("source_n"), F.col("kept")).alias("p"), F.lit(-1).alias("word"), "bits")
    return rows.unionByName(none)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def joint(number: np.ndarray, p: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of a chunk and the sums of f over its terms for each (group, other group). Rows come ordered by word, then group."""
    head = word < 0
    groups, p0, size = number[head], p[head], int(bits[head][0])
    place = np.searchsorted(groups, number)
    # Terms absent from both, and the share of each group's own sets beside a count of zero on the other side.
    out = size * _f(p0[:, None], p0[None, :])
    place, p, word, bits = place[~head], p[~head], word[~head], bits[~head].view(np.uint64)
    zero = p0[place]
    levels, at = np.unique(place << 31 | p, return_inverse=True)
    many = np.bincount(at, np.bitwise_count(bits), len(levels)).astype(np.int64)
    of, level = levels >> 31, levels & (1 << 31) - 1
    for g in range(len(groups)):
        np.add.at(out[g], of, many * (_f(p0[g], level) - _f(p0[g], p0[of])))
        np.add.at(out[:, g], of, many * (_f(level, p0[g]) - _f(p0[of], p0[g])))
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else []
    for lo, hi in zip(starts, np.r_[starts[1:], len(word)] if len(starts) else []):
        first = lo + np.flatnonzero(np.r_[True, place[lo + 1 : hi] != place[lo : hi - 1]])
        there = place[first]
        q, q0, strip = p[None, lo:hi], zero[None, lo:hi], max(1, CELLS // (hi - lo))
        for i in range(lo, hi, strip):
            j = min(i + strip, hi)
            a, a0 = p[i:j, None], zero[i:j, None]
            cells = np.bitwise_count(bits[i:j, None] & bits[None, lo:hi]).astype(np.int64)
            cells *= _f(a, q) - _f(a0, q) - _f(a, q0) + _f(a0, q0)
            across = np.add.reduceat(cells, first - lo, axis=1)
            np.add.at(out, (place[i:j, None], there[None, :]), across)
    return groups, out


def pair_sums(c: Counts) -> DataFrame:
    """(lang, a, b, value) of every two different groups of a language with kept terms; one row a chunk."""
    blocks = c.groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mine = F.floor(F.col("number") / BLOCK).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    rows = bitmaps(c).join(F.broadcast(blocks), "lang").select("lang", "chunk", F.inline(others), "number", "p", "word", "bits")
    names = ["lang", "chunk", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(at: tuple, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            number, p, word, bits = (np.concatenate(x) for x in zip(*parts))
            groups, sums = joint(number, p, word, bits)
            _, _, i, j = at
            a, b = np.repeat(groups, len(groups)), np.tile(groups, len(groups))
            # Pairs inside a block belong to the task of the block with itself.
            keep = (a != b) & ((i == j) | (a // BLOCK != b // BLOCK))
            a, b, v = a[keep], b[keep], sums.ravel()[keep]
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.int64())], ["lang", "a", "b", "value"])

        now, parts = None, []
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            values = [b.column(k).to_numpy() for k in range(4, 8)]
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if keys[lo] != now and parts:
                        yield whole(now, parts)
                        parts = []
                    now = keys[lo]
                    parts.append([x[lo:hi] for x in values])
        if parts:
            yield whole(now, parts)

    return rows.repartition(*names).sortWithinPartitions(*names, "word", "number", "p").mapInArrow(tidy(run), "lang string, a int, b int, value long")


def audit(df: DataFrame, top: int = 200, least_docs: int = LEAST_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources of a language, and each source's `top` most over-used terms."""
    bound_batches(df.sparkSession)
    c = Counts(df, Scratch(df.sparkSession, "divergence"), least_docs, lang, source, text)
    names = c.groups.select("lang", "source", "number")
    one, two = names.withColumnRenamed("number", "a"), names.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    sums = pair_sums(c).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # Languages without kept terms have no chunk; all their pairs have value 0.
    bare = c.groups.where("kept = 0").select("lang", F.col("number").alias("a"))
    bare = bare.join(bare.select("lang", F.col("a").alias("b")), "lang").where("a <> b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    pairs = sums.unionByName(bare).join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    facts = c.groups.select("lang", "source", "source_n")
    used = c.cells.join(facts, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("source_n"), F.col("kept")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q"))
    over = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(over.select("*", rank).where(F.col("rank") <= top))
