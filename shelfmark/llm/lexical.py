"""Ranked lexical search with bit-sliced Bloom signatures: bounds first, exact scores for what they cannot exclude.

The index. A document's signature holds its distinct terms, and for terms that occur 2, 4, 8... times or more the pairs
(term, 2), (term, 4)... as well. Documents of about the same size share a block, whose width fits that size, so long
texts do not fill their signatures. A block is stored in slices: slice i is the bitmap of its documents with bit i. A
lexicon beside it has the documents and occurrences of each term, and the totals of the corpus.

The search. In a block the AND of a term's slices marks every document that may hold it, never too few; so a term adds
at most its weight times its largest factor at the highest marked count. The weighted sums of all terms, one matrix
product for a whole query set, are upper bounds of the scores. The best bounds of each query are scored exactly, whose
k-th score is a floor; every document whose bound reaches the floor is scored exactly, so nothing is lost, ties
included. A false mark costs time only. Queries are taken in sets of at most QUERY_TERMS terms.

Scores are 64-bit integers but for the weight's logarithm; bounds are doubles with a margin for rounding.

Cases: null or wordless texts are never found; a query without terms finds nothing; a document is a row: repeated rows
are ranked one by one, rows with a null id after others of the same score; texts and queries are taken whole; a
query's repeated terms count as often as they occur; two queries of one id are two rows of it, each with its own ranks;
an empty table of either kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, bound_batches, small, tidy

#: Bits set for an entry, and bits of a signature for each entry that the block's largest document may have.
HASHES, BITS = 4, 12
#: Most documents and most cells (documents x bits) of a block, and the narrowest signature.
BLOCK_DOCS, BLOCK_CELLS, LEAST_BITS = 1024, 1 << 23, 256
#: Terms that a task counts before it hands them on, distinct terms of a query set, and bounds scored exactly to find the floor.
HELD, QUERY_TERMS, SEEDS = 200_000, 4096, 32
#: Counts of a term with entries of their own; the bound of a count is one less than the next, or the document's length.
STEPS = (1, 2, 4, 8, 16, 32, 64)

#: Bytes of terms: ASCII digits and letters, in lower case, and all bytes of other characters; the rest parts terms.
_FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() else c | 0x20 if chr(c).isalpha() else 0x20 for c in range(256))
BLOCKS = "width int, keys array<long>, lengths array<long>, slices binary"


def terms(body: bytes | None) -> list[bytes]:
    return body.translate(_FOLD).split() if body else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def scale(length: int, n: int, total: int) -> int:
    """m: how a document of `length` terms compares with the average; `n` documents have `total` terms."""
    return 100 - 75 + (75 * length * n) // total


def factor(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def entries(found: Counter) -> list[bytes]:
    """What a signature holds: each term, and the term with each step that its count reaches."""
    out = list(found)
    for t, n in found.items():
        if n > 1:
            out += [t + bytes([0, k]) for k, step in enumerate(STEPS) if 1 < step <= n]
    return out


def places(entry: bytes) -> tuple[int, int]:
    """Two hashes whose sums give an entry's bits in a signature of any width."""
    h = xxhash.xxh3_128_intdigest(entry)
    return h & 0xFFFFFFFF, (h >> 64) & 0xFFFFFFFF | 1


def bits(pairs: np.ndarray, width: int) -> np.ndarray:
    """The HASHES bits of each entry; widths are powers of two."""
    return (pairs[:, :1] + pairs[:, 1:] * np.arange(HASHES)) & (width - 1)


def width_of(size: int) -> int:
    return max(LEAST_BITS, 1 << (size * BITS - 1).bit_length())


class _Block:
    def __init__(self, width: int):
        self.width, self.keys, self.lengths, self.docs, self.marks = width, [], [], [], []
        self.room = max(8, min(BLOCK_DOCS, BLOCK_CELLS // width))

    def add(self, key: int, length: int, pairs: list[tuple[int, int]]) -> None:
        found = np.unique(bits(np.array(pairs, np.int64), self.width))
        self.docs.append(np.full(len(found), len(self.keys), np.int32))
        self.marks.append(found)
        self.keys.append(key)
        self.lengths.append(length)

    def row(self) -> tuple:
        docs = -(-len(self.keys) // 8) * 8
        slices = np.zeros(self.width * docs // 8, np.uint8)
        at = np.concatenate(self.marks) * docs + np.concatenate(self.docs)
        np.bitwise_or.at(slices, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        return self.width, self.keys, self.lengths, slices.tobytes()


def row_key(key: Column, body: Column) -> Column:
    """Finds an indexed row again. Rows that share it are merely scored together."""
    return F.xxhash64(key, body)


class Index:
    """Blocks of signatures (BLOCKS), lexicon (term, df, n) and totals of one table, written to the shared folder."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text"):
        bound_batches(df.sparkSession)
        self.spark, self.scratch = df.sparkSession, Scratch(df.sparkSession, "lexical")
        body = F.col(text).cast("string")
        self.rows = df.select(F.col(key).alias("doc_id"), row_key(F.col(key), body).alias("key"), body.cast("binary").alias("body"))
        out = self.scratch.write(self.rows.select("key", "body").mapInArrow(tidy(_index), f"{BLOCKS}, term binary, df long, n long"), "index")
        self.blocks = out.where("term IS NULL").select("width", "keys", "lengths", "slices")
        lexicon = out.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
        self.lexicon = self.scratch.write(lexicon.where("term <> X''"), "lexicon")
        total = out.where("term = X''").agg(F.sum("df"), F.sum("n")).first()
        self.n, self.total = total[0] or 0, total[1] or 0


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, and per term the documents and occurrences that this task has seen; the empty term stands for all."""
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = ["width", "keys", "lengths", "slices", "term", "df", "n"]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    def counts() -> pa.RecordBatch:
        out = [(None, None, None, None, t, d, n[t]) for t, d in docs.items()]
        docs.clear(), n.clear()
        return rows(out)

    open_blocks: dict[int, _Block] = {}
    docs, n, known = Counter(), Counter(), {}
    for b in batches:
        for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = Counter(terms(body))
            if not found:
                continue
            length = found.total()
            docs.update(found.keys())
            n.update(found)
            docs[b""] += 1
            n[b""] += length
            held = entries(found)
            if len(known) > HELD:
                known.clear()
            pairs = []
            for e in held:
                pair = known.get(e)
                if pair is None:
                    pair = known[e] = places(e)
                pairs.append(pair)
            width = width_of(len(held))
            block = open_blocks.setdefault(width, None) or _Block(width)
            open_blocks[width] = block
            block.add(key, length, pairs)
            if len(block.keys) >= block.room:
                yield rows([open_blocks.pop(width).row() + (None,) * 3])
        if len(docs) > HELD:
            yield counts()
    for block in open_blocks.values():
        yield rows([block.row() + (None,) * 3])
    if docs:
        yield counts()


class QuerySet:
    """A bounded set of queries: terms with their weights and hashes, and how often each query asks for each."""

    def __init__(self, queries: list[tuple[int, Counter]], df: dict[bytes, int], n: int, total: int):
        self.n, self.total = n, total
        self.ids = [i for i, _ in queries]
        self.words = sorted({t for _, c in queries for t in c})
        place = {t: i for i, t in enumerate(self.words)}
        self.weights = np.array([weight(n, df[t]) for t in self.words], np.float64)
        self.asks = np.zeros((len(queries), len(self.words)))
        for i, (_, c) in enumerate(queries):
            for t, k in c.items():
                self.asks[i, place[t]] = k
        self.pairs = [np.array([places(t if not k else t + bytes([0, k])) for t in self.words], np.int64) for k in range(len(STEPS))]

    def bounds(self, width: int, lengths: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """(query, document): no score of the block is higher."""
        m = np.array([scale(int(x), self.n, self.total) for x in lengths], np.int64)
        most = np.zeros((len(self.words), len(lengths)))
        marked = None
        for k, step in enumerate(STEPS):
            held = np.bitwise_and.reduce(slices[bits(self.pairs[k], width)], axis=1)
            marked = held if marked is None else marked & held
            seen = np.flatnonzero(marked.any(axis=1))
            if not len(seen):
                break
            tf = np.minimum(STEPS[k + 1] - 1, lengths) if k + 1 < len(STEPS) else lengths
            top = np.where(tf >= step, (1_000_000_000 * tf) // (1000 * tf + 8 * m), 0).astype(np.float64)
            there = np.unpackbits(marked[seen], axis=1, count=len(lengths)).astype(bool)
            most[seen] = np.where(there & (tf >= step)[None, :], top[None, :], most[seen])
        # The margin outweighs the rounding of sums beyond 2^53.
        return np.ceil(self.asks @ (self.weights[:, None] * most) * (1 + 2.0**-40))


def bounded(blocks: DataFrame, asked: QuerySet, floors: dict[int, int] | None, seeds: int) -> DataFrame:
    """(query, key, bound): with floors, all documents whose bound is positive and reaches the query's; else each task's `seeds` best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def batch(q: list[np.ndarray], k: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in ((q, pa.int64()), (k, pa.int64()), (v, pa.int64()))], ["query", "key", "bound"])

        for b in batches:
            for width, keys, lengths, slices in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                keys, lengths = keys.values.to_numpy(), lengths.values.to_numpy()
                found = asked.bounds(width, lengths, np.frombuffer(slices.as_buffer(), np.uint8).reshape(width, -1)).astype(np.int64)
                if floors is None:
                    for i, row in enumerate(found):
                        k, v = best.get(i, (keys[:0], row[:0]))
                        k, v = np.concatenate([k, keys[row > 0]]), np.concatenate([v, row[row > 0]])
                        top = np.argsort(-v, kind="stable")[:seeds]
                        best[i] = k[top], v[top]
                else:
                    least = np.array([max(1, floors.get(i, 1)) for i in range(len(found))])
                    q, d = np.nonzero(found >= least[:, None])
                    yield batch([q], [keys[d]], [found[q, d]])
        yield batch([np.full(len(k), i) for i, (k, _) in best.items()], [k for k, _ in best.values()], [v for _, v in best.values()])

    return blocks.mapInArrow(tidy(run), "query long, key long, bound long")


def scored(rows: DataFrame, wanted: DataFrame, asked: QuerySet) -> DataFrame:
    """(query, doc_id, score): exact scores of the pairs (query, key) in wanted, over 0, from the whole texts."""
    pairs = wanted.groupBy("key").agg(F.collect_set("query").alias("queries"))
    met = rows.join(small(pairs), "key").select("doc_id", "body", "queries")
    kind = rows.schema["doc_id"].dataType.simpleString()
    n, total, words, weights, asks = asked.n, asked.total, asked.words, asked.weights, asked.asks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [[(words[t], int(weights[t]) * int(asks[i, t])) for t in np.flatnonzero(asks[i])] for i in range(len(asks))]
        for b in batches:
            q, at, out = [], [], []
            for i, (body, queries) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                found = Counter(terms(body))
                m = scale(found.total(), n, total)
                for query in queries:
                    s = sum(w * factor(found[t], m) for t, w in lists[query] if t in found)
                    if s > 0:
                        q.append(query), at.append(i), out.append(s)
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), ids, pa.array(out, pa.int64())], ["query", "doc_id", "score"])

    return met.mapInArrow(tidy(run), f"query long, doc_id {kind}, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_sets(index: Index, queries: DataFrame, key: str, text: str) -> Iterator[QuerySet]:
    """The queries, read one by one, in sets of at most QUERY_TERMS distinct known terms (or one query)."""
    held: list[tuple[int, Counter]] = []
    known: set[bytes] = set()

    def ready() -> QuerySet:
        words = index.spark.createDataFrame([(t,) for t in known], "term binary")
        df = {bytes(r["term"]): r["df"] for r in index.lexicon.join(F.broadcast(words), "term").collect()}
        kept = [(i, Counter({t: k for t, k in c.items() if t in df})) for i, c in held]
        return QuerySet([(i, c) for i, c in kept if c], df, index.n, index.total)

    for i, body in queries.select(F.col(key), F.col(text).cast("string").cast("binary")).toLocalIterator():
        asked = Counter(terms(bytes(body) if body is not None else None))
        if not asked:
            continue
        if held and len(known | set(asked)) > QUERY_TERMS:
            yield ready()
            held, known = [], set()
        held.append((i, asked))
        known |= set(asked)
    if held:
        yield ready()


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query with a score above 0, equal scores by id."""
    kinds = f"item_id {queries.schema[key].dataType.simpleString()}, rank int, doc_id {index.rows.schema['doc_id'].dataType.simpleString()}, score long"
    results = []
    for asked in query_sets(index, queries, key, text) if index.n else ():
        if not asked.ids:
            continue
        seeds = index.scratch.write(_top_bounds(bounded(index.blocks, asked, None, max(SEEDS, k)), max(SEEDS, k)), "seeds")
        first = best(scored(index.rows, seeds, asked), k).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
        floors = {r["query"]: r["low"] for r in first.collect()}
        wanted = index.scratch.write(bounded(index.blocks, asked, floors, 0).select("query", "key"), "wanted")
        found = index.scratch.write(best(scored(index.rows, wanted, asked), k), "found")
        ids = index.spark.createDataFrame(list(enumerate(asked.ids)), f"query long, {kinds.split(',')[0]}")
        results.append(index.scratch.write(found.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"), "results"))
    out = index.spark.createDataFrame([], kinds)
    for r in results:
        out = r if len(results) == 1 else out.unionByName(r)
    return out


def _top_bounds(found: DataFrame, seeds: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("bound"), "key")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= seeds).select("query", "key")
