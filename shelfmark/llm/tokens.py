"""Token-id output: documents as separately compressed id arrays under one shared zstandard dictionary.

Format, a folder of three Parquet tables that Spark's readers and writers handle on any store:

* `packs`: one row per pack of about PACK_BYTES. `payload` holds the zstandard frames of its documents back to back;
  a frame is the document's ids as little-endian unsigned integers of `id_bytes` bytes each. The offset index stands
  beside it: `doc_ids`, `ends` (end of each frame in the payload) and `tokens`. `bucket`, `pack` order the packs by
  ascending document id, `start` counts the bucket's tokens before the pack, `low` and `high` bound its ids, and
  `dict_hash` names the dictionary.
* `dictionary`: dict_hash (SHA-256), id_bytes and the dictionary's bytes.
* `buckets`: tokens of each bucket; a document's global position is a sum over the buckets before its own.

The dictionary is trained here, on at most DICT_DOCS documents of at most DICT_TEXT bytes, chosen by a hash of their
id; everything else covers all documents. Texts are encoded where they are read, and only compressed frames are
shuffled, to ranges of ids whose bounds come from the id column.

Words are cached: the tokenizer never joins text across white space, so a document's ids are those of its
white-space separated pieces, one after another (the tests compare with whole texts). The cache is bounded.

Cases: null and empty texts have the end id only; null ids come first; rows that share an id stay separate, ordered
by their frame, and are spread over several buckets if they are many; an empty table gives an empty folder that reads
as an empty table; very long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import as_bytes, bound_batches, tidy

PACK_BYTES, PACK_DOCS = 1 << 20, 4096
DICT_DOCS, DICT_TEXT, DICT_BYTES = 1000, 256 << 10, 64 << 10
#: Words kept by the cache of one Python worker, and the longest that it keeps, in bytes.
CACHE_WORDS, CACHE_LENGTH = 700_000, 64
#: Pieces that the tokenizer gets in one call.
LEARN = 16_384
LOWEST = -(2**63)
INDEX = "bucket int, pack int, start long, low long, high long, dict_hash string, payload binary, doc_ids array<long>, ends array<int>, tokens array<int>"


class _Index(dict):
    """Numbers of words; an unknown word gets the next number and is noted in `new`."""

    new: list[bytes]
    n = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = at = self.n
        self.n = at + 1
        self.new.append(word)
        return at


class WordEncoder:
    """Ids of whole texts through a bounded cache of white-space separated pieces."""

    def __init__(self, path: str, words: int | None = None):
        from tokenizers import Tokenizer

        self.words, self.tokenizer = words or CACHE_WORDS, Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.index = _Index()
        self.index.new = []
        self.ids, self.ends = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64)
        self.used = np.zeros(1 << 14, np.int32)

    def _learn(self) -> None:
        """Encode the new pieces, LEARN in a call, so that the tokenizer's own tables stay small."""
        new, self.index.new = self.index.new, []
        first = self.index.n - len(new)
        for i in range(0, len(new), LEARN):
            self._learn_some(first + i, new[i : i + LEARN])

    def _learn_some(self, n: int, new: list[bytes]) -> None:
        """The pieces numbered from n on, in one call; each token belongs to the piece that its offset lies in."""
        words = [w.decode("utf-8", "replace") for w in new]
        # A piece that starts with a combining mark could compose with what stands before it.
        odd = [i for i, s in enumerate(words) if s > "\u02ff" and unicodedata.combining(s[0])]
        alone = {i: self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in odd}
        for i in odd:
            words[i] = ""
        joined = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        begins = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        at = np.fromiter(map(operator.itemgetter(0), joined.offsets), np.int64, len(joined.offsets))
        stops = np.searchsorted(at, begins)
        ids = np.array(joined.ids, self.dtype)
        for i in reversed(odd):
            ids = np.insert(ids, stops[i], alone[i])
            stops[i:] += len(alone[i])
        base = int(self.ends[n - 1]) if n else 0
        total = base + len(ids)
        while len(self.ids) < total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ends) < self.index.n:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.used = np.concatenate([self.used, np.zeros_like(self.used)])
        self.ids[base:total] = ids
        self.ends[n : n + len(words)] = base + stops

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these numbers, one after another."""
        begins = np.where(at > 0, self.ends[at - 1], 0)
        n = self.ends[at] - begins
        return self.ids[np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        ids, stops = self.encode_column(pa.array(texts, pa.binary()))
        return np.split(ids, stops[:-1]) if texts else []

    def encode_column(self, texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one after another, and where each text's ids end.

        Arrow splits the texts and numbers their distinct pieces; only these are looked up one by one.
        """
        strings = pa.StringArray.from_buffers(len(texts), *(texts.buffers()[i] for i in (1, 2, 0)), texts.null_count, texts.offset)
        split = pc.ascii_split_whitespace(strings)
        pieces = split.flatten().dictionary_encode()
        codes, words = pieces.indices.to_numpy(), pieces.dictionary.cast(pa.binary()).to_pylist()
        places = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        long = []
        if self.index.new:
            long = [w for w in self.index.new if len(w) > CACHE_LENGTH]
            self._learn()
        self.used[places] += np.bincount(codes, minlength=len(words)).astype(np.int32)
        at = places[codes]
        begins = np.where(at > 0, self.ends[at - 1], 0)
        n = self.ends[at] - begins
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(begins - ends[:-1], n) + np.arange(ends[-1])]
        for w in long:
            del self.index[w]
        if len(self.index) > self.words or self.index.n > 2 * self.words:
            self._shrink()
        return ids, ends[np.cumsum(pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False))]

    def _shrink(self) -> None:
        """Keep the half of the words that was used most, and their ids; their counts age."""
        n = self.index.n
        keep = np.zeros(n, bool)
        keep[np.argsort(-self.used[:n], kind="stable")[: self.words // 2]] = True
        kept = [(w, i) for w, i in self.index.items() if keep[i]]
        at = np.array([i for _, i in kept], np.int64)
        ids, size, used = self._gather(at), self.ends[at] - np.where(at > 0, self.ends[at - 1], 0), self.used[at] // 2
        self.index = _Index((w, i) for i, (w, _) in enumerate(kept))
        self.index.n, self.index.new = len(kept), []
        spare = 1 << 14
        self.ids = np.concatenate([ids, np.zeros(1 << 16, self.dtype)])
        self.ends, self.used = np.concatenate([np.cumsum(size), np.zeros(spare, np.int64)]), np.concatenate([used, np.zeros(spare, np.int32)])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, words: int | None = None) -> WordEncoder:
    """One encoder a Python worker, kept from task to task while texts are encoded."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, words)
    return _encoders[path]


def _groups(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes of text."""
    begin = total = 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(lengths):
        yield begin, len(lengths)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or none if the samples are too few to train on."""
    if len(samples) < 16 or sum(map(len, samples)) < 4096:
        return b""
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(max(size, 1024), samples).as_bytes()
    except zstandard.ZstdError:
        return b""  # samples without anything in common


def _codec(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_ids(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", cache_words: int | None = None, group_bytes: int = 1 << 22) -> None:
    """Encode `text` of every row, append end_id, and write the folder described above in ascending order of `key`.

    cache_words: words a Python worker keeps, some 150 bytes each; fewer cost time, not results.
    group_bytes: bytes of text encoded at once; the working arrays of a group take some ten times as much.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("key"), as_bytes(text).alias("body"))
    n = rows.count()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 50_000 + 1)
    filled = F.coalesce("key", F.lit(LOWEST))
    cuts = rows.select(F.percentile_approx(filled, [i / wanted for i in range(1, wanted)] or [0.5], 10_000)).first()[0] if n else None
    bounds = np.array(cuts or [], np.int64)
    # Marks are chosen before bodies are read, so that no task gathers the texts of all others' choices.
    marked = rows.where(F.length("body") <= DICT_TEXT).withColumn("mark", F.xxhash64("key", "body"))
    marks = marked.select(F.xxhash64("key").alias("at"), "mark").distinct().orderBy("at", "mark").limit(DICT_DOCS).select("mark")
    probe = marked.join(F.broadcast(marks), "mark", "left_semi").groupBy("mark").agg(F.any_value("body").alias("body"))
    words = encoder(tokenizer)
    samples = [words.encode([r["body"]])[0].tobytes() for r in probe.toLocalIterator()]
    raw = train_dictionary(sorted(s for s in samples if s))
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, words.dtype.itemsize, raw)], "dict_hash string, id_bytes int, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pack = encoder(tokenizer, cache_words), zstandard.ZstdCompressor(level=3, dict_data=_codec(raw))
        end = np.array([end_id], known.dtype)
        for b in batches:
            keys, bodies = b.column(0), b.column(1)
            order = keys.fill_null(LOWEST).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(bounds, order, "left"), np.searchsorted(bounds, order, "right")
            for i, j in _groups(pc.binary_length(bodies).fill_null(0).to_numpy(zero_copy_only=False), group_bytes):
                ids, stops = known.encode_column(bodies.slice(i, j - i))
                whole = np.insert(ids, stops, end[0])
                stops = stops + np.arange(1, len(stops) + 1)
                tokens = np.diff(stops, prepend=0).astype(np.int32)
                frames = [pack.compress(x.tobytes()) for x in np.split(whole, stops[:-1])]
                # An id that several bounds name is spread over their buckets by its frame.
                spread = np.array([zlib.crc32(f) for f in frames], np.int64) % (last[i:j] - first[i:j] + 1)
                columns = [pa.array((first[i:j] + spread).astype(np.int32)), keys.slice(i, j - i), pa.array(tokens), pa.array(frames, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "key", "tokens", "frame"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("pack", pa.int32()), ("start", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("dict_hash", pa.string()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
        _encoders.clear()  # all texts are encoded by now; the worker's memory is free for other stages
        bucket, number, start, size, held = None, 0, 0, 0, []

        def full() -> pa.RecordBatch:
            keys, tokens, frames = zip(*held)
            real = [k for k in keys if k is not None]
            row = (bucket, number, start, min(real, default=None), max(real, default=None), name, b"".join(frames), list(keys), np.cumsum([len(f) for f in frames]), list(tokens))
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema)], schema=schema)

        for b in batches:
            for at, key, tokens, frame in zip(*(c.to_pylist() for c in b.columns)):
                if held and (at != bucket or size + len(frame) > PACK_BYTES or len(held) == PACK_DOCS):
                    yield full()
                    number, start, size, held = number + 1, start + sum(x[1] for x in held), 0, []
                if at != bucket:
                    bucket, number, start = at, 0, 0
                held.append((key, tokens, frame))
                size += len(frame)
        if held:
            yield full()

    frames = rows.mapInArrow(tidy(encode), "bucket int, key long, tokens int, frame binary")
    dealt = frames.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "key", "frame")
    dealt.mapInArrow(tidy(packs), INDEX).write.option("compression", "zstd").parquet(f"{path}/packs")
    sums = spark.read.parquet(f"{path}/packs").select("bucket", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    sums.groupBy("bucket").agg(F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{path}/buckets")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, int, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["dict_hash"], row["id_bytes"], bytes(row["bytes"])


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Tokens before each bucket; one entry a bucket."""
    out, total = {}, 0
    for bucket, tokens in sorted(map(tuple, spark.read.parquet(f"{path}/buckets").collect())):
        out[bucket], total = total, total + tokens
    return out


def read_ids(spark: SparkSession, path: str, only: list[int] | None = None, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<int>) of the written documents; with `digest` ids_crc32 instead of ids.

    `only` reads single documents: packs are chosen by their id bounds, and only the wanted frames are unpacked.
    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    bound_batches(spark)
    name, width, raw = _dictionary(spark, path)
    bases, wanted = _bases(spark, path), set(only) if only is not None else None
    source = spark.read.parquet(f"{path}/packs")
    if only is not None:
        hits = F.lit(False)
        for i in sorted(wanted):
            hits = hits | ((F.col("low") <= i) & (F.col("high") >= i))
        source = source.where(hits)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor(dict_data=_codec(raw))
        last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])
        for b in batches:
            for row in b.to_pylist():
                if row["dict_hash"] != name:
                    raise ValueError(f"pack written with dictionary {row['dict_hash']}, not {name}")
                at, begin, out = bases[row["bucket"]] + row["start"], 0, []
                for key, stop, n in zip(row["doc_ids"], row["ends"], row["tokens"]):
                    if wanted is None or key in wanted:
                        ids = np.frombuffer(codec.decompress(row["payload"][begin:stop]), f"<u{width}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"document {key}: {len(ids)} ids, {n} in the index")
                        out.append((key, at, n, zlib.crc32(ids.tobytes()) if digest else ids.astype(np.int32)))
                    at, begin = at + n, stop
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    fields = "bucket", "start", "dict_hash", "payload", "doc_ids", "ends", "tokens"
    kind = "ids_crc32 long" if digest else "ids array<int>"
    return source.select(*fields).mapInArrow(tidy(unpack), f"doc_id long, start long, n_tokens long, {kind}")
