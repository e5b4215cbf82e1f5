"""The pipeline's stages on a small corpus, each against a plain reckoning of its own input."""

import zlib

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch
from shelfmark.llm.queries import QUERIES, SQL, tokenizer_path
from shelfmark.llm.tokens import encoder

from .helpers import WORD, words
from .test_similar import plain_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    extra = [(9001, None, "en", "src0", 0), (9002, "123 456", "en", "src0", 7), (9003, words(30) + " " + leak, "en", "src1", 1), (None, "The and of the others in that", "en", None, 5)]
    now = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    scratch, columns = Scratch(spark, "test"), now.columns
    seen = [now]
    for name, stage in cp.STAGES:
        seen.append(scratch.write(stage(spark, seen[-1], SF), name.replace(" ", "-")))
    start, identified, single, clean, mix, ids = seen
    assert all(df.columns == columns for df in seen[:-1])
    left = {r["doc_id"] for r in identified.collect()}
    assert left == {r["doc_id"] for r in start.collect()} - {9001, 9002}

    rows = sorted(identified.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    label = plain_components([r["text"] for r in rows])
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for i, r in enumerate(rows) if label[i] == i}

    gone = {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()}
    canon = lambda t: " ".join(w.strip(".,;:!?").lower() for w in WORD.findall(t))
    items = [canon(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert 9003 in gone and gone == {r["doc_id"] for r in single.collect() if any(i in canon(r["text"]) for i in items)}

    times = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert set(times) <= {r["doc_id"] for r in clean.collect()} and max(times.values()) <= 3

    tok, at = encoder(tokenizer_path("word_bpe_49k.json")).tokenizer, 0
    texts = {r["doc_id"]: r["text"] for r in mix.collect()}
    out = sorted(ids.collect(), key=lambda r: r["start"])
    assert len(out) == mix.count()
    for r in out:
        want = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
