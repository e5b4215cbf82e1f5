"""From documents to token ids in five stages; each takes and, but for the last, returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import Scratch, table
from shelfmark.llm.decontam import decontaminate
from shelfmark.llm.langid import keep_identified
from shelfmark.llm.mixing import apply_mix
from shelfmark.llm.queries import tokenizer_path
from shelfmark.llm.similar import deduplicate_near
from shelfmark.llm.tokens import read_ids, write_ids


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that fit no learned language, go."""
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id. Links are SimHash fingerprints at 3 or fewer differing bits,
    found by anchor points as in op4, and beside them five-word shingles at a Jaccard similarity of 0.8 or more."""
    return deduplicate_near(docs, bits=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark questions, re-parameterised ones included, go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    return apply_mix(docs, weights=[1, 2, 3], cap=3)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-id files, read back: doc_id, start, n_tokens, ids_crc32 of each row."""
    path = Scratch(spark, "corpus").path("ids")
    # The earlier stages have filled the executors' heaps: a small cache of words and short groups of text fit beside them.
    write_ids(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=1, cache_words=60_000, group_bytes=1 << 20)
    return read_ids(spark, path, digest=True)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: Trained models, XXH64 and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
