"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; policies
are versioned masks over those bits, so that changing a policy, comparing versions or ablating a rule reads the
small ledger and never the texts.

Cases: a null or empty text has no words (all measurements 0, fails `few_words`), very long texts are measured
whole, repeated rows give repeated ledger rows, an empty table an empty ledger, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import as_bytes, bound_batches, tidy

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_shout_words")
SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Positions inside `width`-word windows that occur twice or more, each position once."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    key = ids[: n - width + 1]
    for k in range(1, width):
        # Renumbering after each step keeps keys below (number of words)^2, whatever the text's length.
        key = np.unique(key * len(known) + ids[k : n - width + 1 + k], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    hit = np.zeros(n + 1, np.int64)
    hit[: n - width + 1] += twice
    hit[width:] -= twice
    return int((np.cumsum(hit[:n]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The values of MEASURES, in that order."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= int(((np.frombuffer(text, np.uint8) & 0xC0) == 0x80).sum())
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    # Upper case counts in ASCII letters: a word with at least two of them and no lower-case one.
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    shout = text.count(b"!!")
    return len(words), chars, symbols, dup, repeat_words(words), lines, upper, shout


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; its place in RULES is its bit."""

    name: str
    sql: str


#: The ledger's rules. A rule is never removed or moved: stored bits keep their meaning; new rules are appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("upper_case", "n_words >= 10 AND 100 * n_upper_words > 50 * n_words"),
    Rule("shouting", "10 * n_shout_words > 3 * n_words"),
)
BITS = {r.name: 1 << i for i, r in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BITS[n] for n in names)


#: Versioned policies: a document is rejected if one of these bits is set.
POLICIES = {
    "base": mask("few_words", "repeated_windows"),
    "v1": mask("few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines", "upper_case", "shouting"),
}


def measurements(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    names = list(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measure(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, i]) for i in range(len(names)))], [key, *names])

    bound_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), as_bytes(text).alias("body")).mapInArrow(tidy(run), f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names))


def failures() -> Column:
    bits = [F.when(F.expr(r.sql), F.lit(BITS[r.name]).cast("long")).otherwise(F.lit(0).cast("long")) for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, MEASURES and `failures`; one pass over the texts, no shuffle."""
    return measurements(df, key, text).withColumn("failures", failures())


def apply_policy(rows: DataFrame, version: str, column: str = "kept") -> DataFrame:
    return rows.withColumn(column, F.col("failures").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """rule, failed (documents with its bit), only (rejected by this rule alone), kept_without (kept if it were dropped).

    One aggregation by the masked bits (at most 2^rules rows, combined before the shuffle), then arithmetic on those.
    """
    policy = POLICIES[version]
    seen = rows.groupBy(F.col("failures").bitwiseAND(F.lit(policy).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [(r.name, BITS[r.name]) for r in RULES if BITS[r.name] & policy]
    each = seen.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in chosen])).alias("r"))
    bit, n = F.col("r.bit"), F.col("n")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, n).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == bit, n).otherwise(0)).alias("only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0, n).otherwise(0)).alias("kept_without"),
    )


def judge(df: DataFrame, version: str = "v1", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger with `base_failed` and `kept` under a policy version."""
    rows = apply_policy(apply_policy(ledger(df, key, text), "base", "base_kept"), version)
    return rows.withColumn("base_failed", ~F.col("base_kept")).withColumn("kept", F.col("base_kept") & F.col("kept")).drop("base_kept")
