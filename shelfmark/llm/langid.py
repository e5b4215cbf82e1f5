"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of all its character n-grams, a linear layer and a softmax make it a
probability. At prediction the embeddings and the layer are one table, so a text costs a hash and a look-up per
n-gram; whole texts are read, in slices of bounded memory. A temperature, fitted on documents that were not trained
on, calibrates the score, and a threshold on it rejects what fits no learned language.

Training takes a bounded sample: at most PER_LANGUAGE documents a language (chosen by a hash of id and text) and
SAMPLE_BYTES of text altogether, the same share of it for each language, so that every labelled language is learned;
a text gives a sixteenth of its language's share at most. The shares of languages and all predictions cover all rows.
More than MAX_LANGUAGES labelled languages raise an error.

Cases: a null text or one without a letter gets `und`, score 0 and is rejected; null languages are not learned from;
without any label every text is `und`; ties go to the language that sorts first; repeated rows get the same answer;
an empty table gives an empty result; the answer is one struct column, so that other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import as_bytes, bound_batches, give_back, spare_name

ORDERS, BUCKETS, WIDTH = (2, 3, 4, 5), 1 << 16, 16
PER_LANGUAGE, SAMPLE_BYTES, MAX_LANGUAGES = 500, 24 << 20, 200
#: Words in the pieces that a sampled document is cut into for training, and pieces taken of each document.
PIECES, PIECES_EACH, EPOCHS, RATE = (3, 8, 25, 100), 6, 4, 0.3
#: Share of well-labelled documents that the rejection threshold may cost, and the highest threshold.
REJECT_SHARE, HIGHEST = 0.001, 0.4
SLICE = 1 << 20
UNKNOWN = "und"
ANSWER = "lang string, score double, rejected boolean"

_LETTER = re.compile(r"[^\W\d_]")
_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normalised(text: bytes | None) -> bytes:
    """Lower case, ASCII non-letters as single spaces, one space at each end; empty without letters."""
    s = (text or b"").decode("utf-8", "replace").lower()
    if not _LETTER.search(s):
        return b""
    return b" " + b" ".join(s.encode("utf-8", "replace").translate(_SPACES).split()) + b" "


def ngrams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a normalised text, in slices."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE + max(ORDERS) - 1].astype(np.uint32)
        starts = min(SLICE, len(raw) - at)
        h = part.copy()
        for n in range(2, max(ORDERS) + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
            if n in ORDERS:
                yield ((h[:starts] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in ngrams(text):
            n += len(h)
            if len(h) < BUCKETS // 4:
                total += self.table[h].sum(0)
            else:
                total += np.bincount(h, minlength=BUCKETS) @ self.table
        return total / max(n, 1) + self.bias

    def probabilities(self, text: bytes) -> np.ndarray:
        z = self.logits(text) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def answer(self, text: bytes | None) -> tuple[str, float, bool]:
        clean = normalised(text)
        if not clean or not self.languages:
            return UNKNOWN, 0.0, True
        p = self.probabilities(clean)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(np.concatenate(list(ngrams(text))), return_counts=True)
    return at, n / n.sum()


def fit(samples: list[tuple[str, bytes]], seed: int = 7) -> Model:
    """Train on (language, normalised text) samples; every fifth one of a language calibrates instead."""
    languages = sorted({lang for lang, _ in samples})
    model = Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return model
    rng = np.random.default_rng(seed)
    place = {lang: i for i, lang in enumerate(languages)}
    seen, fitted, held = dict.fromkeys(languages, 0), [], []
    for x in samples:
        seen[x[0]] += 1
        (fitted if seen[x[0]] % 5 else held).append(x)

    def pieces(text: bytes) -> Iterator[bytes]:
        words = text.split()
        for _ in range(PIECES_EACH):
            n = PIECES[rng.integers(len(PIECES))]
            at = rng.integers(max(1, len(words) - n + 1))
            yield b" " + b" ".join(words[at : at + n]) + b" "

    bags = [(place[lang], *_bag(piece)) for lang, text in fitted for piece in pieces(text)]
    # Languages count alike, whatever their share of the corpus.
    share = np.bincount([b[0] for b in bags], minlength=len(languages))
    weight = np.clip(len(bags) / len(languages) / np.maximum(share, 1), 0.2, 5)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            y, at, w = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            rows = embed[at]
            v = w @ rows
            z = v @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y]
            down = layer @ p
            layer -= rate * np.outer(v, p)
            bias -= 0.1 * rate * p
            # The mean spreads a step over all n-grams; scaling by their number keeps short and long pieces alike.
            embed[at] = rows - rate * len(at) * w[:, None] * down
    model.table, model.bias = embed @ layer, bias
    # Pieces of all lengths calibrate, so that the score of a few words is not that of a page.
    return calibrate(model, [(lang, piece) for lang, text in held for piece in pieces(text)])


def calibrate(model: Model, held: list[tuple[str, bytes]]) -> Model:
    """Temperature of least log loss, then the threshold that rejects at most REJECT_SHARE of the right answers."""
    if not held:
        return model
    truth = np.array([model.languages.index(lang) for lang, _ in held])
    z = np.array([model.logits(t) for _, t in held])

    def p(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(p(t)[np.arange(len(truth)), truth], 1e-12)).mean())

    model.temperature = min(np.geomspace(0.25, 8, 26), key=loss)
    found = p(model.temperature)
    right = found.max(1)[found.argmax(1) == truth]
    if len(right):
        model.threshold = float(min(HIGHEST, np.quantile(right, REJECT_SHARE)))
    return model


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the labelled rows of df; rows that must not be learned from are filtered out before."""
    rows = df.where(F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(lang).cast("string").alias("lang"), as_bytes(text).alias("body"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return fit([])
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled; a model of more would not fit the driver")
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, PER_LANGUAGE / r["n"]))).otherwise(rate)
    share = SAMPLE_BYTES // len(counts)
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce("key", F.lit("")), "body", F.lit("language")), 11) * F.lit(2.0**-53)
    # Long texts are cut, not left out: a language may have no others.
    chosen = rows.withColumn("draw", draw).where(F.col("draw") < rate).withColumn("body", F.substring("body", 1, share // 16))
    order = Window.partitionBy("lang").orderBy("draw", "key", "body")
    taken = chosen.withColumn("size", F.sum(F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = taken.withColumn("rank", F.row_number().over(order)).where((F.col("size") <= share) & (F.col("rank") <= 2 * PER_LANGUAGE))
    samples = []
    for r in taken.orderBy("draw", "key", "lang", "body").toLocalIterator():
        clean = normalised(bytes(r["body"]))
        if clean:
            samples.append((r["lang"], clean))
    return fit(samples)


def predicted(model: Model, text: str = "text") -> Column:
    """Struct (lang, score, rejected) for a text column."""
    shared = model

    @F.pandas_udf(ANSWER)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for bodies in parts:
            yield pd.DataFrame([shared.answer(t) for t in bodies], columns=["lang", "score", "rejected"])
        give_back()

    return find(as_bytes(text))


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is in the third that is never learned from (a null id counts as an empty text)."""
    digits = F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")
    return F.crc32(digits) % 3 == 1


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score and rejected of every row, by a model of the rows that are not held out."""
    bound_batches(df.sparkSession)
    model = train(df.where(~held_out(key)), key, text, lang)
    out = df.select(F.col(key), held_out(key).alias("held_out"), predicted(model, text).alias("found"))
    return out.select(key, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))


def keep_identified(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df whose language is not rejected, all columns."""
    bound_batches(df.sparkSession)
    name = spare_name(df, "language_found")
    model = train(df.where(~held_out(key)), key, text, lang)
    return df.withColumn(name, predicted(model, text)).where(~F.col(name)["rejected"]).drop(name)
