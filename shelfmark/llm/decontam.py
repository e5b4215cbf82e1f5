"""Benchmark decontamination by template canonicalisation.

Every word becomes a token of a template: numbers, quantities with a unit, units and names turn into typed
placeholders and their wording into slot values; other words stay, in lower case and without punctuation. Windows of
WINDOW tokens are hashed on both sides in up to four forms, and equal hashes join:

* EXACT: no placeholders, so that a copy in any case is found, however full of numbers and names;
* PLAIN: placeholders for numbers, quantities and units, but not for names;
* NAMED: for capitalised words inside a sentence too;
* FIRST: for those that start a sentence as well, where a capital letter does not tell a name from another word.

Forms with placeholders need a share of LITERALS other words, as a template of placeholders alone would say nothing.
Windows of one document and one benchmark item on the same diagonal (same distance of positions) must fill the slots
consistently: equal slot values of the item stand against equal values of the document, so that a question with other
numbers or names is caught, while text that only has the same shape is not. The forms are judged one after another
(PLAIN, with NAMED, with FIRST), each adding what is consistent; EXACT windows that hold an item's slots with their
own values always count, those without slots go with PLAIN. A document is
contaminated by an item if windows cover COVERAGE of the item's windows, or COVERAGE of those that have literals
enough, or LONG windows in a row of positions.

The join is prefiltered by a bitmap of the benchmark's hashes, of fixed size however large the benchmark is; the
exact join follows. The benchmark's windows are broadcast below a checked size, else joined by shuffle.

Cases: null or empty texts have no windows; items shorter than WINDOW tokens are one window of their own length, and
below LEAST tokens this window is EXACT only; repeated rows with one id count as one document; null ids match as an
id of their own; an empty table on either side gives an empty result; texts of any length are read whole; other
columns are ignored. Signs that stand alone, such as + and *, are no tokens. What escapes: other names in text that
is all lower case or all capitals, and other values in windows with too few literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, as_bytes, bound_batches, small, spare_name, tidy

WINDOW, LEAST, LITERALS = 8, 4, 0.6
#: Share of an item's windows, and number of windows at adjacent positions, that contaminate.
COVERAGE, LONG = 0.5, 6
#: Bits of the prefilter, and rows of benchmark windows that may be broadcast.
FILTER_BITS, BROADCAST_ROWS = 24, 200_000
CACHE_WORDS = 300_000
LITERAL, NUMBER, QUANTITY, UNIT, NAME, NOTHING = range(6)
EXACT, PLAIN, NAMED, FIRST = range(4)

# Units of measure and money.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams "
    "kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons pint pints s sec secs second seconds min mins minute "
    "minutes h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v a k c f b kb mb gb tb byte bytes bit bits percent % $ € £ ¥ usd eur gbp dollar dollars euro euros cent cents".split()
)
_NUMBER = re.compile(r"[-+]?\d+(?:[.,:/\-]\d+)*(?:st|nd|rd|th)?\Z")
_QUANTITY = re.compile(r"([$€£¥]?)[-+]?\d+(?:[.,:/\-]\d+)*([a-z%°µ$€£¥]*)\Z")
#: Too short to be a unit on their own: they are words of many languages.
_LETTERS_ONLY = frozenset("m t g l s h w v a k c f b in".split())
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 1)


_KIND_HASH = np.array([0, *(_hash(f"\0slot {k}") for k in (NUMBER, QUANTITY, UNIT, NAME)), 0], np.uint64)


def classify(word: str) -> tuple[int, int, bool]:
    """(kind, hash of the canonical word, whether a sentence ends after it); NAME if it starts like one and is not all capitals."""
    ends = word.rstrip("\"')]»”’").endswith((".", "!", "?", ":"))
    core = word.strip(_EDGES)
    low = core.lower()
    value = _hash(low or word)
    if not core:
        return (UNIT if word in UNITS else NOTHING), value, ends
    bare = word.strip(".,;:!?\"'()[]").lower()
    if _NUMBER.match(low):
        return (QUANTITY if bare[:1] in "$€£¥" or bare[-1:] in "%$€£¥" else NUMBER), value, ends
    q = _QUANTITY.match(low)
    if q and q[2] in UNITS:
        return QUANTITY, value, ends
    if low in UNITS and low not in _LETTERS_ONLY:
        return UNIT, value, ends
    return (NAME if core[0].isupper() and core[1:] != core[1:].upper() else LITERAL), value, ends


class Canon:
    """Templates of whole texts; words are classified once and cached in bounded memory."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.kind, self.value, self.ends = np.zeros(1024, np.int8), np.zeros(1024, np.uint64), np.zeros(1024, bool)

    def _add(self, words: set[bytes]) -> None:
        n, total = len(self.known), len(self.known) + len(words)
        while len(self.kind) < total:
            self.kind, self.value, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.value, self.ends))
        for i, w in enumerate(sorted(words), n):
            self.known[w] = i
            self.kind[i], self.value[i], self.ends[i] = classify(w.decode("utf-8", "replace"))

    def template(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token hashes in each form, words, the first form in which each word is a slot or 4) of a text."""
        words = text.split() if text else []
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = set(words)
            self._add(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        at = at[self.kind[at] != NOTHING]
        kind, value = self.kind[at], self.value[at]
        starts = np.r_[True, self.ends[at[:-1]]] if len(at) else np.zeros(0, bool)
        slot = np.where(kind == LITERAL, 4, np.where(kind != NAME, PLAIN, np.where(starts, FIRST, NAMED)))
        return np.where(slot <= np.arange(4)[:, None], _KIND_HASH[kind], value), value, slot


def window_hashes(tokens: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each form and window: hash, whether the form has its own say there, whether literals are enough."""
    n = tokens.shape[1] - width + 1
    if n <= 0:
        return np.zeros((4, 0), np.uint64), np.zeros((4, 0), bool), np.zeros((4, 0), bool)
    h = np.full((4, n), np.uint64(width))
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[:, k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # Slots that each form adds; without one of them a form's window is that of the form before.
    added = np.zeros((4, len(slot) + 1), np.int64)
    np.cumsum(slot == np.arange(4)[:, None], axis=1, out=added[:, 1:])
    added = added[:, width:] - added[:, :-width]
    enough = (width - added.cumsum(0) >= LITERALS * width) & (width >= LEAST)
    own = (added > 0) & enough
    own[EXACT] = True
    return h, own, enough


ROW = "key long, position int, hash long, slots array<long>, form int"


def windows(rows: DataFrame, widths: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """ROW of the windows of (key, body) rows.

    Without `widths` (benchmark side) each text is cut at its own width, and `width`, `windows`, their number, `rich`,
    whether the window has literals enough with all names inside sentences taken out, and `riches`, the number of
    those, are added; with `widths` and `bitmap` (document side) only windows that may be in the bitmap come out.
    """
    own = widths is None
    names = ["key", "position", "hash", "slots", "form"] + (["width", "windows", "rich", "riches"] if own else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            out: list[list] = [[] for _ in names]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens, values, slot = canon.template(text)
                for width in [min(WINDOW, len(values))] if own else widths:
                    if not width:
                        continue
                    h, ok, enough = window_hashes(tokens, slot, width)
                    if not own:
                        low = h & np.uint64((1 << FILTER_BITS) - 1)
                        ok &= (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    rich = enough[NAMED]
                    for form, i in zip(*(x.tolist() for x in np.nonzero(ok))):
                        here = slot[i : i + width]
                        filled = values[i : i + width][here <= form]
                        # An item's window without slots says nothing of their values: it is judged with those of its diagonal.
                        judged = PLAIN if own and form == EXACT and here.min() > NAMED else form
                        row = (key, i, h[form, i].astype(np.int64), filled.astype(np.int64), judged) + ((width, h.shape[1], rich[i], rich.sum()) if own else ())
                        for column, v in zip(out, row):
                            column.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return rows.mapInArrow(tidy(run), ROW + (", width int, windows int, rich boolean, riches int" if own else ""))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched, longest (adjacent windows), changed (slots differ).

    One row for each document and item that it is contaminated by.
    """
    bound_batches(docs.sparkSession)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontam")
    items = windows(benchmark.select(F.col(item).cast("long").alias("key"), as_bytes(text).alias("body")), None, None)
    items = scratch.write(items, "items")
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths")).first()
    bits = items.select(F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long")).cast("int").alias("bit")).distinct()
    bitmap = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    if facts["n"]:
        at = bits.toArrow().column(0).to_numpy()  # 2^FILTER_BITS values at most
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
    found = windows(docs.select(F.col(key).cast("long").alias("key"), as_bytes(text).alias("body")), sorted(facts["widths"]), bitmap)
    # The place of a window in its item, doubled, and one more if it has literals enough.
    at = (2 * F.col("position") + F.col("rich").cast("int")).alias("at")
    known = items.select(F.col("key").alias("item"), F.col("position").alias("place"), at, "hash", F.col("slots").alias("of_item"), F.col("form").alias("of_form"), "windows", "riches").distinct()
    met = found.join(F.broadcast(known) if facts["n"] <= BROADCAST_ROWS else known, "hash")
    met = met.withColumn("diagonal", F.col("position") - F.col("place")).withColumn("form", F.greatest("form", "of_form"))
    item_of = ["windows", "riches"]
    forms, pairs = (PLAIN, NAMED, FIRST), F.arrays_zip("of_item", "slots")
    upto = lambda form, c: F.collect_set(F.when(F.col("form") <= form, c))
    lines = met.groupBy("key", "item", "diagonal", *item_of).agg(
        upto(EXACT, F.col("at")).alias("ats_0"), *(upto(f, F.col("at")).alias(f"ats_{f}") for f in forms), *(F.array_distinct(F.flatten(upto(f, pairs))).alias(f"pairs_{f}") for f in forms)
    )
    even = {f: F.size(F.array_distinct(F.col(f"pairs_{f}")["of_item"])) == F.size(f"pairs_{f}") for f in forms}
    none = F.array().cast("array<int>")
    ats = F.array_distinct(F.concat("ats_0", *(F.when(even[f], F.col(f"ats_{f}")).otherwise(none) for f in forms)))
    differs = [even[f] & F.exists(f"pairs_{f}", lambda p: p["of_item"] != p["slots"]) for f in forms]
    lines = lines.select("key", "item", *item_of, ats.alias("ats"), (differs[0] | differs[1] | differs[2]).alias("changed"))
    matched = lines.groupBy("key", "item", *item_of).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("ats"), F.max("changed").alias("changed"))
    # The longest run of adjacent positions: in a run, position minus rank is the same.
    ranks = F.transform("ats", lambda a, i: F.shiftright(a, 1) - i)
    runs = F.transform(F.array_distinct(ranks), lambda r: F.size(F.filter(ranks, lambda x: x == r)))
    rich = F.size(F.filter("ats", lambda a: a % 2 == 1))
    matched = matched.where(F.size("ats") > 0).withColumn("n", F.size("ats")).withColumn("rich", rich).withColumn("longest", F.array_max(runs))
    half = lambda c: F.ceil(F.lit(COVERAGE) * F.col(c))
    enough = (F.col("n") >= half("windows")) | ((F.col("rich") > 0) & (F.col("rich") >= half("riches"))) | (F.col("longest") >= LONG)
    return matched.where(enough).select(F.col("key").alias(key), F.col("item").alias(item), F.col("windows").cast("long").alias("n_windows"), F.col("n").cast("long").alias("n_matched"), F.col("longest").cast("long").alias("longest"), "changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is in no contaminated document."""
    scratch = Scratch(docs.sparkSession, "decontam")
    bad_id = spare_name(docs, "bad_id")
    keys = contaminated(docs, benchmark, key, text=text).select(F.col(key).alias(bad_id)).distinct()
    bad = small(scratch.write(keys, "contaminated"))
    return docs.join(bad, F.col(key).cast("long").eqNullSafe(F.col(bad_id)), "left_anti")
