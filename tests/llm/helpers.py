"""Small tables with the awkward cases that every operator must take."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, hash long, size long, key string, row_key long, path string, body string, bad_id long, low long, other_key long, kept_key long, kept_fp long, own long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the other columns are there to clash with the operators' own names."""
    full = [(*r, *[None] * (4 - len(r)), 0, "x", 1, 2, "k", 3, "p", "b", 4, 5, 6, 7, 8, 9) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(n, seed=0, size=97):
    return " ".join(f"w{(i * i * 31 + i * 7 + seed * 1009) % size}x{(i + seed) % 13}" for i in range(n))


AWKWARD = [
    (1, None, "en", "b"), (2, "", "en", "b"), (3, " \n\t ", None, None), (4, "Überall ein Wort, né à côté.", "de", "a"), (None, "no id here at all", "en", None),
    (None, "no id here at all", "en", None), (5, words(4000), "en", "a"), (6, words(4000), "en", "a"), (6, words(4000), "en", "a"), (7, "one", None, "c"), (-9, "12345 !!! ???", "de", "c"),
]
