"""Removal of lines that many documents share, in built-in functions only.

Lines are exploded and normalised; a key's 128-bit hash stands for it. Documents per hash are counted in two combining
steps, (hash, document) and then hash, so a line that a third of all rows hold is never gathered. The hashes over the
threshold meet the exploded lines again, and each row gets the positions that it loses; it is put together from the
others in their order. Texts move only if the verdicts are too many to broadcast; otherwise hashes and positions do.

A row is told apart by two hashes of its id and text, so that repeated rows share a verdict and each stays.

Cases: a null or empty text is one empty line and stays as it is; documents are told apart by id, all rows of one id being one document;
null ids are one document, smaller than any other; in the largest id that holds a line all its repeats stay; a text
that loses every line is empty; texts of any length are taken whole; repeated rows stay; an empty table gives an empty
result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, small, spare_name

#: The white space stripped from a key, the letters whose case is ignored.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Copies of each frequent hash in a join by shuffle, since one line may be a third of all rows.
SALTS = 8


def _body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _pair(*columns: Column) -> tuple[Column, Column]:
    """128 bits of columns: two 64-bit hashes of different seeds."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def long_lines(df: DataFrame, least_chars: int, key: str, text: str) -> DataFrame:
    """(doc, r1, r2, at, h1, h2): the lines whose keys have at least `least_chars` code points."""
    r1, r2 = _pair(F.col(key), _body(text))
    # Hashes come before the explosion, or whole texts would be hashed for each of their lines.
    rows = df.select(F.col(key).alias("doc"), r1.alias("r1"), r2.alias("r2"), F.split(F.translate(_body(text), UPPER, LOWER), "\n").alias("lines"))
    rows = rows.select("doc", "r1", "r2", F.posexplode("lines").alias("at", "line"))
    rows = rows.select("doc", "r1", "r2", "at", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.char_length("line") >= least_chars)
    h1, h2 = _pair(F.col("line"))
    return rows.select("doc", "r1", "r2", "at", h1.alias("h1"), h2.alias("h2"))


def frequent(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, last): the hashes in at least `least_docs` documents, and the largest document of each."""
    held = lines.select("h1", "h2", "doc").distinct()
    return held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).where(F.col("n") >= least_docs).drop("n")


def losses(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(r1, r2, gone): the positions that a row loses, each once."""
    salt = F.pmod(F.xxhash64("r1", "at"), F.lit(SALTS)).cast("int")
    copies = common.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    met = lines.withColumn("salt", salt).join(small(copies), ["h1", "h2", "salt"])
    return met.where(~F.col("doc").eqNullSafe(F.col("last"))).groupBy("r1", "r2").agg(F.collect_set("at").alias("gone"))


def drop_common_lines(df: DataFrame, least_chars: int = 40, least_docs: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of df, `text` without the shared lines, and n_lines (before) and n_dropped, as long.

    Columns of df that are called n_lines or n_dropped give way to these.
    """
    scratch = Scratch(df.sparkSession, "lines")
    lines = long_lines(df, least_chars, key, text)
    common = scratch.write(frequent(lines, least_docs), "common")
    verdicts = scratch.write(losses(lines, common), "verdicts")
    df = df.drop("n_lines", "n_dropped")
    r1, r2 = spare_name(df, "row_1"), spare_name(df, "row_2")
    gone = spare_name(df, "gone")
    one, two = _pair(F.col(key), _body(text))
    sides = small(verdicts.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("gone").alias(gone)))
    rows = df.withColumn(r1, one).withColumn(r2, two).join(sides, [r1, r2], "left")
    parts = F.split(_body(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    # The lines are a lambda's argument: as a column they would be split anew for each position.
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i)), "\n"))[0]
    loses = F.col(gone).isNotNull()
    changed = {text: F.when(loses, kept).otherwise(F.col(f"`{text}`").cast("string"))}
    told = [F.size(parts).cast("long").alias("n_lines"), F.when(loses, F.size(gone)).otherwise(0).cast("long").alias("n_dropped")]
    return rows.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns], *told)
