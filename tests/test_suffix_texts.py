import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.functions import paths as P
from tools.compare import rows_of

TEXTS = ["", None, ".", "\n", ".flac", "a.b", "x" * 244, "x" * 245, "é" * 123, "x" * 243 + "😀", "\x00", "." * 300, "a\r\x85 " * 60]


def test_candidates_of_odd_texts_equal_their_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = entry.queries()["h07_suffix_candidate"](spark, str(tmp_path))
    cur = con.execute(entry.oracle_sql()["h07_suffix_candidate"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_a_dotfile_keeps_its_name_whole(spark):
    assert spark.range(1).select(P.suffix_candidate(F.lit(".flac"), F.lit(123))).head()[0] == ".flac (123)"
