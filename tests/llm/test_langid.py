import zlib

from pyspark.sql import functions as F

from shelfmark.llm.langid import fit, identify, keep_identified, normalised

from .helpers import AWKWARD, documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.002 * len(rows)


def test_only_allowed_rows_teach(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    answer = lambda d: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(d).collect()}
    assert answer(docs) == answer(wrong)


def test_calibration():
    text = {"aa": b" lorem ipsum dolor sit amet ", "bb": b" quick brown foxes jump over "}
    model = fit([(k, v * (1 + i % 3)) for i in range(40) for k, v in text.items()])
    assert model.answer(b"lorem ipsum dolor")[0] == "aa" and model.answer(b"QUICK brown foxes")[0] == "bb"
    lang, score, _ = model.answer("жщю".encode())
    assert score < model.answer(b"lorem ipsum dolor sit amet")[1]
    assert model.answer(b"12 !")[:2] == ("und", 0.0) and model.answer(None)[2]


def test_awkward(spark):
    rows = {r["doc_id"]: r for r in identify(documents(spark, AWKWARD)).collect()}
    assert len(rows) == len({r[0] for r in AWKWARD})
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, -9)] == ["und"] * 4 and rows[4]["lang_pred"] in ("de", "en")
    none = identify(documents(spark, [(1, "text", None)])).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert identify(documents(spark, [])).count() == 0
    df = documents(spark, AWKWARD)
    kept = keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 6}


def test_normalised():
    assert normalised("Éa, B9c ß".encode()) == " éa b c ß ".encode() and normalised(b"1 2") == b""
