import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import tokens
from shelfmark.llm.common import Scratch
from shelfmark.llm.queries import tokenizer_path
from shelfmark.llm.tokens import WordEncoder, encoder, read_ids, write_ids

from .helpers import AWKWARD, documents, words

PATH = tokenizer_path("word_bpe_49k.json")
ALPHABET = ["a", "é", "'s", "T", "́", " ", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "9", "<|endoftext|>", "İ", "Σ", "中", "🙂", "-", "...", "x" * 70]
small = WordEncoder(PATH, 20)


@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), max_size=4))
@settings(max_examples=300, deadline=None)
def test_same_ids_as_whole_texts(texts):
    want = [encoder(PATH).tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder(PATH).encode([t.encode() for t in texts])] == want
    assert [x.tolist() for x in small.encode([t.encode() for t in texts])] == want


def written(spark, rows):
    path = Scratch(spark, "test").path("ids")
    write_ids(documents(spark, rows), path, PATH, end_id=1)
    return path


@pytest.mark.parametrize("pack", [1 << 20, 300])
def test_round_trip(spark, monkeypatch, pack):
    monkeypatch.setattr(tokens, "PACK_BYTES", pack)
    rows = [*AWKWARD, *[(i, words(i % 90, i)) for i in range(100, 260)], *[(300, words(30, k)) for k in range(40)]]
    path = written(spark, rows)
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(encoder(PATH).tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    back = sorted(read_ids(spark, path).collect(), key=lambda r: r["start"])
    at, order = 0, []
    for r in back:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"] in want[r["doc_id"]]
        at += len(r["ids"])
        order.append(-(2**63) if r["doc_id"] is None else r["doc_id"])
    assert order == sorted(order) and len(back) == len(rows)
    digests = {(r["start"], r["ids_crc32"]) for r in read_ids(spark, path, digest=True).collect()}
    assert digests == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in back}
    picked = read_ids(spark, path, only=[4, 250, 12345]).collect()
    assert sorted(r["doc_id"] for r in picked) == [4, 250]
    assert all(r["ids"] in want[r["doc_id"]] for r in picked)


def test_empty(spark):
    assert read_ids(spark, written(spark, [])).count() == 0


def test_wrong_dictionary_is_noticed(spark):
    path = written(spark, [(i, words(50, i)) for i in range(60)])
    spark.createDataFrame([("0" * 64, 2, b"")], "dict_hash string, id_bytes int, bytes binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="dictionary"):
        read_ids(spark, path).collect()
