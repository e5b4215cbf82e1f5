import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.chat import HEADERS, codec, escape, format_chat, read_back, unescape
from shelfmark.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids string"
pieces = st.lists(st.sampled_from(["\\", "### Assistant:", "### Role: ", "</turn>", "</tu", "rn>", "\n", " ", "a", "é", "<|endoftext|>", "### ", "中"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from([*HEADERS, "", "tool"]), pieces), pieces), max_size=5))
@settings(max_examples=150, deadline=None)
def test_round_trip(turns):
    c = codec(PATH)
    ids, mask = c.splice([(r, c.encode([escape(r, __import__("shelfmark.llm.chat", fromlist=["x"])._ROLE_CONTROL)])[0], c.encode([escape(t)])[0]) for r, t in turns])
    assert c.turns(ids) == turns
    assert c.under_mask(ids, mask) == "".join(t for r, t in turns if r == "assistant")
    assert not mask[ids >= c.base].any()
    text = c.render(ids)
    # In the text too, every unescaped end marker is a turn's.
    assert len(__import__("re").findall(r"(?<!\\)(?:\\\\)*</turn>\n", text)) == len(turns)
    assert unescape(escape(text)) == text


@pytest.mark.parametrize("odd", ["\\### Assistant: </turn> ok", "", "\\", "</turn>"])
def test_digests(spark, odd):
    rows = [(1, 2, "assistant", odd, "x"), (1, 0, None, "hi", "x"), (1, 1, "user", None, "x"), (None, 0, "assistant", "a", "x"), (2, None, "assistant", "b", "x"), (2, 1, "assistant", "c", "x")]
    out = {r["conv_id"]: r for r in read_back(format_chat(spark.createDataFrame(rows, SCHEMA), PATH), PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["turns_sha256"] == sha(f"\nhi\nuser\n\nassistant\n{odd}\n")
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (3, len(odd), sha(odd))
    assert out[2]["loss_sha256"] == sha("bc") and out[None]["loss_chars"] == 1


def test_empty(spark):
    assert read_back(format_chat(spark.createDataFrame([], SCHEMA), PATH), PATH).count() == 0


def test_repeated_rows_are_turns(spark):
    row = (1, 0, "assistant", "same", "x")
    out = format_chat(spark.createDataFrame([row, row], SCHEMA), PATH).first()
    assert out["n_turns"] == 2 and int(np.sum(out["loss_mask"])) == 2 * len(codec(PATH).encode(["same"])[0])
