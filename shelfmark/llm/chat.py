"""Chat formatting at token level.

Every text segment is encoded on its own; reserved ids beyond the tokenizer's vocabulary are spliced in as turn
headers and ends, so that no text can produce one. The loss mask comes from prefix sums: +1 where an assistant text
begins, -1 where it ends. Rendered as text, a reserved id is a control string; the same strings inside a text, and
backslashes, get a backslash in front, which reading takes away again.

    ### User: ...</turn>\\n### Assistant: ...</turn>\\n        roles with a header of their own
    ### Role: tool\\n...</turn>\\n                             any other role

Cases: a null text or role is empty (an empty role is a role of its own), null turns come first, equal turns are
ordered by role and tokens, repeated rows are turns of their own, a null conversation id is one conversation, empty
tables give empty results, texts of any length are encoded whole, other columns are ignored. Encoding happens before
the shuffle; what is gathered is one conversation, which is one output row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import bound_batches

HEADERS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER, BODY, END = "### Role: ", "\n", "</turn>\n"
#: Reserved strings in the order of their ids, from the vocabulary's size on.
RESERVED = (*HEADERS.values(), OTHER, BODY, END)
_CONTROL = re.compile(r"\\|### (?:System|User|Assistant|Role):|</turn>")
_ROLE_CONTROL = re.compile(r"\\|\n|### (?:System|User|Assistant|Role):|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """A byte-level tokenizer with the reserved ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # its own control strings are ordinary text in a segment
        self.base = self.tokenizer.get_vocab_size()
        self.ids = {s: self.base + i for i, s in enumerate(RESERVED)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""

    def splice(self, turns: list[tuple[str, list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, loss mask) of (role, ids of the role, ids of the text) turns."""
        parts, edges, at = [], [], 0
        for role, named, body in turns:
            head = [self.ids[HEADERS[role]]] if role in HEADERS else [self.ids[OTHER], *named, self.ids[BODY]]
            parts += [head, body, [self.ids[END]]]
            begin = at + len(head)
            at = begin + len(body) + 1
            if role == "assistant":
                edges.append((begin, begin + len(body)))
        step = np.zeros(at + 1, np.int64)
        for begin, stop in edges:
            step[begin] += 1
            step[stop] -= 1
        return np.concatenate([np.array(p, np.int32) for p in parts]) if parts else np.zeros(0, np.int32), np.cumsum(step[:at]).astype(np.int8)

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """(role, text) of every turn, read back from ids."""
        named = {self.ids[h]: role for role, h in HEADERS.items()}
        out, role, begin = [], "", 0
        for at in np.flatnonzero(ids >= self.base).tolist():
            mark = int(ids[at])
            if mark == self.ids[BODY]:
                role = unescape(self.decode(ids[begin:at]))
            elif mark == self.ids[END]:
                out.append((role, unescape(self.decode(ids[begin:at]))))
            elif mark in named:
                role = named[mark]
            begin = at + 1
        return out

    def render(self, ids: np.ndarray) -> str:
        """The formatted text."""
        out, begin = [], 0
        for at in [*np.flatnonzero(ids >= self.base).tolist(), len(ids)]:
            out.append(self.decode(ids[begin:at]))
            if at < len(ids):
                out.append(RESERVED[int(ids[at]) - self.base])
            begin = at + 1
        return "".join(out)

    def under_mask(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """All text under the loss mask, unescaped, in order."""
        edge = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
        return "".join(unescape(self.decode(ids[a:b])) for a, b in edge.reshape(-1, 2))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def format_chat(df: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, ids and loss_mask of every conversation of (conv_id, turn, role, text) rows."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in batches:
            role, text = b.column(2).to_pylist(), b.column(3).to_pylist()
            body = c.encode([escape(t) for t in text])
            named = c.encode(["" if r in HEADERS else escape(r, _ROLE_CONTROL) for r in role])
            ids = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(named, ids), pa.array(body, ids)], ["conv_id", "turn", "role", "named", "body"])

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in batches:
            done = [c.splice([(t["role"], t["named"], t["body"]) for t in turns]) for turns in b.column(1).to_pylist()]
            n = pa.array([len(x) for x in b.column(1).to_pylist()], pa.int64())
            columns = [b.column(0), n, pa.array([x[0] for x in done], pa.list_(pa.int32())), pa.array([x[1] for x in done], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "ids", "loss_mask"])

    bound_batches(df.sparkSession)
    kind = {c: df.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    rows = df.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    encoded = rows.mapInArrow(encode, f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, named array<int>, body array<int>")
    grouped = encoded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "named"))).alias("turns"))
    return grouped.mapInArrow(splice, f"conv_id {kind['conv_id']}, n_turns long, ids array<int>, loss_mask array<tinyint>")


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of formatted conversations, from their ids and masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in batches:
            out = []
            for ids, mask in zip(b.column(1), b.column(2)):
                ids, mask = ids.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False)
                turns, loss = c.turns(ids), c.under_mask(ids, mask)
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(c.render(ids))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "ids", "loss_mask").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
