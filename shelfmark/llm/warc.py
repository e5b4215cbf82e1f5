"""WARC derivatives: from each response record a plain-text conversion record and a metadata record linked to it.

Both refer to the response (WARC-Refers-To, its URI and date). The metadata record names the conversion it belongs
with (WARC-Concurrent-To), carries the HTTP status and every source header in order, and repeats the source's block
and payload digests; the conversion repeats the payload digest of what it was made from. Record ids are made from the
response's id, so a rerun gives the same records. Digests are SHA-256.

Cases: records that are not responses derive nothing; a record without an id, a header end or its full block gives
one row of kind `invalid` with the reason; an empty payload has an empty conversion; a response without a target URI
derives records without one; missing source digests are computed; repeated records derive repeated rows; an empty
table gives an empty result; payloads are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import bound_batches

VERSION, END = "WARC/1.1", b"\r\n\r\n"
_GONE = re.compile(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>")
_BREAK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|body|br|div|dd|dl|dt|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")
_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")
_BLANKS, _LINES = re.compile(r"[ \t\x0b\f\r]+"), re.compile(r" ?\n[ \n]*")


def digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def urn(*parts: str) -> str:
    h = hashlib.md5("\n".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def plain_text(page: str) -> str:
    """Text of a page, a line for each block."""
    text = _TAG.sub("", _BREAK.sub("\n", _WHITE.sub(" ", _GONE.sub("", page))))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip(" \n")


def build(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record; headers without a value are left out."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def fields(lines: list[str]) -> list[tuple[str, str]]:
    """Header lines as pairs, in order; a line that starts with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def parse(record: bytes | None) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block); ValueError says what is wrong."""
    head, found, rest = (record or b"").partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no header")
    headers = {k.lower(): v for k, v in reversed(fields(lines[1:]))}
    size = headers.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        raise ValueError("block is not as long as its header says")
    if not headers.get("warc-record-id"):
        raise ValueError("no record id")
    return headers, rest[: int(size)]


def derive_one(record: bytes | None) -> list[tuple]:
    """Rows (kind, record_id, refers_to, target_uri, block_digest, source_digest, reason, record)."""
    try:
        headers, block = parse(record)
    except ValueError as x:
        return [("invalid", None, None, None, None, None, str(x), None)]
    if headers.get("warc-type") != "response":
        return []
    source, uri, date = headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-date")
    head, _, payload = block.partition(END)
    status, *rest = head.decode("utf-8", "replace").split("\r\n")
    sent = fields(rest)
    charset = next((m[1] for k, v in sent if k.lower() == "content-type" and (m := re.search(r"charset=[\"']?([\w-]+)", v))), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    of_block, of_payload = headers.get("warc-block-digest") or digest(block), headers.get("warc-payload-digest") or digest(payload)
    text = plain_text(page).encode()
    ids = {k: urn(source, k) for k in ("conversion", "metadata")}
    about = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    told = [f"status: {status}", *(f"source-header: {k}: {v}" for k, v in sent), f"source-block-digest: {of_block}", f"source-payload-digest: {of_payload}", f"source-length: {len(payload)}"]
    described = ("\r\n".join(told) + "\r\n").encode()
    conversion = build([("WARC-Type", "conversion"), ("WARC-Record-ID", ids["conversion"]), *about, ("WARC-Source-Payload-Digest", of_payload), ("WARC-Block-Digest", digest(text)), ("Content-Type", "text/plain; charset=utf-8")], text)
    metadata = build([("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *about, ("WARC-Concurrent-To", ids["conversion"]), ("WARC-Block-Digest", digest(described)), ("Content-Type", "application/warc-fields")], described)
    return [
        ("conversion", ids["conversion"], source, uri, digest(text), of_payload, None, conversion),
        ("metadata", ids["metadata"], source, uri, digest(described), of_payload, None, metadata),
    ]


OUT = ("kind", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", "reason", "record")


def derive(df: DataFrame, key: str, record: str = "record") -> DataFrame:
    """key and OUT: two rows for each response record; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, row) for i, x in enumerate(b.column(1).to_pylist()) for row in derive_one(x)]
            keys = b.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            columns = [pa.array([row[k] for _, row in found], pa.binary() if name == "record" else pa.string()) for k, name in enumerate(OUT)]
            yield pa.RecordBatch.from_arrays([keys, *columns], [key, *OUT])

    bound_batches(df.sparkSession)
    kind = ", ".join(f"{c} {'binary' if c == 'record' else 'string'}" for c in OUT)
    return df.select(key, F.col(record).cast("binary").alias("body")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {kind}")


def responses(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """key and record: crawled pages as WARC response records, with the digests a crawler writes."""
    page = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    http = F.concat(F.lit(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string").cast("binary"), F.lit(END), page)
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(url).cast("string"), F.lit(""))).cast("binary"))
    rid = F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-"), h.substr(13, 4), F.lit("-"), h.substr(17, 4), F.lit("-"), h.substr(21, 12), F.lit(">"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: response\r\n"), line("WARC-Record-ID", rid), line("WARC-Target-URI", F.col(url).cast("string")), F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(http, 256))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(page, 256))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(http).cast("string")), F.lit("\r\n"),
    )
    return df.select(key, F.concat(head.cast("binary"), http, F.lit(END)).alias("record"))
