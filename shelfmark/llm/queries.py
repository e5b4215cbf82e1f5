"""The registered queries of the operators, one each, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


SHARDS = 40


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 equally weighted shards; grown_shard is the place among 41."""
    from shelfmark.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
t AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w0 FROM w),
s AS (SELECT r, i, w0, lead(w0, 1) OVER (PARTITION BY r ORDER BY i) AS w1, lead(w0, 2) OVER (PARTITION BY r ORDER BY i) AS w2 FROM t),
c AS (SELECT r, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w0, w1, w2) > 1 AS twice FROM s),
p AS (SELECT r, count(*) FILTER (WHERE hit) AS n FROM (SELECT r, twice OR coalesce(lag(twice, 1) OVER (PARTITION BY r ORDER BY i), FALSE) OR coalesce(lag(twice, 2) OVER (PARTITION BY r ORDER BY i), FALSE) AS hit FROM c) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
g AS (SELECT r, sum(n) AS n_lines, sum(n - 1) AS dup FROM (SELECT r, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
u AS (SELECT r, count(*) FILTER (WHERE octet_length(encode(w0)) > 1 AND regexp_matches(w0, '[A-Z]') AND NOT regexp_matches(w0, '[a-z]')) AS up FROM t GROUP BY r),
m AS (
  SELECT w.r, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(g.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(g.n_lines, 0) AS n_lines, coalesce(u.up, 0) AS up, (length(text) - length(replace(text, '!!', ''))) / 2 AS shout
  FROM w LEFT JOIN p ON p.r = w.r LEFT JOIN g ON g.r = w.r LEFT JOIN u ON u.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)
    OR (n_words >= 10 AND 100 * up > 50 * n_words) OR 10 * shout > 3 * n_words) AS kept
FROM b
"""


@query("op3_quality_rules", QUALITY_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.quality import judge

    rows = judge(table(spark, sf_dir, "documents"), "v1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), threshold=3)
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"), weights=[1, 2, 3], cap=3)


def tokenizer_path(name: str) -> str:
    """The installed vocabulary files; a path is the operators' parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_ids")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.tokens import read_ids, write_ids

    path = Scratch(spark, "token-ids").path("ids")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_ids(spark, path, digest=True)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.extract import extract

    rows = extract(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role)) AS loss_sha256,
  CAST(sum(length(text) + len(regexp_extract_all(text, '\\|### (?:System|User|Assistant|Role):|</turn>')) + 8
    + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 11 + length(role) + len(regexp_extract_all(role, '\\|\n|### (?:System|User|Assistant|Role):|</turn>')) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op1_chat_formatting", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts look like control strings."""
    from shelfmark.llm.chat import format_chat, read_back

    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = tokenizer_path("byte_bpe_50k.json")
    return read_back(format_chat(rows, path), path)


WARC_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5(coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(url, '')) AS h FROM pages),
s AS (SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS source, octet_length(encode(html)) AS n, chr(13) || chr(10) AS nl FROM p),
t AS (SELECT *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || n || nl || nl || html AS block,
  'sha256:' || sha256(html) AS payload_digest, md5(source || chr(10) || 'conversion') AS hc, md5(source || chr(10) || 'metadata') AS hm,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'),
    '(?i)</?(?:address|article|aside|blockquote|body|br|div|dd|dl|dt|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS raw FROM s),
u AS (SELECT *, '<urn:uuid:' || hc[1:8] || '-' || hc[9:12] || '-' || hc[13:16] || '-' || hc[17:20] || '-' || hc[21:32] || '>' AS cid, '<urn:uuid:' || hm[1:8] || '-' || hm[9:12] || '-' || hm[13:16] || '-' || hm[17:20] || '-' || hm[21:32] || '>' AS mid,
  trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\x0b\f\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text,
  'status: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=utf-8' || nl || 'source-header: Content-Length: ' || n || nl || 'source-block-digest: sha256:' || sha256(block) || nl || 'source-payload-digest: ' || payload_digest || nl || 'source-length: ' || n || nl AS told FROM t),
v AS (SELECT *, 'WARC-Refers-To: ' || source || nl || coalesce('WARC-Refers-To-Target-URI: ' || url || nl, '') || 'WARC-Refers-To-Date: 1970-01-01T00:00:00Z' || nl || coalesce('WARC-Target-URI: ' || url || nl, '') || 'WARC-Date: 1970-01-01T00:00:00Z' || nl AS about FROM u),
w AS (
  SELECT page_id, 'conversion' AS kind, cid AS record_id, source, url, text AS body, payload_digest,
    'WARC/1.1' || nl || 'WARC-Type: conversion' || nl || 'WARC-Record-ID: ' || cid || nl || about || 'WARC-Source-Payload-Digest: ' || payload_digest || nl || 'WARC-Block-Digest: sha256:' || sha256(text) || nl || 'Content-Type: text/plain; charset=utf-8' || nl || 'Content-Length: ' || octet_length(encode(text)) || nl || nl || text || nl || nl AS record FROM v
  UNION ALL
  SELECT page_id, 'metadata', mid, source, url, told, payload_digest,
    'WARC/1.1' || nl || 'WARC-Type: metadata' || nl || 'WARC-Record-ID: ' || mid || nl || about || 'WARC-Concurrent-To: ' || cid || nl || 'WARC-Block-Digest: sha256:' || sha256(told) || nl || 'Content-Type: application/warc-fields' || nl || 'Content-Length: ' || octet_length(encode(told)) || nl || nl || told || nl || nl FROM v)
SELECT page_id, kind, record_id, source AS refers_to, url AS target_uri, 'sha256:' || sha256(body) AS block_digest, payload_digest AS source_digest,
  CAST(octet_length(encode(record)) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256 FROM w
"""


@query("op7_warc_derivatives", WARC_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of every page's response record, with the digest of their bytes."""
    from shelfmark.llm.warc import derive, responses

    rows = derive(responses(table(spark, sf_dir, "pages")), "page_id")
    whole = [F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256")]
    return rows.select("page_id", "kind", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", *whole)


LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


@query("op12_line_dedup", LINES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five documents or more share."""
    from shelfmark.llm.lines import drop_common_lines

    rows = drop_common_lines(table(spark, sf_dir, "documents"), least_chars=40, least_docs=5)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
k AS (SELECT lang, count(*) AS kept, CAST(sum(total) AS HUGEINT) AS lang_n FROM v GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN v ON v.lang = t.lang AND v.term = t.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS source_n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (
  SELECT s.lang, s.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.source_n + k.kept) AS p, 1 + (1000000000::HUGEINT * (v.total + 1)) // (k.lang_n + k.kept) AS q
  FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = v.term),
m AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
o AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN m ON m.lang = x.lang AND m.source = x.source AND m.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of each language against each other, and the terms each uses more than its language."""
    from shelfmark.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"), top=200)


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
z AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT item_id, term, count(*) AS asked FROM q GROUP BY item_id, term),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * z.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), z),
m AS (SELECT r, doc_id, 100 - 75 + (75 * CAST(len(ts) AS BIGINT) * z.n) // z.total AS m FROM d, z WHERE len(ts) > 0),
s AS (SELECT a.item_id, m.r, m.doc_id, CAST(sum(a.asked * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m))) AS BIGINT) AS score
  FROM a JOIN w ON w.term = a.term JOIN t ON t.term = a.term JOIN m ON m.r = t.r GROUP BY a.item_id, m.r, m.doc_id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""


@query("op13_ranked_search", SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item, out of all."""
    from shelfmark.llm.lexical import Index, search

    return search(Index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)
