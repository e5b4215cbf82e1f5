import hashlib

from shelfmark.llm.warc import END, build, derive, derive_one, parse, plain_text, responses

PAGE = "<html><head><title>t</title></head><body><h1>Ä &amp; B</h1><script>x</script><p>one <i>two</i>\n three<br>four</p></body></html>"


def record(headers=(), http=b"HTTP/1.1 404 Not Found\r\nX-A: 1\r\nX-A: 2\r\n folded\r\nContent-Type: text/html; charset=latin-1", body=PAGE.encode("latin-1")):
    return build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", "2020-01-01T00:00:00Z"), *headers], http + END + body)


def test_links_headers_and_digests():
    (conversion, metadata) = derive_one(record([("WARC-Payload-Digest", "sha1:ABC")]))
    head, block = parse(conversion[-1])
    assert block.decode() == "Ä & B\none two three\nfour" == plain_text(PAGE)
    assert head["warc-refers-to"] == "<urn:uuid:1>" and head["warc-refers-to-date"] == "2020-01-01T00:00:00Z" and head["warc-source-payload-digest"] == "sha1:ABC"
    assert head["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest() == conversion[4]
    about, told = parse(metadata[-1])
    assert about["warc-concurrent-to"] == head["warc-record-id"] != about["warc-record-id"]
    lines = told.decode().split("\r\n")
    assert lines[:4] == ["status: HTTP/1.1 404 Not Found", "source-header: X-A: 1", "source-header: X-A: 2 folded", "source-header: Content-Type: text/html; charset=latin-1"]
    assert "source-payload-digest: sha1:ABC" in lines


def test_odd_records(spark):
    rows = [None, b"", b"WARC/1.1\r\nWARC-Type: response" + END + b"x", record(), record(), record(body=b"", http=b"HTTP/1.1 200 OK"), build([("WARC-Type", "request"), ("WARC-Record-ID", "<x>")], b"GET"), record()[:-40]]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "n long, record binary, kind string")
    out = derive(df, "n").collect()
    assert sorted((r["n"], r["kind"]) for r in out) == [(0, "invalid"), (1, "invalid"), (2, "invalid"), *[(i, k) for i in (3, 4, 5) for k in ("conversion", "metadata")], (7, "invalid")]
    assert all(r["reason"] for r in out if r["kind"] == "invalid")
    assert derive(df.limit(0), "n").count() == 0


def test_from_pages(spark):
    df = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (1, "http://a/", PAGE)], "page_id long, url string, html string")
    rows = responses(df).collect()
    head, block = parse(bytes(rows[0]["record"]))
    assert head["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and block.endswith(PAGE.encode())
    out = derive(responses(df), "page_id").collect()
    assert len(out) == 6 and {r["target_uri"] for r in out if r["page_id"] == 2} == {None}
    assert len({r["record_id"] for r in out if r["page_id"] == 1}) == 2
