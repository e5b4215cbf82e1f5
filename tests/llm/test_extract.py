import pytest

from shelfmark.llm.extract import Page, extract, host_paths, with_host

SCHEMA = "page_id long, url string, html string, host string, path string, text string"
ARTICLE = "<p>First of the words, many of them.</p><p>Second one &amp; more <b>bo</b>ld<br>line.</p>"
CLEAN = "First of the words, many of them. Second one & more bold line."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><body><nav><a href=x>menu</a></nav><article>{ARTICLE}</article><footer>foot</footer></body></html>", CLEAN),
        (f"<body><header>site</header><main>{ARTICLE}<div class='ad box'>buy</div></main><aside>side</aside>", CLEAN),
        (f"<div id=wrap><div class='post-content'>{ARTICLE}<form><input><label>mail</label></form></div><div class='comments'>{'<p>I agree with all of it.</p>' * 9}</div></div>", CLEAN),
        (f"<body><div class=content-with-sidebar>{ARTICLE}<script>if (a < b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --></div></body>", CLEAN),
        ("<p>open<p>another<ul><li>a<li>b</ul>tail", "open another a b tail"),
        ("no markup &lt;b&gt; at\n all", "no markup <b> at all"),
        ("<div><span hidden>x</span>a<p style='display: none'>b</p>c</div>", "a c"),
        ("a < b and 3 <4", "a < b and 3 <4"),
        ("", ""),
        ("<script>never closed", ""),
    ],
)
def test_pages(page, want):
    assert Page(page).text(None) == want


def test_consensus(spark):
    """A page whose comments are longer than its article follows the other pages of its host."""
    shape = "<body><div class='story s{0}'>{1}</div><div class='talk t{0}'>{2}</div></body>"
    rows = [(i, f"https://www.News.example:80/{i}", shape.format(i, ARTICLE * 3, "<p>short</p>"), "x", "y", "z") for i in range(5)]
    rows += [(9, "http://user@news.example/9", shape.format(9, ARTICLE, "<p>A very long reader comment, again and again.</p>" * 20), "x", "y", "z")]
    rows += [(10, None, f"<article>{ARTICLE}</article>", "x", "y", "z"), (11, "not a url", None, "x", "y", "z"), (12, "http://other.example", shape.format(1, "", ARTICLE), "x", "y", "z")]
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA).repartition(3)
    got = sorted((r["page_id"], r["url"], r["text"]) for r in extract(df).where("url IS NOT NULL").collect())
    assert [g[0] for g in got] == [0, 0, 1, 2, 3, 4, 9, 11, 12]
    assert dict((g[0], g[2]) for g in got)[9] == CLEAN and got[0][2] == " ".join([CLEAN] * 3)
    assert dict((g[0], g[2]) for g in got)[11] == "" and dict((g[0], g[2]) for g in got)[12] == CLEAN
    assert extract(df).where("url IS NULL").first()["text"] == CLEAN
    paths = {r["host"]: r["path"] for r in host_paths(with_host(df)).collect()}
    assert paths["news.example"] == "/body/div.s#.story"


def test_votes_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    votes = {}
    for r in with_host(pages).collect():
        path, n = Page(r["html"]).vote()
        one = votes.setdefault(r["host"], {}).setdefault(path, [0, 0])
        one[0], one[1] = one[0] + 1, one[1] + n
    want = {h: min(v, key=lambda p: (-v[p][0], -v[p][1], p)) for h, v in votes.items()}
    assert {r["host"]: r["path"] for r in host_paths(with_host(pages)).collect()} == want
    texts = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert texts == {r["page_id"]: Page(r["html"]).text(want[r["host"]]) for r in with_host(pages).collect()}


def test_empty(spark):
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0
