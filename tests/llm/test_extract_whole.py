import pytest

from shelfmark.llm.extract import Page

LONG, SHORT = "<p>" + "A long passage of the text. " * 20 + "</p>", "<p>" + "A shorter one it is. " * 16 + "</p>"


@pytest.mark.parametrize(
    ("page", "parts"),
    [
        (f"<body><article><h1>Title</h1><p>The lead.</p><section>{LONG}</section></article></body>", ["Title", "The lead.", "long passage"]),
        (f"<body><article><div class=entry-content>{SHORT}</div><div>{LONG}</div></article></body>", ["shorter one", "long passage"]),
        (f"<body><div class=content>{LONG}</div><div class=rest>{SHORT}</div></body>", ["shorter one", "long passage"]),
        (f"<body><form id=aspnetForm action=x><div><h1>Title</h1>{LONG}</div><input></form></body>", ["Title", "long passage"]),
        ("<body><p>So it is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></body>", ["So it is x = 2 here."]),
    ],
)
def test_nothing_but_boilerplate_goes(page, parts):
    assert all(p in Page(page).text(None) for p in parts)


def test_small_forms_go():
    page = Page(f"<body><form><label>Mail me</label></form><div>{LONG}</div><form>Search <form>here</form></form></body>")
    assert page.text(None) == ("A long passage of the text. " * 20).strip()


def test_host_path_with_next_to_nothing():
    page = Page(f"<body><div class=a>x</div><div class=b>{LONG}</div></body>")
    assert "long passage" in page.text("/body/div.a") and page.text("/body/div.b").startswith("A long")
