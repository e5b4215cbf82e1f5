import pytest

from shelfmark.llm import langid
from shelfmark.llm.langid import fit, identify, train

from .helpers import documents


def corpus(spark):
    """Two common languages of long texts, and two rare ones, one of them with a single very long text."""
    common = [(i, ("lorem ipsum dolor sit amet " if i % 2 else "quick brown foxes jump over ") * 40, "aa" if i % 2 else "bb") for i in range(400)]
    rare = [(1000 + i, "kolme neljä viisi kuusi seitsemän " * 5, "cc") for i in range(3)] + [(2000, "egy kettő három négy öt hat " * 4000, "dd")]
    return documents(spark, common + rare)


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 100_000)
    assert train(corpus(spark)).languages == ["aa", "bb", "cc", "dd"]


def test_rare_language_is_predicted(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 100_000)
    got = {r["doc_id"]: r["lang_pred"] for r in identify(corpus(spark)).where("doc_id >= 1000").collect()}
    assert got == {1000: "cc", 1001: "cc", 1002: "cc", 2000: "dd"}


def test_a_single_sample_teaches():
    model = fit([("aa", b" lorem ipsum dolor sit amet "), *[("bb", b" quick brown foxes jump over ")] * 9])
    assert model.answer(b"lorem ipsum dolor")[0] == "aa"


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError, match="languages"):
        train(corpus(spark))
