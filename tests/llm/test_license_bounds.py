"""Bounds of the license scan's templates, and the same result with and without a broadcast of their shingles."""

import pytest

DOCS = "doc_id long, text string"
TEXT = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "start " + TEXT + " end"), (2, TEXT.replace("six", "other")), (3, None), (4, ""), (None, TEXT), (5, "all rights kept"), (5, TEXT + " all rights kept")], DOCS)


def test_more_than_the_bounds(docs, monkeypatch):
    from tabulon.llm import licenses

    for name, most, templates in (("MOST_TEMPLATES", 1, [("a", TEXT), ("b", "x y")]), ("MOST_WORDS", 13, [("a", TEXT), ("b", "x y")])):
        with monkeypatch.context() as m:
            m.setattr(licenses, name, most)
            with pytest.raises(ValueError, match=f"more than {most}"):
                licenses.scan(docs, templates)
    with pytest.raises(ValueError, match="no words"):
        licenses.scan(docs, [("a", TEXT), ("none", " ,; ")])


def test_result_does_not_hang_on_the_broadcast(docs, monkeypatch):
    from tabulon.llm import licenses

    # two templates of one name
    templates = [("a", TEXT), ("a", "all rights kept"), ("b", "never found here at all")]
    plan = lambda: sorted(map(tuple, licenses.scan(docs, templates).collect()), key=str)
    got = plan()
    assert {(i, n) for i, n, *_ in got} == {(1, "a"), (None, "a"), (5, "a")} and len(got) == 3
    monkeypatch.setattr(licenses, "BROADCAST_WORDS", 0)
    assert plan() == got
