"""Fingerprints of texts with repeated paragraphs."""

from collections import Counter


def test_likeness_is_that_of_multisets():
    from tabulon.llm.fingerprints import likeness, paragraph_sums

    for a, b in (([""] * 60 + [f"p{i}" for i in range(60)], [f"p{i}" for i in range(60)]), (["x"] * 100, ["x"] * 50), (["x"] * 70_000 + ["y"], ["x"] * 30_000), (["x"] * 40, ["y"] * 40)):
        both = sum((Counter(a) & Counter(b)).values())
        x, y = paragraph_sums(["\n".join(a), "\n".join(b)])[:, None]
        assert abs(likeness(x, y)[0] - 2 * both / (len(a) + len(b))) < 0.25


def test_insertion_and_deletion_of_repeated_paragraphs():
    from tabulon.llm.fingerprints import combine, paragraph_sums

    rest, part = ["a", "b", "a"], ["a", "c", "b", "a"]
    before, whole = paragraph_sums(["\n".join(rest), "\n".join(part + rest)])[:, None]
    change = paragraph_sums(["\n".join(part)], [Counter(rest)])
    assert (combine(before, change) == whole).all() and (combine(whole, change, -1) == before).all()
