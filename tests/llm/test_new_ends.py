"""Fingerprints of edited texts by deletion and insertion against those of the whole edited texts."""

import random


def test_edits_equal_a_recount():
    from tabulon.llm.fingerprints import paragraph_sums, with_new_ends

    r = random.Random(3)
    text = lambda: "".join(r.choice("ab\n\n") for _ in range(r.randint(0, 30)))
    texts = [text() for _ in range(3000)] + ["", "\n", "a", "\n\n", "é\n" * 5]
    cuts = [r.randint(0, len(t)) for t in texts]
    ends = [text() for _ in texts]
    edited, got = with_new_ends(texts, paragraph_sums(texts), cuts, ends)
    assert edited == [t[:c] + e for t, c, e in zip(texts, cuts, ends)]
    assert (got == paragraph_sums(edited)).all()


def test_paragraphs_before_the_cut_are_not_hashed(monkeypatch):
    from tabulon.llm import fingerprints as fp

    text = "a long line\n" * 1000 + "the end"
    prints = fp.paragraph_sums([text])
    sizes = []
    whole = fp.paragraph_sums
    monkeypatch.setattr(fp, "paragraph_sums", lambda texts, rests=None: sizes.extend(map(len, texts)) or whole(texts, rests))
    edited, got = fp.with_new_ends([text], prints, [len(text) - 3], ["start"])
    assert sizes == [7, 9] and (got == whole(edited)).all()


def test_none():
    from tabulon.llm.fingerprints import BYTES, paragraph_sums, with_new_ends

    edited, got = with_new_ends([], paragraph_sums([]), [], [])
    assert edited == [] and got.shape == (0, BYTES)
