"""Product quantisation over inverted lists: exact where all lists are probed, recall for links at the border where few are."""

import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import embeddings as em

ROW = "vec_id long, embedding array<float>"


def links_of(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= em.COSINE
    np.fill_diagonal(link, False)
    return link


def planted(n, least, most, seed, size=32):
    """n vectors and a partner of each at a cosine between the two."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.uniform(least, most, size=(n, 1))
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * away]).astype(np.float32)


def run(spark, x, **options):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROW)
    return {r.vec_id: r for r in em.near_duplicates(rows, **options).collect()}


def test_recall_at_the_border(spark, monkeypatch):
    """400 lists of about four vectors, of which sixteen are probed: links of cosine 0.90 to 0.92, the hardest there are."""
    monkeypatch.setattr(em, "PER_LIST", 5)
    x = planted(1000, 0.901, 0.92, 3)
    link = links_of(x)
    got = run(spark, x)
    found, all_ = sum(r.n_links for r in got.values()), link.sum()
    assert all_ >= 2000 and found >= 0.9 * all_
    assert all(got[i].n_links <= link[i].sum() for i in range(len(x)))


def test_all_lists_are_exact(spark, monkeypatch):
    monkeypatch.setattr(em, "PER_LIST", 8)
    monkeypatch.setattr(em, "BLOCK", 3)
    monkeypatch.setattr(em, "CHUNK", 50)
    x = planted(150, 0.88, 0.93, 4)
    link, got = links_of(x), run(spark, x, probes=None)
    assert [got[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()


def test_a_group_of_near_copies_is_whole(spark, monkeypatch):
    """A third of all rows are near copies of one vector: every link among them is counted, in blocks."""
    monkeypatch.setattr(em, "PER_LIST", 10)
    monkeypatch.setattr(em, "BLOCK", 32)
    monkeypatch.setattr(em, "CHUNK", 100)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 16)), rng.normal(size=16) * 2 + 0.05 * rng.normal(size=(200, 16))]).astype(np.float32)
    link, got = links_of(x), run(spark, x)
    assert [got[i].n_links for i in range(400, 600)] == link[400:].sum(axis=1).tolist()
    assert {got[i].component_id for i in range(400, 600)} == {400}


def test_sizes_repeats_and_null_ids(spark):
    """Vectors of each size are compared among themselves; a null id is never the least; repeated ids and clashing columns are kept."""
    a, b = [1.0, 2.0], [1.0, 2.0, 0.0]
    rows = [(7, a), (3, a), (None, a), (9, [2.0, 4.0]), (1, b), (2, b), (4, [1.0, 2.1, 0.0]), (5, [0.0, 0.0, 1.0]), (8, [1e30, 2e30]), (6, [1e-30, 2e-30]), (6, [-1.0, 2.0]), (None, None)]
    df = spark.createDataFrame(rows, ROW).select("*", *[F.lit(1).alias(c) for c in ("node", "n", "size", "own", "list", "same", "x")])
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in em.near_duplicates(df).collect()), key=str)
    # the two rows with id 6: one links to the five others of its direction, the other to nothing
    want = [(7, 5, 3, False), (3, 5, 3, True), (None, 5, 3, False), (9, 5, 3, False), (8, 5, 3, False), (6, 5, 3, False), (6, 0, 6, True), (1, 2, 1, True), (2, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True), (None, 0, None, False)]
    assert got == sorted(want, key=str)
