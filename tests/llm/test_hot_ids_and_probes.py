"""Rows of one id or none in mixing and sharding, and recall of the hardest links as the lists of embeddings grow."""

from collections import Counter, defaultdict

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def hot_rows():
    """A third of all rows have no id, a third id 5; of these half are alike in text too."""
    rows = [(None, f"word{i}" if i % 2 else "alike", "en", "a", 1) for i in range(600)]
    rows += [(5, "two words" if i % 2 else f"and three {i}", "en", "a" if i % 3 else "b", 1) for i in range(600)]
    return rows + [(1000 + i, "some more words here" * (i % 3), "en", "b", 1) for i in range(600)]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    spark.createDataFrame(hot_rows(), DOCS).repartition(7).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_taken_words_meet_the_target(spark, hot):
    from tabulon.llm import mixing

    rows = mixing.op2_mixing(spark, hot).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(rows) == 1800 and len(target) == 2 and all(abs(taken[k] - target[k]) <= 1 for k in target)
    again = mixing.op2_mixing(spark, hot).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_one_source_without_ids_beside_another(spark, tmp_path):
    from tabulon.llm import mixing

    for words in (1, 5):
        docs = [(None, "x " * words, "en", "a", 1)] * 600 + [(i, "y", "en", "b", 1) for i in range(200 * words)]
        spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / str(words) / "documents.parquet"))
        rows = [r for r in mixing.op2_mixing(spark, str(tmp_path / str(words))).collect() if r.source_size == 600 * words]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1


def test_shards_of_hot_ids(spark, hot):
    from tabulon.llm import sharding

    shards = defaultdict(list)
    for r in sharding.op6_sharding(spark, hot).collect():
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(24)) and {len(v) for v in shards.values()} == {75}
    assert all(sorted(r.slot for r in v) == list(range(75)) for v in shards.values())
    # rows of one id that differ in anything are spread; rows alike in all stay together and fill some shards
    often = Counter(r.text_crc32 for v in shards.values() for r in v)
    for key in (None, 5):
        assert sum(any(r.doc_id == key and often[r.text_crc32] == 1 for r in v) for v in shards.values()) >= 12


def test_slices_of_hot_ids(spark, hot):
    """A third of all rows without an id, a third with one, half of these alike: no slice is much larger than another, and all is in order."""
    from pyspark.sql import functions as F

    from tabulon.llm import fingerprints as fp

    docs = spark.read.parquet(f"{hot}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fp.ordered_slices(docs, 16).collect()
    own = [r for r in rows if not r.tail]
    sizes = Counter(r.slice for r in own)
    assert len(own) == 1800 and len(sizes) >= 14 and max(sizes.values()) <= 2 * 1800 / 16
    slices = sorted(sizes)
    tails = {r.slice: r for r in rows if r.tail}
    assert sorted(tails) == slices
    for i, at in enumerate(slices):
        key = lambda r: (r.k, r.h)
        later = [r for r in own if r.slice == slices[(i + 1) % len(slices)]]
        assert key(tails[at]) == min(map(key, later)) and (i + 1 == len(slices) or max(key(r) for r in own if r.slice == at) <= key(tails[at]))


def test_fingerprints_of_hot_ids(spark, hot):
    """The edited texts are those of one order of all rows, by id and then by the hash of the text."""
    import hashlib

    from pyspark.sql import functions as F

    from tabulon.llm import fingerprints as fp

    rows = spark.read.parquet(f"{hot}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = Counter()
    for k, r in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)].text, len(r.text) // 2
        want[r.doc_id, hashlib.sha256((r.text[: len(r.text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fp.op4_fingerprints(spark, hot).collect()) == want


@pytest.mark.parametrize("lists", [256, 1_024, 10_000, 100_000])
def test_recall_of_border_links(lists):
    """Pairs of cosine 0.901 to 0.92 among vectors without clusters: either end's probes hold the other's list."""
    from tabulon.llm import embeddings as em

    rng, size = np.random.default_rng(1), 64
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    quantiser = em.Quantiser(unit(rng.normal(size=(20_000, size))), lists)
    a, cosine = unit(rng.normal(size=(1_000, size))), rng.uniform(0.901, 0.92, size=(1_000, 1))
    across = rng.normal(size=a.shape)
    across = unit(across - (across * a).sum(axis=1, keepdims=True) * a)
    near = [np.concatenate([quantiser.near(x[i : i + 128], em.growing(quantiser.lists)) for i in range(0, len(x), 128)]) for x in (a, cosine * a + np.sqrt(1 - cosine**2) * across)]
    found = (near[0] == near[1][:, :1]).any(axis=1) | (near[1] == near[0][:, :1]).any(axis=1)
    assert found.mean() >= 0.95
