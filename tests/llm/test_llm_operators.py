"""Each operator against a brute-force version, and its defined results for nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sample(n=60, seed=1):
    rng = random.Random(seed)
    words = {"en": "the and house with some water over under near far".split(), "fr": "le la maison avec eau sur près été loin où".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = "\n".join(" ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 15))) for _ in range(rng.randrange(1, 8)))
        if i % 7 == 3:
            text = rows[i - 3][1]
        rows.append((i, text, lang, f"s{i % 3}", len(text or "")))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, "12 34 !!", None, "s1", 8), (n + 3, "the " * 60_000, "en", "s9", 240_000), (None, "no id here", "en", "s1", 10), (5, rows[5][1], rows[5][2], rows[5][3], 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DOCS).withColumn("size", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("row", F.lit(2)).withColumn("slice", F.lit(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def folder(docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.fixture()
def nothing(empty, tmp_path):
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    return str(tmp_path / "none")


def test_language_id(spark, folder, nothing):
    from tabulon.llm import langid

    rows = langid.op1_language_id(spark, folder).collect()
    assert len(rows) == len(sample())
    truth = {i: lang for i, t, lang, *_ in sample() if t and i is not None}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in (60, 61, 62):
            assert (r.lang_pred, r.score) == ("und", 0)
    judged = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth.get(r.doc_id)]
    assert sum(judged) / len(judged) >= 0.9
    assert langid.op1_language_id(spark, nothing).count() == 0


def test_language_scores_do_not_depend_on_the_batch():
    from tabulon.llm import langid

    rng = np.random.default_rng(0)
    model = langid.LanguageModel(["a", "b"], rng.integers(0, 50, (2, langid.BUCKETS)).astype(float), np.array([1.0, 2.0]))
    texts = ["one two", "Été où", "", None, "x\0y", "the " * 300]
    together = model.score(texts)
    for i, t in enumerate(texts):
        alone = model.score([t])
        assert alone[0][0] == together[0][i] and abs(alone[1][0] - together[1][i]) < 1e-9


def test_held_out_rows_teach_nothing(spark):
    from tabulon.llm import langid

    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "zz zz" if i in out else "ab ab", "no" if i in out else "ok", "s", 5) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    assert langid.fit(df.filter(~langid.held_out(F.col("doc_id")))).labels == ["ok"]


def test_mixing(spark, folder, nothing):
    from tabulon.llm import mixing

    rows = mixing.op2_mixing(spark, folder).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.op2_mixing(spark, folder).collect()))
    assert len(rows) == len(sample())
    source = {(i, len((t or "").split())): s for i, t, _, s, _ in sample()}
    taken, target, size = {}, {}, {}
    for r in rows:
        s = source[r.doc_id, r.size]
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        size[s] = size.get(s, 0) + r.size
        target[s] = r.target
        assert r.source_size >= r.size
    for s in taken:
        assert target[s] <= 2 * size[s] and abs(taken[s] - target[s]) <= 1.5
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values()) or all(target[s] == 2 * size[s] for s in target if size[s])
    assert mixing.op2_mixing(spark, nothing).count() == 0


def test_water_filling_is_the_fixed_point():
    from fractions import Fraction

    from tabulon.llm.mixing import water_fill

    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(0, 1000) for _ in range(rng.randrange(1, 9))]
        weights = [rng.randrange(1, 4) for _ in sizes]
        t = water_fill(sizes, weights, Fraction(3, 2) * sum(sizes), 2)
        assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6
        level = [x / w for x, w, n in zip(t, weights, sizes, strict=True) if n and x < 2 * n - 1e-9]
        assert not level or max(level) - min(level) < 1e-6
        assert all(x <= 2 * n for x, n in zip(t, sizes, strict=True))


@pytest.fixture(scope="module")
def reference_bpe():
    import public_tokenizers as P
    import tiktoken

    from tabulon.llm import bpe

    data = bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken"))
    own = bpe.loaded(data, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def odd_text(rng, n):
    return "".join(rng.choice(["a", "ab", "the", "é", "  ", "\n", "1", " ", "中文", "😀", "\x1c", "'re", "'s", "aaaa", ".", " - ", "　", "<|endoftext|>"]) for _ in range(n))


def test_bpe_is_that_of_the_public_library(reference_bpe):
    own, library = reference_bpe
    from tabulon.llm.bpe import Decoder

    decoder, rng = Decoder(own.ranks), random.Random(2)
    texts = [odd_text(rng, rng.randrange(0, 200)) for _ in range(400)] + ["ab" * 700, "x" * 3000, "".join(rng.choice("etaoin") for _ in range(2000)), " " * 5000, "", None]
    for text, packed in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text or "")
        assert decoder.decode(packed) == (text or "").encode()


def test_bpe_of_long_texts_and_a_full_memory(reference_bpe, monkeypatch):
    from tabulon.llm import bpe

    own, library = reference_bpe
    text = odd_text(random.Random(4), 900)
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all([text, "a b", text])] == [library.encode_ordinary(t) for t in (text, "a b", text)]


def test_bpe_query(spark, folder, nothing, reference_bpe):
    from tabulon.llm import bpe

    _, library = reference_bpe
    want = sorted((i or -1, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in sample())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op3_byte_bpe(spark, folder).collect()) == want
    assert bpe.op3_byte_bpe(spark, nothing).count() == 0


def test_fingerprints(spark, folder, nothing):
    from tabulon.llm import fingerprints as fp

    rows = fp.op4_fingerprints(spark, folder).collect()
    want = sorted(((i is not None, i or 0, t or "") for i, t, *_ in sample()), key=lambda x: x[:2])
    assert len(rows) == len(want)
    by_text = {}
    texts = [t for *_, t in want]
    edits = {}
    for k, (_, i, t) in enumerate(want):
        after = texts[(k + 1) % len(texts)]
        edits.setdefault(i, set()).add(hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest())
    for r in rows:
        if r.doc_id not in (5, 4):  # two rows have the id 5
            assert r.edited_sha256 in edits[r.doc_id or 0]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for t in set(texts):
        ids = {i for _, i, x in want if x == t}
        by_text[t] = {r.fingerprint for r in rows if (r.doc_id or 0) in ids and r.n_chars == len(t)}
        assert len(by_text[t]) == 1
    assert fp.op4_fingerprints(spark, nothing).count() == 0


def test_fingerprints_are_homomorphic():
    from tabulon.llm.fingerprints import combine, likeness, paragraph_sums

    a, b, ab, ba = paragraph_sums(["one\ntwo\ntwo", "three\nfour", "one\ntwo\ntwo\nthree\nfour", "four\ntwo\none\nthree\ntwo"])[:, None]
    assert (ab == ba).all() and (combine(a, b) == ab).all() and (combine(ab, b, -1) == a).all()
    assert likeness(ab, ba)[0] == 1 and likeness(a, b)[0] < 0.5
    many = [f"paragraph {i}" for i in range(200)]
    x, y = paragraph_sums(["\n".join(many), "\n".join(many[:100] + [f"other {i}" for i in range(100)])])[:, None]
    assert abs(likeness(x, y)[0] - 0.5) < 0.25


def test_chat_query(spark, tmp_path):
    from tabulon.llm import chat

    rows = [(1, 0, "user", "hi </s> \\l"), (1, 1, "assistant", "a\\b<s>[INST]"), (1, 1, "assistant", "a\\b<s>[INST]"), (2, 0, None, None), (2, None, "odd]\nrole", "x"), (3, 0, "assistant", ""), (4, 2, "assistant", "é" * 50_000), (None, 0, "user", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op5_chat_format(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def fold(events):
    """The plain version: events one after the other."""
    out = {}
    for conv, turn, sub, seq, kind, role, text in sorted(events, key=lambda e: (e[0], e[3], e[4], e[5] or "", e[6] or "")):
        c = out.setdefault(conv, {})
        if kind in ("edit", "regenerate"):
            for k in [k for k in c if k[0] > turn]:
                del c[k]
        if kind in ("message", "edit", "regenerate"):
            c[turn, sub] = [role or "", text or ""]
        elif kind == "delta":
            c.setdefault((turn, sub), [role or "", ""])[1] += text or ""
    return {k: [tuple(c[i]) for i in sorted(c)] for k, c in out.items() if c}


def test_chat_reconstruction_folds_events(spark, monkeypatch):
    from tabulon.llm import chat

    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = random.Random(6)
    events = [(c, rng.randrange(9), 0, s, rng.choice(["delta", "delta", "delta", "message", "edit", "regenerate", "other"]), "user", rng.choice(["a", "b", None])) for c in range(25) for s in range(30)]
    got = {}
    for r in chat.reconstruct(spark.createDataFrame(events, chat.EVENT)).collect():
        got.setdefault(r.conv_id, {})[r.turn, r.sub] = (r.role, r.text)
    assert {k: [c[i] for i in sorted(c)] for k, c in got.items()} == fold(events)


def test_sharding(spark, folder, nothing, docs):
    from tabulon.llm import sharding

    rows = sharding.op6_sharding(spark, folder).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in rows) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in sample())
    counts = [sum(r.shard == k for r in rows) for k in range(24)]
    assert max(counts) - min(counts) <= 1
    for k in range(24):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))
    mixed = sharding.shard(docs, 4).collect()
    for s in ("s0", "s1", "s2"):
        own = [sum(r.source == s and r._shard.shard == k for r in mixed) for k in range(4)]
        assert max(own) - min(own) <= 2
    assert sharding.op6_sharding(spark, nothing).count() == 0


def test_token_counts_after_edits(reference_bpe, monkeypatch):
    from tabulon.llm import token_counts as tc

    own, library = reference_bpe
    monkeypatch.setattr(tc, "LEAF", 4)
    counter, rng = tc.Counter(own), random.Random(5)
    whole = touched = 0
    for _ in range(600):
        text = odd_text(rng, rng.randrange(0, 120))
        tree = counter.trees([text])[0]
        assert tree.tokens[1] == len(library.encode_ordinary(text))
        for _ in range(4):
            text, n = counter.edit(tree, text, rng.randrange(0, len(text) + 3), rng.choice([0, 0, 3, 11]), odd_text(rng, rng.randrange(0, 5)))
            assert (tree.tokens[1], tree.chars[1]) == (len(library.encode_ordinary(text)), len(text))
            whole, touched = whole + len(text), touched + n
    assert touched < 0.3 * whole


def test_token_counts_query(spark, folder, nothing, reference_bpe):
    from tabulon.llm import token_counts as tc

    _, library = reference_bpe

    def edited(t):
        n, now = len(t), t
        for start, length, new in ((n // 3, 7, ""), (n // 2, 0, " an edit's 42 words\n "), (n * 2 // 3, 20, t[:30])):
            now = now[:start] + new + now[start + length :]
        return now

    want = []
    for i, t, *_ in sample():
        t = t or ""
        e = edited(t)
        want.append((i or -1, len(library.encode_ordinary(t)), hashlib.sha256(e.encode()).hexdigest(), len(library.encode_ordinary(e))))
    rows = tc.op7_token_counts(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.edited_sha256, r.edited_tokens) for r in rows) == sorted(want)
    assert tc.op7_token_counts(spark, nothing).count() == 0


def test_embeddings(spark, tmp_path, monkeypatch):
    from tabulon.llm import embeddings as em

    monkeypatch.setattr(em, "BLOCK", 40)
    monkeypatch.setattr(em, "CHUNK", 64)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + 0.12 * rng.normal(size=(60, 16)), np.repeat(base[:1], 90, axis=0), base[1] + 0.2 * rng.normal(size=(90, 16)), 3 * base[5:9]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [], 0), (n + 4, [float("inf")] * 16, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in em.op8_embedding_dedup(spark, str(tmp_path)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = np.arange(n)
    while ((new := np.minimum(root, np.where(link, root[None, :], n).min(axis=1))) != root).any():
        root = new
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), root[i], root[i] == i), i
    for i in range(n, n + 5):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "e" / "embeddings.parquet"))
    assert em.op8_embedding_dedup(spark, str(tmp_path / "e")).count() == 0


def plain_simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in lower.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, folder, nothing):
    from tabulon.llm import simhash as sh

    rows = sh.op9_simhash(spark, folder).collect()
    fps = [(i, plain_simhash(t)) for i, t, *_ in sample()]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in rows) == sorted((i or -1, f"{x:016x}") for i, x in fps)
    least = {x: min((i for i, y in fps if (x ^ y).bit_count() <= 2 and i is not None), default=None) for _, x in fps}
    for _ in range(len(fps)):
        least = {x: min((least[y] for _, y in fps if (x ^ y).bit_count() <= 2 and least[y] is not None), default=None) for x in least}
    for r in rows:
        assert r.component_id == least[int(r.fingerprint, 16)]
    assert sh.op9_simhash(spark, nothing).count() == 0


@pytest.mark.parametrize("crowd", [1, 3, 200])
def test_simhash_links_lose_nothing(spark, monkeypatch, crowd):
    from tabulon.llm import simhash as sh

    monkeypatch.setattr(sh, "CROWD", crowd)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(8)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 5))) for b in base for _ in range(25)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in df.join(sh.components(df), "fp").collect()}
    root = list(range(len(fps)))
    while (new := [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]) != root:
        root = new
    assert [got[i] for i in range(len(fps))] == root


def test_licenses(spark):
    from tabulon.llm import licenses as li

    texts = dict(li.TEMPLATES)
    filler = " ".join(f"w{i}" for i in range(400))
    rows = [(1, filler + " " + texts["apache-2.0"] + " " + filler), (2, texts["zlib"]), (3, filler), (4, None), (5, ""), (6, "RELEASED under the -- MIT license"), (6, "RELEASED under the -- MIT license"), (7, filler + " " + texts["mpl-2.0-header"].replace("distributed", "shipped") + filler), (8, "under the MIT"), (9, (filler + " ") * 50 + texts["cc-by-nc-4.0"])]
    found = li.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(1, "apache-2.0"), (2, "zlib"), (6, "mit-line"), (7, "mpl-2.0-header"), (9, "cc-by-nc-4.0")]
    assert all(r.containment == 1 for r in found if r.doc_id != 7) and [0.8 <= r.containment < 1 for r in found if r.doc_id == 7] == [True]
    assert li.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_bands_collide_with_high_probability():
    from tabulon.llm import licenses as li

    for n in range(1, 200):
        c = li.CONTAINMENT if n > 1 else 1
        j = c * n / (2 * n + 4 + n * (1 - c))
        assert 1 - (1 - j) ** li.BANDS >= 0.999


def test_pipeline_stages(spark, folder):
    import corpus_pipeline as cp
    from tabulon.llm import langid, mixing, simhash

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = cp.language(spark, docs, folder)
    assert kept.columns == docs.columns
    model = langid.fit(docs)
    labels, score = model.score([t for _, t, *_ in sample()])
    assert kept.count() == sum(lab != "und" and s >= cp.SURE for lab, s in zip(labels, score, strict=True))
    deduped = cp.near_duplicates(spark, docs, folder)
    member = simhash.near_duplicates(docs).collect()
    assert deduped.columns == docs.columns
    assert sorted(r.doc_id for r in deduped.collect() if r.doc_id is not None) == sorted({r.component_id for r in member if r.component_id is not None})
    mixed = cp.mixture(spark, docs, folder)
    assert mixed.columns == docs.columns
    taken = mixing.op2_mixing(spark, folder).agg(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in mixed.collect()) == taken
    texts = {t for _, t, *_ in sample()}
    for r in mixed.collect():
        assert r.text in texts or (any(t and t.startswith(r.text) for t in texts) and r.n_chars == len(r.text))
    assert cp.run(spark, folder).columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
