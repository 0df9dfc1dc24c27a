"""Fill-in-middle, prefix trie and removal of repeats against brute-force versions, with nulls, ties, hot keys, empty tables and clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ---- fill-in-middle ----
TEXTS = [None, "", "a", "<P", "an <S> mark", "é", "añb🙂c" * 50, "plain ascii only", "🙂" * 7, "x" * 70_000 + "é" * 3, "mixed \n\t é ü 漢字 end"] + ["abc é 漢 🙂 " * k for k in range(40)]


def plain_cut(key, text):
    x = sha(f"1:{'' if key is None else key}")
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    t, n = text or "", len(text or "")
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if form == "spm" else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return n, form, a, b - a, out


def test_fill_in_middle(spark, tmp_path):
    from tabulon.llm import fim

    rows = [(None if i == 5 else i // 2 if i > 45 else i, t, "clash", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output long")
    got = fim.fill_in_middle(docs).withColumn("back", fim.restore("_fim.output", "_fim.form")).collect()
    forms = Counter()
    for r in got:
        n, form, a, m, out = plain_cut(r.doc_id, r.text)
        assert (r._fim.n, r._fim.form, r._fim.prefix_units, r._fim.middle_units, bytes(r._fim.output).decode()) == (n, form, a, m, out)
        assert bytes(r.back).decode() == (r.text or "") and r.form == "clash"
        forms[form] += 1
    assert forms["psm"] and forms["spm"] and forms["plain"] and len(got) == len(rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert fim.op11_fill_in_middle(spark, str(tmp_path)).count() == 0


def test_runs_give_the_offset_of_every_unit():
    from tabulon.llm import fim

    for text in [t or "" for t in TEXTS[:11]]:
        runs = fim.runs_of_code_points(text.encode())
        assert runs.n == len(text)
        for unit in range(0, len(text) + 1, max(1, len(text) // 50)):
            assert runs.offset(unit) == len(text[:unit].encode())
    assert len(fim.runs_of_code_points(("x" * 70_000 + "é" * 3).encode()).units) == 2
    words = fim.runs_of_words(b"  one two\tthree \n")
    assert [words.offset(k) for k in range(4)] == [0, 5, 9, 17] and fim.runs_of_words(b"").n == 0 and fim.runs_of_words(b" \n").offset(1) == 2
    assert fim.runs_of_code_points(b"\x80\x80a").n == 2


# ---- prefix trie ----
def plain_trie(rows, most=5, share=100):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    said = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % (most + 1) if share else 0
        stem = c - int(abs(c) % share * (1 if c >= 0 else -1)) if share else None
        full[c] = tuple(said.get(stem, [])[:h] + said[c][h:]) if share else tuple(said[c])
    nodes = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], sum(not children[x] for x in below), saved, sha(ends)))
    return sorted(out, key=str)


def conversations(seed, n=150):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "ok", "é漢", ""])) for c in range(-30, n) if c % 7 for t in range(rng.randrange(1, 9))]
    rows += [(5, None, None, None), (5, None, None, None), (6, 1, "user", "tie"), (6, 1, "user", "tie"), (6, 1, "assistant", "tie"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(200, None if t % 2 else t // 40, "user", "same") for t in range(len(rows) // 2)]  # a third of all rows, mostly alike
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_prefix_trie(spark, tmp_path):
    from tabulon.llm import prefix_trie

    rows = conversations(1)
    spark.createDataFrame(rows, CONVERSATIONS).withColumn("depth", F.lit("clash")).repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    got = prefix_trie.op12_prefix_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def test_partial_tries_merge(spark, monkeypatch):
    from tabulon.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rows = [r for r in conversations(2, 60) if r[0] != 200]
    part = lambda k: prefix_trie.trie(prefix_trie.turns(spark.createDataFrame([r for r in rows if r[0] is not None and r[0] % 3 == k], CONVERSATIONS)))
    got = prefix_trie.rollup(*prefix_trie.merge([part(k) for k in range(3)])).drop("x", "y")
    got = got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows, share=0)


def test_no_and_turnless_conversations(spark, tmp_path):
    from tabulon.llm import prefix_trie

    for name, rows in (("none", []), ("lost", [(None, 0, "user", "a")]), ("short", [(c, 0, "user", "a") for c in (3, 4, 7, 11)])):
        spark.createDataFrame(rows, CONVERSATIONS).write.parquet(str(tmp_path / name / "conversations.parquet"))
        assert sorted(map(tuple, prefix_trie.op12_prefix_trie(spark, str(tmp_path / name)).collect()), key=str) == (plain_trie(rows) if name == "short" else [])


# ---- removal of repeats ----
def plain_repeats(texts, length):
    strings = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if strings[t[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        runs = sum(x and not (i and mask[i - 1]) for i, x in enumerate(mask))
        yield len(t), mask.count(1), runs, sha(bytes(b for b, x in zip(t, mask, strict=True) if not x))


def passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, texts = [said(rng.randrange(1, 300)) for _ in range(8)], [None, "", "short"]
    for i in range(40):
        t = rng.choice(base)
        for _ in range(rng.randrange(1, 6) if i % 5 == 0 else 0):
            p = rng.randrange(len(t) + 1)
            t = t[:p] + rng.choice(["X", "", "éé"]) + t[p + 1 :]
        start = rng.randrange(len(t) + 1)
        texts.append([t, "a" * rng.randrange(900), said(30) + t[start : start + 900] + said(30), t + "xyz" * rng.randrange(300), said(200)][i % 5])
    return texts + [base[0]] * 25  # a third are copies


@pytest.mark.parametrize("length", [41, 400])
def test_repeats(spark, length):
    from tabulon.llm import repeats

    texts = passages(length)
    docs = spark.createDataFrame([(i, None if i > 60 else i // 2, t, "clash", 1) for i, t in enumerate(texts)], "n long, doc_id long, text string, key string, ref int").repartition(5)
    rows = {r.n: r for r in repeats.without_repeats(docs, length=length).collect()}
    for i, want in enumerate(plain_repeats([(t or "").encode() for t in texts], length)):
        r = rows[i]._repeats
        assert (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), sha(bytes(r.kept))) == want
        assert rows[i].key == "clash" and rows[i].text == texts[i]


def test_repeats_in_long_texts_and_none(spark, tmp_path, monkeypatch):
    from tabulon.llm import repeats

    monkeypatch.setattr(repeats, "CHUNK", 1000)
    rng = random.Random(5)
    once, passage = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (9_000, 1_500))
    texts = [once[:4_000] + passage + once[4_000:] + passage, passage + "end", "z" * 5_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in repeats.op13_suffix_dedup(spark, str(tmp_path / "a")).collect()}
    assert [got[i] for i in range(3)] == list(plain_repeats([t.encode() for t in texts], 400))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert repeats.op13_suffix_dedup(spark, str(tmp_path / "b")).count() == 0


def test_runs_of_texts_in_many_chunks(monkeypatch):
    from tabulon.llm import repeats

    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (3_000, 10, 400, 1_999, 401)]
    whole = [row for part in repeats.runs(texts, 400) for row in zip(*part, strict=True)]
    monkeypatch.setattr(repeats, "CHUNK", 700)
    cut = [row for part in repeats.runs(texts, 400) for row in zip(*part, strict=True)]
    assert len(cut) > len(whole)
    for rows in (whole, cut):  # each string is in one run
        assert [(t, p) for t, lo, hi, *_ in rows for p in range(lo, hi + 1)] == [(t, p) for t, text in enumerate(texts) for p in range(len(text) - 399)]
    name = {(t, p): n for t, lo, hi, n, _ in whole for p in range(lo, hi + 1)}
    assert all(name[t, p] == n for t, lo, hi, n, _ in cut for p in range(lo, hi + 1))
