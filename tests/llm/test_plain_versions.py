"""Plain versions, a text at a time: naive Bayes, fingerprints with their likenesses, and the whole pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=70, seed=4):
    rng = random.Random(seed)
    words = {"en": "the and house with some water over under near far".split(), "fr": "le la maison avec eau sur près été loin où".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = "\n".join(" ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 15))) for _ in range(rng.randrange(1, 8)))
        text = rows[i - 5][1] if i % 9 == 5 else text + "!! 12" if i % 4 == 0 else text
        rows.append((i, text, lang if i % 6 else None, rng.choice(["s0", "s1", "s2", None]), len(text)))
    return rows + [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, "12 34 !!", None, "s1", 8), (n + 3, "the " * 3_000, "en", "s9", 12_000), (None, "where is no id", "en", "s1", 10), (5, *rows[5][1:]), (5, "another text of id five", "en", "s0", 23)]


class PlainBayes:
    """Counts of hashed 1-, 2- and 3-grams in dictionaries."""

    def __init__(self, labelled):
        from tabulon.llm import langid

        self.buckets, self.smoothing = langid.BUCKETS, langid.SMOOTHING
        self.counts, self.texts = defaultdict(Counter), Counter()
        for text, label in labelled:
            self.texts[label] += 1
            weight = (4_096 * 4_000 // max(len(text), 4_000)) / 4_096
            for b in self.grams(text):
                self.counts[label][b] += weight
        self.total = {k: sum(c.values()) + self.smoothing * self.buckets for k, c in self.counts.items()}

    def grams(self, text):
        folded = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
        while "  " in folded:
            folded = folded.replace("  ", " ")
        for n in (1, 2, 3):
            for i in range(len(folded) - n + 1):
                h = 0
                for c in folded[i : i + n]:
                    h = (h + ord(c) + 1) * 0x01000193 % (1 << 32)
                yield ((h ^ h >> 15) * 0x9E3779B1 % (1 << 32)) >> 17

    def log(self, label, bucket):
        return math.log((self.counts[label][bucket] + self.smoothing) / self.total[label])

    def judge(self, text):
        """label, posterior, gap"""
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0, 0.0
        g, labels = list(self.grams(text)), sorted(self.texts)
        sums = {k: sum(self.log(k, b) for b in g) for k in labels}
        prior = {k: sums[k] + math.log(self.texts[k] / sum(self.texts.values())) for k in labels}
        best = max(labels, key=lambda k: (prior[k], -labels.index(k)))
        mean = sum(n * self.log(best, b) for b, n in self.counts[best].items()) / sum(self.counts[best].values())
        return best, 1 / sum(math.exp(v - prior[best]) for v in prior.values()), mean - sums[best] / len(g)


def test_language_id_against_plain_bayes(spark, tmp_path):
    from tabulon.llm import langid

    rows = corpus()
    spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    plain = PlainBayes([(t, lang) for i, t, lang, *_ in rows if i is not None and t is not None and lang and zlib.crc32(str(i).encode()) % 4 != 2])
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.op1_language_id(spark, str(tmp_path)).collect()), key=str)
    want = sorted(((i, *plain.judge(t)[:2]) for i, t, *_ in rows), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_fingerprints_are_sums_of_paragraph_vectors():
    """Each paragraph's vector alone, and their sums with Python's whole numbers."""
    from tabulon.llm import fingerprints as fp

    texts = ["a\nb\na", "b\na\na", "", "one line", "x\n\n\ny\nx"]
    wide = lambda p: [int.from_bytes(hashlib.blake2b(p.encode(), digest_size=fp.WIDE * 8).digest()[k * 8 : k * 8 + 8], "little") for k in range(fp.WIDE)]
    got = fp.paragraph_sums(texts)
    for i, t in enumerate(texts):
        sums = [sum(v) % (1 << 64) for v in zip(*map(wide, t.split("\n")), strict=True)]
        assert got[i][: fp.WIDE * 8].tobytes() == np.array(sums, dtype="<u8").tobytes()
    assert (got[0] == got[1]).all()


def test_fingerprint_query_against_plain_values(spark, tmp_path):
    """All rows, also those with a repeated or null id: edited texts, equality and both likenesses."""
    from tabulon.llm import fingerprints as fp

    rows = corpus()
    spark.createDataFrame(rows, DOCS).withColumn("slice", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.op4_fingerprints(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)

    def of(text):
        return fp.paragraph_sums([text])

    def outcome(order):
        out = []
        for k, (i, t) in enumerate(order):
            after, t = order[(k + 1) % len(order)][1] or "", t or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half] if half else t
            out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(float(fp.likeness(of(t), of(edited))[0]), 9), round(float(fp.likeness(of(t), of(after))[0]), 9)))
        return sorted(out, key=str)

    # the two texts of id 5 may come in either order
    ids = sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    at = [k for k, r in enumerate(ids) if r[0] == 5]
    orders = []
    for perm in ([0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]):
        order = list(ids)
        for k, p in zip(at, perm, strict=True):
            order[k] = ids[at[p]]
        orders.append(outcome(order))
    assert sorted(((a, b, c, e, f) for a, b, c, _, _, e, f in got), key=str) in orders
    equal = defaultdict(set)
    for i, _, _, f, *_ in got:
        if i is not None and i != 5:
            equal[next(t for j, t, *_ in rows if j == i) or ""].add(f)
    assert all(len(v) == 1 for v in equal.values())


def plain_fingerprint(text):
    w = (text or "").lower().split()
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_pipeline(rows):
    """(doc_id, text) of what the pipeline encodes; corpus() has no two rows of one group and id that differ but in those columns."""
    import corpus_pipeline as cp

    model = PlainBayes([(t, lang) for i, t, lang, *_ in rows if i is not None and t is not None and lang])
    judged = [(r, model.judge(r[1])) for r in rows]
    kept = [r for r, (label, score, gap) in judged if label != "und" and score >= cp.SURE and gap <= cp.FAR]
    fps = [plain_fingerprint(r[1]) for r in kept]
    root = list(range(len(kept)))
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2 or (kept[i][0] is not None and kept[i][0] == kept[j][0])
    while (new := [min(root[j] for j in range(len(kept)) if near(i, j)) for i in range(len(kept))]) != root:
        root = new
    groups = defaultdict(list)
    for r, k in zip(kept, root, strict=True):
        groups[k].append(r)
    chosen = [[r for r in g if (r[0] is None, r[0] or 0) == min((x[0] is None, x[0] or 0) for x in g)] for g in groups.values()]
    assert all(len(set(c)) == 1 or c[0][0] == 5 for c in chosen)
    return [c[0] for c in chosen], [c for c in chosen if len(set(c)) > 1]


def test_whole_pipeline(spark, tmp_path):
    import corpus_pipeline as cp
    import public_tokenizers
    import tiktoken
    from tabulon.llm import mixing

    rows = [r for r in corpus() if r[0] != 5 or r[1] != "another text of id five"]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    stay, open_ = plain_pipeline(rows)
    assert not open_
    sizes, place = Counter(), lambda i: hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()
    for r in stay:
        sizes[r[3]] += len(r[1].split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, left, open_, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over} if over else share
        left -= sum(2 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for s in names:
        rest = round(float(target[s])) - int(target[s] // sizes[s]) * sizes[s]
        for r in sorted((r for r in stay if r[3] == s), key=lambda r: place(r[0])):
            words = len(r[1].split())
            n = int(target[s] // sizes[s]) * words + max(0, min(words, rest))
            rest -= words
            for _ in range(n // words):
                want[r[0], ids_hash(library, r[1])] += 1
            if n % words:
                want[r[0], ids_hash(library, first_words(r[1], n % words))] += 1
    got = Counter((r.doc_id, r.ids_sha256) for r in cp.run(spark, str(tmp_path)).collect())
    assert got == want


def bpe_ranks(path):
    import base64

    return {base64.b64decode(t): int(n) for t, n in (line.split() for line in open(path, "rb").read().splitlines() if line)}


def ids_hash(library, text):
    return hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text))).hexdigest()


def first_words(text, n):
    at = 0
    for _ in range(n):
        while text[at].isspace():
            at += 1
        while at < len(text) and not text[at].isspace():
            at += 1
    return text[:at]


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "mixture"])
def test_stages_of_empty_tables_and_clashing_columns(spark, stage):
    import corpus_pipeline as cp

    run = getattr(cp, stage)
    assert run(spark, spark.createDataFrame([], DOCS), "").count() == 0
    names = ["p", "n", "size", "taken", "copy", "left", "row", "mix", "rate", "fp", "root", "stays", "h1"]
    docs = spark.createDataFrame(corpus(20), DOCS).select("*", *[F.lit("own").alias(c) for c in names])
    out = run(spark, docs, "")
    assert out.columns == docs.columns and out.filter(" and ".join(f"{c} = 'own'" for c in names)).count() == out.count() > 0
