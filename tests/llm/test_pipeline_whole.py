"""What the pipeline's stages must not lose."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_keeps_texts_without_an_id(spark):
    import corpus_pipeline as cp

    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) for _ in range(12)]
    rows = [(None, t, "en", "s", 1) for t in texts[:8]]
    rows += [(None, texts[0], "en", "s", 1)]  # an equal row
    rows += [(None, texts[1], None, "en", 1), (None, texts[1], "en", None, 1)]  # equal text, other rows
    rows += [(7, texts[2], "en", "s", 1), (3, texts[2], "en", "s", 1)]  # copies with an id
    rows += [(20, texts[8], "en", "s", 1), (20, texts[9], "en", "s", 1), (20, texts[9], "en", "s", 1)]  # one id, two texts
    rows += [(21, texts[10], "en", "s", 1)] * 2
    got = [tuple(r) for r in cp.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()]
    assert all(r in rows for r in got)
    assert sorted(r[1] for r in got if r[0] is None) == sorted(t for t in texts[:8] if t != texts[2])
    assert sorted(r[0] for r in got if r[0] is not None) == [3, 20, 21]


def test_language_stage_rejects_noise(spark):
    import corpus_pipeline as cp

    rng = random.Random(3)
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    texts = [r.text for r in base.collect() if any(c.isalpha() for c in r.text or "")]
    words = [t.split() for t in texts]
    short = [w for w in (" ".join(w[at : at + 3]) for w in words for at in [rng.randrange(max(1, len(w) - 2))]) if any(c.isalpha() for c in w)]
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x4E00, 0x9FA5)))]
    noise = [" ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 10))) for _ in range(n)) for a in alphabets for n in (10, 100) for _ in range(50)]
    rows = [(-1, t, None, "short", 1) for t in short] + [(-2, t, None, "noise", 1) for t in noise]
    kept = cp.language(spark, base.union(spark.createDataFrame(rows, DOCS)), "").select("source").collect()
    n = {k: sum(r.source == k for r in kept) for k in ("short", "noise")}
    assert n == {"short": len(short), "noise": 0} and len(kept) - n["short"] == len(texts)


def test_the_product_holds_the_token_ids(spark, tmp_path):
    import corpus_pipeline as cp
    import public_tokenizers
    from tabulon.llm import bpe

    rows = [(1, "one text, another word", "en", "s", 22), (2, "é 中文 😀\n", "fr", "s", 7), (3, "", None, None, 0), (4, None, None, None, None)]
    decoder = bpe.Decoder(bpe.parse_ranks(bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))))
    got = cp.encode(spark, spark.createDataFrame(rows, DOCS), "").select("*", F.sha2("ids", 256).alias("again")).collect()
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        assert (len(r.ids), r.again) == (4 * r.n_tokens, r.ids_sha256)
        assert decoder.decode(bytes(r.ids)) == text.encode()
    spark.createDataFrame([(i, f"some words of text {i}", "en", "s", 20) for i in range(40)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    product = cp.encoded(spark, str(tmp_path))
    assert product.columns == [*cp.run(spark, str(tmp_path)).columns, "ids"]
    assert all(len(r.ids) == 4 * r.n_tokens for r in product.collect()) and product.count() > 0
