"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower-case letters with single spaces between words; their 1-, 2- and 3-grams are hashed into a fixed number of
buckets. Counts of a bounded, hash-chosen sample of labelled texts give a (languages x buckets) matrix of log probabilities, which is
broadcast: its size depends on the two parameters alone. Scoring is sparse and batched in numpy: the matrix is read only at the
buckets that a batch of texts holds and summed between the texts' borders.

The score nears 1 within a few words whatever they are. So each text also has a gap, which doesn't grow with its length: how much less
likely its n-grams are in its language, by their mean logarithm, than the n-grams that language was learnt from.

Texts that are null or hold no letter are ``und`` with score 0. With nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import chunks, short_batches, table

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Texts learnt for each language, about; chosen by a hash of their id among all labelled ones.
PER_LANGUAGE = 2_000
SMOOTHING = 0.5
#: The most labels: the matrix, the driver's counts and the broadcast hold a row for each.
MOST_LABELS = 1_000
#: A longer text counts as one of so many characters, or a few very long ones would make up their language. Weights are whole UNITs.
LOUDEST, UNIT = 4_000, 4_096
CHUNK = 1 << 17
UNKNOWN = "und"


@cache
def folding() -> np.ndarray:
    """Code point -> lower-case letter, 32 for all else, 0 for the mark between texts."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    out[0] = 0
    return out


def hashed_grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Folded letters, for each order the bucket of the n-gram at each place (BUCKETS where it would cross a border), the texts' starts."""
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts)
    c = folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = np.ones(c.size, dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    starts = np.flatnonzero(c == 0)
    grams, value, across = [], np.zeros(c.size, dtype=np.uint32), np.zeros(c.size, dtype=bool)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in range(max(ORDERS)):
        ahead = np.zeros_like(c)
        ahead[: c.size - n] = c[n:]
        across = across | (ahead == 0)
        value = (value + ahead + np.uint32(1)) * np.uint32(0x01000193)
        if n + 1 in ORDERS:
            mixed = value ^ (value >> np.uint32(15))
            mixed = (mixed * np.uint32(0x9E3779B1)) >> shift
            grams.append(np.where(across, np.uint32(BUCKETS), mixed))
    return c, grams, starts


class LanguageModel:
    """labels, log_prior, log_prob (labels x buckets, and a last column of zeros for places that count nothing) and its mean by label over
    the n-grams learnt."""

    def __init__(self, labels: list[str], counts: np.ndarray, texts: np.ndarray):
        self.labels = labels
        p = counts + SMOOTHING
        self.log_prob = np.zeros((len(labels), BUCKETS + 1))
        self.log_prob[:, :-1] = np.log(p / p.sum(axis=1, keepdims=True))
        self.mean = (counts * self.log_prob[:, :-1]).sum(axis=1) / np.maximum(counts.sum(axis=1), 1e-9)
        self.log_prior = np.log(texts / texts.sum()) if len(labels) else np.zeros(0)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and its posterior probability for each text."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, its posterior probability and the gap for each text."""
        n = len(texts)
        letters, places, sums = np.zeros(n), np.zeros(n), np.zeros((n, len(self.labels)))
        for part in chunks([t or "" for t in texts], CHUNK):
            at = np.array([i for i, _ in part])
            c, grams, starts = hashed_grams([t for _, t in part])
            np.add.at(letters, at, np.add.reduceat((c > 32).astype(np.int64), starts))
            size = np.diff(starts, append=c.size)
            np.add.at(places, at, sum(np.maximum(size - k, 0) for k in ORDERS))
            for k in range(len(self.labels)):
                row = self.log_prob[k]
                total = row[grams[0]]
                for g in grams[1:]:
                    total += row[g]
                np.add.at(sums[:, k], at, np.add.reduceat(total, starts))
        if not self.labels:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        best = (sums + self.log_prior).argmax(axis=1)
        gap = self.mean[best] - sums[np.arange(n), best] / np.maximum(places, 1)
        sums += self.log_prior
        score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        none = letters == 0
        return [UNKNOWN if none[i] else self.labels[best[i]] for i in range(n)], np.where(none, 0.0, score), np.where(none, 0.0, gap)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model of the labels in ``labelled``; rows with a null text, label or key teach nothing.

    Rows of a label are taken where a hash of their key falls below per_language over the label's rows, so the sample is bounded and
    the same in each run. The driver gets a row for each label and bucket: languages are few, buckets fixed.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label"), F.col(key).cast("string").alias("key"))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(totals) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels = sorted(totals)
    if not labels:
        return LanguageModel([], np.zeros((0, BUCKETS)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, per_language / totals[k])])
    place = F.expr("(xxhash64('lang', key) & 9223372036854775807) / 9223372036854775807D")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, group in batch.groupby("label"):
                own = found.setdefault(k, np.zeros(BUCKETS + 1, dtype=np.int64))
                size = group["text"].str.len().to_numpy()
                for part in chunks(group["text"], CHUNK):
                    c, grams, starts = hashed_grams([t for _, t in part])
                    weight = np.maximum(UNIT * LOUDEST // np.maximum(size[[i for i, _ in part]], LOUDEST), 1)
                    weight = np.repeat(weight, np.diff(starts, append=c.size))
                    for g in grams:
                        own += np.bincount(g, weights=weight, minlength=BUCKETS + 1).astype(np.int64)
        for k, own in found.items():
            at = np.flatnonzero(own[:-1])
            yield pd.DataFrame({"label": k, "bucket": at, "n": own[at]})

    sums = rows.filter(place < share[F.col("label")]).select("label", "text").mapInPandas(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sums["n"] /= UNIT
    counts = np.zeros((len(labels), BUCKETS))
    counts[sums["label"].map({k: i for i, k in enumerate(labels)}).to_numpy(dtype=np.int64), sums["bucket"].to_numpy(dtype=np.int64)] = sums["n"]
    return LanguageModel(labels, counts, np.array([totals[k] for k in labels], dtype=float))


def predict(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score, gap) of each text."""
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, gap double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            labels, score, gap = shared.value.judge(texts.tolist())
            yield pd.DataFrame({"lang_pred": labels, "score": score, "gap": gap})

    return language(text)


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for null ids, which teach nothing either."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every whole text, learnt from rows that are not held out; no SQL form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(spark, model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
