"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (what stands between line feeds). Each paragraph is hashed to a wide vector and the vectors
are added, lane by lane, modulo powers of two: 8 lanes modulo 2^64, equal only for equal multisets but for a chance of about 2^-256 and
less, and 256 lanes of +1 or -1 modulo 2^32. So the order of paragraphs doesn't matter, and paragraphs can be inserted or deleted by
adding or subtracting their vectors, without the rest of the text. The narrow lanes hash a paragraph with its occurrence number among
like ones, so that each difference counts once: paragraphs that the rest holds too are inserted or deleted with the numbers after its own.

The narrow lanes also give a likeness: the mean square of the difference of two fingerprints estimates how many paragraphs only one
of the texts has, and 1 - that / (paragraphs of both) is their likeness, 1 for equal multisets and about 0 for disjoint ones, with a
standard error of about sqrt(2 / 256). The number of paragraphs is one more lane.

Null texts are like empty ones: one empty paragraph. The sums are exact for texts of fewer than 2^31 paragraphs.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import short_batches, table

WIDE, NARROW = 8, 256
#: Bytes of a fingerprint: wide lanes, narrow lanes, the number of paragraphs.
BYTES = WIDE * 8 + NARROW * 4 + 8
STEP = 20_000


def paragraph_sums(texts: list[str], rests: list[dict[str, int]] | None = None) -> np.ndarray:
    """A fingerprint a text, as rows of bytes; with how often each paragraph is in the rest of each text, where it is a part of one."""
    wide, narrow, count = np.zeros((len(texts), WIDE), dtype="<u8"), np.zeros((len(texts), NARROW), dtype="<u4"), np.zeros((len(texts), 1), dtype="<u8")
    held: list[bytes] = []
    owner: list[int] = []

    def add() -> None:
        at = np.array(owner)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        data = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(len(held), -1)
        rows = at[starts]
        wide[rows] += np.add.reduceat(np.ascontiguousarray(data[:, : WIDE * 8]).view("<u8"), starts, axis=0)
        signs = np.unpackbits(data[:, WIDE * 8 :], axis=1)
        n = np.diff(starts, append=len(at)).astype("<u4")[:, None]
        narrow[rows] += 2 * np.add.reduceat(signs, starts, axis=0, dtype="<u4") - n
        count[rows] += n
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        seen = dict(rests[i]) if rests else {}
        for paragraph in text.split("\n"):
            b, nth = paragraph.encode(), seen.get(paragraph, 0)
            seen[paragraph] = nth + 1
            held.append(hashlib.blake2b(b, digest_size=WIDE * 8).digest() + hashlib.blake2b(b, digest_size=NARROW // 8, person=b"signs", salt=nth.to_bytes(8, "little")).digest())
            owner.append(i)
            if len(held) >= STEP:
                add()
    if held:
        add()
    return np.concatenate([wide.view(np.uint8), narrow.view(np.uint8), count.view(np.uint8)], axis=1)


def _lanes(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide, narrow, count = np.split(np.ascontiguousarray(fingerprints), [WIDE * 8, WIDE * 8 + NARROW * 4], axis=1)
    return np.ascontiguousarray(wide).view("<u8"), np.ascontiguousarray(narrow).view("<u4"), np.ascontiguousarray(count).view("<u8")


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of a's paragraphs with b's inserted, or with b's deleted where sign is -1; b's made with the rest's counts."""
    return np.concatenate([(x + y if sign > 0 else x - y).view(np.uint8) for x, y in zip(_lanes(a), _lanes(b), strict=True)], axis=1)


def with_new_ends(texts: list[str], prints: np.ndarray, cuts: list[int], ends: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts of which all after the cut is replaced by another end, and their fingerprints: those of the texts, with the paragraphs from the
    cut one on deleted and the new ones inserted. The paragraphs before it are counted, as far as they occur there too, but not hashed."""
    edited, gone, put, rests, held = [], [], [], [], []
    for text, cut, end in zip(texts, cuts, ends, strict=True):
        start = text.rfind("\n", 0, cut) + 1
        edited.append(text[:cut] + end)
        gone.append(text[start:])
        put.append(text[start:cut] + end)
        touched = {*gone[-1].split("\n"), *put[-1].split("\n")}
        rests.append(Counter(p for p in text[: start - 1].split("\n") if p in touched) if start else {})
        held.append(start > 0)
    # where nothing stands before the cut's paragraph, what is deleted is the text itself, whose fingerprint is known
    deleted = prints.copy()
    if any(held):
        deleted[held] = paragraph_sums([x for x, h in zip(gone, held) if h], [x for x, h in zip(rests, held) if h])
    return edited, combine(combine(prints, deleted, -1), paragraph_sums(put, rests))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows."""
    (wide_a, narrow_a, count_a), (wide_b, narrow_b, count_b) = _lanes(a), _lanes(b)
    apart = (np.square((narrow_a - narrow_b).view("<i4").astype(np.float64))).mean(axis=1)
    both = (count_a + count_b).astype(np.float64)[:, 0]
    like = np.clip(1 - apart / np.maximum(both, 1), 0, 1)
    return np.where((wide_a == wide_b).all(axis=1) & (count_a == count_b)[:, 0], 1.0, like)


@pandas_udf(T.BinaryType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprint of a text column."""
    for texts in batches:
        yield pd.Series([x.tobytes() for x in paragraph_sums([t or "" for t in texts])], dtype=object)


#: Stands for no id, before all ids.
NO_ID = -(1 << 63)
#: Follows all parts of a value that is cut.
REST = 1 << 19


def _cuts(limits: list) -> tuple[list, dict]:
    """The limits of slices, and for each value that several slices would be full of, how many."""
    held = Counter(x for x in limits or [] if x is not None)
    return sorted(held), {value: n for value, n in held.items() if n > 1}


def _below(limits: list, value: str) -> str:
    """SQL for how many limits lie at or below the value, counted in two steps: groups of limits, then limits of a group."""
    if not limits:
        return "0"
    step = max(1, int(len(limits) ** 0.5))
    groups = [limits[i : i + step] for i in range(0, len(limits), step)]
    array = lambda v: f"array({', '.join('bigint(' + repr(str(x)) + ')' for x in v)})"
    group = f"size(filter({array([g[0] for g in groups])}, x -> x <= {value}))"
    inner = f"size(filter(element_at(array({', '.join(map(array, groups))}), {group}), x -> x <= {value}))"
    return f"CASE WHEN {group} > 0 THEN ({group} - 1) * {step} + {inner} ELSE 0 END"


def ordered_slices(docs: DataFrame, slices: int) -> DataFrame:
    """docs (doc_id, text) dealt by ranges of their order (column ``slice``, those with more of it later), which is that of the ids, none
    first, then of a hash of the text, ``h``; each slice has the next one's first row too, marked ``tail``; the last one the first's.

    The ranges' limits are quantiles, a number a range. An id that would fill several slices is cut by quantiles of its hashes, and rows
    that are alike in id and text, which may follow each other in any order, by their place in the input. Ids from 2^53 on are not cut so.
    """
    spark = docs.sparkSession
    d = docs.withColumn("k", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("h", F.xxhash64("text")).withColumn("h48", F.shiftright("h", 16)).withColumn("place", F.monotonically_increasing_id())
    fractions = lambda n: [i / n for i in range(1, n)]
    quantiles = lambda c, n: F.percentile_approx(c, fractions(n), 100 * n)
    limits, hot = _cuts(d.agg(quantiles("k", slices)).first()[0] if slices > 1 else None)
    # a slice begins at its limit, so the rows of one that are not of the value that is cut come after those that are
    by_hash, by_place = F.lit(REST), F.lit(REST)
    if hot:
        most = max(hot.values())
        for row in d.filter(F.col("k").isin(*hot)).groupBy("k").agg(quantiles("h48", most).alias("q")).collect():
            inner, alike = _cuts(row["q"])
            by_hash = F.when(F.col("k") == row["k"], F.expr(_below(inner, "h48"))).otherwise(by_hash)
            for value, n in alike.items():
                by_place = F.when((F.col("k") == row["k"]) & (F.col("h48") == value), F.pmod("place", F.lit(n))).otherwise(by_place)
    number = lambda c, bits: F.shiftleft(c.cast("long"), bits)
    dealt = d.withColumn("slice", number(F.expr(_below(limits, "k")), 40) + number(by_hash, 20) + by_place.cast("long")).drop("h48")
    firsts = sorted((r["slice"], *r["first"]) for r in dealt.groupBy("slice").agg(F.min(F.struct("k", "h", "place")).alias("first")).collect())
    if not firsts:
        return dealt.withColumn("tail", F.lit(False))
    before = spark.createDataFrame([(*first, firsts[i - 1][0]) for i, (_, *first) in enumerate(firsts)], "k long, h long, place long, to long")
    tails = d.join(F.broadcast(before), ["k", "h", "place"]).withColumn("slice", F.col("to"))
    return dealt.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True)).select(*dealt.columns, "tail"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in one pass over the documents dealt by ranges of doc_id; the edited text's
    come from the text's by deleting and inserting the paragraphs that the edit touches.

    Documents with equal ids follow each other by a hash of their text, those without an id come first.
    """
    short_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ordered_slices(docs, 4 * partitions).repartition(partitions, "slice").sortWithinPartitions("slice", "tail", "k", "h")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows = list(zip(part["slice"].tolist(), part["tail"].tolist(), part["doc_id"].tolist(), part["text"].tolist(), strict=True))
                prints = paragraph_sums([r[3] for r in rows])
                rows, prints = ([held[0], *rows], np.concatenate([held[1], prints])) if held else (rows, prints)
                held = rows[-1], prints[-1:]
                own = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
                if not own:
                    continue
                texts = [(rows[i][3], rows[i + 1][3]) for i in own]
                here = prints[own]
                edited, after = with_new_ends([a for a, _ in texts], here, [len(a) - len(a) // 2 for a, _ in texts], [b[: len(a) // 2] for a, b in texts])
                ids = pd.array([None if rows[i][2] != rows[i][2] else rows[i][2] for i in own], dtype="Int64")
                yield pd.DataFrame(
                    {
                        "doc_id": ids,
                        "n_chars": [len(a) for a, _ in texts],
                        "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                        "fingerprint": [x.tobytes().hex() for x in here],
                        "edited_fingerprint": [x.tobytes().hex() for x in after],
                        "near_edited": likeness(here, after),
                        "near_next": likeness(here, prints[[i + 1 for i in own]]),
                    }
                )

    return dealt.mapInPandas(pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
