"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ.

Fingerprints are cut into four blocks of 16 bits. Two that differ in at most two bits agree in at least two whole blocks, so each
fingerprint is dealt to the six pairs of blocks, joined there with those of equal blocks, and the Hamming distance verified.
A pair of blocks that more than ``CROWD`` fingerprints share is not joined: there each fingerprint is sent to itself and to the 32
one-bit changes of its other blocks. Two that differ in at most two bits meet at one of these, and all that meet differ in two bits
at most, so linking each to the least one there gives the same components with rows in proportion to the fingerprints.

Only distinct fingerprints are linked; copies are counted before. Null texts are like empty ones: fingerprint zero, which is linked
like any other. Rows with equal ids are one document id with possibly several fingerprints, which then link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import checkpointed, connected_components, short_batches, table

WORDS, SEED, DISTANCE = 3, 42, 2
#: The most fingerprints on a pair of blocks for which pairs are made; larger groups take the other way, with the same links.
CROWD = 200
STEP = 200_000


def shingle_bits(words: list[bytes]) -> int:
    """The fingerprint, as a signed 64-bit integer. Bits of STEP shingles at a time are summed."""
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + WORDS - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=">u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n).view(">i8")[0])


@pandas_udf(T.LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprint of a text: ASCII letters lower-cased, words between ASCII white space, three-word shingles hashed by XXH64."""
    for texts in batches:
        yield pd.Series([shingle_bits(t.encode().lower().split()) if t else 0 for t in texts], dtype="int64")


def blocks_of(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF) for k in range(4)]


def links(fingerprints: DataFrame, column: str = "fp") -> DataFrame:
    """(a, b) edges between distinct non-null fingerprints; their connected components are those of all pairs within DISTANCE bits."""
    part = blocks_of(F.col("fp"))
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = [F.lit(k).cast("long") * (1 << 32) + part[i] * 65536 + part[j] for k, (i, j) in enumerate(pairs)]
    distinct = fingerprints.select(F.col(column).alias("fp")).filter("fp is not null").distinct()
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    size = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = checkpointed(dealt.join(size, "key"))
    calm, crowd = dealt.filter(F.col("n") <= CROWD).select("key", "fp"), dealt.filter(F.col("n") > CROWD)
    other = calm.select("key", F.col("fp").alias("other"))
    near = calm.join(other, "key").filter(F.col("fp") > F.col("other")).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    # the masks of bits outside the two blocks of each pair, and no change at all
    masks = [F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64) if b // 16 not in p]) for p in pairs]
    masks_of = F.element_at(F.array(*masks), (F.shiftrightunsigned("key", 32) + 1).cast("int"))
    met = crowd.select("key", "fp", F.explode(masks_of).alias("mask")).select("key", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))
    least = met.groupBy("key", "at").agg(F.min("fp").alias("b"), F.count("*").alias("m")).filter("m > 1").select("key", "at", "b")
    starred = met.join(least, ["key", "at"]).filter("fp != b").select(F.col("fp").alias("a"), "b")
    return near.union(starred)


def components(fingerprints: DataFrame) -> DataFrame:
    """(doc_id, fp) -> (fp, root, component_id): the least fingerprint and the least doc_id reachable by links. fp must not be null; null
    doc_ids are never the least, and component_id is null where a component has no other."""
    groups = fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    shared = fingerprints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b != top").select("doc_id", "b")
    same_id = fingerprints.join(shared, "doc_id").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    roots = connected_components(links(fingerprints).union(same_id), "a", "b").withColumnRenamed("node", "fp")
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, the columns ``also``, root, component_id), a row for each row of docs."""
    short_batches(docs.sparkSession)
    fps = checkpointed(docs.select(F.col(key).alias("doc_id"), simhash(F.col(text)).alias("fp"), *also))
    return fps.join(components(fps), "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
