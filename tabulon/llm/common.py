"""What several operators share: table readers, durable cuts of the lineage and connected components."""

from __future__ import annotations

import re
import tempfile
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the folder in ``spark.checkpoint.dir``, so that a lost executor costs a read, not a recomputation.

    A folder of its own is set only in local mode where the session names none.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def short_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of whole texts at a time, unless the session has smaller batches already."""
    unit = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        number, letter = re.match(r"(-?\d+)([kmg]?)", spark.conf.get(key).lower()).groups()
        now = int(number) * unit[letter]
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def chunks(texts, chars: int):
    """Consecutive lists of (index, text) pieces of about ``chars`` characters; longer texts are cut into several pieces."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) or 1, chars):
            piece = text[at : at + chars]
            held.append((i, piece))
            size += len(piece) + 1
            if size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def blocks(iterator, n: int):
    while part := list(islice(iterator, n)):
        yield part


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node that links reach.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each node's minimum is pre-aggregated before it is joined
    back, so a node with very many links is split by the skew join. Each round is written to the checkpoint folder; the driver
    sees two numbers a round. Edges with a null end and loops link nothing.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(f"`{a}` is not null and `{b}` is not null").filter("a != b").distinct()
    e, last = checkpointed(e), None
    while True:
        state = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == last or not state[0]:
            break
        last = state
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        e = checkpointed(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
