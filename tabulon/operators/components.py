"""Connected components of a graph of numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.storage import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges of (a, b), longs: root is the smallest node that can be reached.

    Each round hangs the larger neighbours of a node on its smallest one, then all neighbours of a node that are smaller on the smallest of
    them, until nothing moves. Smallest neighbours are found by an aggregation that is made before the shuffle; a node with very many edges is
    split by the join. Rounds are written to the shared folder; the driver sees two numbers a round.
    """
    ordered = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now, before = checkpointed(edges.select(*ordered("a", "b")).filter("a <> b").distinct()), None
    while (state := now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.filter("b > a").join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        moved = hung.join(least, "a")
        now = checkpointed(moved.select("a", F.col("m").alias("b")).union(moved.filter("b <> m").select(*ordered("b", "m"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
