"""Ranks over groups of any size: no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.storage import checkpointed, small


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, within ``keys`` by ``order``, which must tell all rows of a group apart.

    Rows are dealt by ranges of keys and order, numbered within a range, and moved on by how many rows of the group lie in ranges before:
    a number for each range and group.
    """
    dealt = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = small(checkpointed(counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))))
    inner = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    return dealt.withColumn("_inner", inner).join(counts, [*keys, "_range"]).withColumn(name, (F.col("_before") + F.col("_inner")).cast("int")).drop("_range", "_inner", "_before")
