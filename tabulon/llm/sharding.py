"""Sharding by proportional stratified interleaving: every shard holds the sources in the proportions of the whole.

Rows are shuffled within their source by a seeded hash of their id and all their other columns, so rows of one id, or of none, are spread
like any others. The row at place r of n in its source gets the fraction
(r + 1/2) / n; all rows are ordered by it, and the order is cut into shards of equal row counts, at most one apart. Both orders are
made without sorting a source, or all rows, in one task: rows are counted by (source, hash prefix) and by slice of the fraction, the
counts are summed up, and only the rows of one prefix or slice are ranked together. A source's rows are even over both.

Rows alike in all columns are interchangeable; they have one hash, and are numbered together. Null texts have no bytes; a
null source is a source of its own. Equal texts are dealt like any other rows: the law is that of row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.common import checkpointed, table

SEED = "shard-1"
PREFIX = 3
SLICES = 4096


def shard(rows: DataFrame, shards: int, key: str = "doc_id", source: str = "source") -> DataFrame:
    """rows with a struct ``_shard`` of shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    own = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.select(F.struct(*own).alias("row"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("source"), F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (key, *[c for c in rows.columns if c != key])]).cast("binary")).alias("place"))
    rows = rows.withColumn("prefix", F.substring("place", 1, PREFIX))
    counts = rows.groupBy("source", "prefix").agg(F.count("*").alias("n"))
    before = counts.select("source", "prefix", (F.sum("n").over(W.partitionBy("source").orderBy("prefix")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy("source")).alias("of"))
    inner = F.row_number().over(W.partitionBy("source", "prefix").orderBy("place", F.xxhash64("row")))
    ranked = rows.withColumn("inner", inner).join(before, ["source", "prefix"])
    ranked = ranked.withColumn("fraction", (F.col("before") + F.col("inner") - 0.5) / F.col("of"))
    ranked = checkpointed(ranked.select("row", "source", "place", "fraction", F.floor(F.col("fraction") * SLICES).alias("slice")))
    counts = ranked.groupBy("slice").agg(F.count("*").alias("n"))
    # at most SLICES rows, so one window holds them
    before = counts.select("slice", (F.sum("n").over(W.orderBy("slice")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("of"))
    inner = F.row_number().over(W.partitionBy("slice").orderBy("fraction", "source", "place", F.xxhash64("row")))
    at = ranked.withColumn("inner", inner).join(before, "slice").withColumn("at", F.col("before") + F.col("inner") - 1)
    number = F.expr(f"(at * {shards}) div of")
    placed = at.withColumn("shard", number).withColumn("slot", F.col("at") - F.expr(f"(shard * of + {shards - 1}) div {shards}"))
    return placed.select("row.*", F.struct(F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")).alias("_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "_shard.shard", "_shard.slot", F.lit(None).cast("int").alias("grown_shard"))


# crc32 by its table of 256 remainders
ORACLE = """
WITH polynomial AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)::BIGINT[]),
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT + 8 AS size, coalesce(text, '') AS text,
             coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') AS own FROM documents),
e AS (SELECT d.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(text), '..'), lambda k: ('0x' || k)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, polynomial),
c AS (SELECT *, md5('shard-1|' || own || '|' || size || '|' || text_crc32) AS place FROM e),
f AS (SELECT doc_id, source, size, text_crc32, place, (row_number() OVER (PARTITION BY source ORDER BY place, size, text_crc32) - 0.5::DOUBLE)
             / count(*) OVER (PARTITION BY source) AS fraction FROM c),
g AS (SELECT *, row_number() OVER (ORDER BY fraction, coalesce('s' || source, ''), place, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 24 // n)::INTEGER AS shard, (pos - ((pos * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM g
"""
