"""Mixing sources to target weights by capped water-filling, and a seeded sample of whole and fractional repetitions.

The words that the mix may hold are shared by weight; a source whose share is above ``max_epochs`` times its size is clamped there and
its excess is shared among the others by weight, again until no share is above its limit. A source then takes every document
floor(target / size) times, and for what is left once more the documents that come first by a seeded hash of their id. The document at
the border gives only its first words, so that a source takes its target to the word.

The border is found without sorting a source: sizes are summed by hash prefix, the prefix that holds the border is picked from a
prefix sum over at most 4096 rows a source, and only its documents (a 4096th of the source) are ranked. Documents of one place share the words
at the border in proportion, each rounded down. ``apart`` gives each row a place of its own, by id and text and, for rows alike in both, which are
interchangeable, by number: so the border is one row, and rows of one id, or of none, are spread over all prefixes. It needs rows that are
stored (checkpointed), as the number is that of the row where it was read. Null and word-less texts have size 0 and take nothing; a null source is
a source of its own, ordered last.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.common import WORD, checkpointed, table

SEED = "mix-1"
PREFIX = 3
#: Sources up to which their table is broadcast.
FEW = 1_000
#: The most sources: the driver fills their targets, a row for each.
MOST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: Fraction, max_epochs: int) -> list[float]:
    """The target of each source. Sources without size get 0."""
    target: list[float] = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * left > max_epochs * sizes[i] * weight]
        if not above:
            for i in open_:
                target[i] = float(weights[i] * left) / weight
            break
        for i in above:
            target[i] = float(max_epochs * sizes[i])
            left -= max_epochs * sizes[i]
        open_ = [i for i in open_ if i not in set(above)]
    return target


def hash_key(key: Column) -> Column:
    """Hexadecimal place of a document in its source's order, the same in each run."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", apart: bool = False) -> DataFrame:
    """docs and a struct ``_row`` of source, size and place."""
    if apart:
        both = F.concat(F.lit(SEED + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
        place = F.concat(F.md5(both.cast("binary")), F.lit("-"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
        return docs.withColumn("_row", F.struct(F.col(source).alias("source"), words(F.col(text)).alias("size"), place.alias("place")))
    return docs.withColumn("_row", F.struct(F.col(source).alias("source"), words(F.col(text)).alias("size"), hash_key(F.col(key)).alias("place")))


def rates(rows: DataFrame, weights, share: Fraction = Fraction(3, 2), max_epochs: int = 2) -> DataFrame:
    """A row for each source of ``rows`` (source, size, place): source, source_size, target, epochs, and where its last repetition ends.

    weights(n): whole-number weights of the n sources in code point order, null last. The driver gets a row for each source: a mix is
    written down source by source, so they are few by nature.
    """
    place = rows.select("source", "place", "size", F.substring("place", 1, PREFIX).alias("prefix"))
    prefixes = checkpointed(place.groupBy("source", "prefix").agg(F.sum("size").alias("size")))
    sums = prefixes.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: mix coarser ones")
    sums.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in sums]
    targets = water_fill(sizes, list(weights(len(sums))), share * sum(sizes), max_epochs)
    spark = rows.sparkSession
    plan = [(r["source"], n, t, int(t // n) if n else 0) for r, n, t in zip(sums, sizes, targets, strict=True)]
    sources = spark.createDataFrame([(s, n, t, e, round(t - e * n)) for s, n, t, e in plan], "source string, source_size long, target double, epochs long, rest long")
    sources = sources.withColumnRenamed("source", "s")
    order = W.partitionBy("source").orderBy("prefix")
    before = prefixes.withColumn("before", F.sum("size").over(order) - F.col("size"))
    at = before.join(sources, F.expr("source <=> s")).filter("before < rest and rest <= before + size").select("s", F.col("prefix").alias("p"), "before", "rest")
    inner = place.join(small(at, len(plan)), F.expr("source <=> s and prefix = p")).groupBy("s", "place").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inner = inner.withColumn("before", F.col("before") + F.sum("size").over(W.partitionBy("s").orderBy("place")) - F.col("size"))
    border = inner.filter("before < rest and rest <= before + size").select(F.col("s").alias("b"), F.col("place").alias("border"), (F.col("rest") - F.col("before")).alias("part"), F.col("size").alias("of"))
    found = {r["b"]: r for r in border.collect()}
    full = [(s, n, t, e, *((found[s]["border"], found[s]["part"], found[s]["of"]) if s in found else (None, None, None))) for s, n, t, e in plan]
    return small(spark.createDataFrame(full, "source string, source_size long, target double, epochs long, border string, part long, of long"), len(plan))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if it has few rows, else joined by Spark's own choice."""
    return F.broadcast(df) if rows <= FEW else df


def take(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """What measured() gave, and a struct ``_mix`` of size, source_size, target and taken."""
    r = rates.select(F.struct(*rates.columns).alias("_rate"))
    joined = rows.join(r, F.expr("_row.source <=> _rate.source"), "left")
    size, place, border = F.col("_row.size"), F.col("_row.place"), F.col("_rate.border")
    once_more = F.when(place < border, size).when(place == border, F.floor(size * F.col("_rate.part") / F.col("_rate.of")))
    taken = F.col("_rate.epochs") * size + F.coalesce(once_more, F.lit(0))
    mixed = F.struct(size.alias("size"), F.col("_rate.source_size").alias("source_size"), F.col("_rate.target").alias("target"), taken.cast("long").alias("taken"))
    return joined.withColumn("_mix", mixed).drop("_row", "_rate")


def three_one_two(n: int) -> list[int]:
    return [(3, 1, 2)[i % 3] for i in range(n)]


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(measured(table(spark, sf_dir, "documents"), apart=True).select("doc_id", "_row"))
    return take(rows, rates(rows.select("_row.*"), three_one_two)).select("doc_id", "_mix.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) || '-' || lpad((row_number() OVER (PARTITION BY doc_id, coalesce(text, '')))::VARCHAR, 20, '0') AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS k FROM w WHERE source_size > 0),
c AS (SELECT *, total - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_weight FROM o),
f AS (SELECT min(k) AS k0 FROM c WHERE weight * rest <= 2 * source_size * open_weight),
t AS (SELECT c.source, c.source_size, CASE WHEN c.k < coalesce(k0, 1e18) THEN 2.0::DOUBLE * c.source_size
             ELSE c.weight * (SELECT rest FROM c c2 WHERE c2.k = k0) / (SELECT open_weight FROM c c2 WHERE c2.k = k0) END AS target FROM c, f),
u AS (SELECT s.source, s.source_size, coalesce(t.target, 0::DOUBLE) AS target FROM s LEFT JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM u),
r AS (SELECT *, round_even(target - epochs * source_size, 0)::BIGINT AS rest FROM e),
p AS (SELECT d.*, r.source_size, r.target, r.epochs, r.rest, sum(d.size) OVER (PARTITION BY d.source, d.place) AS tied,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE UNBOUNDED PRECEDING), 0) AS upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN rest <= 0 OR size = 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - tied < rest
       THEN floor(size * (rest - (upto - tied)) / tied) ELSE 0 END)::BIGINT AS taken FROM p
"""
