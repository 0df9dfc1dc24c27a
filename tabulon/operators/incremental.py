"""Keeping the count cube up to date: what changed is taken out as it was and put in as it is.

All counts are sums over events, so a change of any record is a change of its event. The counts of the touched events alone are made twice, from
the tables before with a minus and from the tables now with a plus, and merged into the stored ones by cell; cells that come to nothing go.
A stored cube is partitioned by month, so an update reads and writes the touched months only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.counts import BASELINE_COLUMNS, CARD_COLUMNS, CELL, IDENTITY_COLUMNS, Counts
from tabulon.storage import checkpointed

#: Of each count: the columns that tell a row, and those that add up.
CUBE = {"card_counts": ([*CELL, "card_id"], CARD_COLUMNS), "side_counts": (CELL, BASELINE_COLUMNS), "identity_counts": ([*CELL, "identity"], IDENTITY_COLUMNS), "faction_counts": ([*CELL, "faction"], ["decks"])}


@dataclass
class Touched:
    """The tables of some events only; cards and rulings are whole. A changed card or ruling touches every event that has it."""

    tables: object
    tids: DataFrame

    def _of(self, name: str) -> DataFrame:
        return getattr(self.tables, name).join(self.tids, "tid", "left_semi")

    @cached_property
    def deck(self) -> DataFrame:
        return self._of("deck")

    @cached_property
    def deck_card(self) -> DataFrame:
        return self.tables.deck_card.join(self.deck.select("deck_id"), "deck_id", "left_semi")

    def __getattr__(self, name: str) -> DataFrame:
        return self._of(name) if name in ("tournament", "entry", "game") else getattr(self.tables, name)


def touched_events(changed: dict[str, DataFrame], decks: list[DataFrame]) -> DataFrame:
    """(tid): events of changed records, a table of rows each, before or now; rows of ``deck_card`` count through their decks."""
    with_tid = [df.select("tid") for name, df in changed.items() if name != "deck_card"]
    if "deck_card" in changed:
        with_tid += [d.join(changed["deck_card"].select("deck_id"), "deck_id", "left_semi").select("tid") for d in decks]
    return checkpointed(reduce(DataFrame.union, with_tid).distinct())


def deltas(before: object, now: object, tids: DataFrame, names: tuple[str, ...] = tuple(CUBE), **how) -> dict[str, DataFrame]:
    """For each of the named tables of the cube the rows by which it changes: counts of the touched events, negative before and positive now.
    Only tables that these counts read are made."""
    old, new = Counts(Touched(before, tids), **how), Counts(Touched(now, tids), **how)
    out = {}
    for name in names:
        keys, columns = CUBE[name]
        minus = getattr(old, name).select(*keys, *[(-F.col(c)).alias(c) for c in columns])
        out[name] = merged(minus, getattr(new, name).select(*keys, *columns), name)
    return out


def merged(counts: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """The sum of two tables of counts of the same name, without rows that come to nothing."""
    keys, columns = CUBE[name]
    total = counts.select(*keys, *columns).unionByName(more.select(*keys, *columns)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
    return total.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns]))


def store(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").partitionBy("month").parquet(path)


def refresh(path: str, change: DataFrame, name: str) -> DataFrame:
    """Merges a change into a stored table: reads the partitions of its months, and replaces these. Returns what it wrote. Months of which
    nothing is left keep an empty partition. A run that is repeated after it has written would count twice: changes are applied once."""
    spark = change.sparkSession
    change = checkpointed(change)
    months = [r[0] for r in change.select("month").distinct().collect()]
    stored = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    rows = checkpointed(merged(stored.filter(F.col("month").isin(months)), change, name))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    gone = set(months) - {r[0] for r in rows.select("month").distinct().collect()}
    for m in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={m}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return rows
