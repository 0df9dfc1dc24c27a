"""Named queries: a function from (spark, sf_dir) to a DataFrame each and, where SQL can say the same, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.operators.counts import Counts
from tabulon.sources.adapters import COVERAGE, MIN_PLAYERS, Canonical

#: Shuffled bytes of a task, and how many parts a shuffle is cut into before small ones are put together: stored strings repeat, so a compressed
#: MB is some fifteen MB of rows, and a task's sorts and sums should stay in memory. Up to 200 parts are written without a sort. Only where
#: the session doesn't set them.
SHUFFLED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sized(spark: SparkSession) -> SparkSession:
    for key, value in SHUFFLED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def query(name: str, oracle: str | None = None):
    """Registers a function of the canonical tables under a name."""

    def register(f: Callable[[Canonical], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Canonical(sized(spark), sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def cube(tables: Canonical, scope: str = "all") -> Counts:
    """The count cube of the input, its tables stored once."""
    return Counts(tables, MIN_PLAYERS, COVERAGE, COVERAGE / 2, scope, tables.keep)
