"""Loading in phases that can be stopped anywhere, and loading chosen keys again.

Each phase is a stream that is read to its end. Its micro-batches are written as folders ``rows/phase=p/batch=b``; a batch counts once
its entry stands in the ledger, which is created whole or not at all. So a batch that is written twice, or half, is one batch, and a phase
that was stopped goes on where it was. After its last batch a phase is published, then marked as finished. Loading chosen keys again is one
more phase: of a key's rows those of the latest phase that holds it count.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.sources.sinks import exists, put_if_absent
from tabulon.storage import small

#: Phases from here on are reloads.
RELOAD = 1000
#: How many missing keys an error names.
NAMED = 20


class ReloadNotFound(ValueError):
    pass


class Ledger:
    """What is whole under ``root``; ``schema`` is that of the loaded rows."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str):
        self.spark, self.root, self.schema, self.key = spark, root, schema, key

    def has(self, phase: int, batch: int) -> bool:
        return exists(self.spark, f"{self.root}/ledger/{phase}-{batch}")

    def add(self, phase: int, batch: int) -> None:
        put_if_absent(self.spark, f"{self.root}/ledger/{phase}-{batch}", json.dumps({"phase": phase, "batch": batch}))

    def finished(self, phase: int) -> bool:
        return self.has(phase, -1)

    def finish(self, phase: int) -> None:
        self.add(phase, -1)

    def entries(self) -> DataFrame:
        """(phase, batch) of whole batches."""
        if not exists(self.spark, f"{self.root}/ledger"):
            return self.spark.createDataFrame([], "phase int, batch long")
        return self.spark.read.schema("phase int, batch long").json(f"{self.root}/ledger").filter("batch >= 0")

    def write(self, phase: int) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: writes a batch once."""

        def batch(rows: DataFrame, number: int) -> None:
            if not self.has(phase, number):
                rows.write.mode("overwrite").parquet(f"{self.root}/rows/phase={phase}/batch={number}")
                self.add(phase, number)

        return batch

    def loaded(self) -> DataFrame:
        """The rows of whole batches with their phase; of a key those of its latest phase and, there, its latest batch."""
        if not exists(self.spark, f"{self.root}/rows"):
            return self.spark.createDataFrame([], f"{self.schema}, phase int, batch long")
        full = T.StructType.fromDDL(f"{self.schema}, phase int, batch long")
        rows = self.spark.read.schema(full).parquet(f"{self.root}/rows").join(small(self.entries()), ["phase", "batch"], "left_semi")
        place = F.struct("phase", "batch")
        latest = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max(place).alias("_at"))
        same = F.col(self.key).eqNullSafe(F.col("_key")) & (place == F.col("_at"))
        return rows.join(latest, same, "left_semi").select(*full.names)


def backfill(ledger: Ledger, phases: list[int], stream_of: Callable[[int], DataFrame], publish: Callable[[int, DataFrame], None]) -> list[int]:
    """Loads the phases in order, each from where an earlier run stopped, and publishes all that is loaded after each; returns those
    published now. If publishing fails, later phases aren't begun, and a later run publishes that phase first."""
    published = []
    for phase in phases:
        if ledger.finished(phase):
            continue
        stream = stream_of(phase).writeStream.foreachBatch(ledger.write(phase))
        stream.option("checkpointLocation", f"{ledger.root}/progress/{phase}").trigger(availableNow=True).start().awaitTermination()
        publish(phase, ledger.loaded())
        ledger.finish(phase)
        published.append(phase)
    return published


def in_phase(phase, p: int, phases: list[int]):
    """Rows of a phase; those of phase 0, the references, come with the first one."""
    return phase.isin(0, p) if p == phases[0] else phase == p


def reload(ledger: Ledger, source: DataFrame, wanted: DataFrame) -> int:
    """Loads the wanted keys' rows again from the source, in place of all that is loaded of them; returns the phase that holds them.

    All keys are looked up first: if one is missing, nothing is written.
    """
    keys = wanted.select(ledger.key).filter(F.col(ledger.key).isNotNull()).distinct()
    missing = [r[0] for r in keys.join(source, ledger.key, "left_anti").sort(ledger.key).limit(NAMED).collect()]
    if missing:
        raise ReloadNotFound(f"not found: {', '.join(map(str, missing))}")
    last = ledger.entries().agg(F.max("phase")).first()[0]
    phase = max(RELOAD, (last or 0) + 1)
    ledger.write(phase)(source.join(keys, ledger.key, "left_semi"), 0)
    ledger.finish(phase)
    return phase
