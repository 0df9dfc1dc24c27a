"""Intermediate tables that are written once and then read by every query of a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A folder of its own is set only in local mode where the session names none."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def stored(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, as Parquet in the shared folder: written when an application first asks for the key, then read.

    The key names the input's path; input that changes under the same path while an application runs is not seen.
    """
    at = (spark.sparkContext.applicationId, *key)
    if at not in _written:
        path = f"{shared_folder(spark)}/tabulon-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _written[at] = path
    return spark.read.parquet(_written[at])


#: Rows up to which a table that is small by nature is broadcast.
FEW = 10_000


def small(df: DataFrame) -> DataFrame:
    """A table that is small by nature: counted, and broadcast if it has few rows, else joined by Spark's own choice."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that a lost executor costs a read, not a recomputation."""
    shared_folder(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()
