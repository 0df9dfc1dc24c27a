"""Ordered event logs: running numbers, pools anchored at known values, dense series. A log is one user's events by (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ["ts", "event_id"]


def lines(events: DataFrame) -> DataFrame:
    """(game_id, event_id, ts, kind, amount): signup starts a turn with a printed pool, click gains, purchase spends, view draws, error damages."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "turn", "click", "gain", "purchase", "spend", "view", "draw", "error", "damage")])
    return events.select(F.col("user_id").alias("game_id"), "event_id", "ts", kinds[F.col("event_type")].alias("kind"), F.floor("value").alias("amount"))


def numbered(log: DataFrame) -> DataFrame:
    """Adds turn (turn starts so far), delta and pool: the printed value at a turn's start, then a running sum; 5 before the first."""
    up_to = W.partitionBy("game_id").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    log = log.withColumn("turn", F.sum(F.when(F.col("kind") == "turn", 1).otherwise(0)).over(up_to))
    log = log.withColumn("delta", F.when(F.col("kind") == "gain", F.col("amount")).when(F.col("kind") == "spend", -F.col("amount")).otherwise(0))
    part = W.partitionBy("game_id", "turn").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    anchor = F.first(F.when(F.col("kind") == "turn", F.col("amount")), ignorenulls=True).over(part)
    return log.withColumn("pool", F.coalesce(anchor, F.lit(5)) + F.sum("delta").over(part))


def segment_check(log: DataFrame) -> DataFrame:
    """(game_id, turn, derived_end, printed_next, ok) for each turn that another follows."""
    last = log.groupBy("game_id", "turn").agg(F.max_by("pool", F.struct(*ORDER)).alias("derived_end"), F.min_by(F.when(F.col("kind") == "turn", F.col("amount")), F.struct(*ORDER)).alias("printed"))
    last = last.withColumn("printed_next", F.lead("printed").over(W.partitionBy("game_id").orderBy("turn")))
    return last.filter("printed_next is not null").select("game_id", "turn", "derived_end", "printed_next", (F.col("derived_end") == F.col("printed_next")).alias("ok"))


def dense_series(log: DataFrame) -> DataFrame:
    """(game_id, turn, gained, spent, net, total_gained, pool): every turn from 0 to the last, zeros where nothing happened, the last known pool."""
    per = log.groupBy("game_id", "turn").agg(F.sum(F.when(F.col("kind") == "gain", F.col("amount")).otherwise(0)).alias("gained"), F.sum(F.when(F.col("kind") == "spend", F.col("amount")).otherwise(0)).alias("spent"), F.max_by("pool", F.struct(*ORDER)).alias("end"))
    spine = per.groupBy("game_id").agg(F.max("turn").alias("m")).select("game_id", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("turn"))
    d = spine.join(per, ["game_id", "turn"], "left").fillna({"gained": 0, "spent": 0})
    w = W.partitionBy("game_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return d.select("game_id", "turn", "gained", "spent", (F.col("gained") - F.col("spent")).alias("net"), F.sum("gained").over(w).alias("total_gained"), F.coalesce(F.last("end", ignorenulls=True).over(w), F.lit(5)).alias("pool"))
