"""How many requests a load would make, and how long they take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The share of claimed decks that no file of a day holds, the decks read where only the cut's are open, tables of the catalog
#: and the list of what may be read.
SINGLE_SHARE, CUT_DECKS, FIRST_REQUESTS = 0.1, 16, 7
#: Seconds between two requests to a host, in the order in which hosts of equal time are named.
INTERVALS = {"abr": 2, "cobra": 2, "nrdb": 1}
PHASES = 4


def requests(items: DataFrame) -> DataFrame:
    """(host, phase, requests) of each item. items: (kind, phase, frozen, claims, players, swiss, cut: visibility of decks)."""
    results = F.col("kind") == "abr_entries"
    event = (F.col("kind") == "cobra_tournament") & ~F.col("frozen")
    active = F.coalesce("players", F.lit(0))
    decks = F.when(F.col("swiss") == "public", active).when(F.col("cut") == "public", F.least(active, F.lit(CUT_DECKS))).otherwise(0)
    ask = lambda host, n: F.struct(F.lit(host).alias("host"), n.cast("double").alias("requests"))
    each = F.when(results, F.array(ask("abr", F.lit(1)), ask("nrdb", F.col("claims") * 2 * SINGLE_SHARE))).when(event, F.array(ask("cobra", 1 + decks)))
    return items.select("phase", F.explode(each).alias("r")).select("r.host", "phase", "r.requests")


def estimate(asked: DataFrame, days: int, listing: dict[str, int] | None = None) -> DataFrame:
    """(phase, host, requests, seconds, duration_s, slowest): a row for every phase and host. Hosts work side by side, so a phase takes as long
    as its slowest one. ``listing``: requests already made to each host; the first phase also has the catalog and a file for each day."""
    spark = asked.sparkSession
    made = {**dict.fromkeys(INTERVALS, 0), **(listing or {})}
    made["nrdb"] += FIRST_REQUESTS + days
    spine = [(h, p, i, s, float(made[h]) if p == 0 else 0.0) for i, (h, s) in enumerate(INTERVALS.items()) for p in range(PHASES)]
    spine = spark.createDataFrame(spine, "host string, phase int, at int, interval int, requests double")
    # what is asked adds up to a row for each host and phase; tenths are whole numbers, so that their sum is exact
    tenths = asked.select("host", "phase", F.round(F.col("requests") * 10).cast("long").alias("n"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("interval"))
    rows = tenths.unionByName(spine.select("host", "phase", (F.col("requests") * 10).cast("long").alias("n"), "at", "interval")).groupBy("host", "phase").agg(F.sum("n").alias("n"), F.max("at").alias("at"), F.max("interval").alias("interval"))
    rows = rows.filter("at is not null").withColumn("requests", F.ceil(F.col("n") / 10)).withColumn("seconds", F.col("requests") * F.col("interval"))
    top = rows.groupBy("phase").agg(F.max("seconds").alias("duration_s"), F.max_by("host", F.struct("seconds", -F.col("at"))).alias("slowest"))
    return rows.join(top, "phase").select("phase", "host", "requests", "seconds", "duration_s", "slowest")
