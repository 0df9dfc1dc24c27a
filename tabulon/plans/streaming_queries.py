"""Queries whose rows come through streams over a table's files: late data, phased loading, reloading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators import assembly as a
from tabulon.plans.registry import query
from tabulon.sources import backfill as b
from tabulon.sources.adapters import Canonical
from tabulon.storage import shared_folder
from tabulon.streaming import rechecks as r


def stream_of(t: Canonical, name: str) -> DataFrame:
    """A table's files as a stream; a pattern, as a stream's source is a folder or a pattern."""
    return t.spark.readStream.schema(t.raw(name).schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


def ledger(t: Canonical, schema: str, key: str) -> b.Ledger:
    return b.Ledger(t.spark, f"{shared_folder(t.spark)}/loaded-{uuid.uuid4().hex}", schema, key)


TODAY = "2001-08-01"
ITEM = "o_orderkey long, o_orderstatus string"
PHASE_SQL = f"CASE WHEN o_orderkey % 8 < 2 THEN 1 WHEN DATE '{TODAY}' - o_orderdate::DATE <= 90 THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END"


def loaded(t: Canonical) -> b.Ledger:
    """The orders as items, those of two kinds reference data, loaded in their phases."""
    k, phases = F.col("o_orderkey"), [1, 2, 3]
    kind = F.when(k % 8 == 0, "nrdb_catalog").when(k % 8 == 1, "abr_list_recent").otherwise("cobra_tournament")
    of = a.phase(kind, F.to_date("o_orderdate"), F.when(k % 3 == 0, "megacity").otherwise("gnk"), F.to_date(F.lit(TODAY)))
    whole = ledger(t, ITEM, "o_orderkey")
    b.backfill(whole, phases, lambda p: stream_of(t, "orders").filter(b.in_phase(of, p, phases)).select("o_orderkey", "o_orderstatus"), lambda p, rows: None)
    return whole


@query("ss_10_phased_load", f"SELECT o_orderkey, o_orderstatus, {PHASE_SQL}::INTEGER AS phase FROM orders")
def phased_load(t):
    return loaded(t).loaded().drop("batch")


@query("ss_09_reloaded", f"SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 1000 ELSE {PHASE_SQL} END::INTEGER AS phase FROM orders")
def reloaded(t):
    """The dearest orders are loaded again, from a source where their status is another."""
    whole, orders = loaded(t), t.raw("orders")
    b.reload(whole, orders.select("o_orderkey", F.lit("X").alias("o_orderstatus")), orders.filter("o_totalprice > 200000"))
    return whole.loaded().drop("batch")


@query("ss_08_listing_days", "SELECT day::DATE AS day, count(*) AS events FROM (SELECT unnest(generate_series(o_orderdate::DATE - 1, o_orderdate::DATE + 14, INTERVAL 1 DAY)) AS day FROM orders) GROUP BY ALL")
def listing_days(t):
    return r.listing_days(t.raw("orders").select(F.to_date("o_orderdate").alias("event_date"))).withColumn("events", F.col("events").cast("long"))


@query("ss_08_rechecks", """WITH o AS (SELECT o_orderkey::VARCHAR AS key, o_orderkey AS k, o_orderdate::DATE::TIMESTAMP AS t, o_orderkey % 5 = 0 AS skipped, o_orderkey % 7 > 3 AS over, o_orderkey % 3 = 0 AS public, max(o_orderdate::DATE::TIMESTAMP) OVER () - INTERVAL 1 DAY AS mark FROM orders)
SELECT key, t AS due, 'backfill' AS reason, 1::BIGINT AS checks FROM o WHERE skipped AND k % 2 = 0
UNION ALL SELECT key, t + INTERVAL 6 HOUR, 'live', 1 FROM o WHERE NOT skipped AND NOT over AND t + INTERVAL 6 HOUR <= mark
UNION ALL SELECT key, t + INTERVAL 1 DAY, 'settings', 1 FROM o WHERE NOT skipped AND over AND NOT public AND t + INTERVAL 1 DAY <= mark""")
def rechecks(t):
    """An observation an order, at its date, of an event up to six days before; the watermark then fires what is due a day before the newest."""
    k, at = F.col("o_orderkey"), F.to_timestamp(F.to_date("o_orderdate"))
    seen = stream_of(t, "orders").select(
        k.cast("string").alias("key"), at.alias("at"), F.date_sub(F.to_date("o_orderdate"), (k % 7).cast("int")).alias("event_date"),
        F.when(k % 5 == 0, "skipped_not_standard").otherwise("collected").alias("status"), (k % 3 == 0).alias("public"), (k % 2 == 0).alias("may_be_standard"),
    )
    whole = ledger(t, r.CHECK, "key")
    b.backfill(whole, [0], lambda p: r.rechecks(seen), lambda p, rows: None)
    return t.spark.read.schema(f"{r.CHECK}, phase int, batch long").parquet(f"{whole.root}/rows").select([f.name for f in T.StructType.fromDDL(r.CHECK)])
