"""Readers and writers on files, published versions, and the two streams against plain loops."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabulon.sources import records as r
from tabulon.sources import schemas, sinks
from tabulon.streaming import items, windows


def test_missing_tables_are_empty_and_typed(spark, tmp_path):
    rows = spark.createDataFrame([("t2", "a"), ("t1", "b")], "tid string, name string")
    for name in ("cobra_id", "abr_id", "players"):
        rows = rows.withColumn(name, F.lit(None).cast("int"))
    full = spark.createDataFrame([], schemas.CANONICAL["tournament"]).unionByName(rows.select("tid", "name"), allowMissingColumns=True)
    sinks.write_canonical(full, "tournament", str(tmp_path))
    tables = r.canonical_tables(spark, str(tmp_path))
    assert [x.tid for x in tables["tournament"].collect()] == ["t1", "t2"]
    assert tables["game"].count() == 0 and tables["game"].columns == [c.split()[0] for c in schemas.CANONICAL["game"].split(", ")]


def test_json_records(spark, tmp_path):
    root = tmp_path / "store"
    for key, body in {"a/1.json": '{"n": 1}', "a/2.json": "{broken", "b/x/3.json": '{"m": "x", "other": 2}', "c/4.json": "{}", "a/5.txt": "{}"}.items():
        (root / key).parent.mkdir(parents=True, exist_ok=True)
        (root / key).write_text(body)
    kinds = {"a": ("a/", "n long"), "b": ("b/", "m string")}
    rec = r.json_records(spark, str(root))
    assert sorted(x.key for x in rec.collect()) == ["a/1.json", "a/2.json", "b/x/3.json", "c/4.json"]
    out = r.dispatched(rec, kinds)
    assert [tuple(x) for x in out["a"].collect()] == [("a/1.json", "1", 1)] and [tuple(x) for x in out["b"].collect()] == [("b/x/3.json", "3", "x")]
    assert sorted((x.key, x.reason) for x in r.quarantined(rec, kinds).collect()) == [("a/2.json", "not_readable"), ("c/4.json", "unknown_prefix")]
    cache = spark.createDataFrame(rec.filter("key <> 'c/4.json'").collect(), rec.schema).withColumn("body", F.when(F.col("key") == "a/1.json", F.lit("old")).otherwise(F.col("body")))
    cache = cache.withColumn("bytes", F.when(F.col("key") == "b/x/3.json", F.lit(1).cast("long")).otherwise(F.col("bytes"))).unionByName(spark.createDataFrame([("gone.json", "x", datetime(2020, 1, 1), 1)], "key string, body string, changed timestamp, bytes long"))
    now = {x.key: x.body for x in r.refreshed(rec, cache).collect()}
    assert now == {"a/1.json": "old", "a/2.json": "{broken", "b/x/3.json": '{"m": "x", "other": 2}', "c/4.json": "{}"}
    assert sorted(x.key for x in r.stale(rec, cache).collect()) == ["b/x/3.json", "c/4.json"]


def test_precedence(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v string")
    got = {x.k: x.v for x in r.first_wins(rows(("a", "1"), ("a", "2")), rows(("a", "3"), ("b", "4")), key="k").collect()}
    assert got == {"a": "2", "b": "4"}


def test_deck_files(spark, tmp_path):
    path = tmp_path / "decks.csv"
    path.write_bytes('﻿name,identity,card,card_count\nAnn,"The ""One""",Card,3\n"Bo\nB.",X,"two\n\nlines",2\nCy,,Y,\n'.encode())
    got = [tuple(x) for x in r.deck_file(spark, str(path)).collect()]
    assert got == [(2, "Ann", 'The "One"', "Card", "3"), (3, "Bo\nB.", "X", "two\n\nlines", "2"), (7, "Cy", "", "Y", "")]
    path.write_text("name,card\na,b\n")
    with pytest.raises(ValueError, match="missing columns: identity, card_count"):
        r.deck_file(spark, str(path))


def test_pages_and_envelopes(spark):
    pages = spark.createDataFrame([(1, "[1, 2]"), (2, '["x"]'), (3, "[4, 5]")], "page int, body string")
    assert [(x.page, x.item) for x in r.paged(pages, 2).orderBy("page", "place").collect()] == [(1, "1"), (1, "2"), (2, "x")]
    docs = spark.createDataFrame([("a", '{"success": true, "data": [1]}'), ("b", '{"success": false, "data": []}'), ("c", '{"success": false}'), ("d", '{"success": true}'), ("e", '{"data": []}')], "key string, body string")
    assert sorted((x.key, x.status, x.item) for x in r.enveloped(docs).collect()) == [("a", "found", "1"), ("b", "not_found", None), ("c", "not_found", None), ("d", "error", None), ("e", "found", None)]


def test_changed_records_and_imports(spark, tmp_path):
    make = lambda *x: spark.createDataFrame(list(x), "id int, v string, fetched_at string")
    none = spark.createDataFrame([], "id int, record_hash string")
    first = sinks.append_changed(make((1, "a", "t1"), (2, None, "t1")), "id", str(tmp_path / "r"), none)
    stored = spark.createDataFrame(first.collect(), first.schema)
    again = sinks.append_changed(make((1, "a", "t2"), (2, "b", "t2"), (3, "c", "t2")), "id", str(tmp_path / "r"), stored)
    assert sorted(x.id for x in again.collect()) == [2, 3]
    decks = lambda *x: spark.createDataFrame(list(x), "deck string, cobra_id int")
    sinks.replace_imports(decks(("a", 1), ("b", 1), ("c", 2)), str(tmp_path / "i"))
    sinks.replace_imports(decks(("d", 1)), str(tmp_path / "i"))
    assert sorted((x.deck, x.cobra_id) for x in spark.read.parquet(str(tmp_path / "i")).collect()) == [("c", 2), ("d", 1)]
    links = lambda *x: spark.createDataFrame(list(x), "id string, hash string")
    assert sorted(tuple(x) for x in sinks.insert_if_absent(links(("x", "h1"), ("y", "h2"), ("z", "h2")), links(("o", "h1"))).collect()) == [("y", "h2")]


def test_published_versions(spark, tmp_path):
    root, now = str(tmp_path / "snap"), datetime(2026, 1, 1, 0, 0, 0)
    read = lambda p: [json.loads(x.value) for x in spark.read.text(p).collect()]
    a = sinks.publish(spark, {"s": spark.createDataFrame([(1, None)], "n int, v string")}, root, now)
    assert a == "20260101T000000Z" and read(f"{root}/{a}/s") == [{"n": 1, "v": None}] and read(f"{root}/manifest") == [{"version": a, "slices": ["s"]}]
    b = sinks.publish(spark, {"s": spark.range(2)}, root, now)
    assert b == "20260101T000001Z" and read(f"{root}/manifest")[0]["version"] == b
    for bad in ({"errors": ["x"]}, {}):
        with pytest.raises(ValueError):
            sinks.publish(spark, {"s": spark.range(3) if bad else spark.range(1).withColumn("big", F.repeat(F.lit("x"), 3_000_000))}, root, now, **bad)
        assert read(f"{root}/manifest")[0]["version"] == b


def test_item_states(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    at = lambda hours: t0 + timedelta(hours=hours)
    act = lambda key, h, action, kind="abr_entries", priority=None, event=None, changed=None, live=None: (key, at(h), action, kind, priority, event, changed, live)
    one = [act("a", 0, "upsert", priority=10.0), act("a", 1, "complete", changed=False), act("b", 0, "signal"), act("c", 0, "upsert", event=date(2025, 11, 1)), act("c", 1, "complete", changed=False), act("d", 0, "upsert", kind="nrdb_deck"), act("d", 2, "complete", kind="nrdb_deck", changed=True)]
    one += [act("e", h, "fail") for h in range(1, 8)] + [act("e", 0, "upsert")] + [act("f", 0, "upsert", event=date(2024, 1, 1)), act("f", 1, "complete", changed=True), act("g", 0, "known", kind="x")]
    two = [act("a", 2, "upsert", priority=5.0, event=date(2025, 12, 1)), act("a", 3, "signal"), act("c", 50, "complete", changed=False), act("c", 60, "complete", changed=False, live=True), act("d", 5, "signal"), act("e", 100, "fail"), act("g", 9, "reopen")]
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, items.ACTION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = items.item_states(spark.readStream.schema(items.ACTION).parquet(str(tmp_path / "in")))
        # each micro-batch's rows, written as they come
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda df, _, k=k: df.write.mode("append").parquet(str(tmp_path / f"out{k}"))).start()
        q.awaitTermination()
    first, second = ({x.key: x for x in spark.read.parquet(str(tmp_path / f"out{k}")).collect()} for k in (0, 1))
    assert "b" not in first
    assert (first["a"].interval_s, first["a"].next_due, first["a"].priority) == (items.DAY, at(25), 10.0)
    assert (first["c"].interval_s, first["d"].frozen, first["f"].frozen, first["g"].frozen) == (2 * items.DAY, True, True, True)
    assert (first["e"].failures, first["e"].frozen, first["e"].next_due) == (7, False, at(7) + timedelta(hours=6 * 64))
    assert (second["a"].priority, second["a"].next_due, second["a"].event_date) == (10.0 + items.SIGNAL, at(3), date(2025, 12, 1))
    assert (second["c"].interval_s, second["c"].next_due) == (items.LIVE, at(66))
    assert (second["d"].frozen, second["e"].frozen, second["e"].failures, second["g"].frozen, second["g"].next_due) == (False, True, 8, False, at(9))


def test_windowed_counts_of_a_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x.start, x.event_type): x.events for x in spark.table("daily").collect()}
    want = {(x.start, x.event_type): x.events for x in e.groupBy(F.to_timestamp(F.to_date("ts")).alias("start"), "event_type").agg(F.count("*").alias("events")).collect()}
    assert got == want
