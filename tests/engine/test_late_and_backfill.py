"""Late data by timers, phased loading that is stopped at every step, and reloading."""

from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabulon.sources import backfill as b
from tabulon.streaming import rechecks as r

T0 = datetime(2026, 3, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def batches(spark, tmp_path, steps):
    """The checks made after each file of observations, one file a micro-batch, then what the last watermark brings."""
    out = []
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, r.OBSERVATION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = r.rechecks(spark.readStream.schema(r.OBSERVATION).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        q.foreachBatch(lambda df, _, k=k: df.write.mode("append").parquet(str(tmp_path / f"out{k}"))).start().awaitTermination()
        out.append(sorted((x.key, x.due, x.reason, x.checks) for x in spark.read.schema(r.CHECK).parquet(str(tmp_path / f"out{k}")).collect()))
    return out


def test_late_repeated_and_timed_out(spark, tmp_path):
    see = lambda key, h, day, status="collected", public=False, standard=True: (key, at(h), day, status, public, standard)
    today = T0.date()
    tick = lambda h: see("clock", h, None, public=True)
    first = [
        see("live", 0, today), see("live", 0, today),  # repeated
        see("over", 0, date(2026, 2, 20)),
        see("open", 0, date(2026, 2, 20), public=True),
        see("old", 0, date(2025, 3, 2)),
        see("rule", 0, date(2026, 2, 1), status="skipped_not_standard"), see("never", 0, date(2026, 2, 1), status="skipped_not_standard", standard=False),
        (None, at(0), today, "collected", False, True), ("no time", None, today, "collected", False, True),
    ]
    out = batches(spark, tmp_path, [first, [tick(24 + 7)], [see("over", 20, date(2026, 2, 20), public=True), see("rule", 32, date(2026, 2, 1), status="skipped_not_standard"), tick(24 + 26)], [tick(24 * 6), see("live", 30, today)], [tick(24 * 8)]])
    live = lambda h, n: ("live", at(h), "live", n)
    assert out[0] == [("rule", at(0), "backfill", 1)]
    # the watermark is a day behind: at 7 h
    assert [x for x in out[1] if x[0] != "clock"] == [live(6, 1)]
    # at 26 h: decks became public before the first check of "over"; a late row of "live" at most repeats; rule is reopened once
    got = {x[:3] for x in out[2]}
    assert ("live", at(12), "live") in got and not any(x[0] in ("over", "rule", "open", "never") for x in got)
    assert ("old", at(24), "settings") in got
    # at 120 h, five days on: the event is over since the fourth day, so its live checks were made once and its settings are watched
    assert [x[0] for x in out[3]].count("live") == 1
    # a year old on the second check: none follows
    assert [x for x in out[3] if x[0] == "old"] == [] and [x for x in out[4] if x[0] == "old"] == []
    assert [x[2] for x in out[4] if x[0] == "live"] == ["settings"]


def test_rules_of_watches():
    s = lambda h: int((at(h) - datetime(1970, 1, 1)).total_seconds())
    w, now = r.observed(None, s(0), date(2026, 2, 20), "collected", False, True)
    assert now is None and (w["due"], w["step"], w["reason"]) == (s(24), r.DAY, "settings")
    # late: fills nothing but a missing date
    assert r.observed(w, s(-5), date(2020, 1, 1), "collected", True, True) == (w, None)
    w2 = r.fired(w, s(24))
    assert w2["checks"] == 1 and w2["due"] == s(48)  # younger than 14 days: at most a day
    w3 = r.fired({**w, "event_date": date(2026, 1, 1)}, s(24))
    assert w3["due"] == s(24 * 3)  # then doubled, up to a week
    w4 = r.fired({**w, "event_date": date(2026, 1, 1)}, s(24 * 40))
    assert w4["checks"] == 1 and w4["due"] > s(24 * 40)  # due many times, made once
    assert r.fired({**w, "event_date": date(2025, 2, 1)}, s(24))["due"] is None
    empty, _ = r.observed(None, s(0), None, None, False, False)
    assert empty["reason"] == "live"
    dated, _ = r.observed(empty, s(-1), date(2026, 1, 1), "collected", True, True)
    assert dated["event_date"] == date(2026, 1, 1) and dated["public"] is False


def test_listing_days(spark):
    e = spark.createDataFrame([(date(2026, 1, 10),), (date(2026, 1, 10),), (date(2026, 1, 12),), (None,)], "event_date date")
    want = Counter()
    for d in (date(2026, 1, 10), date(2026, 1, 10), date(2026, 1, 12)):
        want.update(d + timedelta(days=k) for k in range(-1, 15))
    assert {x.day: x.events for x in r.listing_days(e).collect()} == dict(want)


ITEM = "id int, v string, phase int"


class Stop(Exception):
    pass


def loader(spark, tmp_path, name):
    src = tmp_path / "items"
    if not src.exists():
        for k in range(3):
            spark.range(k * 10, k * 10 + 10).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 4).cast("int").alias("phase")).coalesce(1).write.mode("append").parquet(str(src))
    phases = [1, 2, 3]
    stream = lambda p: spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(str(src)).filter(b.in_phase(F.col("phase"), p, phases)).drop("phase")
    return b.Ledger(spark, str(tmp_path / name), "id int, v string", "id"), phases, stream


def rows(ledger):
    return sorted((x.id, x.v, x.phase) for x in ledger.loaded().collect())


def test_phases_stopped_anywhere(spark, tmp_path):
    plain, phases, stream = loader(spark, tmp_path, "plain")
    seen = []
    assert rows(plain) == [] and b.backfill(plain, phases, stream, lambda p, df: seen.append((p, df.count()))) == phases
    want = [(i, f"v{i}", max(i % 4, 1)) for i in range(30)]
    assert rows(plain) == want and [p for p, _ in seen] == phases and [n for _, n in seen] == sorted(n for _, n in seen) and seen[-1][1] == 30
    assert b.backfill(plain, phases, stream, lambda p, df: seen.append(p)) == []

    # stopped between writing a batch and its entry, then before publishing, then before the phase is marked
    ledger, _, _ = loader(spark, tmp_path, "stopped")
    add, count = ledger.add, [0]

    def failing(phase, batch):
        count[0] += 1
        if count[0] in (2, 6, 9):
            raise Stop
        add(phase, batch)

    ledger.add = failing
    published, tries = [], 0

    def publish(p, df):
        df.count()
        published.append(p)
        if len(published) == 2:
            raise Stop

    while tries < 9:
        tries += 1
        try:
            b.backfill(ledger, phases, stream, publish)
            break
        except Exception as error:  # a stream's failure comes as another class
            assert "Stop" in repr(error) or "Stop" in str(error)
            assert all(x in want for x in rows(ledger))
    assert 3 <= tries < 9 and rows(ledger) == want and published == sorted(published)


def test_reload(spark, tmp_path):
    ledger, phases, stream = loader(spark, tmp_path, "again")
    b.backfill(ledger, phases, stream, lambda p, df: None)
    source = spark.createDataFrame([(3, "new"), (4, "new"), (4, "second row"), (99, "not loaded before")], "id int, v string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "id int")
    before = rows(ledger)
    with pytest.raises(b.ReloadNotFound, match="not found: 5, 6"):
        b.reload(ledger, source, keys(3, 6, 5))
    assert rows(ledger) == before
    assert b.reload(ledger, source, keys(3, 4, 4, None)) == b.RELOAD
    kept = [x for x in before if x[0] not in (3, 4)]
    assert rows(ledger) == sorted(kept + [(3, "new", 1000), (4, "new", 1000), (4, "second row", 1000)])
    assert b.reload(ledger, source.withColumn("v", F.lit("newer")), keys(3)) == b.RELOAD + 1
    assert [x for x in rows(ledger) if x[0] == 3] == [(3, "newer", 1001)]


def test_watches_of_many_keys_are_few_values(spark, tmp_path):
    """Calls to the state store grow with buckets, not with keys; what each key is told is what its own watch says."""
    day = T0.date()
    rows = [(f"k{i}", at(h), day - timedelta(days=i % 9), "collected", i % 3 == 0, False) for i in range(6000) for h in ((0, 5) if i % 4 == 0 else (0,))]
    spark.createDataFrame([*rows, ("clock", at(24 + 30), None, None, True, False)], r.OBSERVATION).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = r.rechecks(spark.readStream.schema(r.OBSERVATION).parquet(str(tmp_path / "in"))).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    q = q.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 6000
    s = lambda t: int((t - datetime(1970, 1, 1)).total_seconds())
    want, watches = [], {}
    for key, t, *what in rows:
        watches[key], _ = r.observed(watches.get(key), s(t), *what)
    for key, w in watches.items():
        if w["due"] is not None and w["due"] <= s(at(30)):
            want.append((key, w["due"], w["reason"], r.fired(w, s(at(30)))["checks"]))
    got = [(x.key, s(x.due), x.reason, x.checks) for x in spark.read.schema(r.CHECK).parquet(str(tmp_path / "out")).collect() if x.key != "clock"]
    assert want and sorted(got) == sorted(want)
