"""Late data: what is to be looked at again and when, kept by key from a stream of observations, with timers of event time.

An observation is (key, at, event_date, status, public, may_be_standard). An event that isn't over (its date lies less than ``OVER`` days
back) is looked at every 6 hours; one that is over without public decks every day, then at doubled intervals up to what its age allows, as
organisers publish decks late, and no longer once it is a year old. One that was skipped as not Standard is reopened once if it may be
Standard by the rule of today. Public decks end the watch.

An observation older than the newest one of its key fills a missing date and changes nothing else; a repeated one changes nothing. Those
further behind the stream's newest than ``late`` are dropped by the watermark. A check that fell due several times since the last batch
is made once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tabulon.streaming.items import DAY, LIVE, ceiling

OBSERVATION = "key string, at timestamp, event_date date, status string, public boolean, may_be_standard boolean"
CHECK = "key string, due timestamp, reason string, checks long"
#: The same inside, with whole seconds since 1970 for times, whatever the session's zone.
_CHECK = CHECK.replace("timestamp", "long")
#: The watch of a key: times in seconds since 1970, ``due`` null where nothing is due.
WATCH = "event_date date, public boolean, reopened boolean, seen long, due long, step long, reason string, checks long"
KINDS = {"string": pa.string(), "date": pa.date32(), "boolean": pa.bool_(), "long": pa.int64()}
WATCHES = pa.schema([(n, KINDS[kind]) for n, kind in (c.split() for c in f"key string, {WATCH}".split(", "))])
#: Into how many buckets keys are dealt, fixed for the life of a stream's state: of 50 million keys some 50,000 a bucket.
BUCKETS = 1024
OVER = 3
#: Days around an event in which its decklists are usually published.
AROUND = (-1, 14)


def _day(seconds: int) -> date:
    return datetime.fromtimestamp(seconds, UTC).date()


def _over(w: dict, seconds: int) -> bool:
    return w["event_date"] is not None and _day(seconds) > w["event_date"] + timedelta(days=OVER)


def observed(w: dict | None, at: int, event_date: date | None, status: str | None, public: bool, standard: bool) -> tuple[dict, str | None]:
    """The watch after an observation, and what is to be done at once."""
    if w is not None and at <= w["seen"]:
        return {**w, "event_date": w["event_date"] or event_date}, None
    w = {**(w or {"reopened": False, "checks": 0}), "event_date": event_date or (w or {}).get("event_date"), "public": public, "seen": at}
    if status == "skipped_not_standard":
        again = standard and not w["reopened"]
        return {**w, "reopened": w["reopened"] or again, "due": None, "step": 0, "reason": None, "checks": w["checks"] + again}, "backfill" if again else None
    if _over(w, at):
        w |= {"due": None if public else at + DAY, "step": DAY, "reason": None if public else "settings"}
    else:
        w |= {"due": at + LIVE, "step": LIVE, "reason": "live"}
    return w, None


def fired(w: dict, now: int) -> dict:
    """The watch after its check fell due; the next one is the first after ``now``, the watermark."""
    due, step, reason = w["due"], w["step"], w["reason"]
    while due is not None and due <= max(now, w["due"]):
        if reason == "live" and _over(w, due):
            reason, step = (None, 0) if w["public"] else ("settings", DAY)
        elif reason == "settings":
            most = ceiling((_day(due) - w["event_date"]).days)
            reason, step = (None, 0) if most is None else (reason, min(step * 2, most))
        due = due + step if reason else None
    return {**w, "due": due, "step": step, "reason": reason, "checks": w["checks"] + 1}


class Rechecks(StatefulProcessor):
    """The watches of a bucket of keys are one value, an Arrow table, with one timer at the earliest of their times: a call to the state store
    a bucket and batch, not several a key. Only watches that are observed or due are looked at one by one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watches = handle.getValueState("watches", "watches binary")

    def _held(self) -> pa.Table:
        held = self.watches.get()
        return pa.ipc.open_stream(held[0]).read_all() if held else WATCHES.empty_table()

    def _keep(self, held: pa.Table, changed: np.ndarray, watches: dict[str, dict], expired: int | None = None) -> None:
        """Keeps what was held, with the watches in place of the rows that they changed; ``expired`` is the timer that Spark takes out itself."""
        rest = held.take(np.setdiff1d(np.arange(held.num_rows), changed))
        held = pa.concat_tables([rest, pa.Table.from_pylist([{"key": k, **w} for k, w in watches.items()], WATCHES)])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, WATCHES) as to:
            to.write_table(held)
        self.watches.update((sink.getvalue().to_pybytes(),))
        due, timers = pc.min(held["due"]).as_py(), set(self.handle.listTimers())
        for old in timers - {expired, due and due * 1000}:
            self.handle.deleteTimer(old)
        if due is not None and due * 1000 not in timers:
            self.handle.registerTimer(due * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # of observations of one time the one with most known comes first
        seen = pd.concat(list(rows)).sort_values(["key", "at", "public", "status", "event_date"], ascending=[True, True, False, True, True], kind="stable")
        held = self._held()
        places = pd.Index(held["key"].to_pandas()).get_indexer(seen["key"].unique())
        places = places[places >= 0]
        watches, out = {w.pop("key"): w for w in held.take(places).to_pylist()}, []
        for a in seen.itertuples(index=False):
            w, now = observed(watches.get(a.key), a.at, None if pd.isna(a.event_date) else a.event_date, None if pd.isna(a.status) else a.status, a.public == True, a.may_be_standard == True)  # noqa: E712
            watches[a.key] = w
            if now:
                out.append((a.key, a.at, now, w["checks"]))
        self._keep(held, places, watches)
        if out:
            yield pd.DataFrame(out, columns=["key", "due", "reason", "checks"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs() // 1000
        places = np.flatnonzero(held["due"].fill_null(now + 1).to_numpy() <= now)
        before = {w.pop("key"): w for w in held.take(places).to_pylist()}
        watches = {k: fired(w, now) for k, w in before.items()}
        self._keep(held, places, watches, expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame([(k, w["due"], w["reason"], watches[k]["checks"]) for k, w in before.items()], columns=["key", "due", "reason", "checks"])


def rechecks(observations: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of the checks that fall due, each once, as (key, due, reason, checks): reason is live, settings or backfill, checks how
    many the key has had. The state of timers needs the RocksDB store, which is set for the session's streams."""
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = observations.filter("key is not null and at is not null").withWatermark("at", late)
    rows = rows.select("key", F.unix_timestamp("at").alias("at"), "event_date", "status", "public", "may_be_standard", F.col("at").alias("event_time"))
    checks = rows.withColumn("bucket", F.expr(f"pmod(xxhash64(key), {BUCKETS})")).groupBy("bucket").transformWithStateInPandas(Rechecks(), _CHECK, "append", "eventTime")
    return checks.withColumn("due", F.timestamp_seconds("due"))


def listing_days(event_dates: DataFrame) -> DataFrame:
    """(day, events): the days whose listings are read for late decklists, each once, and how many events ask for it."""
    days = F.sequence(F.date_add("event_date", AROUND[0]), F.date_add("event_date", AROUND[1]))
    # events of one day are counted before their days are written out
    per_date = event_dates.filter("event_date is not null").groupBy("event_date").agg(F.count("*").alias("n"))
    return per_date.select(F.explode(days).alias("day"), "n").groupBy("day").agg(F.sum("n").alias("events"))
