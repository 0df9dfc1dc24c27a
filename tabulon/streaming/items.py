"""The state of watched items (when each is to be looked at again), kept by key from a stream of what happened to them.

An action is (key, at, action, kind, priority, event_date, changed, live). ``upsert`` creates an item that is due at once, else raises its
priority and fills a missing date; ``known`` notes one that is never fetched; ``signal`` re-opens and pulls forward; ``complete`` sets the
next time by whether the content changed; ``fail`` backs off and freezes the eighth time; ``reopen`` makes it as new.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR, DAY = 3_600, 86_400
# Intervals in seconds by kind.
FIXED = {"abr_list_recent": HOUR, "abr_list_sweep": 7 * DAY, "abr_list_full": 30 * DAY, "cobra_index": HOUR, "cobra_catalog": 7 * DAY, "nrdb_catalog": HOUR}
ONCE = {"cobra_deck", "nrdb_decklist", "nrdb_deck", "nrdb_catalog_bulk"}
LIVE, RETRY, LONGEST, FAILURES, SIGNAL = 6 * HOUR, 6 * HOUR, 30 * DAY, 8, 100_000.0

ACTION = "key string, at timestamp, action string, kind string, priority double, event_date date, changed boolean, live boolean"
STATE = "kind string, next_due timestamp, interval_s long, priority double, frozen boolean, failures int, event_date date"


def ceiling(age: int | None) -> int | None:
    """The longest interval by the event's age in days; None for one so old that it is frozen."""
    return next((seconds for days, seconds in ((14, DAY), (90, 7 * DAY), (365, 30 * DAY)) if age is None or age < days), None)


def after(s: tuple | None, a) -> tuple | None:
    """The state after an action; items that aren't there are touched by upsert and known only."""
    if s is None:
        if a.action not in ("upsert", "known"):
            return None
        date = None if pd.isna(a.event_date) else a.event_date
        return (a.kind, a.at, FIXED.get(a.kind, DAY), 0.0 if pd.isna(a.priority) else a.priority, a.action == "known", 0, date)
    kind, due, interval, priority, frozen, failures, date = s
    if a.action == "upsert":
        if not frozen and not pd.isna(a.priority):
            priority = max(priority, a.priority)
        date = date if date is not None or pd.isna(a.event_date) else a.event_date
    elif a.action == "known":
        frozen = True
    elif a.action == "signal":
        frozen, due, priority = False, min(due, a.at), priority + SIGNAL if priority < SIGNAL else priority
        interval = interval if kind in FIXED or kind in ONCE else DAY
    elif a.action == "reopen":
        frozen, due, interval, failures = False, a.at, FIXED.get(kind, DAY), 0
    elif a.action == "fail":
        failures += 1
        frozen = frozen or failures >= FAILURES
        due = a.at + timedelta(seconds=min(RETRY * 2 ** (failures - 1), LONGEST))
    elif a.action == "complete":
        failures, priority = 0, priority - SIGNAL if priority >= SIGNAL else priority
        most = ceiling(None if date is None else (a.at.date() - date).days)
        if kind in FIXED:
            interval = FIXED[kind]
        elif kind in ONCE or (not a.live and most is None):
            return (kind, due, interval, priority, True, failures, date)
        else:
            interval = LIVE if a.live else DAY if a.changed else min(max(interval, DAY) * 2, max(most, DAY))
        due = a.at + timedelta(seconds=interval)
    return (kind, due, interval, priority, frozen, failures, date)


def item_states(actions: DataFrame) -> DataFrame:
    """A stream of the states that actions leave, a row for each key and micro-batch; actions apply in order of their time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for a in rows.itertuples(index=False):
            s = after(s, a)
        if s is not None:
            state.update(s)
            yield pd.DataFrame([(*key, *s)], columns=["key", *[c.split()[0] for c in STATE.split(", ")]])

    return actions.groupBy("key").applyInPandasWithState(update, f"key string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
