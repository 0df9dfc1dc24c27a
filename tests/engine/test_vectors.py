"""Trends as vectors: slices are made where vectors are filled, from base rows that are dealt and sorted by card once."""

import random
from collections import defaultdict

import pyarrow as pa

from tabulon.operators import views
from tabulon.operators.vectors import vectors

NAMES = ["side", "restriction_id", "tier", "month", "card_id", "decks", "won"]


def some_rows(n):
    """Rows of cells that repeat, with sums of zero, tiers named 'all' and NULL keys; an axis is longer than the other."""
    r = random.Random(5)
    months = {"corp": [f"{y}-{m:02}" for y in (2019, 2020, 2021) for m in (1, 6, 12)], "runner": ["2020-11", "2021-02"]}
    out = []
    for _ in range(n):
        side = r.choice(["corp", "runner"])
        out.append((side, r.choice(["r1", "r2", None]), r.choice(["A", "B", "all"]), r.choice(months[side]), r.choice([None, *map(str, range(12))]), r.choice([-1, 0, 0, 1]), r.choice([0.0, 0.5, -0.5])))
    return out


def plain(rows):
    """The same by definition: a row's sums of each slice and month."""
    n = lambda month: int(month[:4]) * 12 + int(month[5:])
    axis = {s: (min(x[3] for x in rows if x[0] == s), max(x[3] for x in rows if x[0] == s)) for s in {x[0] for x in rows}}
    sums = defaultdict(lambda: defaultdict(lambda: [0, 0.0]))
    for side, restriction, tier, month, card, decks, won in rows:
        for r in (restriction, "all"):
            for t in (tier, "all"):
                cell = sums[side, r, t, card, axis[side][0]][n(month) - n(axis[side][0])]
                cell[0] += decks
                cell[1] += won
    length = {side: n(b) - n(a) + 1 for side, (a, b) in axis.items()}
    return {k: tuple([cells[i][c] if i in cells else 0 for i in range(length[k[0]])] for c in (0, 1)) for k, cells in sums.items() if any(any(x) for x in cells.values())}


def test_vectors_equal_sums_however_rows_are_cut_into_batches(spark):
    rows = some_rows(400)
    cards = spark.createDataFrame(rows, "side string, restriction_id string, tier string, month string, card_id string, decks long, won double")
    want = plain(rows)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for most in (before, "3"):
            spark.conf.set(setting, most)
            got = [tuple(r) for r in views.trend_vectors(cards, ["decks", "won"]).collect()]
            assert len(got) == len(want) and {r[:5]: r[5:] for r in got} == want
    finally:
        spark.conf.set(setting, before)


def test_a_card_of_many_batches_and_one_longer_than_a_part():
    keys = ["side", "restriction_id", "tier", "card_id", "first_month"]
    row = lambda card, at: {"side": "corp", "restriction_id": "r", "tier": "A", "card_id": card, "first_month": "2020-01", "long": 100_000, "at": at, "decks": 1}
    batches = [pa.RecordBatch.from_pylist([row(c, at) for c, at in part]) for part in ([("x", 1)], [("x", 1), ("x", 2)], [("x", 99_999), ("y", 0)], [("z", 5)])]
    got = {(r["card_id"], r["restriction_id"], r["tier"]): r["decks"] for b in vectors(iter(batches), keys, ["restriction_id", "tier"], ["decks"]) for r in b.to_pylist()}
    assert len(got) == 12 and all(len(v) == 100_000 for v in got.values())
    assert {i: x for i, x in enumerate(got["x", "all", "A"]) if x} == {1: 2, 2: 1, 99_999: 1} and sum(got["y", "r", "all"]) == 1


def test_base_rows_are_moved_and_sorted_not_those_of_slices(spark):
    rows = some_rows(50)
    cards = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'decks' else 'double' if n == 'won' else 'string'}" for n in NAMES)).localCheckpoint()
    text = views.trend_vectors(cards, ["decks", "won"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "ObjectHashAggregate" not in text and "flatten" not in text
    # sorted above the join, where Spark doesn't take it away
    assert text.index("MapInArrow") < text.index("Sort [card_id") < text.index("Join")
