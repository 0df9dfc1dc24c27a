"""Rules of the assembly by hand, the sequential link pass against a loop, links and random ids."""

import random

import pytest
from fractions import Fraction
from pyspark.sql import functions as F

from tabulon.functions import links, ratios
from tabulon.operators import assembly as a
from tabulon.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_results_by_score(spark):
    cases = [(3, 0, "corp_win"), (None, 0, "corp_win"), (0, 3, "runner_win"), (0, None, "runner_win"), (0, 0, None), (1, 1, "draw"), (1, 0, "draw"), (0, 2, "runner_win"), (2, 0, "corp_win"), (None, None, None), (2, 2, None), (3, 3, "corp_win")]
    df = spark.createDataFrame([(i, c, r) for i, (c, r, _) in enumerate(cases)], "i int, c int, r int")
    got = {x.i: x.w or None for x in df.select("i", a.result(F.col("c"), F.col("r")).alias("w")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def test_games_of_pairings(spark):
    row = lambda table, **over: {"tid": "t", "stage": 1, "round": 1, "table": table, "elimination": False, "double_sided": False, "p1": 1, "p2": 2, "e1": 11, "e2": 12, "p1_side": "corp", "p1_corp_score": 3, "p1_runner_score": 0, "p2_corp_score": 3, "p2_runner_score": 0, "intentional_draw": False, "two_for_one": False, "winner": None} | over
    rows = [row(1), row(2, p1_side="runner"), row(3, p1_side=None), row(4, p2=None), row(5, e2=None), row(6, double_sided=True), row(7, double_sided=True, two_for_one=True), row(8, intentional_draw=True, p1_corp_score=None), row(9, elimination=True), row(10, elimination=True, winner=2), row(11, elimination=True, winner=2, p1_side="runner"), row(12, p1_corp_score=0, p2_runner_score=0), row(13, double_sided=True, p1_corp_score=0, p2_runner_score=0)]
    schema = "tid string, stage int, round int, table int, elimination boolean, double_sided boolean, p1 int, p2 int, e1 int, e2 int, p1_side string, p1_corp_score int, p1_runner_score int, p2_corp_score int, p2_runner_score int, intentional_draw boolean, two_for_one boolean, winner int"
    got = sorted((x.table, x.side, x.corp_entry, x.runner_entry, x.result) for x in a.games(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect())
    assert got == [(1, "corp", 11, 12, "corp_win"), (2, "runner", 12, 11, "corp_win"), (6, "corp", 11, 12, "corp_win"), (6, "runner", 12, 11, "corp_win"), (8, "corp", 11, 12, "intentional_draw"), (10, "corp", 11, 12, "runner_win"), (11, "runner", 12, 11, "corp_win"), (13, "runner", 12, 11, "corp_win")]


def test_links_in_order_of_ids(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(2), i, 100 + rng.randrange(25)) for i in range(30) for _ in range(rng.randrange(4))]
    pairs = [(i % 2, i, o) for _, i, o in set(pairs)]
    taken = {103, 110}
    # events of different sizes have no candidates in common, so a pair's size keeps them apart here too
    apart = [(s, i, o * 10 + s) for s, i, o in pairs]
    want = {}
    used = {o * 10 + s for o in taken for s in (0, 1)}
    for i in sorted({p[1] for p in apart}):
        free = {o for _, j, o in apart if j == i} - used
        if len(free) == 1:
            want[i] = free.pop()
            used.add(want[i])
    got = a.resolved_links(spark.createDataFrame(apart, "size int, id long, other_id long"), spark.createDataFrame([(o * 10 + s,) for o in taken for s in (0, 1)], "other_id long"))
    assert {r.id: r.other_id for r in got.collect()} == want


def test_import_rules(spark):
    cards = [("one", "i1", "corp", "corp_identity"), ("two", "i2", "runner", "runner_identity"), ("card", "c1", "corp", "asset"), ("same", "c2", "corp", "asset"), ("same", "c3", "corp", "asset")]
    rows = [(2, "Ann", 1, "One", "Card", "3"), (3, "Ann", 1, "One", "Card", "1"), (4, "Ann", 1, "Two", "Card", "1"), (5, "Bo", None, "One", "Card", "1"), (6, "Cy", 3, "Card", "Card", "1"), (7, "Di", 4, "One", "Same", "1"), (8, "Di", 4, "Two", "Card", "100"), (9, "Ed", 5, "One", "Card", "1"), (10, "Ed", 5, "ONE", "Card", "1"), (11, "Fi", 6, "Two", "Card", "00")]
    players = [(1, "i1", "i9"), (3, None, None), (4, None, None), (5, None, None), (6, None, None)]
    got = a.import_checks(spark.createDataFrame(rows, "line long, name string, pid int, identity string, card string, qty string"), spark.createDataFrame(players, "pid int, corp_identity string, runner_identity string"), spark.createDataFrame(cards, "key string, card_id string, side_id string, card_type_id string"))
    assert {(r.name, r.identity): (r.reason, r.line) for r in got.collect()} == {
        ("Ann", "One"): (None, 2), ("Ann", "Two"): ("identity_differs_from_cobra", 4), ("Bo", "One"): ("player_not_found", 5), ("Cy", "Card"): ("unknown_identity", 6), ("Di", "One"): ("unknown_card", 7), ("Di", "Two"): ("bad_count", 8),
        ("Ed", "One"): (None, 9), ("Ed", "ONE"): ("two_decks_for_one_side", 10), ("Fi", "Two"): ("bad_count", 11),
    }


def test_share_links(spark):
    texts = ["turn 3 of a game é", "", "plain", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("link", links.packed("t"))
    rows = {r.i: r for r in df.select("i", "link", links.unpacked("link").alias("back"), links.is_log(F.col("link")).alias("log")).collect()}
    assert [rows[i].back for i in range(4)] == texts and [rows[i].log for i in range(4)] == [True, False, False, False]
    assert rows[0].link.startswith("gz.") and "=" not in rows[0].link
    bad = ["gz.!!", "gz.", "raw.dHVybiA", "zip.dHVybiA", "gz.dHVybiA", "raw." + "A" * 40_000, "raw._w"]
    got = [r.t for r in spark.createDataFrame([(b,) for b in bad], "b string").select(links.unpacked("b").alias("t")).collect()]
    assert got == [None, None, "turn ", None, None, None, None]


def test_exact_rounding(spark):
    values = [0.00125, 0.00045, 2.675, -1.005, 0.5, 1e-9]
    got = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(ratios.rounded(F.col("v"), 2).alias("r")).collect()]
    for v, x in zip(values, got, strict=True):
        assert abs(Fraction(v) - Fraction(str(x))) <= Fraction(1, 200) and x == round(v, 2)


def test_random_ids(spark):
    rows = [r.id for r in QUERIES["fs_18_random_ids"](spark, SF).collect()]
    assert all(len(i) == 8 and i.isalnum() and i.isascii() for i in rows) and len(set(rows)) == len(rows)


@pytest.mark.parametrize("days", [0, -1])
def test_links_are_kept_a_day_at_least(spark, days):
    from tabulon.plans.scalar_queries import retained

    with pytest.raises(ValueError):
        retained(None, days)
