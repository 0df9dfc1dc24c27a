"""Hand-computed counts, the additivity of the cube, interval values, rules, logs, and the SQL twins on a small table set."""

import math
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulon.functions import ratios, text
from tabulon.operators import logs, rules
from tabulon.operators.counts import CARD_COLUMNS, Counts
from tabulon.plans import ORACLES, QUERIES
from tabulon.sources.adapters import Canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def two_events(spark):
    """Two events: the first with a cut, the second without; one illegal deck; an intentional draw. Fixed values, as are the counts below."""
    make = spark.createDataFrame
    tournament = make([("T1", "2026-08-10", "megacity", "std", 8, 2, 1.0), ("T2", "2026-09-05", "gnk", "std", 8, 0, 1.0)], "tid string, date string, tier string, restriction_id string, players int, cut_size int, decklist_coverage double").withColumn("date", F.to_date("date"))
    entry = make([("T1", n, n <= 2, "corp_id", "runner_id") for n in (1, 2, 3, 4)] + [("T2", n, False, "corp_id", "runner_id") for n in (1, 2)], "tid string, entry_no int, made_cut boolean, corp_identity string, runner_identity string")
    decks = [("T1", 1, "corp", {"c1": 3, "c2": 1}), ("T1", 2, "corp", {"c1": 2}), ("T1", 3, "corp", {"c2": 2}), ("T2", 1, "corp", {"c1": 1}), ("T1", 1, "runner", {"r1": 3}), ("T2", 1, "runner", {"r1": 2}), ("T1", 4, "corp", {"c1": 3})]
    deck = make([(f"d{i}", t, n, s, f"{s}_id", i != 6) for i, (t, n, s, _) in enumerate(decks)], "deck_id string, tid string, entry_no int, side string, identity_card string, legal boolean")
    deck_card = make([(f"d{i}", c, q) for i, (*_, cards) in enumerate(decks) for c, q in cards.items()], "deck_id string, card_id string, qty int")
    results = "T1 1 2 corp_win,T1 2 1 runner_win,T1 3 1 draw,T1 1 3 corp_win,T1 2 4 intentional_draw,T1 4 1 corp_win,T2 1 2 runner_win,T2 2 1 corp_win,T2 1 2 corp_win,T2 2 1 draw"
    game = make([(t, int(a), int(b), r) for t, a, b, r in (x.split() for x in results.split(","))], "tid string, corp_entry int, runner_entry int, result string")
    cards = ["c1", "c2", "r1", "corp_id", "runner_id"]
    card = make([(c, "f") for c in cards], "card_id string, faction_id string")
    ruling = make([], "card_id string, restriction_id string, barred boolean")
    return SimpleNamespace(tournament=tournament, entry=entry, deck=deck, deck_card=deck_card, game=game, card=card, ruling=ruling)


def test_card_counts_by_hand(two_events):
    rows = {(r.side, r.month, r.card_id): r for r in Counts(two_events).card_counts.collect()}
    got = {k: (r.decks_with_card, r.copies_sum, r.games_total, r.games_won, r.entries_with_card_hc, r.cut_with_card_hc) for k, r in rows.items()}
    assert got == {
        ("corp", "2026-08", "c1"): (2, 5, 3, 2.0, 2, 2),
        ("corp", "2026-09", "c1"): (1, 1, 2, 1.0, 0, 0),
        ("corp", "2026-08", "c2"): (2, 3, 3, 2.5, 2, 1),
        ("runner", "2026-08", "r1"): (1, 3, 3, 1.5, 1, 1),
        ("runner", "2026-09", "r1"): (1, 2, 2, 0.5, 0, 0),
    }
    assert [rows["corp", "2026-08", "c1"][k] for k in ("qty1", "qty2", "qty3", "tournaments_hc_with_card")] == [0, 1, 1, 1]


def test_baselines_and_identities_by_hand(two_events):
    c = Counts(two_events)
    side = {(r.side, r.month): (r.side_decks, r.side_games, r.side_wins, r.side_entries_hc, r.side_cut_hc) for r in c.side_counts.collect()}
    assert side["corp", "2026-08"] == (3, 4, 2.5, 3, 2) and side["corp", "2026-09"] == (1, 2, 1.0, 0, 0)
    assert side["runner", "2026-08"][1:3] == (3, 1.5)
    sums = c.identity_counts.filter("identity = 'corp_id'").agg(*[F.sum(k) for k in ("entries", "cut_entries", "cut_made")]).first()
    assert tuple(sums) == (6, 4, 2)


def test_months_add_up(spark):
    t = Canonical(spark, SF)
    by_month = Counts(t, 8, 0.6).card_counts
    months = by_month.groupBy("side", "card_id").agg(*[F.sum(c).alias(c) for c in CARD_COLUMNS])
    merged = SimpleNamespace(tournament=t.tournament.withColumn("date", F.to_date(F.lit("2000-01-01"))).withColumn("tier", F.lit("x")), entry=t.entry, deck=t.deck, deck_card=t.deck_card, game=t.game, card=t.card, ruling=t.ruling)
    whole = Counts(merged, 8, 0.6).card_counts.groupBy("side", "card_id").agg(*[F.sum(c).alias(c) for c in CARD_COLUMNS])
    assert months.exceptAll(whole).count() == 0 and whole.exceptAll(months).count() == 0


def test_intervals(spark):
    low, high = ratios.wilson(F.col("w"), F.col("n"))
    rows = spark.createDataFrame([(3.0, 5), (0.0, 10), (0.0, 0)], "w double, n int").select("n", low.alias("a"), high.alias("b")).collect()
    got = {r.n: (r.a, r.b) for r in rows}
    assert math.isclose(got[5][0], 0.2307, abs_tol=1e-4) and math.isclose(got[5][1], 0.8824, abs_tol=1e-4)
    assert got[10][0] == 0 and math.isclose(got[10][1], 0.2775, abs_tol=1e-4) and got[0] == (None, None)


def test_folding(spark):
    df = spark.createDataFrame([("Myōshu: Éa 2",), (None,), ("",)], "t string")
    rows = df.select(text.fold(F.col("t")), text.title_key(F.col("t")), text.name_key(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("myoshu: ea 2", "myoshu ea 2", "myoshuea2"), (None, None, None), ("", "", "")]


def test_list_in_force(spark):
    lists = spark.createDataFrame([("a", "2020-01-01"), ("b", "2021-01-01"), ("c", "2021-01-01")], "restriction_id string, date_start string").withColumn("date_start", F.to_date("date_start"))
    events = spark.createDataFrame([(1, "2019-12-31"), (2, "2020-01-01"), (3, "2022-05-05")], "tid int, date string").withColumn("date", F.to_date("date"))
    assert {r.tid: r.list_in_force for r in rules.in_force(events, lists).collect()} == {1: None, 2: "a", 3: "c"}


def test_running_pool(spark):
    rows = [(1, 1, "gain", 3), (1, 2, "turn", 7), (1, 3, "spend", 2), (1, 4, "turn", 5), (2, 1, "draw", 1)]
    log = logs.numbered(spark.createDataFrame([(g, e, e, k, a) for g, e, k, a in rows], "game_id int, event_id int, ts int, kind string, amount long"))
    assert {(r.game_id, r.event_id): (r.turn, r.pool) for r in log.collect()} == {(1, 1): (0, 8), (1, 2): (1, 7), (1, 3): (1, 5), (1, 4): (2, 5), (2, 1): (0, 5)}
    assert [(r.turn, r.ok) for r in logs.segment_check(log).orderBy("turn").collect()] == [(0, False), (1, True)]


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else None if v is None else str(v)


@pytest.mark.parametrize("name", ["ql_01_summary", "jn_08_side_baseline_dense", "rl_01_to_09_deck_issues", "jn_14_asof_list_in_force", "wn_16_17_18_19_dense_series"])
def test_query_agrees_with_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(map(str, ([plain(r[c]) for c in names] for r in df.collect())))
    found = db.execute(ORACLES[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == names
    assert got == sorted(map(str, ([plain(r[at.index(c)]) for c in names] for r in found.fetchall())))


def test_ranks_over_ranges(spark):
    """As one window would number them, though a group lies in many ranges."""
    from pyspark.sql import Window as W

    from tabulon.operators.ranking import ranked

    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 101).alias("v"), "id").repartition(6)
    got = ranked(rows, ["k"], [F.desc_nulls_last("v"), F.asc("id")])
    want = rows.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy(F.desc_nulls_last("v"), "id")))
    assert got.select("k", "v", "id", "rank").exceptAll(want).count() == 0 and got.count() == 500
