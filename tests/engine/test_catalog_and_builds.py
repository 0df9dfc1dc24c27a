"""The catalog's kinds and look-ups, events of two registries, load estimates and vectors, by hand."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tabulon.operators import builds, load_plan, views
from tabulon.sources import catalog

ITEMS = [
    ("cards", {"id": "b", "title": "Éa", "card_type_id": "corp_identity", "printing_ids": ["1", "2"], "influence_cost": "3", "is_unique": True, "colour": "red"}),
    ("cards", {"id": "a", "title": "", "stripped_title": "Ea!", "card_type_id": "runner_identity", "printing_ids": ["2", "3"], "influence_cost": "x"}),
    ("cards", {"id": "c", "card_type_id": "program"}),
    ("cards", {"title": "no id"}),
    ("printings", {"id": "2", "card_id": "c", "date_release": "2001-02-30"}),
    ("printings", {"id": "3"}),
    ("snapshots", {"id": "s2", "format_id": "standard", "date_start": "2020-01-01", "active": "true"}),
    ("snapshots", {"id": "s1", "format_id": "standard", "date_start": "2020-01-01"}),
    ("snapshots", {"id": "s0", "format_id": "standard"}),
    ("snapshots", {"id": "s3", "format_id": "eternal", "date_start": "2019-01-01"}),
    ("restrictions", {"id": "r", "point_limit": 7, "verdicts": {"banned": ["a"], "points": {"b": 2}}}),
    ("rumours", {"id": "z"}),
]


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in ITEMS] + [("formats", "[1"), ("formats", None), (None, "{}")], "kind string, item string")


def test_typed_rows(feed):
    cards = {r.id: r for r in catalog.rows(feed, "cards").collect()}
    assert set(cards) == {"a", "b", "c"} and cards["a"].title == "Ea!" and cards["c"].title == "c"
    assert (cards["b"].influence_cost, cards["a"].influence_cost, cards["b"].is_unique, cards["a"].is_unique, cards["c"].printing_ids) == (3, None, True, False, [])
    r = catalog.rows(feed, "restrictions").first()
    assert (r.name, r.point_limit, r.verdicts.banned, r.verdicts.points, r.verdicts.restricted) == ("", 7, ["a"], {"b": 2}, None)
    assert catalog.rows(feed, "printings").first().date_release is None


def test_refused_and_unknown(feed):
    assert sorted((r.kind or "", r.reason) for r in catalog.refused(feed).collect()) == [
        ("", "unknown_kind"), ("cards", "incomplete"), ("formats", "not_readable"), ("formats", "not_readable"), ("printings", "incomplete"), ("rumours", "unknown_kind"),
    ]
    assert [tuple(r) for r in catalog.unknown_fields(feed).collect()] == [("cards", "colour")]


def test_look_ups(feed):
    cards = catalog.rows(feed, "cards")
    assert {r.printing_id: r.card_id for r in catalog.printing_cards(catalog.rows(feed, "printings"), cards).collect()} == {"1": "b", "2": "c", "3": "a"}
    assert {r.key: (r.identity, r.card_id) for r in catalog.title_cards(cards).collect()} == {"ea": ("a", None), "c": (None, "c")}
    assert [(r.place, r.id) for r in catalog.ordered_snapshots(catalog.rows(feed, "snapshots")).orderBy("place").collect()] == [(1, "s1"), (2, "s2")]


def test_references(spark):
    items = [("play_formats", {"id": 1, "name": "Standard"}), ("deckbuilding_restrictions", {"id": 9, "name": "n" * 200, "play_format_id": 1}), ("play_formats", {"name": "no id"})]
    got = catalog.references(spark.createDataFrame([(k, json.dumps(v)) for k, v in items], "kind string, item string")).collect()
    assert sorted((r.id, len(r.name), r.extra) for r in got) == [("1", 8, None), ("9", 120, "1|")]


def test_two_registries(spark):
    of = spark.createDataFrame
    day = date(2024, 1, 2)
    event = "cobra_id long, abr_id long, date date, type string, tier string, restriction_id string, card_set string, swiss string, cut string, name string, swiss_format string"
    events = of([(1, 5, day, "store", "store", "r", "s", "public", "open", "", "double_sided"), (2, None, day, "store", "store", None, None, "private", "private", "An Online Cup", None)], event)
    players = of([(1, 10, 1, 1, "i", None, 9), (1, 11, 2, None, None, "j", 6), (1, 12, None, None, None, None, 0)], "cobra_id long, pid long, swiss_rank int, cut_rank int, corp_identity string, runner_identity string, points int")
    stages = of([(1, 1, None), (1, 2, 4)], "cobra_id long, n int, size int")
    linked = of([(5, "Its link", "X", None, True)], "abr_id long, title string, country string, linked_online boolean, online_type boolean")
    matches = of([("c1", 2, 2)], "tid string, entry_no int, abr_swiss_rank int")
    # one deck told twice, one of a player without a rank
    decks = of([("c1", 1, "corp"), ("c1", 1, "corp"), ("c1", 2, "runner"), ("c1", 3, "corp")], "tid string, entry_no int, side string")
    rows, entries = builds.first_registry(events, players, stages, linked, matches, decks, of([("c1",)], "tid string"))
    a, b = rows.orderBy("tid").collect()
    assert (a.name, a.country, a.online, a.players, a.cut_size, a.has_games, a.deck_visibility, a.decklist_coverage) == ("Its link", "X", True, 3, 4, True, "swiss:public,cut:open", 0.5)
    assert (b.name, b.country, b.online, b.players, b.cut_size, b.has_games, b.decklist_coverage) == ("An Online Cup", None, True, 0, 0, False, 0.0)
    assert [(r.entry_no, r.made_cut, r.cobra_pid, r.abr_swiss_rank) for r in entries.orderBy("entry_no").collect()] == [(1, True, 10, None), (2, False, 11, 2)]

    events = of([(7, day, "gnk", "gnk", None, "T", "Y", 3, 0, False, False), (8, day, "gnk", "gnk", None, "U", "Y", 0, 2, None, None)], "abr_id long, date date, type string, tier string, restriction_id string, title string, country string, players_count int, top_count int, linked_online boolean, online_type boolean")
    listed = of([(7, 1, 1, "i", "j"), (8, 1, 0, "i", "j"), (8, 2, 2, None, None)], "abr_id long, swiss_rank int, cut_rank int, corp_identity string, runner_identity string")
    rows, entries = builds.second_registry(events, listed, of([("a7", 1, "corp")], "tid string, entry_no int, side string"))
    assert [(r.tid, r.players, r.cut_size, r.online, r.decklist_coverage, r.deck_visibility) for r in rows.orderBy("tid").collect()] == [("a7", 3, 0, False, 0.166667, "n/a"), ("a8", 0, 2, False, 0.0, "n/a")]
    assert [(r.tid, r.entry_no, r.cut_rank, r.made_cut, r.points) for r in entries.orderBy("tid", "entry_no").collect()] == [("a7", 1, 1, False, None), ("a8", 1, None, False, None), ("a8", 2, 2, True, None)]


def test_estimate(spark):
    items = [("abr_entries", 1, False, 3, None, None, None), ("abr_entries", 1, False, 0, None, None, None), ("cobra_tournament", 2, False, None, 40, "public", "open"), ("cobra_tournament", 2, False, None, 40, "open", "public"), ("cobra_tournament", 2, True, None, 40, "public", "public"), ("cobra_tournament", 3, False, None, None, "private", "public"), ("listing", 3, False, 1, 1, "public", "public")]
    asked = load_plan.requests(spark.createDataFrame(items, "kind string, phase int, frozen boolean, claims int, players int, swiss string, cut string"))
    got = {(r.phase, r.host): (r.requests, r.duration_s, r.slowest) for r in load_plan.estimate(asked, 10, {"abr": 9}).collect()}
    assert len(got) == 12 and got[0, "nrdb"] == (17, 18, "abr") and got[0, "abr"] == (9, 18, "abr")
    assert got[1, "abr"] == (2, 4, "abr") and got[1, "nrdb"][0] == 1
    assert got[2, "cobra"] == (58, 116, "cobra") and got[3, "cobra"] == (1, 2, "cobra") and got[2, "abr"][0] == 0


def test_vectors(spark):
    rows = [("corp", "r1", "A", "2020-11", "x", 1, 0.5), ("corp", "r1", "A", "2021-02", "x", 2, 1.0), ("corp", "r2", "A", "2020-12", "x", 4, 0.0), ("corp", "r2", "A", "2020-12", "y", 0, 0.0), ("runner", "r1", "B", "2020-10", "z", 3, 1.5)]
    cards = spark.createDataFrame(rows, "side string, restriction_id string, tier string, month string, card_id string, decks long, won double")
    v = views.trend_vectors(cards, ["decks", "won"])
    got = {(r.side, r.restriction_id, r.tier, r.card_id): (r.first_month, r.decks, r.won) for r in v.collect()}
    assert got["corp", "r1", "A", "x"] == ("2020-11", [1, 0, 0, 2], [0.5, 0, 0, 1])
    assert got["corp", "all", "all", "x"] == ("2020-11", [1, 4, 0, 2], [0.5, 0, 0, 1]) and got["runner", "r1", "all", "z"] == ("2020-10", [3], [1.5])
    assert not [k for k in got if k[3] == "y"]
    back = views.from_vectors(v, ["decks", "won"]).filter("restriction_id <> 'all' and tier <> 'all'")
    assert sorted(map(tuple, back.select(*cards.columns).collect())) == sorted(r for r in rows if r[5])
