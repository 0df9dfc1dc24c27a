"""Two whole games, the forms in which logs are pasted, forced losses, forfeits, and every achievement with one case that just misses it."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import game_logs as g

# Two games and what they come to.
MILL = """Corp started their turn 1 with 5  and 5 cards in HQ.
Corp spends  to use Corp Basic Action Card to draw 1 card.
Corp is ending their turn 1 with 5  and 5 cards in HQ.
Runner keeps their hand.
Runner started their turn 1 with 5  and 5 cards in their Grip.
Runner spends  to use Runner Basic Action Card to gain 1 .
Runner is ending their turn 1 with 6  and 5 cards in their Grip.
Corp started their turn 2 with 5  and 5 cards in HQ.
Corp is decked.
Runner wins the game."""
FAST = """Corp takes a mulligan.
Corp started their turn 1 with 5  and 5 cards in HQ.
Corp makes their mandatory start of turn draw.
Corp spends  and pays 0  to install ice protecting HQ.
Corp is ending their turn 1 with 5  and 5 cards in HQ.
Runner started their turn 1 with 5  and 5 cards in their Grip.
Runner spends  to use Runner Basic Action Card to gain 1 .
Runner steals Hostile Takeover and gains 2 agenda points.
Runner steals Hostile Takeover and gains 2 agenda points.
Runner steals Hostile Takeover and gains 2 agenda points.
Runner is ending their turn 1 with 6  and 5 cards in their Grip.
Corp started their turn 2 with 5  and 5 cards in HQ.
Corp spends  and pays 5  to play Hedge Fund.
Corp uses Hedge Fund to gain 9 .
Corp scores Kimberlite Field and gains 2 agenda points.
Corp scores Kimberlite Field and gains 2 agenda points.
Corp scores Kimberlite Field and gains 1 agenda point.
Corp is ending their turn 2 with 9  and 5 cards in HQ.
Runner started their turn 2 with 6  and 5 cards in their Grip.
Runner forfeits Hostile Takeover.
Runner is ending their turn 2 with 6  and 5 cards in their Grip.
Corp started their turn 3 with 9  and 5 cards in HQ.
Corp uses Bladderwort to gain 1 .
Corp spends  and pays 10  to play Myōshu.
Corp uses Myōshu to add itself to their score area as an Agenda worth 2 points.
Corp wins the game."""


def raw(spark, **games):
    return spark.createDataFrame([(n, i, line) for n, text in games.items() for i, line in enumerate(text.split("\n"))], "game_id string, line_no int, line string")


def steps(spark, **games):
    log = g.read(g.joined(raw(spark, **games)))
    who = g.players(log)
    lines = g.with_sides(log, who)
    return log, who, lines, g.pools(log, g.credit_events(lines)), g.agenda_events(lines)


@pytest.fixture(scope="module")
def two(spark):
    return steps(spark, mill=MILL, fast=FAST)


def test_two_games(two):
    log, who, lines, pool, agendas = two
    result = {(r.game_id, r.player): (r.won, r.win_reason, r.final_score, r.rounds) for r in g.results(log, who, lines, agendas).collect()}
    assert result == {("mill", "Corp"): (False, "decked", 0, 2), ("mill", "Runner"): (True, "decked", 0, 2), ("fast", "Corp"): (True, "agenda", 7, 3), ("fast", "Runner"): (False, "agenda", 4, 3)}
    assert [r.ok for r in g.segments(pool).collect() if r.ok is not None] == [True] * 10
    credits = {r.player: (r.a, r.b) for r in pool.filter("game_id = 'fast'").groupBy("player").agg(F.sum(F.greatest("change", F.lit(0))).alias("a"), F.sum(F.greatest(-F.col("change"), F.lit(0))).alias("b")).collect()}
    assert credits == {"Corp": (10, 15), "Runner": (1, 0)}


def test_series_on_the_axis_of_turns(two):
    log, who, _, pool, agendas = two
    rows = g.series(log, who, pool, agendas).filter("game_id = 'fast'").orderBy("player", "seq").collect()
    by = lambda c: {p: [r[c] for r in rows if r.player == p] for p in ("Corp", "Runner")}
    assert by("pool") == {"Corp": [5, 5, 5, 9, 9, 0], "Runner": [5, 5, 6, 6, 6, 6]}
    assert by("agenda") == {"Corp": [0, 0, 0, 5, 5, 7], "Runner": [0, 0, 6, 6, 4, 4]}
    turns = {r.player: r.l for r in g.agenda_by_turn(agendas, who).filter("game_id = 'fast'").groupBy("player").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "agenda"))), lambda x: x["agenda"]).alias("l")).collect()}
    assert turns == {"Corp": [0, 0, 5, 7], "Runner": [0, 6, 4, 4]}


def contexts(two):
    log, who, lines, pool, agendas = two
    stat = g.stats(lines)
    return g.context(g.results(log, who, lines, agendas), stat, pool, g.trailing(agendas, who), g.tag_totals(stat, who), g.damage(lines), g.opposing_trashes(lines, g.opened(lines)))


def test_achievements_of_two_games(two):
    got = {(r.game_id, r.player): r.earned for r in g.achievements(contexts(two)).collect()}
    assert got == {
        ("mill", "Corp"): [],
        ("mill", "Runner"): ["mill-win", "mill-win-no-points", "no-click-draw"],
        ("fast", "Corp"): ["broke-win", "comeback", "fast-win", "mulligan-win", "no-click-credit", "no-click-draw"],
        ("fast", "Runner"): [],
    }


IDLE = {"won": False, "win_reason": None, "final_score": 0, "flatlined": False, "mulligan": False, "click_credits": 1, "draw_clicks": 1, "trashes": 0, "opponent_trashes": 0, "final_pool": 5, "peak_pool": 10, "trailed": False, "opponent_gained": 1, "tags": 0, "damage_taken": 0, "rounds": 9}
CASES = [
    ("no-click-credit", "corp runner", {"won": True, "click_credits": 0}, {"click_credits": 0}),
    ("no-click-draw", "corp runner", {"won": True, "draw_clicks": 0}, {"won": True, "draw_clicks": 1}),
    ("rich", "corp runner", {"peak_pool": 30}, {"peak_pool": 29}),
    ("broke-win", "corp runner", {"won": True, "final_pool": 0}, {"won": True, "final_pool": None}),
    ("flatline-win", "corp", {"won": True, "win_reason": "flatline"}, {"win_reason": "flatline"}),
    ("flatlined-at-six", "runner", {"flatlined": True, "final_score": 6}, {"flatlined": True, "final_score": 5}),
    ("mill-win", "runner", {"won": True, "win_reason": "decked", "final_score": 1}, {"win_reason": "decked"}),
    ("mill-win-no-points", "runner", {"won": True, "win_reason": "decked"}, {"won": True, "win_reason": "decked", "final_score": 1}),
    ("shutout", "corp runner", {"won": True, "win_reason": "agenda", "opponent_gained": 0}, {"won": True, "win_reason": "agenda"}),
    ("comeback", "corp runner", {"won": True, "trailed": True}, {"trailed": True}),
    ("fast-win", "corp runner", {"won": True, "win_reason": "agenda", "rounds": 6}, {"won": True, "win_reason": "agenda", "rounds": 7}),
    ("tags", "corp runner", {"won": True, "tags": 10}, {"won": True, "tags": 9}),
    ("trasher", "corp runner", {"trashes": 5}, {"trashes": 4}),
    ("attrition-win", "corp", {"won": True, "opponent_trashes": 5}, {"won": True, "damage_taken": 5}),
    ("attrition-win", "runner", {"won": True, "damage_taken": 5}, {"won": True, "opponent_trashes": 5}),
    ("mulligan-win", "corp runner", {"won": True, "mulligan": True}, {"mulligan": True}),
]


def test_every_achievement(spark):
    rows, want = [], {}
    for name, sides, hit, miss in CASES:
        for side in sides.split():
            for case, change in (("hit", hit), ("miss", miss)):
                key = f"{name} {side} {case}"
                rows.append((key, "p", side, *{**IDLE, **change}.values()))
                want[key] = case == "hit"
    kinds = {bool: "boolean", int: "int", str: "string", type(None): "string"}
    df = spark.createDataFrame(rows, "game_id string, player string, side string, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in IDLE.items()))
    got = {r.game_id: r.game_id.split()[0] in r.earned for r in g.achievements(df).collect()}
    assert got == want and len(g.ACHIEVEMENTS) == 26


def test_pasted_forms(spark):
    """Times glued to a name, times on lines of their own, several indented lines, and indented lines without times."""
    games = {"glued": "Ann[22:40:21] draws.\n\nBo [1:02:03] waits.", "timed": "Ann\n[1:02:03]\n draws.\n  again\n  and again\nBo\n [1:02:03] \nBo\nhello", "plain": "Ann\n draws."}
    got = {}
    for r in g.joined(raw(spark, **games)).orderBy("game_id", "line_no").collect():
        got.setdefault(r.game_id, []).append(r.line)
    assert got == {"glued": ["Ann draws.", "Bo [1:02:03] waits."], "timed": ["Ann draws.", "again  and again", "Bo", "Bo", "hello"], "plain": ["Ann", "draws."]}


def test_a_forced_loss_takes_what_is_there(spark):
    start = "Ann started her turn 1 with 2  and 5 cards in HQ.\nBob started his turn 1 with 3  and 5 cards in their Grip.\n"
    lines = "Ann uses X to make the Runner lose 7 .\nBob pays 4  to trash Y.\nAnn uses Z to let the Runner gain 2 .\nBob uses Y to force the Corp to lose 1, and then gain 6.\nBob uses Q (\" gain 9 \") to gain 14 agenda counters."
    pool = steps(spark, a=start + lines)[3].filter("place >= 0").orderBy("line_no", "place").collect()
    # the corp is named 25 characters before its gain; the last line's number backtracks to one digit
    assert [(r.player, r.change, r.pool) for r in pool] == [("Bob", -3, 0), ("Bob", -4, -4), ("Bob", 2, -2), ("Ann", 6, 8), ("Ann", -1, 7), ("Bob", 1, -1)]


def test_forfeits_and_corrections(spark):
    start = "Ann started her turn 1 with 2  and 5 cards in HQ.\n"
    lines = "Ann scores Big Plan and gains 3 agenda points.\nAnn forfeits Big Plan and Send a Message to use X.\nAnn forfeits Big Plan.\nAnn sets her agenda points to 1 (-2).\nAnn uses X to reveal Regenesis from Archives and add it to her score area."
    agendas = steps(spark, a=start + lines)[4].orderBy("line_no", "place", "title").collect()
    assert [(r.title, r.points) for r in agendas] == [("big plan", 3), ("big plan", -3), ("send a message", -3), ("big plan", None), (None, -2), ("regenesis", 1)]


def test_courtesies(spark):
    lines = "Ann\nAnn\nglhf\nBo\nBo\ngg, thank you\n!Bo uses a command: /save-replay\nTwo words\nTwo words\ngg"
    got = {r.player: (r.glhf, r.gg, r.ty, r.saved_replay) for r in g.badges(g.joined(raw(spark, a=lines))).collect()}
    assert got == {"Ann": (True, False, False, False), "Bo": (False, True, True, True)}


def test_three_players_and_no_lines_are_no_game(spark):
    turn = "{} started their turn 1 with 5  and 5 cards in HQ."
    assert steps(spark, a="\n".join(turn.format(p) for p in ("A", "B", "C")), b="")[1].count() == 0


def test_opened_and_trashed_cards(spark):
    """A name that both brought into play, one that the opponent alone did, before or after, one from a server, damage and placeholders."""
    start = "Ann started her turn 1 with 2  and 5 cards in HQ.\nBob started his turn 1 with 3  and 5 cards in their Grip.\n"
    lines = """Bob trashes Late Card.
Ann spends  and pays 1  to install Both (paying 2 less).
Bob spends  to install Both.
Ann spends  to install a card in the root of Server 3.
Ann pays 4  to rez Wall protecting R&D at position 2.
Ann spends  to install Late Card.
Bob trashes Both and Wall.
Bob pays 4  to trash La Costa Grid from Server 1.
Ann trashes Hers due to net damage.
Bob trashes a card from HQ."""
    log, who, got, *_ = steps(spark, a=start + lines)
    cards = g.opened(got)
    assert [(r.player, r.kind, r.card, r.server, r.cost) for r in cards.orderBy("line_no").collect()] == [("Ann", "install", "Both", None, 1), ("Bob", "install", "Both", None, 0), ("Ann", "rez", "Wall", "R&D", 4), ("Ann", "install", "Late Card", None, 0)]
    assert [(r.player, r.trashes) for r in g.opposing_trashes(got, cards).collect()] == [("Bob", 2)]


def test_trashes_meet_one_row_a_card(spark):
    """However often a card came into play; whose it is depends on who brought it before the line."""
    cards = spark.createDataFrame([(1, p, n, "Wall") for p, at in (("Ann", range(0, 90, 2)), ("Bob", range(61, 90, 3))) for n in at], "game_id int, player string, line_no int, card string")
    one = g.owners(cards).collect()
    assert len(one) == 1 and {tuple(x) for x in one[0].owners} == {("Ann", 0), ("Bob", 61)}
    said = [("Bob", 0), ("Bob", 60), ("Bob", 61), ("Bob", 80), ("Ann", 50), ("Ann", 70)]
    lines = spark.createDataFrame([(1, p, n, f"{p} trashes Wall.", "runner") for p, n in said], "game_id int, player string, line_no int, line string, side string")
    assert [tuple(x) for x in g.opposing_trashes(lines, cards).collect()] == [(1, "Bob", 2)]


def test_a_query_stores_the_steps_it_reads(spark):
    from tabulon.plans import log_queries as q

    class Tables:
        kept = []

        def keep(self, name, make):
            self.kept.append(name)
            return spark.createDataFrame([(1, 0, "gg")], "game_id int, line_no int, line string")

    q.g.badges(q.Log(Tables()).joined)
    assert Tables.kept == ["log_joined"]


def test_few_bytes_of_parts_are_read_by_all_cores(spark):
    from tabulon.plans.log_queries import card_amounts
    from tabulon.sources.adapters import Canonical

    got = card_amounts(Canonical(spark, "/root/testdata/sf0.001"))
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
