"""Copies of cards first in, first out against a queue; credit pools of random and very long games against a plain fold; white space of all kinds."""

import random

from pyspark.sql import functions as F

from tabulon.operators import card_copies as c
from tabulon.operators import game_logs as g

START = "Ann started her turn 1 with 5  and 5 cards in HQ.\nBob started his turn 1 with 5  and 5 cards in their Grip.\n"


def steps(spark, **games):
    rows = [(n, i, line) for n, text in games.items() for i, line in enumerate(text.split("\n"))]
    log = g.read(g.joined(spark.createDataFrame(rows, "game_id string, line_no int, line string")))
    who = g.players(log)
    return log, who, g.with_sides(log, who)


def test_copies_of_a_game(spark):
    """By server first, then own, then anybody's; uses go round; what comes after a copy left belongs to it in the same turn, later to none."""
    lines = """Ann pays 4  to rez Wall protecting HQ.
Ann pays 3  to rez Wall protecting R&D at position 1.
Bob spends  and pays 2  to install Daily Casts.
Bob spends  and pays 2  to install Daily Casts.
Bob uses Daily Casts to gain 2 .
Bob uses Daily Casts to gain 3 .
Bob uses Daily Casts to gain 4 .
Bob pays 1  to trash Wall from R&D.
Bob uses Daily Casts to trash itself.
Bob trashes Daily Casts.
Bob uses Daily Casts to gain 5 .
Bob trashes Daily Casts.
Bob started his turn 2 with 5  and 5 cards in their Grip.
Bob uses Daily Casts to gain 6 .
Bob trashes Wall due to net damage.
Ann started her turn 2 with 5  and 5 cards in HQ.
Bob trashes Wall."""
    log, who, got = steps(spark, a=START + lines)
    copies = c.lifetimes(log, who, got)
    shared = c.shared_out(c.uses(got), copies)
    rows = {(r.card, r.copy): tuple(r)[4:] for r in c.installed_rows(copies, shared).collect()}
    # turn, turn left, turns in play, gained, cost, net
    assert rows == {("Wall", 1): (1, 2, 2, 0, 4, -4), ("Wall", 2): (1, 1, 1, 0, 3, -3), ("Daily Casts", 1): (1, 1, 1, 6, 2, 4), ("Daily Casts", 2): (1, 1, 1, 8, 2, 6)}
    assert [tuple(r)[2:] for r in c.operation_rows(shared).collect()] == [("Daily Casts", 2, None, 0, 6, 6)]


def test_pairs_are_those_of_a_queue(spark):
    rng = random.Random(3)
    events = [(f"k{rng.randrange(6)}", line, rng.random() < 0.5) for line in range(400)]
    queues, want = {}, set()
    for key, line, put in events:
        queue = queues.setdefault(key, [])
        if put:
            queue.append(line)
        elif queue:
            want.add((queue.pop(0), line))
    df = spark.createDataFrame([(k, n, 0, n, put) for k, n, put in events], "k string, line_no int, place int, id int, put boolean")
    assert {tuple(r) for r in c.paired(df.filter("put"), df.filter("not put"), ["k"]).collect()} == want


def test_closings_with_and_without_a_server_in_the_order_of_lines(spark):
    """Against a reading line by line; one that names a server doesn't go before an earlier one that names none."""
    lines = """Ann pays 1  to rez Wall protecting HQ.
Bob trashes Wall.
Ann pays 2  to rez Wall protecting HQ.
Ann pays 3  to rez Wall protecting HQ.
Bob pays 0  to trash Wall from HQ."""
    log, who, got = steps(spark, a=START + lines)
    assert sorted((x.cost, x.closed_line) for x in c.lifetimes(log, who, got).collect()) == [(1, 3), (2, 6), (3, None)]
    rng, rows, here, want = random.Random(5), [], {}, set()
    for line in range(600):
        card, player, server, put = rng.choice("xyz"), rng.choice("ab"), rng.choice(["HQ", "R&D", None]), rng.random() < 0.55
        rows.append((1, player, card, server, line, 0, put))
        held = here.setdefault(card, [])
        if put:
            held.append((player, server, line))
            continue
        fit = [h for h in held if server and h[1] == server] or [h for h in held if h[0] == player] or held
        if fit:
            copy = fit[0]
            held.remove(copy)
            want.add((copy[0], copy[2], line))
    df = spark.createDataFrame(rows, "game_id long, player string, card string, server string, line_no int, place int, put boolean")
    assert {(x.player, x.line_no, x.closed_line) for x in c.left_play(df.filter("put"), df.filter("not put")).collect()} == want


def test_times_of_an_operation(spark):
    """A play is a time of its own, extra costs belong to the last, gains to the first without one; a gain or cost alone is a time."""
    lines = """Ann spends  and pays 5  to play Hedge Fund.
Ann spends  and pays 4  to play Hedge Fund.
Ann pays 1  to use Hedge Fund to do something.
Ann uses Hedge Fund to gain 9 .
Ann uses Hedge Fund to gain 8 .
Ann uses Hedge Fund to gain 7 .
Ann pays 2  to use Hedge Fund to do something.
Ann pays 2 from Stash and 1 from her credit pool to trash Thing."""
    _, _, got = steps(spark, a=START + lines)
    none = spark.createDataFrame([], "game_id string, player string, card string, line_no int, place int, closed_line int, closed_turn int")
    rows = c.operation_rows(c.shared_out(c.uses(got), none)).orderBy("card", "nth").collect()
    assert [tuple(r)[2:] for r in rows] == [("Hedge Fund", 1, 1, 5, 9, 4), ("Hedge Fund", 1, 2, 5, 8, 3), ("Hedge Fund", 1, 3, 2, 7, 5), ("Stash", 1, None, 0, 2, 2)]


def pool_of(items):
    pool, out = None, []
    for _, _, amount, forced, printed in items:
        if printed is not None:
            pool = printed
        elif pool is not None:
            pool += max(amount, min(0, -pool)) if forced else amount
        out.append(pool)
    return out


def pools(spark, rows):
    """rows: (game, line, amount, forced, printed)"""
    df = spark.createDataFrame(rows, "game_id string, line_no int, amount int, forced boolean, printed int").withColumn("player", F.lit("p")).withColumn("seq", F.lit(0).cast("long"))
    log = df.filter("printed is not null").select("game_id", "player", "line_no", "seq", F.lit("start").alias("kind"), F.col("printed").alias("credits"), F.col("line_no").alias("printed_turn"))
    return g.pools(log, df.filter("printed is null").select("game_id", "player", "line_no", "seq", F.lit(0).alias("place"), "amount", "forced"))


def test_random_pools(spark):
    rng = random.Random(4)
    rows = []
    for game in range(40):
        for line in range(60):
            if rng.random() < 0.1:
                rows.append((f"g{game}", line, None, None, rng.randrange(6)))
            else:
                forced = rng.random() < 0.4
                rows.append((f"g{game}", line, -rng.randrange(1, 9) if forced else rng.randrange(-4, 5), forced, None))
    got = {}
    for r in pools(spark, rows).orderBy("game_id", "line_no").collect():
        got.setdefault(r.game_id, []).append(r.pool)
    assert got == {f"g{k}": pool_of([r for r in rows if r[0] == f"g{k}"]) for k in range(40)}


def test_a_game_of_a_million_lines(spark):
    n = 1_000_000
    lines = spark.range(n).select(F.lit("g").alias("game_id"), F.lit("p").alias("player"), F.col("id").cast("int").alias("line_no"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("place"), F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id") % 6).cast("int").alias("amount"), (F.col("id") % 3 == 0).alias("forced"))
    log = lines.limit(1).select("game_id", "player", F.lit(-1).alias("line_no"), "seq", F.lit("start").alias("kind"), F.lit(5).alias("credits"), F.lit(1).alias("printed_turn"))
    got = g.pools(log, lines).agg(F.max_by("pool", "line_no").alias("end"), F.sum(F.col("pool").cast("long")).alias("sum"), F.count("*").alias("n")).first()
    want = pool_of([("g", -1, None, None, 5)] + [("g", i, -7 if i % 3 == 0 else i % 6, i % 3 == 0, None) for i in range(n)])
    assert (got["end"], got["sum"], got["n"]) == (want[-1], sum(want), n + 1)


def test_white_space_and_an_oath(spark):
    text = START.replace("\n", "\r\n") + "\t\r\n  \r\nBob is flatlined.\t\r\nAnn\nAnn\no kurwa mać"
    log, who, _ = steps(spark, a=text)
    assert [(r.kind, r.player) for r in log.filter("kind = 'flatlined'").collect()] == [("flatlined", "Bob")] and who.count() == 2
    assert [(r.player, r.egg, r.gg) for r in g.badges(log.select("game_id", "line_no", "line")).collect()] == [("Ann", True, False)]
