"""The cube by deltas equals the cube made anew; a stored one changes in the touched months only; links and components against plain versions."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from tabulon.operators import assembly as a
from tabulon.operators import incremental
from tabulon.operators.components import components
from tabulon.operators.counts import Counts
from tabulon.plans.cube_queries import Yesterday
from tabulon.sources.adapters import Canonical

SF = "/root/testdata/sf0.001"


def test_deltas_equal_a_rebuild(spark, tmp_path):
    before, now = Yesterday(spark, SF), Canonical(spark, SF)
    tids = incremental.touched_events({"deck": before.deck.filter("cast(deck_id as long) % 100 = 7")}, [])
    assert 0 < tids.count() < now.tournament.count()
    how = {"min_players": 2, "coverage": 0.6}
    changes = incremental.deltas(before, now, tids, **how)
    for name, change in changes.items():
        path = str(tmp_path / name)
        incremental.store(getattr(Counts(before, **how), name), path)
        stamp = {p.name: sorted(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in Path(path).glob("month=*")}
        incremental.refresh(path, change, name)
        want, columns = getattr(Counts(now, **how), name), incremental.CUBE[name][0] + incremental.CUBE[name][1]
        got = spark.read.parquet(path).withColumn("month", F.col("month").cast("string")).select(columns)
        assert got.exceptAll(want.select(columns)).count() == 0 and want.select(columns).exceptAll(got).count() == 0
        touched = {f"month={r[0]}" for r in change.select("month").distinct().collect()}
        same = {p.name for p in Path(path).glob("month=*") if sorted(f.stat().st_mtime_ns for f in p.glob("*.parquet")) == stamp[p.name]}
        assert same == set(stamp) - touched and touched


def test_a_change_of_cards_touches_their_decks(spark):
    deck = spark.createDataFrame([("d1", "t1"), ("d2", "t2")], "deck_id string, tid string")
    assert [r.tid for r in incremental.touched_events({"deck_card": spark.createDataFrame([("d2", "c")], "deck_id string, card_id string")}, [deck]).collect()] == ["t2"]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, k) for k in range(1001, 1400)] + [(2000 + k, 2001 + k) for k in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        if x != y:
            lo, hi = sorted((find(x), find(y)))
            root[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_candidates_share_nine_tenths(spark):
    """Multisets of all sizes against every pair of events; events without pairs meet all of their size and days."""
    rng = random.Random(9)
    own = [(i, f"2026-01-{rng.randrange(1, 28):02}", rng.choice([8, 9])) for i in range(120)]
    mine = {i: [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(12, 24))] for i, *_ in own}
    other, theirs = [], {}
    for i, date, size in own:
        o = 1000 + i
        other.append((o, date, None if i % 3 else date, size))
        theirs[o] = [] if i % 15 == 0 else [p if rng.random() < 0.93 else "new" for p in rng.sample(mine[i], rng.randrange(1, len(mine[i])))]
    day = lambda s: int(s[-2:])
    want = set()
    for i, date, size in own:
        for o, start, _, of in other:
            shared = sum(min(mine[i].count(p), theirs[o].count(p)) for p in set(theirs[o]))
            if size == of and abs(day(date) - day(start)) <= 1 and shared >= 0.9 * len(theirs[o]):
                want.add((i, o, shared, len(theirs[o])))
    pairs = lambda d, key: spark.createDataFrame([(k, p) for k, ps in d.items() for p in ps], f"{key} long, pair string")
    got = a.link_candidates(
        spark.createDataFrame(own, "id long, date string, size int").withColumn("date", F.to_date("date")), spark.createDataFrame(other, "other_id long, date string, end_date string, size int").withColumn("date", F.to_date("date")).withColumn("end_date", F.to_date("end_date")), pairs(mine, "id"), pairs(theirs, "other_id")
    )
    assert {(r.id, r.other_id, r.shared, r.known) for r in got.collect()} == want and len(want) > 100


def test_cards_of_decks_are_dealt_by_card_once(spark):
    """What lists bar comes with the card: no second deal by card and list; unknown cards and barred ones go."""
    from types import SimpleNamespace

    from tabulon.operators.counts import Counts

    rows = lambda data, schema: spark.createDataFrame(data, schema)
    tables = SimpleNamespace(
        deck_card=rows([("d1", "a", 1), ("d1", "b", 2), ("d2", "a", 3), ("d2", "x", 1), ("d3", "b", 1)], "deck_id string, card_id string, qty int"),
        card=rows([("a", "f"), ("b", "g")], "card_id string, faction_id string"),
        ruling=rows([("a", "r1", True), ("a", "r3", True), ("b", "r2", False)], "card_id string, restriction_id string, barred boolean"),
    )
    got = Counts(tables).legal_cards(rows([("d1", "r1"), ("d2", "r2"), ("d3", None)], "deck_id string, restriction_id string"))
    assert sorted((x.deck_id, x.card_id, x.qty, x.faction_id) for x in got.collect()) == [("d1", "b", 2, "g"), ("d2", "a", 3, "f"), ("d3", "b", 1, "g")]
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
