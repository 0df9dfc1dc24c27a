"""Steps that large inputs need: only what is asked for is made, and what doesn't change is made once."""

from pyspark.sql import functions as F

from tabulon.operators import assembly, incremental, rules, views
from tabulon.operators.counts import BASELINE_COLUMNS, CARD_COLUMNS, CELL, slices
from tabulon.plans.cube_queries import Yesterday
from tabulon.plans.record_queries import listed_events
from tabulon.sources import addresses
from tabulon.sources.adapters import Canonical

SF = "/root/testdata/sf0.001"


def test_deltas_of_sides_make_no_cards(spark):
    class Cardless(Canonical):
        @property
        def deck_card(self):
            raise AssertionError("sides read no cards of decks")

    now = Cardless(spark, SF)
    tids = incremental.touched_events({"deck": now.deck.filter("cast(deck_id as long) % 100 = 7")}, [])
    assert list(incremental.deltas(now, now, tids, ("side_counts",), min_players=2)) == ["side_counts"]


def test_yesterday_is_placed_as_from_its_own_orders(spark):
    class FromOrders(Canonical):
        def raw(self, name):
            df, changed = super().raw(name), F.col("o_orderkey") % 100 == 7
            if name != "orders":
                return df
            status = F.when(changed, F.when(F.col("o_orderstatus") == "P", "F").otherwise("P")).otherwise(F.col("o_orderstatus"))
            return df.withColumn("o_orderstatus", status).withColumn("o_totalprice", F.when(changed, F.col("o_totalprice") / 2).otherwise(F.col("o_totalprice")))

        def keep(self, name, make):
            return make()

    want, got = FromOrders(spark, SF)._seats, Yesterday(spark, SF)._seats
    assert want.count() and want.exceptAll(got.select(want.columns)).count() == 0 == got.select(want.columns).exceptAll(want).count()
    assert sorted(Yesterday(spark, SF).deck_card.inputFiles()) == sorted(Canonical(spark, SF).deck_card.inputFiles())


def plan(df):
    """The nodes of a plan from its result down to its tables."""
    return [line.strip(" :+-*()0123456789").split(" ")[0] for line in df._jdf.queryExecution().executedPlan().toString().splitlines()]


def card_counts(spark, months=("2020-01",)):
    rows = spark.range(200).select(F.lit("corp").alias("side"), F.lit("r1").alias("restriction_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("tier"), F.explode(F.array(*map(F.lit, months))).alias("month"), F.col("id").cast("string").alias("card_id"))
    return rows.select("*", *[F.lit(2.0 if c == "games_won" else 2).alias(c) for c in CARD_COLUMNS])


def test_rows_of_cards_move_once_before_they_are_in_four_slices(spark):
    nodes = plan(slices(card_counts(spark).localCheckpoint(), CARD_COLUMNS, ["side", "month", "card_id"]))
    assert nodes.count("Exchange") == 1 and "Generate" in nodes[: nodes.index("Exchange")]


def test_only_rows_of_a_range_are_moved(spark):
    counts = card_counts(spark, [f"20{y:02}-0{m}" for y in range(10, 30) for m in range(1, 10)]).localCheckpoint()
    sides = spark.createDataFrame([("corp", "r1", "t0", "2010-01"), ("corp", "r1", "t0", "2029-09")], CELL[:1] + ["restriction_id", "tier", "month"]).select("*", *[F.lit(1.0 if "wins" in c else 1).alias(c) for c in BASELINE_COLUMNS])
    spans = views.periods(sides, 3).localCheckpoint()
    sums = views.period_sums(counts, CARD_COLUMNS, ["card_id"], spans)
    nodes = plan(sums)
    below = nodes[nodes.index("Exchange") :]
    assert "BroadcastHashJoin" in below and not any("Aggregate" in n for n in below)
    # 67 cards of tier t0 in its own two slices; those of all tiers end with the same months
    assert {r.decks_with_card for r in sums.filter("tier = 't0'").collect()} == {6} and sums.filter("tier = 't0'").count() == 67 * 2


def test_months_without_games_are_not_moved(spark):
    t = Canonical(spark, SF)
    counts = card_counts(spark, ("2000-01", "2009-12")).localCheckpoint()
    sides = both = counts.groupBy(*CELL).agg(*[F.lit(1.0 if "wins" in c else 4).alias(c) for c in BASELINE_COLUMNS]).localCheckpoint()
    factions = both.select(*CELL, F.lit("f").alias("faction"), F.lit(1).alias("decks")).localCheckpoint()
    series = views.monthly_series(counts, sides, factions, t.card)
    nodes = plan(series)
    first = nodes.index("Generate")
    assert "Exchange" not in nodes[:first]
    assert series.count() == 200 * 120 and series.filter("decks > 0").count() == 400


def test_a_stored_slice_has_few_files(spark, tmp_path):
    addresses.store(card_counts(spark).repartition(20), str(tmp_path / "cube"))
    assert len(list((tmp_path / "cube").rglob("*.parquet"))) == 3


def test_decks_are_not_copied_for_each_day_of_a_window(spark):
    decks = spark.sql("SELECT * FROM VALUES ('a', DATE'2020-01-10'), ('b', DATE'2020-01-10'), ('c', DATE'2020-03-01'), ('d', DATE'2020-03-01'), ('n', CAST(NULL AS DATE)) t(deck_id, date)")
    files = spark.sql("SELECT explode(sequence(DATE'2020-01-09', DATE'2020-01-24')) AS day, CAST(NULL AS STRING) AS deck_id UNION ALL SELECT * FROM VALUES (DATE'2020-01-24', 'a'), (DATE'2020-01-25', 'b'), (DATE'2020-02-29', 'c'), (DATE'2020-02-29', 'c') t(day, deck_id)")
    found = assembly.in_bulk_files(decks, files)
    assert {r.deck_id: r.found for r in found.collect()} == {"a": True, "b": False, "c": True, "d": None}
    assert "Generate" not in plan(found)


def test_cards_of_decks_are_dealt_by_card_once(spark):
    t = Canonical(spark, SF)
    decks = t.deck.select("deck_id", "side", "identity_card", F.lit("r1996").alias("restriction_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = rules.deck_issues(decks, t.deck_card, t.card, t.ruling, t.restriction)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    both = [line for line in text.splitlines() if "Exchange hashpartitioning(card_id" in line and "restriction_id" in line]
    assert not both and "partial_collect_list(CASE" not in text.split("REPARTITION_BY_COL")[1]


def moved(df):
    """The columns of each shuffle of a plan."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan().initialPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
    return found


def test_cards_of_decks_move_twice_and_without_what_lists_say(spark):
    """However many lists an event's decks are judged by."""
    t = Canonical(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = moved(rules.chosen_list(listed_events(t), t.deck, t.deck_card, t.card, t.ruling, t.restriction))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cards = [columns for columns in shuffles if "qty" in columns]
    assert len(cards) == 2 and not [columns for columns in cards if columns & {"restriction_id", "ruled", "barred", "_rules"}]
