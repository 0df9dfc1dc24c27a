"""Steps of the game logs make what they read of a line once, and look for a pattern's words before they look for the pattern."""

from pyspark.sql import functions as F

from tabulon.operators import game_logs as g


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_of_a_line_are_made_once(spark):
    d = spark.createDataFrame([("Ann uses A to draw 1 card then gain 2 .",)], "line string").withColumn("deeds", g.clauses(F.col("line"), F.lit("Ann")))
    assert plan(d.select(g.gain_of_card(F.col("deeds")).alias("x"))).count("array_position(") == 1
    assert plan(d.select(g.trashed_cards(F.col("line")).alias("x"))).count(" from the root,") == 1
    assert plan(d.select(g.named_before_verb(F.col("line")).alias("x"))).count("split(") == 0
    assert plan(d.select(g.pool_spend(F.col("line")).alias("x"))).count("pays\\s") == 1
    assert d.select(g.gain_of_card(F.col("deeds")).alias("x")).first().x == ("A", 2)


def test_names_before_verbs(spark):
    lines = {
        "Ann uses A.": "Ann", " Bob \t Lee  takes a mulligan.": "Bob Lee", "uses uses A.": "uses", "uses A.": None, "\U0001f600 Né pays, 2": "\U0001f600 Né", "Ann usesX is here": "Ann usesX",
        "Ann is-not uses": "Ann", "Ann 'uses A' has": "Ann 'uses A'", "nobody acts": None, "": None, "x " * 50_000: None, "x " * 50_000 + "wins": ("x " * 50_000).strip(), "a\nb uses c": "a b",
    }
    d = spark.createDataFrame(list(lines.items()), "line string, want string").withColumn("got", g.named_before_verb(F.col("line")))
    assert [r for r in d.collect() if r.got != r.want] == []


def test_words_are_looked_for_as_the_patterns_do(spark):
    """Capitals, quotes, and lines that hold a word but not the pattern."""
    rows = ["Ann USES Hedge Fund to GAIN 4 .", "Ann uses Again to do nothing.", 'Ann resolves A (" gain 9 ") and gains 3 .', "Ann Pays 2 to play X.", "Ann pays 2 to play X.", "Ann SETS CREDIT to 9 (+4).", "Ann uses X to MAKE the Runner LOSE 2 .", "Ann uses X to force the Runner to pay 1."]
    d = spark.createDataFrame([(1, i, r, 1) for i, r in enumerate(rows)], "game_id int, line_no int, line string, seq int")
    d = d.withColumns({"player": F.lit("Ann"), "side": F.lit("corp"), "corp_player": F.lit("Ann"), "runner_player": F.lit("Bob")})
    got = {(r.line_no, r.player, r.place, r.amount, r.forced) for r in g.credit_events(d).collect()}
    assert got == {(0, "Ann", 0, 4, False), (2, "Ann", 0, 3, False), (4, "Ann", 5, -2, False), (5, "Ann", 7, 4, False), (6, "Bob", 4, -2, True), (7, "Bob", 6, -1, False)}
