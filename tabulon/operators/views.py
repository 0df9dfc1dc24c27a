"""Views of the count cube: period sums first, ratios last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.dates import add_months, first_day, months_between
from tabulon.functions.ratios import points, ratio, status, wilson
from tabulon.operators.counts import BASELINE_COLUMNS, CARD_COLUMNS, CELL, IDENTITY_COLUMNS, dealt, four_slices, slices
from tabulon.operators.ranking import ranked
from tabulon.operators.vectors import vectors
from tabulon.storage import checkpointed, small

SLICE = ["side", "restriction_id", "tier"]


def periods(side_counts: DataFrame, months: int) -> DataFrame:
    """For each slice the current and the previous range of months, ending with its latest month with decks; the slices' sizes are small."""
    last = slices(side_counts, ["side_decks"], ["side", "month"]).filter("side_decks > 0").groupBy(*SLICE).agg(F.max("month").alias("to"), F.min("month").alias("earliest"))
    p = last.withColumn("from", add_months(F.col("to"), 1 - months)).withColumn("prev_to", add_months(F.col("to"), -months)).withColumn("prev_from", add_months(F.col("to"), 1 - 2 * months))
    return p.withColumn("has_prev", F.col("earliest") <= F.col("prev_to"))


def period_sums(counts: DataFrame, columns: list[str], by: list[str], spans: DataFrame) -> DataFrame:
    """The sums of either range. Months may be missing, so ranges are compared, not rows. Cards or identities without a row in either have
    none; of the rows only those of a range are moved."""
    wide = four_slices(counts.select(*CELL, *by, *columns)).join(small(spans), SLICE)
    if by:
        within = F.col("month").between(F.col("prev_from"), F.col("prev_to")) | F.col("month").between(F.col("from"), F.col("to"))
        wide = dealt(wide.filter(within), *by)
    now, before = F.col("month").between(F.col("from"), F.col("to")), F.col("month").between(F.col("prev_from"), F.col("prev_to"))
    sums = [F.sum(F.when(x, F.col(c)).otherwise(0)).alias(p + c) for x, p in ((now, ""), (before, "prev_")) for c in columns]
    return wide.groupBy(*SLICE, *by).agg(*sums)


#: A previous popularity below this is 0 as published, with four decimals.
LEAST_SHOWN = 0.00005


def given_range(sides: DataFrame, first: str, last: str) -> DataFrame:
    """periods() of one range of months for all slices, with the range of as many months before it."""
    s = slices(sides, ["side_decks"], ["side", "month"]).filter("side_decks > 0").groupBy(*SLICE).agg(F.min("month").alias("earliest"))
    months = F.months_between(first_day(F.lit(last)), first_day(F.lit(first))).cast("int") + 1
    s = s.select(*SLICE, F.lit(last).alias("to"), "earliest", F.lit(first).alias("from"), add_months(F.lit(first), -1).alias("prev_to"), add_months(F.lit(first), -months).alias("prev_from"))
    return s.withColumn("has_prev", F.col("earliest") <= F.col("prev_to"))


def summary(cards: DataFrame, sides: DataFrame, months: int, min_games: int, min_entries: int, spans: DataFrame | None = None) -> DataFrame:
    """The flagship view: for each slice and card popularity, copies, win rate with its interval, conversion, change and rank. The period is
    the last ``months`` of each slice, or that of ``spans``."""
    spans = periods(sides, months) if spans is None else spans
    base = period_sums(sides, BASELINE_COLUMNS, [], spans)
    c = period_sums(cards, CARD_COLUMNS, ["card_id"], spans).join(base, SLICE).join(spans.select(*SLICE, "has_prev"), SLICE)
    popularity, before = ratio(F.col("decks_with_card"), F.col("side_decks")), F.when(F.col("has_prev"), F.coalesce(ratio(F.col("prev_decks_with_card"), F.col("prev_side_decks")), F.lit(0.0)))
    winrate, baseline = ratio(F.col("games_won"), F.col("games_total")), ratio(F.col("side_wins"), F.col("side_games"))
    low, high = wilson(F.col("games_won"), F.col("games_total"))
    conversion, cut_rate = ratio(F.col("cut_with_card_hc"), F.col("entries_with_card_hc")), ratio(F.col("side_cut_hc"), F.col("side_entries_hc"))
    c = c.filter((F.col("decks_with_card") > 0) | (before >= LEAST_SHOWN))
    out = c.select(
        *SLICE,
        "card_id",
        F.col("decks_with_card").alias("decks"),
        popularity.alias("popularity"),
        before.alias("prev_popularity"),
        points(popularity, before).alias("change_pp"),
        ratio(F.col("copies_sum"), F.col("decks_with_card")).alias("avg_copies"),
        copies_mode(F.col("qty1"), F.col("qty2"), F.col("qty3")).alias("copies_mode"),
        F.col("games_total").alias("games"),
        winrate.alias("winrate"),
        points(winrate, baseline).alias("winrate_diff_pp"),
        low.alias("winrate_low"),
        high.alias("winrate_high"),
        status(F.col("games_total"), min_games).alias("winrate_status"),
        conversion.alias("conversion"),
        ratio(conversion, cut_rate).alias("conversion_ratio"),
        status(F.col("entries_with_card_hc"), min_entries).alias("conversion_status"),
    )
    # dealing by ranges reads its input twice
    return ranked(checkpointed(out), SLICE, [F.desc("decks"), F.asc("card_id")]).withColumn("rank", F.when(F.col("decks") > 0, F.col("rank")))


def copies_mode(one: Column, two: Column, three: Column) -> Column:
    """The most frequent number of copies, the lowest of equally frequent ones; NULL without decks. Three stands for three or more."""
    top = F.greatest(one, two, three)
    return F.when(top > 0, F.when(one == top, 1).when(two == top, 2).otherwise(3))


def identities(counts: DataFrame, sides: DataFrame, months: int, min_games: int, min_entries: int) -> DataFrame:
    spans = periods(sides, months)
    c = period_sums(counts, IDENTITY_COLUMNS, ["identity"], spans).filter("entries > 0")
    side = c.groupBy(*SLICE).agg(F.sum("entries").alias("all_entries"))
    c = c.join(side, SLICE)
    low, high = wilson(F.col("games_won"), F.col("games_total"))
    rows = c.select(
        *SLICE,
        "identity",
        "entries",
        ratio(F.col("entries"), F.col("all_entries")).alias("share"),
        ratio(F.col("games_won"), F.col("games_total")).alias("winrate"),
        low.alias("winrate_low"),
        high.alias("winrate_high"),
        status(F.col("games_total"), min_games).alias("winrate_status"),
        ratio(F.col("cut_made"), F.col("cut_entries")).alias("conversion"),
        status(F.col("cut_entries"), min_entries).alias("conversion_status"),
    )
    return ranked(rows, SLICE, [F.desc("entries"), F.asc("identity")])


def faction_split(cards: DataFrame, factions: DataFrame, sides: DataFrame, card: DataFrame, min_splash: int, keys: tuple[str, ...] = ("side",)) -> DataFrame:
    """Popularity inside and outside the card's own faction, and the share of its decks outside, of counts summed by ``keys``. Neutral cards
    and identities have neither, agendas none outside."""
    keys = list(keys)
    c = dealt(cards.select(*keys, "card_id", "decks_with_card", "decks_in_faction"), "card_id").groupBy(*keys, "card_id").agg(F.sum("decks_with_card").alias("decks"), F.sum("decks_in_faction").alias("inside"))
    f = factions.groupBy(*keys, F.col("faction").alias("faction_id")).agg(F.sum("decks").alias("faction_decks"))
    s = sides.groupBy(*keys).agg(F.sum("side_decks").alias("side_decks"))
    has_in = F.col("faction_id").isNotNull() & ~F.col("faction_id").startswith("neutral") & ~F.col("card_type_id").endswith("identity")
    c = c.join(card.select("card_id", "faction_id", "card_type_id"), "card_id").join(f, [*keys, "faction_id"], "left").join(s, keys).fillna({"faction_decks": 0})
    has_out = has_in & (F.col("card_type_id") != "agenda")
    return c.select(
        *keys,
        "card_id",
        "decks",
        "side_decks",
        "faction_decks",
        F.when(has_in, F.col("inside")).alias("decks_in_faction"),
        F.when(has_in, F.coalesce(ratio(F.col("inside"), F.col("faction_decks")), F.lit(0.0))).alias("popularity_in"),
        F.when(has_out, F.coalesce(ratio(F.col("decks") - F.col("inside"), F.col("side_decks") - F.col("faction_decks")), F.lit(0.0))).alias("popularity_out"),
        F.when(has_out, ratio(F.col("decks") - F.col("inside"), F.col("decks"))).alias("splash_share"),
        F.when(has_out, status(F.col("decks"), min_splash)).alias("splash_status"),
    )


def played_rows(split: DataFrame, keys: tuple[str, ...] = ("side",), hide_small: bool = True) -> DataFrame:
    """(keys, mode, card_id, value, of, out_of, rank): faction_split() by the four views of the most-played table: of all decks, of those of
    the card's faction, of the other factions', and the splash share; with the decks counted and the decks they are out of."""
    decks, inside, total, own = F.col("decks"), F.coalesce("decks_in_faction", F.lit(0)), F.col("side_decks"), F.col("faction_decks")
    splash = F.col("splash_share").isNotNull() & (decks > 0) & (F.lit(not hide_small) | (F.col("splash_status") == "ok"))
    mode = lambda name, keep, value, of, out_of: F.when(keep, F.struct(F.lit(name).alias("mode"), value.alias("value"), of.alias("of"), out_of.alias("out_of")))
    modes = F.array_compact(
        F.array(
            mode("all", decks > 0, ratio(decks, total), decks, total),
            mode("in", F.col("popularity_in").isNotNull() & (inside > 0), F.col("popularity_in"), inside, own),
            mode("out", F.col("popularity_out").isNotNull() & (decks - inside > 0), F.col("popularity_out"), decks - inside, total - own),
            mode("splash", splash, F.col("splash_share"), decks - inside, decks),
        )
    )
    r = split.select(*keys, "card_id", "decks", F.explode(modes).alias("m")).select(*keys, "card_id", "decks", "m.*")
    r = ranked(r, [*keys, "mode"], [F.desc("value"), F.desc("decks"), F.asc("card_id")])
    return r.select(*keys, "mode", "card_id", "value", "of", "out_of", "rank")


def trends(cards: DataFrame, columns: list[str]) -> DataFrame:
    """Long form: a row for each side, card, month and ban list with any count, tiers summed."""
    t = dealt(cards, "card_id").groupBy("side", "card_id", "month", "restriction_id").agg(*[F.sum(c).alias(c) for c in columns])
    return t.filter(" or ".join(f"{c} <> 0" for c in columns))


def _place(month: Column, first: Column) -> Column:
    """How many months after the first one."""
    number = lambda m: F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 6, 2).cast("int")
    return number(month) - number(first)


def trend_vectors(cards: DataFrame, columns: list[str]) -> DataFrame:
    """(slice, card_id, first_month, columns): the trends of every slice with a vector for each column instead of rows: its n-th number is of
    the n-th month of the side's axis, 0 where nothing was counted. Cards without any count have no row. Base rows are dealt and sorted by
    card; slices are made where vectors are filled, in Arrow batches, as most numbers are zeros that no expression should make one by one."""
    axis = cards.groupBy("side").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    t = dealt(cards.select(*CELL, "card_id", *columns), "card_id").join(F.broadcast(axis), "side")  # two sides
    keys, month, first = [*SLICE, "card_id", "first_month"], F.col("month"), F.col("first_month")
    kinds = {c: "double" if cards.schema[c].dataType.typeName() == "double" else "long" for c in columns}
    numbers = [F.coalesce(F.col(c).cast(k), F.lit(0).cast(k)).alias(c) for c, k in kinds.items()]
    t = t.select(*keys, (_place(F.col("last_month"), first) + 1).alias("long"), _place(month, first).alias("at"), *numbers).sortWithinPartitions("card_id")
    schema = T.StructType([t.schema[k] for k in keys] + [T.StructField(c, T.ArrayType(t.schema[c].dataType, False)) for c in columns])
    return t.mapInArrow(lambda batches: vectors(batches, keys, ["restriction_id", "tier"], columns), schema)


def from_vectors(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """trend_vectors() as rows again, one for each month with any count."""
    rows = vectors.select(*SLICE, "card_id", "first_month", F.posexplode(F.arrays_zip(*columns)).alias("at", "v"))
    return rows.select(*SLICE, "card_id", add_months(F.col("first_month"), F.col("at")).alias("month"), "v.*").filter(" or ".join(f"{c} <> 0" for c in columns))


def monthly_series(cards: DataFrame, sides: DataFrame, factions: DataFrame, card: DataFrame) -> DataFrame:
    """For each side and card a row for every month from the first to the last, whether it was played or not: popularity, also inside and
    outside the card's faction, copies, win rate with its interval, and both against that month's baseline."""
    s = sides.groupBy("side", "month").agg(F.sum("side_decks").alias("side_decks"), F.sum("side_games").alias("side_games"), F.sum("side_wins").alias("side_wins"))
    span = s.groupBy("side").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    names = {"decks_with_card": "decks", "copies_sum": "copies", "decks_in_faction": "inside", "games_total": "games", "games_won": "won"}
    played = dealt(cards.select("side", "card_id", "month", *names), "card_id").groupBy("side", "card_id", "month").agg(*[F.sum(a).alias(b) for a, b in names.items()])
    f = factions.groupBy("side", "month", F.col("faction").alias("faction_id")).agg(F.sum("decks").alias("faction_decks"))
    known = card.select("card_id", "faction_id", "card_type_id")
    # the months of a card are as many as the axis has: they meet it as one row, so no row of a month without games is moved
    d = played.groupBy("side", "card_id").agg(F.map_from_entries(F.collect_list(F.struct("month", F.struct(*names.values())))).alias("cells")).join(known, "card_id", "left")
    d = d.join(F.broadcast(span), "side").withColumn("month", F.explode(months_between(F.col("a"), F.col("b")))).withColumn("c", F.col("cells")[F.col("month")])  # two sides
    d = d.select("side", "card_id", "month", "faction_id", "card_type_id", "c.*").join(small(s), ["side", "month"], "left").join(small(f), ["side", "month", "faction_id"], "left")
    d = d.fillna(0, ["decks", "copies", "inside", "games", "won", "side_decks", "side_games", "side_wins", "faction_decks"])
    has_in = F.col("faction_id").isNotNull() & ~F.col("faction_id").startswith("neutral") & ~F.col("card_type_id").endswith("identity")
    winrate, base = ratio(F.col("won"), F.col("games")), ratio(F.col("side_wins"), F.col("side_games"))
    low, high = wilson(F.col("won"), F.col("games"))
    return d.select(
        "side",
        "card_id",
        "month",
        "decks",
        ratio(F.col("decks"), F.col("side_decks")).alias("popularity"),
        F.when(has_in, ratio(F.col("inside"), F.col("faction_decks"))).alias("popularity_in"),
        F.when(has_in & (F.col("card_type_id") != "agenda"), ratio(F.col("decks") - F.col("inside"), F.col("side_decks") - F.col("faction_decks"))).alias("popularity_out"),
        ratio(F.col("copies"), F.col("decks")).alias("avg_copies"),
        winrate.alias("winrate"),
        low.alias("winrate_low"),
        high.alias("winrate_high"),
        points(winrate, base).alias("winrate_diff_pp"),
        points(low, base).alias("low_diff_pp"),
        points(high, base).alias("high_diff_pp"),
    )


def movers(view: DataFrame, k: int, keys: list[str] = SLICE) -> DataFrame:
    """The k largest rises and falls of each slice."""
    up = W.partitionBy(*keys).orderBy(F.desc("change_pp"), "card_id")
    down = W.partitionBy(*keys).orderBy(F.asc("change_pp"), "card_id")
    rises = view.filter("change_pp > 0").withColumn("place", F.row_number().over(up)).withColumn("kind", F.lit("riser"))
    falls = view.filter("change_pp < 0").withColumn("place", F.row_number().over(down)).withColumn("kind", F.lit("faller"))
    return rises.filter(F.col("place") <= k).union(falls.filter(F.col("place") <= k)).select(*keys, "kind", "place", "card_id", "change_pp")


def merge_cubes(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Any two parts of the cube add up, whatever cells they share."""
    rows = a.unionByName(b).select(*CELL, "card_id", *columns)
    return dealt(rows, "card_id").groupBy(*CELL, "card_id").agg(*[F.sum(c).alias(c) for c in columns])
