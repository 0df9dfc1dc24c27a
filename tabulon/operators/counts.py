"""The count cube: additive counts by side, ban list, tier and month. Ratios are never stored, so any cells add up.

Games are summed for each player before anything is joined to them, so that a deck is one row with its games and wins, and a card's decks,
copies, games and wins come from one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["side", "restriction_id", "tier", "month"]
SEAT = ["tid", "side", "entry_no"]
CARD_COLUMNS = ["decks_with_card", "copies_sum", "qty1", "qty2", "qty3", "games_total", "games_won", "entries_with_card_hc", "cut_with_card_hc", "tournaments_hc_with_card", "decks_in_faction"]
BASELINE_COLUMNS = ["side_decks", "side_games", "side_wins", "side_entries_hc", "side_cut_hc", "tournaments", "tournaments_hc", "side_games_all", "side_wins_all"]
IDENTITY_COLUMNS = ["entries", "games_total", "games_won", "cut_entries", "cut_made"]


#: Columns whose values grow with the input.
IDS = ("card_id", "identity")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys that few rows share, for groups that hold these keys: rows are moved once, as they are, and no task keeps sums of all that it
    reads, which would grow with the rows that a stored table packs into a file."""
    return df.repartition(*keys)


def both_sides(df: DataFrame) -> DataFrame:
    """Each row once for either side."""
    return df.withColumn("side", F.explode(F.array(F.lit("corp"), F.lit("runner"))))


def straight(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    return make()


@dataclass
class Counts:
    """tables: tournament, entry, deck, deck_card, game, card, ruling. identity_coverage: share of known identities for conversion.

    keep(name, make) may store a table that several counts share; by default it doesn't. In the scope ``cut`` the decks that made a top cut
    count, with all their games.
    """

    tables: object
    min_players: int = 8
    coverage: float = 0.7
    identity_coverage: float = 0.7
    scope: str = "all"
    keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = straight

    @cached_property
    def every_event(self) -> DataFrame:
        t = self.tables.tournament.filter(F.col("restriction_id").isNotNull() & (F.col("players") >= self.min_players))
        return t.select("tid", "restriction_id", "tier", F.date_format("date", "yyyy-MM").alias("month"), ((F.col("decklist_coverage") >= self.coverage) & (F.col("cut_size") > 0)).alias("hc"), "cut_size")

    @cached_property
    def events(self) -> DataFrame:
        return self.every_event.filter("cut_size > 0") if self.scope == "cut" else self.every_event

    @cached_property
    def games(self) -> DataFrame:
        """A row for each player of a game that counts, with the half points won."""
        g = both_sides(dealt(self.tables.game.filter("result <> 'intentional_draw'"), "tid").join(self.every_event.drop("hc", "cut_size"), "tid"))
        won = F.when(F.col("result") == "draw", 0.5).when((F.col("result") == "corp_win") == (F.col("side") == "corp"), 1.0).otherwise(0.0)
        return g.select("tid", "side", F.when(F.col("side") == "corp", F.col("corp_entry")).otherwise(F.col("runner_entry")).alias("entry_no"), "restriction_id", "tier", "month", won.alias("won"))

    @cached_property
    def player_games(self) -> DataFrame:
        return self.keep("player_games", lambda: self.games.groupBy(*SEAT).agg(F.count("*").alias("games"), F.sum("won").alias("wins")))

    @cached_property
    def every_deck(self) -> DataFrame:
        """Legal decks of counted events, with the games and wins of the player who played each."""

        def make() -> DataFrame:
            faction = self.tables.card.select(F.col("card_id").alias("identity_card"), F.col("faction_id").alias("id_faction"))
            d = self.tables.deck.filter("legal").join(self.every_event, "tid").join(self.tables.entry.select("tid", "entry_no", "made_cut"), ["tid", "entry_no"]).join(faction, "identity_card", "left")
            d = d.join(self.player_games, SEAT, "left").fillna({"games": 0, "wins": 0.0})
            return d.select("deck_id", *SEAT, "made_cut", "id_faction", "restriction_id", "tier", "month", "hc", "cut_size", "games", "wins")

        return self.keep("every_deck", make)

    @cached_property
    def decks(self) -> DataFrame:
        return self.every_deck.filter("made_cut and cut_size > 0") if self.scope == "cut" else self.every_deck

    @cached_property
    def deck_games(self) -> DataFrame:
        """Games whose deck is known."""
        return self.games.join(self.decks.select("deck_id", *SEAT), SEAT)

    def legal_cards(self, df: DataFrame, by_card: bool = False) -> DataFrame:
        """The cards of decks, with their faction, but those unknown or not legal by the deck's list; dealt by card where asked."""
        # a card's row names the lists that bar it, so the cards of decks are dealt by card once, and that also serves the counts by card
        barred = self.tables.ruling.filter("barred").groupBy("card_id").agg(F.collect_list("restriction_id").alias("_barred"))
        card = self.tables.card.select("card_id", "faction_id").join(barred, "card_id", "left")
        c = df.join(self.tables.deck_card, "deck_id")
        c = (dealt(c, "card_id") if by_card else c).join(card, "card_id")
        return c.filter(~F.coalesce(F.array_contains("_barred", F.col("restriction_id")), F.lit(False))).drop("_barred")

    @cached_property
    def card_counts(self) -> DataFrame:
        hc, inside = F.col("hc"), F.col("faction_id") == F.col("id_faction")

        def make() -> DataFrame:
            c = self.legal_cards(self.decks, by_card=True).groupBy(*CELL, "card_id").agg(
                F.count("*").alias("decks_with_card"),
                F.sum("qty").alias("copies_sum"),
                F.count_if(F.col("qty") == 1).alias("qty1"),
                F.count_if(F.col("qty") == 2).alias("qty2"),
                F.count_if(F.col("qty") >= 3).alias("qty3"),
                F.sum("games").alias("games_total"),
                F.sum("wins").alias("games_won"),
                F.count_if(hc).alias("entries_with_card_hc"),
                F.count_if(hc & F.col("made_cut")).alias("cut_with_card_hc"),
                F.count_distinct(F.when(hc, F.col("tid"))).alias("tournaments_hc_with_card"),
                F.count_if(inside).alias("decks_in_faction"),
            )
            return c.select(*CELL, "card_id", *CARD_COLUMNS)

        return self.keep(f"card_counts_{self.scope}", make)

    @cached_property
    def faction_counts(self) -> DataFrame:
        return self.decks.filter("id_faction is not null").groupBy(*CELL, F.col("id_faction").alias("faction")).agg(F.count("*").alias("decks"))

    @cached_property
    def side_decks(self) -> DataFrame:
        known = self.decks.groupBy(*CELL).agg(F.count("*").alias("side_decks"), F.sum("games").alias("side_games"), F.sum("wins").alias("side_wins"), F.count_if("hc").alias("side_entries_hc"), F.count_if(F.col("hc") & F.col("made_cut")).alias("side_cut_hc"))
        return known

    @cached_property
    def side_games(self) -> DataFrame:
        """All games, whether the deck is known or not."""
        g = self.player_games.join(self.events.select("tid", "restriction_id", "tier", "month"), "tid")
        if self.scope == "cut":
            g = g.join(self.tables.entry.filter("made_cut").select("tid", "entry_no"), ["tid", "entry_no"], "left_semi")
        return g.groupBy(*CELL).agg(F.sum("games").alias("side_games_all"), F.sum("wins").alias("side_wins_all"))

    @cached_property
    def event_counts(self) -> DataFrame:
        return self.events.groupBy("restriction_id", "tier", "month").agg(F.count("*").alias("tournaments"), F.count_if("hc").alias("tournaments_hc"))

    @cached_property
    def side_counts(self) -> DataFrame:
        """Dense: a side without a deck has a row too."""

        def make() -> DataFrame:
            c = both_sides(self.event_counts).join(self.side_decks, CELL, "left").join(self.side_games, CELL, "left")
            return c.fillna({k: 0.0 if "wins" in k else 0 for k in BASELINE_COLUMNS}).select(*CELL, *BASELINE_COLUMNS)

        return self.keep(f"side_counts_{self.scope}", make)

    @cached_property
    def identity_entries(self) -> DataFrame:
        """Known identities; coverage is that of the whole event and side, before illegal ones go."""
        e = both_sides(self.tables.entry.join(self.events.drop("hc"), "tid"))
        e = e.withColumn("identity", F.when(F.col("side") == "corp", F.col("corp_identity")).otherwise(F.col("runner_identity")))
        w = W.partitionBy("tid", "side")
        e = e.withColumn("has_cut", (F.col("cut_size") > 0) & (F.count("identity").over(w) / F.count(F.lit(1)).over(w) >= self.identity_coverage))
        e = e.select(*SEAT, "identity", "made_cut", "restriction_id", "tier", "month", "has_cut")
        e = e.join(self.tables.card.select(F.col("card_id").alias("identity")), "identity", "left_semi")
        return e.join(self.tables.ruling.filter("barred").select(F.col("card_id").alias("identity"), "restriction_id"), ["identity", "restriction_id"], "left_anti")

    @cached_property
    def identity_counts(self) -> DataFrame:
        def make() -> DataFrame:
            e = self.identity_entries.join(self.player_games, SEAT, "left")
            counts = [F.count("*").alias("entries"), F.coalesce(F.sum("games"), F.lit(0)).alias("games_total"), F.coalesce(F.sum("wins"), F.lit(0.0)).alias("games_won"), F.count_if("has_cut").alias("cut_entries"), F.count_if(F.col("has_cut") & F.col("made_cut")).alias("cut_made")]
            return e.groupBy(*CELL, "identity").agg(*counts).select(*CELL, "identity", *IDENTITY_COLUMNS)

        return self.keep("identity_counts", make)

    @cached_property
    def identity_side_counts(self) -> DataFrame:
        names = {"entries": "side_entries", "games_total": "side_games", "games_won": "side_wins", "cut_entries": "side_cut_entries", "cut_made": "side_cut_made"}
        return self.identity_counts.groupBy(*CELL).agg(*[F.sum(a).alias(b) for a, b in names.items()])


def slices(counts: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """The counts of every slice: ban list and tier each as they are and as 'all'. Base counts are summed, never counted anew; each row is
    expanded into its four slices. Counts of cards or identities are dealt by these before that, others are few, and summed before they move."""
    counts = dealt(counts.select("restriction_id", "tier", *by, *columns), *[k for k in by if k in IDS]) if set(by) & set(IDS) else counts
    return four_slices(counts).groupBy("restriction_id", "tier", *by).agg(*[F.sum(c).alias(c) for c in columns])


def four_slices(counts: DataFrame) -> DataFrame:
    """Each row in the four slices it is in."""
    pairs = F.array(*[F.struct(r.alias("r"), t.alias("t")) for r in (F.col("restriction_id"), F.lit("all")) for t in (F.col("tier"), F.lit("all"))])
    wide = counts.withColumn("_s", F.explode(pairs)).drop("restriction_id", "tier")
    return wide.select("*", F.col("_s.r").alias("restriction_id"), F.col("_s.t").alias("tier")).drop("_s")
