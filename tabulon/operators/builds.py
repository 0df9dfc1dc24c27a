"""Canonical events and entries built from two registries' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.assembly import online
from tabulon.sources.schemas import CANONICAL

ENTRY = [c.split()[0] for c in CANONICAL["entry"].split(", ")]
EVENT = [c.split()[0] for c in CANONICAL["tournament"].split(", ")]


def event_rows(events: DataFrame) -> DataFrame:
    """Rows of the canonical table from either registry's events. Beside its columns, events have linked_online and online_type (flags of the
    event's link), decks (sides with a deck) and seats (entries that could have two). Columns that a registry lacks are NULL."""
    missing = [c for c in (*EVENT, "linked_online", "online_type", "decks", "seats") if c not in events.columns]
    e = events.withColumns({c: F.lit(None) for c in missing})
    coverage = F.coalesce(F.round(F.try_divide(F.coalesce("decks", F.lit(0)).cast("double"), 2.0 * F.col("seats")), 6), F.lit(0.0))
    e = e.withColumns({
        "format": F.lit("standard"),
        "online": online(F.col("linked_online").cast("boolean"), F.col("name"), F.col("type"), F.col("online_type").cast("boolean")),
        "has_games": F.coalesce(F.col("has_games").cast("boolean"), F.lit(False)),
        "decklist_coverage": coverage,
    })
    return e.select(*[F.col(n).cast(kind).alias(n) for n, kind in (c.split() for c in CANONICAL["tournament"].split(", "))])


def _entries(df: DataFrame) -> DataFrame:
    e = df.withColumns({c: F.lit(None) for c in ENTRY if c not in df.columns})
    return e.select(*[F.col(n).cast(kind).alias(n) for n, kind in (c.split() for c in CANONICAL["entry"].split(", "))])


def _decks(decks: DataFrame, entries: DataFrame) -> DataFrame:
    """(tid, decks): sides of entries that have a deck, however many sources tell of it."""
    slots = decks.select("tid", "entry_no", "side").distinct().join(entries.select("tid", "entry_no"), ["tid", "entry_no"], "left_semi")
    return slots.groupBy("tid").agg(F.count("*").alias("decks"))


def _tid(prefix: str, number: str) -> Column:
    return F.concat(F.lit(prefix), F.col(number).cast("string"))


def first_registry(events: DataFrame, players: DataFrame, stages: DataFrame, linked: DataFrame, matches: DataFrame, decks: DataFrame, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and entries of the registry that keeps rounds.

    events: (cobra_id, abr_id, date, type, tier, restriction_id, card_set, swiss, cut: visibility of decks, name, swiss_format); players:
    (cobra_id, pid, swiss_rank, cut_rank, corp_identity, runner_identity, points), no entry without a Swiss rank; stages: (cobra_id, n, size), the
    cut is the second; linked: (abr_id, title, country, linked_online, online_type) of the other registry's events, one an id; matches: (tid,
    entry_no, abr_swiss_rank); decks and games by tid.
    """
    p = players.withColumn("tid", _tid("c", "cobra_id"))
    entries = p.filter("swiss_rank is not null").withColumn("entry_no", F.col("swiss_rank")).withColumn("made_cut", F.col("cut_rank").isNotNull()).withColumn("cobra_pid", F.col("pid"))
    entries = _entries(entries.join(matches.select("tid", "entry_no", "abr_swiss_rank"), ["tid", "entry_no"], "left"))
    seats = p.groupBy("tid").agg(F.count("*").alias("players"), F.count("swiss_rank").alias("seats"))
    cuts = stages.filter("n = 2").groupBy(_tid("c", "cobra_id").alias("tid")).agg(F.max("size").alias("cut_size"))
    played = games.select("tid").distinct().withColumn("has_games", F.lit(True))
    e = events.withColumn("tid", _tid("c", "cobra_id")).join(linked.select("abr_id", "title", "country", "linked_online", "online_type"), "abr_id", "left")
    e = e.join(seats, "tid", "left").join(cuts, "tid", "left").join(_decks(decks, entries), "tid", "left").join(played, "tid", "left").fillna(0, ["players", "cut_size"])
    visibility = F.concat(F.lit("swiss:"), "swiss", F.lit(",cut:"), "cut")
    return event_rows(e.withColumn("deck_visibility", visibility).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "title"))), entries


def second_registry(events: DataFrame, entries: DataFrame, decks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and entries of the registry that keeps results alone.

    events: (abr_id, date, type, tier, restriction_id, title, country, players_count, top_count, linked_online, online_type); entries: (abr_id,
    swiss_rank, cut_rank, corp_identity, runner_identity). Ranks in the cut count above zero, and only in events with a cut.
    """
    e = entries.join(events.select("abr_id", "top_count"), "abr_id").withColumn("tid", _tid("a", "abr_id"))
    rank = F.when(F.col("cut_rank") > 0, F.col("cut_rank"))
    rows = _entries(e.withColumns({"entry_no": F.col("swiss_rank"), "cut_rank": rank, "made_cut": (F.col("top_count") > 0) & rank.isNotNull(), "abr_swiss_rank": F.col("swiss_rank")}))
    seats = e.groupBy("tid").agg(F.count("*").alias("listed"))
    t = events.withColumn("tid", _tid("a", "abr_id")).join(seats, "tid", "left").join(_decks(decks, rows), "tid", "left")
    t = t.withColumns({"seats": F.greatest(F.coalesce("listed", F.lit(0)), "players_count"), "players": F.col("players_count"), "cut_size": F.col("top_count"), "name": F.col("title"), "deck_visibility": F.lit("n/a")})
    return event_rows(t), rows
