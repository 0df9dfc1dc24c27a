"""From source records to canonical rows: guards with reasons, rounds and games, links between two registries, decks from several sources."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions.text import name_key, title_key
from tabulon.operators.components import components
from tabulon.storage import checkpointed, small

#: Names of other formats, and kinds of records that are reference data.
OTHER_FORMATS = r"(?i)\b(start ?up|eternal|sealed|draft|cube|throwback|system gateway|1\.1\.1\.1)\b"
REFERENCE_KINDS = ["nrdb_by_date", "nrdb_catalog", "nrdb_catalog_bulk", "cobra_catalog", "cobra_index"]
RECENT_DAYS, LIVE_DAYS, SETTLED_DAYS = 90, 3, 14
#: Share of one registry's identity pairs that the other must have too.
LINK_SHARE = 0.9
DEFAULT_TIER = "online"
#: Days around an event in which its decklists may have been published.
BY_DATE = (-1, 14)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, NULL if none does. A condition that is NULL doesn't hold."""
    return reduce(lambda c, r: c.when(r[0], r[1]), rules, F.when(F.lit(False), None))


def listing_reason(least: int, since: Column) -> Column:
    """Why an event of the listing is skipped."""
    return first_reason(
        (~F.col("format").eqNullSafe("standard"), "not_standard"),
        (~F.col("approved").eqNullSafe(1), "unapproved"),
        (~F.coalesce("concluded", F.lit(False)), "not_concluded"),
        (F.coalesce("claim_conflict", F.lit(False)), "claim_conflict"),
        (F.coalesce("players", F.lit(0)) < least, "too_small"),
        (F.col("date") < since, "before_window"),
    )


def not_standard_reason() -> Column:
    """Why an event is no Standard one: its own format, else that of its link, else its name, else its identities.

    Columns: format_name (NULL before there was one), linked, linked_format, name, identities (known ones), near (a list's identities are
    legal near the date; NULL without a list in force), illegal (some identity is legal in no list near the date).
    """
    named = F.coalesce("name", F.lit("")).rlike(r"(?i)\bstandard\b")
    return (
        F.when(F.col("format_name").isNotNull(), F.when(F.lower(F.trim("format_name")) != "standard", "not_standard"))
        .when(F.col("linked"), F.when(~F.col("linked_format").eqNullSafe("standard"), "not_standard"))
        .when(F.coalesce("name", F.lit("")).rlike(OTHER_FORMATS), "not_standard_name")
        .when(F.col("identities") == 0, F.when(~named, "format_unknown"))
        .when(~F.coalesce("near", F.lit(False)), "format_unknown")
        .when(F.col("illegal"), "not_standard_identities")
    )


def online(linked_flag: Column, name: Column, label: Column, online_type: Column) -> Column:
    return F.coalesce(linked_flag, F.lit(False)) | F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(label, F.lit(""))).rlike(r"(?i)\bonline\b") | F.coalesce(online_type, F.lit(False))


def preferred_tier(own: Column, linked: Column) -> Column:
    """The event's own tier unless that is the default, then its link's."""
    return F.when((own == DEFAULT_TIER) & linked.isNotNull(), linked).otherwise(own)


def numbered_rounds(rounds: DataFrame) -> DataFrame:
    """(tid, place, flagged, prelim) -> stage, round, elimination. A round is of the cut if a game of it is marked so or if as many rounds
    as planned for the Swiss stage, if any, were played before; both stages count their rounds from 1."""
    at = W.partitionBy("tid").orderBy("place")
    plain = F.count_if(~F.col("flagged")).over(at.rowsBetween(W.unboundedPreceding, -1))
    r = rounds.withColumn("elimination", F.col("flagged") | ((F.col("prelim") > 0) & (plain >= F.col("prelim"))))
    stage = W.partitionBy("tid", "elimination").orderBy("place")
    return r.select("tid", "place", "elimination", F.when(F.col("elimination"), 2).otherwise(1).alias("stage"), F.row_number().over(stage).alias("round"))


def provisional_cut(players: DataFrame, pairings: DataFrame) -> DataFrame:
    """(tid, pid, cut_rank) of the players in elimination pairings: their seeds by Swiss rank, those without one last, then by id."""
    playing = pairings.filter("elimination").select("tid", F.explode(F.array("p1", "p2")).alias("pid")).filter("pid is not null").distinct()
    seeds = W.partitionBy("tid").orderBy(F.coalesce("swiss_rank", F.lit(1_000_000)), "pid")
    return players.join(playing, ["tid", "pid"], "left_semi").select("tid", "pid", F.row_number().over(seeds).alias("cut_rank"))


def result(corp: Column, runner: Column) -> Column:
    """Who won by the scores, by the first rule that holds; both lost, or nothing known, is no result."""
    return first_reason(
        ((corp == 3) | (corp.isNull() & (runner == 0)), "corp_win"),
        ((runner == 3) | (runner.isNull() & (corp == 0)), "runner_win"),
        ((corp == 0) & (runner == 0), ""),
        ((corp == 1) | (runner == 1), "draw"),
        (corp == 0, "runner_win"),
        (runner == 0, "corp_win"),
    )


PAIRING = ["p1", "p2", "p1_side", "p1_corp_score", "p1_runner_score", "p2_corp_score", "p2_runner_score", "intentional_draw", "two_for_one", "elimination", "winner"]


def games(pairings: DataFrame) -> DataFrame:
    """(tid, stage, round, table, elimination, side, corp_entry, runner_entry, result) of pairings with the players' entries (e1, e2) and
    the event's double_sided: one game of a single-sided or elimination pairing, two of a double-sided one. Byes, players without an entry,
    unreported games and two results reported as one give none. ``side`` is that of the first player."""
    p = pairings.filter("p1 is not null and p2 is not null and e1 is not null and e2 is not null")
    by_score = lambda first: F.when(F.col("intentional_draw"), "intentional_draw").otherwise(F.nullif(result(F.col("p1_corp_score" if first else "p2_corp_score"), F.col("p2_runner_score" if first else "p1_runner_score")), F.lit("")))
    game = lambda first, outcome: F.struct(F.lit(first).alias("first"), outcome.alias("result"))
    first = F.col("p1_side") == "corp"
    cut = F.when(F.col("winner").isNotNull(), F.when((F.col("winner") == 1) == first, "corp_win").otherwise("runner_win"))
    single = F.when(first, F.array(game(True, by_score(True)))).when(~first, F.array(game(False, by_score(False))))
    knocked = F.when(first, F.array(game(True, cut))).when(~first, F.array(game(False, cut)))
    double = F.when(~F.col("two_for_one"), F.array(game(True, by_score(True)), game(False, by_score(False))))
    played = F.when(F.col("elimination"), knocked).when(F.col("double_sided"), double).otherwise(single)
    p = p.withColumn("g", F.explode(played)).filter("g.result is not null")
    corp_first = F.col("g.first")
    return p.select("tid", "stage", "round", "table", "elimination", F.when(corp_first, "corp").otherwise("runner").alias("side"), F.when(corp_first, F.col("e1")).otherwise(F.col("e2")).alias("corp_entry"), F.when(corp_first, F.col("e2")).otherwise(F.col("e1")).alias("runner_entry"), F.col("g.result").alias("result"))


def unreported(events: DataFrame, pairings: DataFrame) -> DataFrame:
    """(tid, unreported): whether a result is missing; byes have none. An event without pairings misses all."""
    scores = [F.col(c).isNull() for c in PAIRING[3:7]]
    missing = F.when(F.col("elimination"), F.col("winner").isNull()).when(F.col("double_sided"), reduce(lambda a, b: a | b, scores)).otherwise(scores[0] & scores[1])
    m = pairings.groupBy("tid").agg(F.max(F.col("p1").isNotNull() & F.col("p2").isNotNull() & missing).alias("missing"))
    return events.select("tid").join(m, "tid", "left").select("tid", F.coalesce("missing", F.lit(True)).alias("unreported"))


def live(date: Column, today: Column, unreported: Column) -> Column:
    """Still played or reported: of the last days, or with a missing result until it is settled."""
    age = F.datediff(today, date)
    return (age <= LIVE_DAYS) | ((age <= SETTLED_DAYS) & unreported)


def decks_to_fetch(players: DataFrame) -> DataFrame:
    """Players of (tid, pid, cut_rank, swiss_visibility, cut_visibility) whose decks may be read: all of a public Swiss stage, those of the
    cut where only that is public."""
    return players.filter((F.col("swiss_visibility") == "public") | ((F.col("cut_visibility") == "public") & F.col("cut_rank").isNotNull())).select("tid", "pid")


def link_candidates(own: DataFrame, other: DataFrame, own_pairs: DataFrame, other_pairs: DataFrame) -> DataFrame:
    """(id, other_id, shared, known): events of two registries that can be one, of equal size and within a day of the other's days, of which
    at least LINK_SHARE of the other's identity pairs are found in the own ones; multisets of (id, pair).

    own: (id, date, size); other: (other_id, date, end_date, size).

    Events meet by rare pairs, not by size alone. Of an event of k pairs at most k - ceil(LINK_SHARE k) may be missing in the own one, so of any
    one pair more than that at least one is found there: these few, the rarest ones, are looked up among the own events' pairs, the n-th of
    like pairs with the n-th. So candidates grow with the events and how common their rarest pairs are. Events that name no pair can be any of
    their size and days, and are joined by these.
    """
    spans = other.select("other_id", F.col("size").alias("other_size"), F.date_sub("date", 1).alias("a"), F.date_add(F.coalesce("end_date", "date"), 1).alias("b"))
    months = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
    spans, days = spans.withColumn("month", F.explode(months)), own.select("id", "date", F.col("size").alias("other_size"), F.trunc("date", "month").alias("month"))
    numbered = lambda df, key: df.withColumn("n", F.row_number().over(W.partitionBy(key, "pair").orderBy(key)))
    ours = numbered(own_pairs.select("id", "pair"), "id").join(days, "id")
    common = ours.groupBy("pair", "n", "other_size").agg(F.count("*").alias("common"))
    theirs = numbered(other_pairs.select("other_id", "pair"), "other_id").join(other.select("other_id", F.col("size").alias("other_size")), "other_id").join(common, ["pair", "n", "other_size"], "left")
    event = W.partitionBy("other_id")
    theirs = theirs.withColumn("k", F.count("*").over(event)).withColumn("place", F.row_number().over(event.orderBy(F.coalesce("common", F.lit(0)), "pair", "n")))
    rare = theirs.filter(F.col("place") <= F.col("k") - F.ceil(F.col("k") * F.lit(LINK_SHARE)) + 1).select("other_id", "pair", "n")
    within = F.col("date").between(F.col("a"), F.col("b"))
    met = rare.join(spans, "other_id").join(ours, ["pair", "n", "other_size", "month"]).filter(within).select("id", "other_id")
    unnamed = spans.join(other_pairs.select("other_id").distinct(), "other_id", "left_anti").join(days, ["other_size", "month"]).filter(within).select("id", "other_id")
    near = checkpointed(met.union(unnamed).distinct())
    count = lambda df, key, n: df.groupBy(key, "pair").agg(F.count("*").alias(n))
    theirs = near.join(count(other_pairs, "other_id", "theirs"), "other_id")
    both = theirs.join(count(own_pairs, "id", "ours"), ["id", "pair"], "left")
    overlap = both.groupBy("id", "other_id").agg(F.sum("theirs").alias("known"), F.sum(F.least("theirs", F.coalesce("ours", F.lit(0)))).alias("shared"))
    return near.join(overlap, ["id", "other_id"], "left").fillna({"known": 0, "shared": 0}).filter(F.col("shared") >= LINK_SHARE * F.col("known"))


def direct_links(own: DataFrame, other: DataFrame) -> DataFrame:
    """(id, other_id, mismatch) by the code that an event has of the other registry: digits that name an event there."""
    code = F.trim(F.coalesce("code", F.lit("")))
    o = own.select("id", code.alias("code")).filter("code <> ''").withColumn("wanted", F.when(F.col("code").rlike(r"^[0-9]+\z"), F.col("code").try_cast("long")))
    o = o.join(other.select(F.col("other_id").alias("wanted")), "wanted", "left_semi").select("id", F.col("wanted").alias("other_id")).withColumn("mismatch", F.lit(None).cast("string")).union(
        o.join(other.select(F.col("other_id").alias("wanted")), "wanted", "left_anti").select("id", F.lit(None).cast("long"), F.lit("abr_code_unresolved"))
    )
    return o


def resolved_links(candidates: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, other_id): candidates in order of id, each linked if exactly one of its candidates is free by then.

    Whether an event's candidates are free depends on earlier events with a common candidate only, so each component of events that are tied by
    common candidates is resolved by itself, in order; a task holds whole components, of pairs of numbers, and no component meets another.
    ``candidates`` has (id, other_id), ``taken`` the other_ids that are linked already.
    """
    free = checkpointed(candidates.join(taken.select("other_id").distinct(), "other_id", "left_anti").select("id", "other_id").distinct())
    roots = components(free.select((F.col("id") * 2).alias("a"), (F.col("other_id") * 2 + 1).alias("b")))

    def greedy(pairs: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for own, group in pairs.sort_values(["id", "other_id"]).groupby("id", sort=True):
            left = [x for x in group["other_id"] if x not in used]
            if len(left) == 1:
                used.add(left[0])
                out.append((own, left[0]))
        return pd.DataFrame(out, columns=["id", "other_id"]).astype("int64")

    tied = free.withColumn("node", F.col("id") * 2).join(roots, "node")
    # a component of one pair needs no order
    tied = tied.withColumn("pairs", F.count("*").over(W.partitionBy("root")))
    return tied.filter("pairs = 1").select("id", "other_id").union(tied.filter("pairs > 1").select("root", "id", "other_id").groupBy("root").applyInPandas(greedy, "id long, other_id long"))


def matching_entries(entries: DataFrame, others: DataFrame) -> DataFrame:
    """entries of (tid, entry_no, corp_identity, runner_identity) with matched: whether the other registry's entry of the same rank doesn't
    contradict an identity; NULL where it has none."""
    o = others.select("tid", F.col("rank").alias("entry_no"), F.col("corp").alias("oc"), F.col("runner").alias("orn"), F.lit(True).alias("there"))
    differs = F.coalesce(F.col("oc") != F.col("corp_identity"), F.lit(False)) | F.coalesce(F.col("orn") != F.col("runner_identity"), F.lit(False))
    return entries.join(o, ["tid", "entry_no"], "left").withColumn("matched", F.when(F.col("there"), ~differs)).drop("oc", "orn", "there")


def resolved_cards(rows: DataFrame, printings: DataFrame, cards: DataFrame) -> DataFrame:
    """rows of (deck_id, card_ref, printing_ref, qty) with card_id: a known card's id, else the card of the printing; NULL if neither is known."""
    known = cards.select(F.col("card_id").alias("card_ref"), F.lit(True).alias("known"))
    by_printing = printings.select(F.col("printing_id").alias("printing_ref"), F.col("card_id").alias("of_printing"))
    r = rows.join(known, "card_ref", "left").join(by_printing, "printing_ref", "left")
    return r.withColumn("card_id", F.coalesce(F.when(F.col("known"), F.col("card_ref")), F.col("of_printing"))).drop("known", "of_printing")


def merged_cards(rows: DataFrame) -> DataFrame:
    """(deck_id, card_id, qty, printing_ref): the copies of a card that a deck lists several times added up, with the first printing."""
    return rows.filter("card_id is not null").groupBy("deck_id", "card_id").agg(F.sum("qty").alias("qty"), F.min_by("printing_ref", "place").alias("printing_ref"))


def identities_by_title(titles: DataFrame, identities: DataFrame) -> DataFrame:
    """titles with card_id: the identity of that key, else the only one whose key goes on after it with a space. ``key`` columns are title
    keys; of identities with equal keys the least id counts.

    Prefixes meet by the words they start with, so no title meets every identity.
    """
    own = identities.groupBy("key").agg(F.min("card_id").alias("card_id"))
    words = F.split("key", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " "))
    longer = own.filter(F.size(words) > 1).select(F.explode(prefixes).alias("prefix"), "card_id").groupBy("prefix").agg(F.count_distinct("card_id").alias("n"), F.min("card_id").alias("only")).filter("n = 1")
    t = titles.join(own.withColumnRenamed("card_id", "exact"), "key", "left").join(longer.select(F.col("prefix").alias("key"), "only"), "key", "left")
    return t.withColumn("card_id", F.when(F.col("key") != "", F.coalesce("exact", "only"))).drop("exact", "only")


def cards_by_title(titles: DataFrame, cards: DataFrame) -> DataFrame:
    """titles with card_id where exactly one card has that title key."""
    only = cards.groupBy("key").agg(F.count_distinct("card_id").alias("n"), F.min("card_id").alias("card_id")).filter("n = 1").drop("n")
    return titles.join(only, "key", "left")


def matched_players(names: DataFrame, players: DataFrame) -> DataFrame:
    """(tid, name, pid): the player of that name in the event, else the only one whose name is the same by name_key; NULL if none or several
    fit. names: (tid, name); players: (tid, pid, name)."""
    only = lambda df, by, out: df.groupBy("tid", by).agg(F.count_distinct("pid").alias("n"), F.min("pid").alias("pid")).select("tid", by, F.lit(True).alias(f"has_{out}"), F.when(F.col("n") == 1, F.col("pid")).alias(out))
    p = players.filter("pid is not null").select("tid", "pid", F.trim(F.coalesce("name", F.lit(""))).alias("trimmed"), name_key(F.coalesce("name", F.lit(""))).alias("loose"))
    n = names.select("tid", "name", F.trim("name").alias("trimmed"), name_key(F.col("name")).alias("loose"))
    m = n.join(only(p, "trimmed", "exact"), ["tid", "trimmed"], "left").join(only(p, "loose", "by_key"), ["tid", "loose"], "left")
    pid = F.when(F.col("loose") != "", F.when(F.col("has_exact"), F.col("exact")).otherwise(F.col("by_key")))
    return m.select("tid", "name", pid.alias("pid"))


def in_bulk_files(decks: DataFrame, files: DataFrame) -> DataFrame:
    """decks of (deck_id, date) with found: whether a by-date file of the window around the event lists it; NULL if a day's file is still
    missing and none lists it, so that the decision is put off. files: (day, deck_id) and a NULL deck_id for a file that is there at all."""
    first, last = F.date_add("date", BY_DATE[0]), F.date_add("date", BY_DATE[1])
    # whether a file is missing is asked once a date, not once a deck: dates are as many as the calendar has
    days = decks.filter("date is not null").select("date").distinct().withColumn("day", F.explode(F.sequence(first, last)))
    there = files.select("day").distinct().withColumn("there", F.lit(True))
    dates = small(checkpointed(days.join(there, "day", "left").groupBy("date").agg(F.max(F.col("there").isNull()).alias("waiting"))))
    listed = files.filter("deck_id is not null").select("day", "deck_id")
    d = decks.join(dates, "date").join(listed, "deck_id", "left").groupBy("deck_id").agg(F.max(F.when(F.col("day").between(first, last), True)).alias("listed"), F.max("waiting").alias("waiting"))
    return d.select("deck_id", F.when(F.col("listed"), True).when(~F.col("waiting"), False).alias("found"))


def import_checks(rows: DataFrame, players: DataFrame, cards: DataFrame) -> DataFrame:
    """(name, identity, line, reason, side, pid): each deck of an imported file by player and identity, with why it is left out (NULL if it
    isn't) and the line that says so.

    rows: (line, name, pid, identity, card, qty as text), players: (pid, corp_identity, runner_identity) as card ids, cards: (key, card_id,
    side_id, card_type_id) with title keys. In this order: no such player, identity unknown, identity other than registered, the first line
    with an unknown card or a count that is no number from 1 to 99, a second deck for a side.
    """
    titled = cards.groupBy("key").agg(F.count_distinct("card_id").alias("n"), F.min(F.struct("card_id", "side_id", "card_type_id")).alias("c")).filter("n = 1").select("key", "c")
    r = rows.withColumn("k1", title_key(F.col("identity"))).withColumn("k2", title_key(F.col("card")))
    r = r.join(titled.select(F.col("key").alias("k1"), F.col("c").alias("ident")), "k1", "left").join(titled.select(F.col("key").alias("k2"), F.col("c").alias("known")), "k2", "left")
    bad = F.when(F.col("known").isNull(), "unknown_card").when(~F.col("qty").rlike(r"^[0-9]{1,2}\z") | (F.col("qty").try_cast("int") == 0), "bad_count")
    d = r.groupBy("name", "identity").agg(F.min("line").alias("line"), F.first("pid").alias("pid"), F.first("ident").alias("ident"), F.min(F.when(bad.isNotNull(), F.struct("line", bad.alias("reason")))).alias("bad"))
    d = d.join(players.select("pid", "corp_identity", "runner_identity", F.lit(True).alias("playing")), "pid", "left")
    fits = F.col("ident.card_type_id").endswith("identity") & F.col("ident.side_id").isin("corp", "runner")
    own = F.when(F.col("ident.side_id") == "corp", F.col("corp_identity")).otherwise(F.col("runner_identity"))
    reason = first_reason((F.col("playing").isNull(), "player_not_found"), (~F.coalesce(fits, F.lit(False)), "unknown_identity"), (own != F.col("ident.card_id"), "identity_differs_from_cobra"), (F.col("bad").isNotNull(), "?"))
    d = d.withColumn("reason", F.when(reason == "?", F.col("bad.reason")).otherwise(reason)).withColumn("at", F.when(reason == "?", F.col("bad.line")).otherwise(F.col("line")))
    side = F.when(F.col("reason").isNull(), F.col("ident.side_id"))
    first = F.row_number().over(W.partitionBy("pid", side).orderBy("line", "identity")) == 1
    d = d.withColumn("again", F.when(side.isNotNull() & ~first, F.lit("two_decks_for_one_side")))
    return d.select("name", "identity", F.col("at").alias("line"), F.coalesce("reason", "again").alias("reason"), F.when(F.coalesce("reason", "again").isNull(), side).alias("side"), "pid")


def import_report(checks: DataFrame) -> DataFrame:
    """(reason, decks, lines): how many decks were left out for each reason and at which lines; 'imported' for the others."""
    return checks.groupBy(F.coalesce("reason", F.lit("imported")).alias("reason")).agg(F.count("*").alias("decks"), F.sort_array(F.collect_list("line")).alias("lines"))


def phase(kind: Column, event_date: Column, tier_name: Column, today: Column) -> Column:
    """0 reference data, 1 recent events and those without a date, 2 the largest events, 3 the rest."""
    return F.when(kind.isin(*REFERENCE_KINDS) | kind.startswith("abr_list"), 0).when(event_date.isNull() | (F.datediff(today, event_date) <= RECENT_DAYS), 1).when(tier_name == "megacity", 2).otherwise(3)


def fingerprint(columns: list[str]) -> Column:
    """A hash of the named columns, by which a change of any of them is seen."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))

