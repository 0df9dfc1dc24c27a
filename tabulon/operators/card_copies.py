"""Copies of cards in a game's log: when each came into play and left it, what it gave and cost; and plays of cards that are in play never.

A card that leaves play is named, not which copy of it. Closings are read in the order of lines: each takes the oldest copy in play of the
server that it names (that the card was rezzed in or protects), else the oldest of the player's own, else the oldest of anybody's; one that
finds none takes none. Openings and closings of a game and card are sorted by Spark and pass through a task in order, in time that grows with their number.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.operators import game_logs as g
from tabulon.storage import checkpointed


def paired(openings: DataFrame, closings: DataFrame, keys: list[str]) -> DataFrame:
    """(opening, closing): ids matched first in, first out within ``keys``, from rows of (keys, line_no, place, id); null keys match nothing."""
    row = lambda df, step: df.dropna(subset=keys).select(*keys, "line_no", "place", "id", F.lit(step).alias("step"))
    # of one line, what comes into play is there before what leaves
    at = W.partitionBy(*keys).orderBy("line_no", F.col("step").desc(), "place")
    e = row(openings, 1).union(row(closings, -1)).withColumn("balance", F.sum("step").over(at.rowsBetween(W.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.min("balance").over(at.rowsBetween(W.unboundedPreceding, -1)))
    e = e.withColumn("low", low).filter("step = 1 or balance >= low")
    e = e.withColumn("n", F.row_number().over(W.partitionBy(*keys, "step").orderBy("line_no", "place")))
    opened = e.filter("step = 1").select(*keys, "n", F.col("id").alias("opening"))
    return opened.join(e.filter("step = -1").select(*keys, "n", F.col("id").alias("closing")), [*keys, "n"]).select("opening", "closing")


def left_play(openings: DataFrame, closings: DataFrame) -> DataFrame:
    """(game_id, player, line_no, place, closed_line): the openings that leave play, from rows of (game_id, player, card, server, line_no, place)."""
    row = lambda df, opens: df.dropna(subset=["game_id", "card"]).select("game_id", "card", "line_no", F.lit(opens).alias("opens"), "place", "player", "server")
    e = row(openings, True).union(row(closings, False)).repartition("game_id", "card")
    # of one line, what comes into play is there before what leaves
    e = e.sortWithinPartitions("game_id", "card", "line_no", F.desc("opens"), "place", "player", "server")
    return e.select("game_id", "card", "line_no", "opens", "place", "player", "server").mapInPandas(_closed, f"game_id {openings.schema['game_id'].dataType.simpleString()}, player string, line_no int, place int, closed_line int")


def _closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by game and card, in order; held are the copies in play of one of them, oldest first, by server, by player and all."""
    now, here, gone = None, {}, set()
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if now != (r.game_id, r.card):
                now, here, gone = (r.game_id, r.card), {}, set()
            queues = [here.setdefault(q, deque()) for q in (("server", r.server), ("player", r.player), "all") if q != ("server", None)]
            if r.opens:
                for q in queues:
                    q.append((r.player, r.line_no, r.place))
                continue
            for q in queues:
                while q and q[0] in gone:
                    q.popleft()
            copy = next((q[0] for q in queues if q), None)
            if copy is not None:
                gone.add(copy)
                out.append((r.game_id, *copy, r.line_no))
        yield pd.DataFrame(out, columns=["game_id", "player", "line_no", "place", "closed_line"])


def closings(lines: DataFrame) -> DataFrame:
    """(game_id, player, line_no, place, card, server): cards that a line takes out of play: trashed (not by damage, which discards from hand),
    trashed by themselves, or shuffled away."""
    line, deeds = F.col("line"), F.col("deeds")
    gone = g.trashed_cards(line)
    itself = F.contains(line, F.lit(" trash itself")) | F.contains(line, F.lit(" trashes itself"))
    own = F.when(itself, g.about(deeds, "uses", "use")).when(F.contains(line, F.lit(" shuffles ")), g.up_to(g.about(deeds, "shuffles"), " into ", " back "))
    none = F.lit(None).cast("string")
    one = lambda place, card, server: F.struct(place.alias("place"), card.alias("card"), server.alias("server"))
    trashed = F.when(gone.isNotNull() & ~itself, F.transform(gone["cards"], lambda c, i: one(i, c, gone["server"])))
    left = F.when(own.isNotNull(), F.array(one(F.lit(0), g.clean_name(own), none)))
    c = lines.select("game_id", "player", "line_no", F.explode(F.coalesce(trashed, left)).alias("c")).select("game_id", "player", "line_no", "c.*")
    return c.filter((F.col("card") != "") & ~F.col("card").rlike(g.UNNAMED))


def lifetimes(log: DataFrame, who: DataFrame, lines: DataFrame) -> DataFrame:
    """(game_id, player, card, kind, server, line_no, place, turn, cost, closed_line, closed_turn, last_turn): every copy, with the line and its
    owner's turn where it leaves play (NULL if it stays) and the turn up to which it counts."""
    openings = checkpointed(g.opened(lines).withColumn("place", F.when(F.col("kind") == "rez", 1).otherwise(0)))
    copies = openings.join(left_play(openings, closings(lines)), ["game_id", "player", "line_no", "place"], "left")
    # the owner's turn at a line of anybody's
    starts = log.filter("kind = 'start'").select("game_id", "player", F.col("line_no").alias("closed_line"), F.col("printed_turn").alias("now"))
    asked = copies.select("game_id", "player", "closed_line", F.lit(None).cast("int").alias("now")).dropna(subset=["closed_line"])
    at = W.partitionBy("game_id", "player").orderBy("closed_line").rangeBetween(W.unboundedPreceding, 0)
    turns = starts.union(asked).withColumn("closed_turn", F.coalesce(F.last("now", ignorenulls=True).over(at), F.lit(0))).filter("now is null").select("game_id", "player", "closed_line", "closed_turn").distinct()
    copies = copies.join(turns, ["game_id", "player", "closed_line"], "left").join(who.select("game_id", "player", "rounds"), ["game_id", "player"], "left")
    return copies.withColumn("last_turn", F.coalesce("closed_turn", "rounds", "turn")).drop("rounds", "seq")


def uses(lines: DataFrame) -> DataFrame:
    """(game_id, player, line_no, place, turn, card, plays, gain, cost): credits that a line says of a card: playing it, what using it costs, what
    it gives, and credits spent from it, which it gave."""
    deeds = F.col("deeds")
    gained = g.gain_of_card(deeds)
    played, used = F.when(g.place_of(deeds, "play") > 1, g.about(deeds, "play")), F.when(g.place_of(deeds, "use") > 1, g.about(deeds, "use"))
    span = g.up_to(F.regexp_extract("line", r"\bpays\s+(\d.*)$", 1), " to ")
    shares = F.filter(F.split(span, r"\s*,\s*(?:and )?|\s+and\s+"), lambda x: x.rlike(r"^\d+ from ") & ~F.contains(F.lower(x), F.lit("credit pool")))
    no = F.lit(None).cast("int")
    row = lambda place, card, gain=no, cost=no, plays=False: F.struct(F.lit(place).alias("place"), g.clean_name(card).alias("card"), F.lit(plays).alias("plays"), gain.cast("int").alias("gain"), cost.cast("int").alias("cost"))
    said = F.array(
        F.when(gained["amount"].isNotNull(), row(0, gained["card"], gain=gained["amount"])),
        F.when(g.paid_for(deeds, "play").isNotNull(), row(1, played, cost=g.digits(g.paid_for(deeds, "play")), plays=True)),
        F.when(g.leading(g.paid_for(deeds, "use")).isNotNull(), row(2, used, cost=g.leading(g.paid_for(deeds, "use")))),
    )
    spent = F.transform(shares, lambda x, i: F.struct((i + 3).alias("place"), g.beyond(x, " from ").alias("card"), F.lit(False).alias("plays"), g.leading(x).alias("gain"), no.alias("cost")))
    u = lines.select("game_id", "player", "line_no", "turn", F.explode(F.concat(F.array_compact(said), spent)).alias("u")).select("game_id", "player", "line_no", "turn", "u.*")
    u = checkpointed(u)
    return u.filter((F.col("card") != "") & ~F.lower("card").contains("basic action card"))


def shared_out(used: DataFrame, copies: DataFrame) -> DataFrame:
    """uses() with ``copy_line`` and ``copy_place``, the opening of the copy that each belongs to: one in play, or else the last one that left in
    this turn; NULL for cards that aren't. Where several are in play, uses go round among them from the oldest on."""
    key = ["game_id", "player", "card"]
    c = copies.select(*key, F.col("line_no").alias("copy_line"), F.col("place").alias("copy_place"), "closed_line", "closed_turn")
    there = (F.col("copy_line") < F.col("line_no")) & (F.col("closed_line").isNull() | (F.col("closed_line") > F.col("line_no")))
    just_left = (F.col("closed_line") <= F.col("line_no")) & (F.col("closed_turn") == F.col("turn"))
    # a deck holds few copies of a card, so a use meets few
    met = used.join(c, key, "left").groupBy(*used.columns).agg(
        F.array_sort(F.collect_list(F.when(there, F.struct("copy_line", "copy_place")))).alias("open"), F.max(F.when(just_left, F.struct("closed_line", "copy_line", "copy_place"))).alias("left")
    )
    stretch = W.partitionBy(*key, "open").orderBy("line_no", "place")
    turn = (F.row_number().over(stretch) - 1) % F.greatest(F.size("open"), F.lit(1))
    copy = F.coalesce(F.get("open", turn), F.struct("left.copy_line", "left.copy_place"))
    return met.select(*used.columns, copy["copy_line"].alias("copy_line"), copy["copy_place"].alias("copy_place"))


def installed_rows(copies: DataFrame, shared: DataFrame) -> DataFrame:
    """(game_id, player, card, copy, turn, left_turn, turns_in_play, gained, cost, net): a row a copy, numbered from 1 where there are several."""
    key = ["game_id", "player", "card"]
    of = shared.filter("copy_line is not null").groupBy(*key, F.col("copy_line").alias("line_no"), F.col("copy_place").alias("place")).agg(F.sum("gain").alias("gained"), F.sum("cost").alias("paid"))
    c = copies.join(of, [*key, "line_no", "place"], "left").fillna({"gained": 0, "paid": 0})
    n, number = F.count("*").over(W.partitionBy(*key)), F.row_number().over(W.partitionBy(*key).orderBy("line_no", "place"))
    cost = F.col("cost") + F.col("paid")
    return c.select(*key, F.when(n > 1, number).alias("copy"), "turn", F.col("closed_turn").alias("left_turn"), F.greatest(F.lit(1), F.col("last_turn") - F.col("turn") + 1).alias("turns_in_play"), "gained", cost.alias("cost"), (F.col("gained") - cost).alias("net"))


def operation_rows(shared: DataFrame) -> DataFrame:
    """(game_id, player, card, turn, nth, cost, gain, net): a row for each time that a card without a copy was triggered in a turn, numbered where
    there are several. A play is a new time; another cost belongs to the last one of the turn, a gain to the first that has none yet; where
    there is none, either is a new time. Which gains find one follows from the balance of times and gains, as for copies."""
    key = ["game_id", "player", "card", "turn"]
    at = W.partitionBy(*key).orderBy("line_no", "place")
    e = shared.filter("copy_line is null").withColumn("opens", F.col("gain").isNull() & (F.col("plays") | (F.row_number().over(at) == 1)))
    step = F.when(F.col("opens"), 1).when(F.col("gain").isNotNull(), -1).otherwise(0)
    e = e.withColumn("step", step).withColumn("balance", F.sum("step").over(at.rowsBetween(W.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.min("balance").over(at.rowsBetween(W.unboundedPreceding, -1)))
    e = e.withColumn("alone", (F.col("step") == -1) & (F.col("balance") < low)).withColumn("begins", F.col("opens") | F.col("alone"))
    e = e.withColumn("time", F.count_if(F.col("begins")).over(at.rowsBetween(W.unboundedPreceding, 0)))
    # the n-th gain that finds a time belongs to the n-th that was opened by a cost
    e = e.withColumn("n", F.when(F.col("opens"), F.count_if(F.col("opens")).over(at)).when((F.col("step") == -1) & ~F.col("alone"), F.count_if((F.col("step") == -1) & ~F.col("alone")).over(at)))
    costs = e.filter("gain is null or alone").groupBy(*key, "time").agg(F.sum("cost").alias("cost"), F.sum("gain").alias("own"), F.max(F.when(F.col("opens"), F.col("n"))).alias("n"))
    gains = e.filter("step = -1 and not alone").groupBy(*key, "n").agg(F.sum("gain").alias("found"))
    t = costs.join(gains, [*key, "n"], "left")
    cost, gain = F.coalesce("cost", F.lit(0)), F.coalesce("own", "found", F.lit(0))
    nth: Column = F.when(F.count("*").over(W.partitionBy(*key)) > 1, F.row_number().over(W.partitionBy(*key).orderBy("time")))
    return t.select(*key, nth.alias("nth"), cost.alias("cost"), gain.alias("gain"), (gain - cost).alias("net"))
