"""Game logs as text: lines (game_id, line_no, line) to players' actions, credit pools, series, outcomes and achievements.

A line is read as words: who acts (what stands before the first of VERBS), then clauses, cut at " to ", each of a verb and what it is about.
What a clause names is cut off at the words that say where and why. Every step is a projection, a window or an aggregation by game and player.
What a line says in quotes is a card's printed wording and counts for nothing where amounts are read. A turn line without printed credits and
hand is no boundary: there is nothing to set the pool to.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The wording of the logs.
PRONOUNS = ("his", "her", "their", "its", "faer", "nir", "vis", "eir", "hir", "zir", "xyr", "xir")
PRONOUN = f"(?:{'|'.join(PRONOUNS)})"
VERBS = (
    "accesses", "approaches", "breaches", "declines", "discards", "encounters", "forfeits", "has", "indicates", "installs", "is", "jacks", "makes", "must",
    "passes", "pays", "resolves", "scores", "sets", "spends", "started", "steals", "takes", "trashes", "uses", "will", "wins",
)
CENTRALS = ("HQ", "R&D", "Archives")
ZONES = [f" {at} {root}{zone}" for at in ("from", "in") for root in ("", "the root of ") for zone in ("Server", *CENTRALS)]
DAMAGE = ("net", "meat", "core")
STAMP = r"\[\d{1,2}:\d{2}:\d{2}\]"
BASIC = r"\buses?\s+(Corp|Runner) Basic Action Card to "
CLICK_GAINS = {"nanomanagement": 2}
AGENDA_POINTS = {"regenesis": 1, "fujii asset retrieval": 3, "sisyphus protocol": 2, "longevity serum": 2, "hybrid release": 1, "blood in the water": 2, "let them dream": 2, "send a message": 3}
POOL_START, WINNING_SCORE = 5, 7


def number(text: Column, pattern: str, group: int = 1) -> Column:
    """The group as a number; NULL where the pattern isn't found or the group is empty."""
    return F.regexp_extract(text, pattern, group).try_cast("int")


def said(text: Column, pattern: str, group: int = 1) -> Column:
    """The group trimmed; NULL where the pattern isn't found."""
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, group)))


def total(text: Column, pattern: str, group: int = 1) -> Column:
    """The sum of all matches."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0), lambda a, x: a + x.cast("int"))


def trimmed(text: Column) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def up_to(text: Column, *marks: str) -> Column:
    """What stands before the first of the marks, all of it where there is none."""
    return reduce(lambda t, m: F.substring_index(t, m, 1), marks, text)


def beyond(text: Column, mark: str) -> Column:
    """What stands after the first of the marks; NULL where there is none."""
    return F.when(F.contains(text, F.lit(mark)), F.substr(text, F.locate(mark, text) + len(mark)))


def digits(text: Column) -> Column:
    """The sum of all numbers in it."""
    return total(text, r"(\d+)")


def leading(text: Column) -> Column:
    """The number that it begins with."""
    return number(text, r"^\s*\+?(-?\d+)\b")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has(text: Column, *parts: str) -> Column:
    """Whether one of the parts stands in it. What a pattern can't be found without is looked for first, as that costs far less; where a
    pattern takes capitals for small letters, in the text in small letters."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def spaced(text: Column) -> Column:
    """Its words with one space between them."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def named_before_verb(line: Column) -> Column:
    """Who acts: the words before the first verb, NULL where there is no verb or nothing before it."""
    return F.nullif(spaced(F.regexp_extract(line, rf"(?s)^(.*?\S)\s+(?:{'|'.join(VERBS)})(?!\w)", 1)), F.lit(""))


def clauses(line: Column, player: Column) -> Column:
    """The line after the player's name, as an array of (verb, about): it is cut at " to ", and each clause after its first word."""
    rest = F.regexp_replace(spaced(F.substr(line, F.length(player) + 1)), r"\.$", "")
    return F.transform(F.split(rest, " to "), lambda c: F.struct(F.substring_index(c, " ", 1).alias("verb"), F.trim(F.coalesce(beyond(c, " "), F.lit(""))).alias("about")))


def about(deeds: Column, *verbs: str) -> Column:
    """What the first clause of one of the verbs is about; NULL where there is none."""
    return F.get(F.filter(deeds, lambda d: d["verb"].isin(*verbs)), F.lit(0))["about"]


def place_of(deeds: Column, *verbs: str) -> Column:
    """The place of the first clause of one of the verbs, from 1; 0 where there is none."""
    return F.array_position(F.transform(deeds, lambda d: d["verb"].isin(*verbs)), True).cast("int")


def paid_for(deeds: Column, *verbs: str) -> Column:
    """The clause before the first one of the verbs from "pays" on: what doing it costs; NULL where nothing is paid."""
    c = F.get(deeds, place_of(deeds, *verbs) - 2)
    return F.when(place_of(deeds, *verbs) > 1, beyond(F.concat(F.lit(" "), c["verb"], F.lit(" "), c["about"], F.lit(" ")), " pays "))


def gain_of_card(deeds: Column) -> Column:
    """(card, amount): what a used card gives. It is told by the clause after the card, by a part of a clause after "and" or "then", or by a
    later clause, in this order; the amount is NULL where the number isn't readable. NULL where nothing is gained."""
    direct = lambda d: F.filter(d, lambda x: F.lower(x["verb"]) == "gain")["about"]

    def told(rest: Column) -> Column:
        parts = F.flatten(F.transform(rest, lambda d: F.slice(F.split(d["about"], r" (?:and|then) (?:then )?"), 2, 99)))
        joined_on = F.transform(F.filter(parts, lambda p: p.rlike(r"^gain\b")), lambda p: F.substr(p, F.lit(5)))
        return F.coalesce(F.get(direct(F.slice(rest, 1, 1)), F.lit(0)), F.get(joined_on, F.lit(0)), F.get(direct(rest), F.lit(0)))

    def given(at: Column) -> Column:
        said_, card = once(F.slice(deeds, at + 1, F.size(deeds) - at), told), F.get(deeds, at - 1)["about"]
        return F.when((at > 0) & (card != ""), once(said_, lambda x: F.when(x.isNotNull(), F.struct(card.alias("card"), leading(x).alias("amount")))))

    return once(place_of(deeds, "uses", "use"), given)


def trashed_cards(line: Column) -> Column:
    """(cards, there, server): what a line trashes, whether from where only the corp's cards are, and from which server. Cards that damage
    discards are none. NULL for other lines."""
    def said_of(object_: Column, rest: Column) -> Column:
        there = reduce(lambda a, b: a | b, [rest.startswith(z) for z in ZONES])
        server = F.when(there, up_to(F.regexp_replace(rest, r"^ (?:from|in) ", ""), " to ", " and ", ","))
        cards = F.filter(F.transform(F.split(object_, " and "), clean_name), lambda c: c != "")
        return F.struct(cards.alias("cards"), there.alias("there"), server.alias("server"))

    def parts(text: Column) -> Column:
        object_ = up_to(text, " to use ", " from the root", *[f" from {z}" for z in ("Server", *CENTRALS)], " in Server", " due to")
        return once(object_, lambda o: once(F.substr(text, F.length(o) + 1), lambda rest: said_of(o, rest)))

    text = F.regexp_replace(line, r"\.$", "")
    text = F.coalesce(beyond(text, " trashes "), beyond(text, " trash "))
    harm = has(F.lower(line), *[f" due to {kind} damage" for kind in DAMAGE])
    return F.when(has(line, " trash") & ~harm, once(text, lambda t: F.when(t.isNotNull(), parts(t))))


def unquoted(line: Column) -> Column:
    return F.when(has(line, '"'), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)


def clean_name(raw: Column) -> Column:
    """A card's name without its closing dot, a discount, what it is put on and where it comes from."""
    for pattern in (r"\.$", r"(?i)\(paying\s*\d+\s*less\)", r"(?i)\s+on\s+.+$", r"(?i)\s+from\s+(?:the\s+)?(?:Grip|HQ|R&D|Archives|root(?:\s+of\s+.+)?)\b.*$"):
        raw = F.trim(F.regexp_replace(F.trim(raw), pattern, ""))
    return raw


def joined(raw: DataFrame) -> DataFrame:
    """The lines of pasted logs as one line an entry, trimmed, without blank ones, numbered from 0.

    A time glued to a name goes. In logs with times on lines of their own these lines go, and a line is joined to the indented one after
    it; of several indented lines every other one begins anew.
    """
    game, at = W.partitionBy("game_id"), W.partitionBy("game_id").orderBy("line_no")
    bracket = has(F.col("line"), "[")
    r = raw.withColumn("line", F.when(bracket, F.regexp_replace("line", rf"(\S){STAMP}", "$1")).otherwise(F.col("line")))
    r = r.withColumn("mark", bracket & F.col("line").rlike(rf"^\s*{STAMP}\s*$"))
    r = r.withColumn("timed", F.max("mark").over(game)).filter("not mark").filter(F.col("line").rlike(r"\S"))
    r = r.withColumn("group", F.sum(F.when(F.col("line").rlike(r"^[ \t]"), 0).otherwise(1)).over(at))
    group = W.partitionBy("game_id", "group").orderBy("line_no")
    r = r.withColumn("k", F.row_number().over(group)).withColumn("after", F.lead("line").over(group))
    r = r.filter("not timed or k % 2 = 1")
    line = F.when(F.col("timed") & F.col("after").isNotNull(), F.concat(trimmed(F.col("line")), "after")).otherwise(F.col("line"))
    return r.select("game_id", (F.row_number().over(at) - 1).alias("line_no"), trimmed(line).alias("line"))


def badges(lines: DataFrame) -> DataFrame:
    """(game_id, player, glhf, gg, ty, egg, saved_replay): courtesies and one oath in the chat, where a name stands twice and then what was said."""
    at = W.partitionBy("game_id").orderBy("line_no")
    c = lines.withColumn("next", F.lead("line").over(at)).withColumn("text", F.lead("line", 2).over(at))
    chat = F.col("line").rlike(r"^[^\s.]+$") & (F.length("line") < 40) & (F.col("line") == F.col("next")) & F.col("text").isNotNull()
    c = c.select("game_id", F.when(chat, F.col("line")).otherwise(said(F.col("line"), r"(?i)^!(.+?)\s+uses a command:\s*/save-replay\b")).alias("player"), F.when(chat, F.col("text")).alias("text")).filter("player is not null")
    has = lambda p: F.coalesce(F.max(F.col("text").rlike(p)), F.lit(False))
    return c.groupBy("game_id", "player").agg(
        has(r"(?i)\b(glhf|gl\s*hf|good luck|have fun)\b").alias("glhf"), has(r"(?i)\bgg\b").alias("gg"), has(r"(?i)\b(ty4tg|tftg|thank you for the game|thanks for the game|thank you)\b").alias("ty"), has("(?i)kurw[aąeęioy]").alias("egg"), F.max(F.col("text").isNull()).alias("saved_replay")
    )


def read(lines: DataFrame) -> DataFrame:
    """Each line with what it is (kind: start, end, win, flatlined, decked, mulligan, or player for a line of a player who had a turn), who
    says it, the turn (the player's own), seq (turns of either so far), the player's side as far as known, printed credits and hand."""
    line = F.col("line")
    boundary = lambda verb: up_to(line, f" {verb} ")
    printed = rf"{PRONOUN} turn (\d+) with (\d+)\s+and (\d+) cards? in"
    turn = lambda verb: F.when(F.regexp_replace(F.coalesce(beyond(line, f" {verb} "), F.lit("")), r"\s+", " ").rlike("^" + printed), trimmed(boundary(verb)))
    started_by, ended_by = turn("started"), turn("is ending")
    ended = {"win": "wins the game", "flatlined": "is flatlined", "decked": "is decked", "mulligan": "takes a mulligan"}
    tell = lambda kind, said_: F.when(line.endswith(f" {said_}") | line.endswith(f" {said_}.") | (F.contains(line, F.lit(f" {said_}")) if kind == "win" else F.lit(False)), trimmed(up_to(line, f" {said_}")))
    told = {k: tell(k, v) for k, v in ended.items()}
    given_up = F.when(line.rlike(r"(?i)\sconcedes?\b"), trimmed(F.regexp_extract(line, r"(?i)^(.+?)\sconcedes?\b", 1)))
    # what several columns read is a column, made once a line
    r = lines.repartition("game_id").select("game_id", "line_no", "line", started_by.alias("start"), ended_by.alias("end"), *[v.alias(k) for k, v in told.items()])
    kind = reduce(lambda c, k: c.when(F.col(k).isNotNull(), k), [*ended, "start", "end"], F.when(F.lit(False), None))
    who = F.coalesce("start", "end", *ended, named_before_verb(line), given_up)
    pick = lambda group: F.when(F.col("kind").isin("start", "end"), number(line, printed, group))
    r = r.select("game_id", "line_no", "line", kind.alias("kind"), who.alias("player")).select("*", pick(1).alias("printed_turn"), pick(2).alias("credits"), pick(3).alias("hand"))
    own = W.partitionBy("game_id", "player").orderBy("line_no")
    so_far = own.rowsBetween(W.unboundedPreceding, 0)
    started, bound = F.col("kind") == "start", F.col("kind").isin("start", "end")
    r = r.withColumn("known", F.max(F.when(bound, 1)).over(own.rowsBetween(W.unboundedPreceding, -1)).isNotNull())
    r = r.withColumn("kind", F.coalesce("kind", F.when(F.col("known"), "player")))
    actions = F.when((F.col("kind") == "player") & has(line, " Basic Action Card to ") & line.rlike(BASIC + r"(?:gain|draw 1 card|remove 1 tag|trash |advance\b|purge virus counters)"), F.lower(F.regexp_extract(line, BASIC, 1)))
    by_hand = F.when(started, F.when(line.rlike(r"\bcards? in HQ\b"), "corp").otherwise("runner"))
    r = r.withColumn("side", F.coalesce(F.last(actions, ignorenulls=True).over(so_far), F.first(by_hand, ignorenulls=True).over(so_far)))
    r = r.withColumn("turn", F.coalesce(F.last(F.when(started, F.col("printed_turn")), ignorenulls=True).over(so_far), F.lit(0)))
    return r.withColumn("seq", F.sum(F.when(started, 1).otherwise(0)).over(W.partitionBy("game_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))).drop("known")


def players(log: DataFrame) -> DataFrame:
    """(game_id, player, side, first_line, rounds): those who had a turn; more than two of them are no game that is understood."""
    p = log.filter("kind in ('start', 'end', 'player')").groupBy("game_id", "player").agg(F.max_by("side", "line_no").alias("side"), F.min("line_no").alias("first_line"), F.max("printed_turn").alias("rounds"))
    n = F.count("*").over(W.partitionBy("game_id"))
    return p.withColumn("n", n).filter("n <= 2").drop("n")


def with_sides(log: DataFrame, who: DataFrame) -> DataFrame:
    """Player lines with the corp's and the runner's player, each from its first turn on, and the line's clauses."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("player", "first_line"))).alias(s)
    s = who.groupBy("game_id").agg(side("corp"), side("runner"), F.max("rounds").alias("game_rounds"))
    since = lambda s: F.when(F.col(f"{s}.first_line") < F.col("line_no"), F.col(f"{s}.player"))
    x = log.filter("kind = 'player'").join(s, "game_id")
    return x.withColumn("corp_player", since("corp")).withColumn("runner_player", since("runner")).drop("corp", "runner").withColumn("deeds", clauses(F.col("line"), F.col("player")))


def pool_spend(scan: Column) -> Column:
    """Credits that a "pays" takes out of the pool: the amount itself, or of amounts with sources those from the credit pool."""
    return F.when(has(scan, "pays"), once(up_to(F.regexp_extract(scan, r"\bpays\s+(\d.*)$", 1), " to "), _from_pool))


def _from_pool(span: Column) -> Column:
    shares = F.filter(F.split(span, r"\s*,\s*(?:and )?|\s+and\s+"), lambda x: F.contains(F.lower(x), F.lit("credit pool")))
    from_pool = F.aggregate(shares, F.lit(0), lambda n, x: n + F.coalesce(leading(x), F.lit(0)))
    return F.when(span == "", None).when(span.rlike(r"^\d+\s*from\b"), from_pool).otherwise(leading(span))


def credit_events(lines: DataFrame) -> DataFrame:
    """(game_id, player, line_no, seq, place, amount, forced) from with_sides(): gains and spends in the order in which a line's take effect."""
    scan, low, side = F.col("scan"), F.col("low"), F.col("side")
    gain = r"(?i)%s\bgains?\s+(\d+)(?!\s*agenda)"
    summed = lambda pattern, *parts: F.when(reduce(lambda a, b: a & b, [has(low, p) for p in parts]), total(scan, pattern)).otherwise(0)
    found = lambda pattern, *parts: F.when(has(low, *parts), number(scan, pattern))
    other = F.when(side == "runner", F.lit("corp")).otherwise(F.lit("runner"))
    # of a gain whose 25 characters before name the other side, that side's player gets the credits
    aside = F.when(side == "runner", summed(gain % r"(?<=\bCorp\b.{0,21})", "gain", "corp")).otherwise(summed(gain % r"(?<=\bRunner\b.{0,19})", "gain", "runner"))
    of = lambda s: F.coalesce(F.when(s == "corp", F.col("corp_player")).otherwise(F.col("runner_player")), F.col("player"))
    forced_side = F.lower(F.regexp_extract(scan, r"(?i)\bforce\s+the\s+(Runner|Corp)\s+to\s+pay\s+(\d+)\b", 1))
    set_to = F.when(has(F.lower("line"), "sets credit"), number(F.col("line"), r"(?i)\bsets credits? to (-?\d+) \(\+?(-?\d+)\)", 2))
    # what several events read is a column, made once a line
    lines = lines.withColumn("scan", unquoted(F.col("line"))).withColumn("low", F.lower(scan))
    lines = lines.withColumns({"aside": aside, "forced_pay": found(r"(?i)\bforce\s+the\s+(?:Runner|Corp)\s+to\s+pay\s+(\d+)\b", "force")})
    aside, forced_pay = F.col("aside"), F.col("forced_pay")
    entry = lambda place, who, amount, forced=False: F.struct(F.lit(place).alias("place"), who.alias("player"), amount.cast("int").alias("amount"), F.lit(forced).alias("forced"))
    me = F.col("player")
    lose = lambda s: (F.lit(s), summed(rf"(?i)\b(?:force|forces|make|makes)\s+the\s+{s}\s+(?:to\s+)?lose\s+(\d+)\b", "lose"))
    events = F.array(
        entry(0, me, summed(gain % "", "gain") - aside),
        entry(1, of(other), aside),
        entry(2, me, found(r"(?i)\buses?\s+.+?\s+to\s+take\s+(\d+)\s*\.?\s*$", "take")),
        *[entry(3 + k, of(s), -n, True) for k, (s, n) in enumerate(map(lose, ("corp", "runner")))],
        entry(5, me, -pool_spend(scan)),
        entry(6, F.when(forced_pay.isNotNull(), of(forced_side)).otherwise(me), -F.coalesce(forced_pay, found(r"(?i)\bto\s+pay\s+(\d+)\b", "pay"))),
        entry(7, me, set_to),
    )
    e = lines.select("game_id", "line_no", "seq", F.explode(events).alias("e")).filter("e.amount <> 0")
    return e.select("game_id", "e.player", "line_no", "seq", "e.place", "e.amount", "e.forced")


def pools(log: DataFrame, events: DataFrame) -> DataFrame:
    """(game_id, player, line_no, place, seq, turn, printed, before, pool, change, segment): each player's credit pool, reset to the printed
    value at the start and end of turns (place -1), and what each event really changed: a forced loss takes at most what is there, and nothing
    of a pool that is below zero already.

    Printed values cut a game into segments that don't depend on each other. Within one, the pool is the plain sum plus what forced losses
    couldn't take. While the pool isn't below zero, that is the furthest that the sum has been below zero at a forced loss so far: a running
    sum and a running maximum, so a segment of any length takes linear time. Only segments where a forced loss meets a pool below zero are
    folded in order (logs that don't add up have such).
    """
    anchors = log.filter("kind in ('start', 'end')").select("game_id", "player", "line_no", "seq", F.lit(-1).alias("place"), F.lit(0).alias("amount"), F.lit(False).alias("forced"), F.col("credits").alias("printed"), F.when(F.col("kind") == "start", F.col("printed_turn")).alias("turn"))
    every = anchors.unionByName(events.withColumn("printed", F.lit(None).cast("int")).withColumn("turn", F.lit(None).cast("int")))
    at = W.partitionBy("game_id", "player").orderBy("line_no", "place")
    so_far = at.rowsBetween(W.unboundedPreceding, 0)
    every = every.withColumn("segment", F.count("printed").over(so_far)).withColumn("turn", F.coalesce(F.last("turn", ignorenulls=True).over(so_far), F.lit(0)))
    within = W.partitionBy("game_id", "player", "segment").orderBy("line_no", "place")
    until = within.rowsBetween(W.unboundedPreceding, 0)
    every = every.withColumn("plain", F.first("printed").over(until) + F.sum("amount").over(until))
    every = every.withColumn("pool", F.col("plain") + F.greatest(F.lit(0), F.max(F.when(F.col("forced"), -F.col("plain"))).over(until)))
    below = F.col("forced") & (F.lag("pool").over(within) < 0)
    every = every.withColumn("folded", F.coalesce(F.max(below).over(W.partitionBy("game_id", "player", "segment")), F.lit(False)))
    columns = ["game_id", "player", "line_no", "place", "seq", "turn", "printed", "amount", "forced", "segment", "pool"]
    p = every.filter("not folded").select(*columns).union(_folded(every.filter("folded")).select(*columns))
    p = p.withColumn("before", F.lag("pool").over(at))
    change = F.when(F.col("place") >= 0, F.when(~F.col("forced"), F.col("amount")).otherwise(F.coalesce(F.col("pool") - F.col("before"), F.lit(0))))
    return p.select("game_id", "player", F.col("line_no").cast("int").alias("line_no"), "place", "seq", F.col("turn").cast("int").alias("turn"), "printed", F.col("before").cast("int").alias("before"), F.col("pool").cast("int").alias("pool"), change.cast("int").alias("change"), "segment")


def _folded(rows: DataFrame) -> DataFrame:
    """rows of whole segments with the pool event by event."""
    item = F.struct("line_no", "place", "seq", "turn", "printed", "amount", "forced")
    g = rows.groupBy("game_id", "player", "segment").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(pools_: Column, x: Column) -> Column:
        now = F.element_at(pools_, -1)
        lost = F.when(x["forced"], F.greatest(x["amount"], F.least(F.lit(0), -now))).otherwise(x["amount"])
        return F.concat(pools_, F.array(F.coalesce(x["printed"].cast("long"), now + lost)))

    pool = F.aggregate("items", F.array(F.lit(0).cast("long")), step)
    return g.select("game_id", "player", "segment", F.explode(F.arrays_zip("items", F.slice(pool, 2, F.size("items")).alias("pool"))).alias("z")).select("game_id", "player", "segment", "z.items.*", "z.pool")


def segments(pool: DataFrame) -> DataFrame:
    """(game_id, player, segment, start, derived, expected, ok, peak) of each stretch between printed values. Its peak is corrected downward
    by what a stretch that doesn't add up is above the printed value; of the last one derived, expected and ok are NULL."""
    w = W.partitionBy("game_id", "player").orderBy("segment")
    s = pool.groupBy("game_id", "player", "segment").agg(F.max("printed").alias("start"), F.max(F.when(F.col("place") >= 0, F.col("pool"))).alias("top"), F.max_by("pool", F.struct("line_no", "place")).alias("end"))
    s = s.withColumn("expected", F.lead("start").over(w)).withColumn("derived", F.when(F.col("expected").isNotNull(), F.col("end")))
    peak = F.greatest("start", "expected", F.col("top") + F.coalesce(F.least(F.lit(0), F.col("expected") - F.col("derived")), F.lit(0)))
    return s.select("game_id", "player", "segment", "start", "derived", "expected", (F.col("derived") == F.col("expected")).alias("ok"), peak.alias("peak"))


def zone(raw: Column) -> Column:
    """Which zone a place is in, tried in this order."""
    rules = [("(?i)the root of R&D", "RD"), ("(?i)the root of HQ", "HQ"), ("(?i)the root of Archives", "Archives"), ("(?i)the root of Server", "remote"), ("(?i)^HQ", "HQ"), ("(?i)^R&D", "RD"), ("(?i)^Archives", "Archives"), (r"(?i)Server\s*\d+", "remote")]
    return reduce(lambda c, r: c.when(F.trim(raw).rlike(r[0]), r[1]), rules, F.when(F.lit(False), None))


def titles(raw: Column) -> Column:
    return F.filter(F.split(raw, r"\s*,\s*(?:and\s+)?|\s+and\s+"), lambda x: x != "")


def agenda_events(lines: DataFrame) -> DataFrame:
    """(game_id, player, line_no, place, turn, seq, title, points) of player lines: stolen, scored and added agendas, corrections by hand,
    agendas revealed into a score area, forfeits (the points last remembered of that title, else of the fixed list, else NULL)."""
    line = F.col("line")
    deeds = F.col("deeds")
    taken = about(deeds, "steals", "scores")
    taken = F.when(F.contains(taken, F.lit(" agenda point")) & leading(beyond(taken, " and gains ")).isNotNull(), F.struct(up_to(taken, " and gains ").alias("t"), leading(beyond(taken, " and gains ")).alias("p")))
    # "uses X to add itself to their score area as an agenda worth 2 points": the third clause says what it is worth
    added = F.lower(F.get(deeds, place_of(deeds, "add"))["about"])
    added = F.when((about(deeds, "add") == "itself") & added.startswith("score area as an agenda worth "), F.struct(about(deeds, "uses", "use").alias("t"), number(added, r"worth (-?\d+)").alias("p")))
    shown, shown_to = about(deeds, "reveal"), F.get(deeds, place_of(deeds, "reveal"))
    shown = F.when(shown.endswith(" and add it") & shown_to["verb"].isin(*PRONOUNS) & shown_to["about"].startswith("score area"), up_to(up_to(shown, " and add it"), " from "))
    lost = about(deeds, "forfeits")
    lost = titles(F.when(lost.rlike(r"^\d+ agendas? \("), F.rtrim(beyond(lost, "("), F.lit(")"))).otherwise(lost))
    known = F.create_map(*[F.lit(x) for pair in AGENDA_POINTS.items() for x in pair])
    key = lambda raw: F.lower(clean_name(raw))
    entry = lambda place, title, points, forfeit=False: F.struct(F.lit(place).alias("place"), title.alias("title"), points.cast("int").alias("points"), F.lit(forfeit).alias("forfeit"))
    scored = F.coalesce(taken, added)
    shown = key(shown)
    none = F.lit(None).cast("string")
    one = F.array(entry(0, key(scored["t"]), scored["p"]), entry(1, none, number(line, rf"(?i)\bsets {PRONOUN} agenda points? to (-?\d+) \(\+?(-?\d+)\)", 2)), entry(3, shown, F.try_element_at(known, shown)))
    every = F.concat(one, F.coalesce(F.transform(lost, lambda t: entry(2, key(t), F.lit(None), True)), F.array().cast("array<struct<place:int,title:string,points:int,forfeit:boolean>>")))
    # only lines with one of these words have an entry
    e = lines.filter(has(line, "steals", "scores", "add", "reveal", "forfeits") | has(F.lower(line), "sets "))
    e = e.select("game_id", "player", "line_no", "turn", "seq", F.explode(every).alias("e")).select("game_id", "player", "line_no", "turn", "seq", "e.*").filter("points is not null or forfeit")
    before = W.partitionBy("game_id", "player", "title").orderBy("line_no", "place")
    remembered = F.lag(F.when(~F.col("forfeit"), F.col("points"))).over(before)
    points = F.when(F.col("forfeit"), -F.coalesce(remembered, F.try_element_at(known, F.col("title")))).otherwise(F.col("points"))
    return e.select("game_id", "player", "line_no", "place", "turn", "seq", "title", points.alias("points"))


STATS = [
    "click_credits", "click_credits_gained", "draw_clicks", "clicks_gained", "tag_removals", "tag_removal_cost", "trash_resources", "trash_resource_cost", "advances", "advance_cost", "purges", "installs", "rezzed", "draws",
    "tags_given", "tags_taken", "runs", "plays", "access_hq", "access_rd", "access_archives", "access_remote", "breach_hq", "breach_rd", "breach_archives", "zone_trashes",
]


def stats(lines: DataFrame) -> DataFrame:
    """(game_id, player, STATS...): what each player did, from with_sides()."""
    line, low, deeds = F.col("line"), F.col("low"), F.col("deeds")
    scan = unquoted(line)
    count = lambda c: F.count_if(c)
    # what several statistics read is a column, made once a line
    lines = lines.withColumn("low", F.lower("line")).withColumn("given", F.when(has(low, "gain"), gain_of_card(deeds))).withColumn("gone", trashed_cards(line))
    given, gone = F.col("given"), F.col("gone")
    reached = F.coalesce(*[F.when(line.rlike(p), zone(F.regexp_extract(line, p, 1))) for p in (r"(?i)\baccesses\s+.+?\s+from\s+(.+?)\.?$", r"(?i)\baccesses everything else in\s+(.+?)\.?$")])
    breached = once(F.regexp_extract(line, r"(?i)\bbreaches\s+(.+?)\.?$", 1), zone)
    lines = lines.withColumn("gained", F.when(given.isNotNull(), F.struct(clean_name(given["card"]).alias("card"), given["amount"].alias("n"))))
    lines = lines.withColumns({"reached": F.when(has(low, "accesses"), reached), "breached": F.when(has(low, "breaches"), breached), "by_action": has(low, "basic action card")})
    gained, by_action = F.col("gained"), F.col("by_action")
    said_so = lambda p: by_action & line.rlike(p)
    cost = lambda p: F.coalesce(F.sum(F.when(by_action, number(line, p))), F.lit(0))
    tags = lambda p: F.coalesce(F.sum(F.when(has(low, "tag"), number(scan, p))), F.lit(0))
    basic = gained["card"].rlike("(?i)(corp|runner) basic action card")
    bonus = F.create_map(*[F.lit(x) for pair in CLICK_GAINS.items() for x in pair])
    clicks = F.when(gained.isNotNull() & ~basic & gained["n"].isNull(), F.coalesce(F.try_element_at(bonus, F.lower(gained["card"])), F.lit(1)))
    mandatory = has(line, "mandatory") & line.rlike(rf"\bmakes {PRONOUN} mandatory start of turn draw\b")
    draws = F.when(mandatory, 1).otherwise(0) + F.coalesce(F.when(has(low, "draw"), number(line, r"(?i)\bdraws?\s+(\d+)\s+cards?\b")), F.lit(0))
    removed, resource, advanced = r"pays\s+(\d+)\s+to use Runner Basic Action Card to remove 1 tag", r"(?i)pays\s+(\d+)\s+to use Corp Basic Action Card to trash (?:a |an )?resource", r"(?i)pays\s+(\d+)\s+to use Corp Basic Action Card to advance\b"
    by_ability = (place_of(deeds, "uses", "use") > 0) & (place_of(deeds, "uses", "use") < place_of(deeds, "install"))
    installed = has(line, "install") & (place_of(deeds, "install") > 1) & ~by_ability
    played = once(F.when(has(line, "play") & (place_of(deeds, "play") > 1), clean_name(about(deeds, "play"))), lambda x: x.isNotNull() & ~x.rlike("(?i)basic action card"))
    # cards that the runner trashes where only the corp's can be
    named = F.size(F.filter(F.when((F.col("side") == "runner") & gone["there"], gone["cards"]), lambda t: ~t.rlike(UNNAMED)))
    in_zone = lambda z, where: count(F.col(where) == z)
    values = [
        count(basic), F.coalesce(F.sum(F.when(basic, gained["n"])), F.lit(0)), count(said_so(r"to use (?:Corp|Runner) Basic Action Card to draw 1 card")), F.coalesce(F.sum(clicks), F.lit(0)),
        count(said_so(removed)), cost(removed), count(said_so(resource)), cost(resource), count(said_so(advanced)), cost(advanced), count(said_so(r"(?i)\bto use Corp Basic Action Card to purge virus counters\b")),
        count(installed), count(has(line, "rez") & rezzed(deeds).isNotNull()), F.sum(draws), tags(r"(?i)\bgives?\s+the Runner (\d+) tags?"), tags(r"(?i)\btakes?\s+(\d+)\s+tags?"), count(has(low, "a run on") & line.rlike(r"(?i)\bmakes? a run on\b")),
        count(played), *[in_zone(z, "reached") for z in ("HQ", "RD", "Archives", "remote")], *[in_zone(z, "breached") for z in ("HQ", "RD", "Archives")], F.coalesce(F.sum(F.when(named > 0, named)), F.lit(0)),
    ]
    return lines.groupBy("game_id", "player").agg(*[v.cast("long").alias(n) for n, v in zip(STATS, values, strict=True)])


#: What stands for a card without naming it.
UNNAMED = r"(?i)^(?:a card|an? (?:installed|facedown|hosted)|hosted|itself|the top|all)\b"


def rezzed(deeds: Column) -> Column:
    """(card, server) of a clause that rezzes a card in or protecting a server."""
    text = F.when(place_of(deeds, "rez") > 1, about(deeds, "rez"))
    server = F.coalesce(beyond(text, " protecting "), beyond(text, " in "))
    return F.when(server.isNotNull(), F.struct(up_to(text, " protecting ", " in ").alias("card"), F.trim(up_to(server, " at position ")).alias("server")))


def opened(lines: DataFrame) -> DataFrame:
    """(game_id, player, line_no, turn, seq, kind, card, server, cost): cards that come into play, each install and rez a copy of its own.
    Installs that only say where (a card in a server, ice) name no card and open nothing; they count as actions all the same."""
    deeds = F.col("deeds")
    raw = F.when(place_of(deeds, "install") > 1, F.trim(about(deeds, "install")))
    unnamed = reduce(lambda a, b: a | b, [F.lower(raw).startswith(x) for x in ("a card in", "a card from", "ice protecting")])
    cost = lambda verb: F.coalesce(digits(paid_for(deeds, verb)), F.lit(0))
    none = F.lit(None).cast("string")
    entry = lambda kind, card, server, paid: F.struct(F.lit(kind).alias("kind"), card.alias("card"), server.alias("server"), paid.alias("cost"))
    installs = F.when(raw.isNotNull() & ~unnamed, entry("install", clean_name(raw), none, cost("install")))
    rez = rezzed(deeds)
    rezzes = F.when(rez.isNotNull(), entry("rez", clean_name(rez["card"]), rez["server"], cost("rez")))
    o = lines.select("game_id", "player", "line_no", "turn", "seq", F.explode(F.array_compact(F.array(installs, rezzes))).alias("o"))
    return o.select("game_id", "player", "line_no", "turn", "seq", "o.*").filter("card <> ''")


def opposing_trashes(lines: DataFrame, cards: DataFrame) -> DataFrame:
    """(game_id, player, trashes): cards of the opponent that a player trashed: the runner's from where only the corp's can be, and those of
    a name that so far the opponent alone brought into play (cards: opened()). Placeholders and cards discarded by damage don't count."""
    gone = trashed_cards(F.col("line"))
    t = lines.filter(gone.isNotNull())
    there = (F.col("side") == "runner") & gone["there"]
    t = t.select("game_id", "player", "line_no", F.coalesce(there, F.lit(False)).alias("there"), F.posexplode(gone["cards"]).alias("k", "card")).filter(~F.col("card").rlike(UNNAMED))
    t = t.join(owners(cards), ["game_id", "card"], "left")
    brought = lambda whose: F.coalesce(F.exists("owners", lambda o: whose(o["player"], F.col("player")) & (o["since"] <= F.col("line_no"))), F.lit(False))
    theirs, own = brought(lambda o, p: o != p), brought(lambda o, p: o == p)
    return t.filter(F.col("there") | (theirs & ~own)).groupBy("game_id", "player").agg(F.count("*").alias("trashes"))


def owners(cards: DataFrame) -> DataFrame:
    """(game_id, card, owners): a row a game and card, with each player who brought it into play and from which line on. A line that names
    the card meets one row, however often it came into play."""
    first = cards.groupBy("game_id", "card", "player").agg(F.min("line_no").alias("since"))
    return first.groupBy("game_id", "card").agg(F.collect_list(F.struct("player", "since")).alias("owners"))


def damage(lines: DataFrame) -> DataFrame:
    """(game_id, player, damage_taken): the runner's, whoever's line it is; a line without cards is one point."""
    line = F.lower("line")
    hit = F.contains(line, F.lit("trashes")) & reduce(lambda a, b: a | b, [F.contains(line, F.lit(f" due to {kind} damage")) for kind in (*DAMAGE, "brain")])
    listed = F.trim(F.substring_index(up_to(F.col("line"), " due to "), "trashes", -1))
    n = F.when(listed == "", 1).otherwise(F.size(titles(listed)))
    return lines.filter(hit & F.col("runner_player").isNotNull()).groupBy("game_id", F.col("runner_player").alias("player")).agg(F.sum(n).alias("damage_taken"))


def results(log: DataFrame, who: DataFrame, lines: DataFrame, agendas: DataFrame) -> DataFrame:
    """(game_id, player, side, rounds, won, win_reason, final_score, flatlined, mulligan): how the game ended for each player. The last line
    of each kind counts; flatline comes before decking, conceding and the score."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("player")), F.when(F.col("kind") == kind, F.col("line_no")))
    ends = log.groupBy("game_id").agg(*[last(k).alias(k) for k in ("win", "flatlined", "decked")], F.collect_set(F.when(F.col("kind") == "mulligan", F.col("player"))).alias("mulligans"))
    given_up = lines.filter(F.col("line").rlike(r"(?i)^(.+?)\s+concedes?\b")).groupBy("game_id").agg(F.max_by(F.trim(F.regexp_extract("line", r"(?i)^(.+?)\s+concedes?\b", 1)), "line_no").alias("conceded"))
    score = agendas.groupBy("game_id", "player").agg(F.coalesce(F.sum("points"), F.lit(0)).alias("final_score"))
    r = who.join(ends, "game_id").join(given_up, "game_id", "left").join(score, ["game_id", "player"], "left").fillna({"final_score": 0})
    game = W.partitionBy("game_id")
    r = r.withColumn("won", F.coalesce(F.col("win") == F.col("player"), F.lit(False))).withColumn("score_of_winner", F.max(F.when(F.col("won"), F.col("final_score"))).over(game)).withColumn("game_rounds", F.max("rounds").over(game))
    reason = F.when(F.col("win").isNull(), None)
    for column, name in (("flatlined", "flatline"), ("decked", "decked"), ("conceded", "concede")):
        reason = reason.when(F.col(column) != F.col("win"), name)
    reason = reason.when(F.col("score_of_winner") >= WINNING_SCORE, "agenda")
    return r.select("game_id", "player", "side", F.col("game_rounds").alias("rounds"), "won", reason.alias("win_reason"), "final_score", F.coalesce(F.col("flatlined") == F.col("player"), F.lit(False)).alias("flatlined"), F.array_contains("mulligans", F.col("player")).alias("mulligan"))


def trailing(agendas: DataFrame, who: DataFrame) -> DataFrame:
    """(game_id, player, trailed, opponent_gained): whether the player was ever at nothing or below while the opponent had six points or more."""
    a = agendas.filter("points is not null").join(who.select("game_id", F.col("player").alias("me")), "game_id")
    w = W.partitionBy("game_id", "me").orderBy("line_no", "place").rowsBetween(W.unboundedPreceding, 0)
    mine = F.col("player") == F.col("me")
    of = lambda c: F.sum(F.when(c, F.col("points")).otherwise(0)).over(w)
    a = a.withColumn("own", of(mine)).withColumn("theirs", of(~mine))
    gained = F.sum(F.when(~mine & (F.col("points") > 0), F.col("points")).otherwise(0))
    return a.groupBy("game_id", F.col("me").alias("player")).agg(F.max((F.col("own") <= 0) & (F.col("theirs") >= 6)).alias("trailed"), gained.alias("opponent_gained"))


def tag_totals(stat: DataFrame, who: DataFrame) -> DataFrame:
    """(game_id, player, tags): what the runner got (given by either, or taken), and what either gave for the corp; other players NULL."""
    s = stat.select("game_id", "player", "tags_given", "tags_taken")
    given = s.groupBy("game_id").agg(F.sum("tags_given").alias("all_given"))
    t = who.select("game_id", "player", "side").join(s, ["game_id", "player"], "left").join(given, "game_id", "left").fillna(0)
    return t.select("game_id", "player", F.when(F.col("side") == "runner", F.col("all_given") + F.col("tags_taken")).when(F.col("side") == "corp", F.col("all_given")).alias("tags"))


#: The 26 rules, fixed values: (name, side, predicate on the columns of context()).
ACHIEVEMENTS = [
    *[("no-click-credit", s, "won and click_credits = 0") for s in ("corp", "runner")],
    *[("no-click-draw", s, "won and draw_clicks = 0") for s in ("corp", "runner")],
    *[("rich", s, "peak_pool >= 30") for s in ("corp", "runner")],
    *[("broke-win", s, "won and final_pool = 0") for s in ("corp", "runner")],
    ("flatline-win", "corp", "won and win_reason = 'flatline'"),
    ("flatlined-at-six", "runner", "flatlined and final_score = 6"),
    ("mill-win", "runner", "won and win_reason = 'decked'"),
    ("mill-win-no-points", "runner", "won and win_reason = 'decked' and final_score <= 0"),
    *[("shutout", s, "won and win_reason = 'agenda' and opponent_gained = 0") for s in ("corp", "runner")],
    *[("comeback", s, "won and trailed") for s in ("corp", "runner")],
    *[("fast-win", s, "won and win_reason = 'agenda' and rounds <= 6") for s in ("corp", "runner")],
    *[("tags", s, "won and tags >= 10") for s in ("corp", "runner")],
    *[("trasher", s, "trashes >= 5") for s in ("corp", "runner")],
    ("attrition-win", "corp", "won and opponent_trashes >= 5"),
    ("attrition-win", "runner", "won and damage_taken >= 5"),
    *[("mulligan-win", s, "won and mulligan") for s in ("corp", "runner")],
]


def context(result: DataFrame, stat: DataFrame, pool: DataFrame, trail: DataFrame, tags: DataFrame, hurt: DataFrame, trashed: DataFrame) -> DataFrame:
    """A row for each player with all that the achievements ask for."""
    key = ["game_id", "player"]
    last = pool.groupBy(*key).agg(F.max_by("pool", F.struct("line_no", "place")).alias("final_pool")).join(segments(pool).groupBy(*key).agg(F.max("peak").alias("peak_pool")), key)
    c = result.join(stat.select(*key, "click_credits", "draw_clicks"), key, "left").join(trashed, key, "left").join(last, key, "left").join(trail, key, "left").join(tags, key, "left").join(hurt, key, "left")
    c = c.fillna({"click_credits": 0, "draw_clicks": 0, "trashes": 0, "peak_pool": 0, "opponent_gained": 0, "trailed": False, "damage_taken": 0})
    both = F.sum("trashes").over(W.partitionBy("game_id"))
    return c.withColumn("opponent_trashes", both - F.col("trashes"))


def achievements(contexts: DataFrame) -> DataFrame:
    """(game_id, player, side, earned): the names of the rules of the player's side that hold."""
    holds = [F.when((F.col("side") == side) & F.expr(rule), F.lit(name)) for name, side, rule in ACHIEVEMENTS]
    return contexts.select("game_id", "player", "side", F.array_sort(F.array_compact(F.array(*holds))).alias("earned"))


def series(log: DataFrame, who: DataFrame, pool: DataFrame, agendas: DataFrame) -> DataFrame:
    """(game_id, player, seq, gained, spent, net, pool, hand, agenda): dense on the axis of all turns of the game, from 0 (the start).

    Pool and hand are the last known ones, 5 before any, the pool never below 0; agenda is the running score.
    """
    key = ["game_id", "player", "seq"]
    last = log.groupBy("game_id").agg(F.max("seq").alias("m"))
    spine = who.select("game_id", "player").join(last, "game_id").select("game_id", "player", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("seq"))
    change = pool.groupBy(*key).agg(F.sum(F.when(F.col("change") > 0, F.col("change")).otherwise(0)).alias("gained"), F.sum(F.when(F.col("change") < 0, -F.col("change")).otherwise(0)).alias("spent"), F.max_by("pool", F.struct("line_no", "place")).alias("end"))
    hands = log.filter("kind = 'start'").groupBy(*key).agg(F.max("hand").alias("printed_hand"))
    points = agendas.groupBy(*key).agg(F.sum("points").alias("points"))
    d = spine.join(change, key, "left").join(hands, key, "left").join(points, key, "left").fillna({"gained": 0, "spent": 0, "points": 0})
    w = W.partitionBy("game_id", "player").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    known = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(POOL_START))
    return d.select(*key, "gained", "spent", (F.col("gained") - F.col("spent")).alias("net"), F.when(F.col("seq") == 0, POOL_START).otherwise(F.greatest(F.lit(0), known("end"))).alias("pool"), known("printed_hand").alias("hand"), F.sum("points").over(w).alias("agenda"))


def agenda_by_turn(agendas: DataFrame, who: DataFrame) -> DataFrame:
    """(game_id, player, turn, agenda): the running score on the player's own turns 0 to the game's last; points outside go to the nearest."""
    rounds = who.withColumn("m", F.max("rounds").over(W.partitionBy("game_id"))).select("game_id", "player", "m")
    spine = rounds.select("game_id", "player", F.explode(F.sequence(F.lit(0), "m")).alias("turn"))
    a = agendas.join(rounds, ["game_id", "player"]).groupBy("game_id", "player", F.greatest(F.lit(1), F.least("m", "turn")).alias("turn")).agg(F.sum("points").alias("points"))
    w = W.partitionBy("game_id", "player").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return spine.join(a, ["game_id", "player", "turn"], "left").fillna({"points": 0}).select("game_id", "player", "turn", F.sum("points").over(w).alias("agenda"))
