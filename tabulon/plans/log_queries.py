"""Queries on game logs. The logs are written from the events table: an event is a line of one of TEMPLATES, a game a user's half month.

The DuckDB twins know what each line means from its template's number and read no text, so they are independent of the patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.operators import card_copies as c
from tabulon.operators import game_logs as g
from tabulon.plans.registry import query

#: (what, side or None for either, line): {p} is the player, {n} a number from 1 to 9, {t} the turn.
TEMPLATES = [
    ("start", None, "{p} started their turn {t} with {n}  and 5 cards in {hand}."),
    ("end", None, "{p} is ending their turn {t} with {n}  and 4 cards in {hand}."),
    ("start", None, "{p} started her turn {t} with {n}  and 5 cards in {hand}."),
    ("click", "corp", "{p} spends  to use Corp Basic Action Card to gain 1 ."),
    ("click", "runner", "{p} spends  to use Runner Basic Action Card to gain 1 ."),
    ("draw_click", "corp", "{p} spends  to use Corp Basic Action Card to draw 1 card."),
    ("gain", None, "{p} uses Hedge Fund to gain {n} ."),
    ("play", None, "{p} spends  and pays {n}  to play Hedge Fund."),
    ("aside", "corp", "{p} uses Beanstalk to let the Runner gain {n} ."),
    ("start", None, "{p} started their turn {t} with {n}  and 5 cards in {hand}."),
    ("lose", None, "{p} uses Cryptocrash to make the Runner lose {n} ."),
    ("shares", "runner", "{p} pays {n} from Touchstone and 2 from their credit pool to trash La Costa Grid from Server 1."),
    ("take", "runner", "{p} uses Paladin Poemu to take {n} ."),
    ("mandatory", "corp", "{p} makes their mandatory start of turn draw."),
    ("draw", "runner", "{p} uses Diesel to draw 3 cards."),
    ("damage", "corp", "{p} trashes Alpha, Beta, and Gamma due to net damage."),
    ("grip", "runner", "{p} trashes  due to meat damage."),
    ("give_tags", "corp", "{p} uses Hunter to give the Runner {n} tags."),
    ("take_tags", "runner", "{p} takes {n} tags."),
    ("run", "runner", "{p} makes a run on HQ."),
    ("access", "runner", "{p} accesses Hostile Takeover from R&D."),
    ("root", "runner", "{p} accesses everything else in the root of Server {n}."),
    ("breach", "runner", "{p} breaches HQ."),
    ("steal", "runner", "{p} steals Hostile Takeover and gains 2 agenda points."),
    ("score", "corp", "{p} scores Project Vitruvius and gains 3 agenda points."),
    ("steal", "runner", "{p} steals Hostile Takeover and gains 2 agenda points."),
    ("score", "corp", "{p} scores Project Vitruvius and gains 3 agenda points."),
    ("forfeit", "runner", "{p} forfeits Hostile Takeover."),
    ("reveal", "corp", "{p} uses Ark to reveal Longevity Serum from Archives and add it to their score area."),
    ("credit", None, "{p} sets credit to 9 (+{n})."),
    ("points", None, "{p} sets their agenda points to 3 (-1)."),
    ("quoted", "corp", '{p} resolves 1 unbroken subroutine on Tithe (" Give the Runner 5 tags and gain 9 ").'),
    ("untag", "runner", "{p} spends  and pays {n}  to use Runner Basic Action Card to remove 1 tag."),
    ("advance", "corp", "{p} spends  and pays {n}  to use Corp Basic Action Card to advance a card."),
    ("resource", "corp", "{p} spends  and pays {n}  to use Corp Basic Action Card to trash a resource."),
    ("purge", "corp", "{p} spends  to use Corp Basic Action Card to purge virus counters."),
    ("force", "corp", "{p} uses Attini to force the Runner to pay {n}."),
    ("pay", "runner", "{p} uses Fencer Fueno to pay {n}."),
    ("nano", "runner", "{p} uses Nanomanagement to gain ."),
    ("install", None, "{p} spends  to install a card in the root of Server {n}."),
    ("rez", "corp", "{p} pays {n}  to rez Wall protecting HQ at position 0."),
    ("own_card", "runner", "{p} spends  and pays {n}  to install Kati Jones (paying 2 less) on Server 2."),
    ("trash_wall", "runner", "{p} trashes Wall and Kati Jones."),
    ("kati", "runner", "{p} uses Kati Jones to gain {n} ."),
    ("kati_cost", "runner", "{p} pays {n}  to use Kati Jones to make a run on HQ."),
    ("kati_itself", "runner", "{p} uses Kati Jones to trash itself."),
    ("wall_server", "runner", "{p} pays {n}  to trash Wall from HQ."),
    ("mulligan", None, "{p} takes a mulligan."),
    ("stranger", None, "Spectator uses Hedge Fund to gain {n} ."),
    ("chat", None, "good luck and have fun"),
    ("chat_gg", None, "gg, thank you"),
    ("chat_oath", None, "o kurwa"),
    ("replay", None, "!{p} uses a command: /save-replay"),
    ("win", None, "{p} wins the game."),
    ("flatlined", "runner", "{p} is flatlined."),
    ("decked", "corp", "{p} is decked."),
    ("concede", None, "{p} concedes."),
    ("end", None, "{p} is ending their turn {t} with {n}  and 4 cards in {hand}."),
    ("start", None, "{p} started their turn {t} with {n}  and 5 cards in {hand}."),
]
NAMES = {"corp": "Ann", "runner": "Bob Lee"}
STAMP = "[10:11:12]"


def pasted(t) -> DataFrame:
    """(game_id, line_no, line): every third user's logs have times on lines of their own, the others' every fifth line a glued one."""
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k)
    k = ((F.col("event_id") * 7 + F.col("user_id")) % len(TEMPLATES) + 1).cast("int")
    e = t.raw("events").select((F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 16)).alias("game_id"), "user_id", "event_id", "ts", pick([x[0] for x in TEMPLATES], k).alias("what"), pick([x[1] or "" for x in TEMPLATES], k).alias("s"), pick([x[2] for x in TEMPLATES], k).alias("line"))
    e = e.withColumn("side", F.when(F.col("s") != "", F.col("s")).when(F.col("event_id") % 2 == 0, "corp").otherwise("runner")).withColumn("p", F.when(F.col("side") == "corp", NAMES["corp"]).otherwise(NAMES["runner"]))
    own = W.partitionBy("game_id", "p").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("t", F.count_if(F.col("what") == "start").over(own))
    hand = F.when(F.col("side") == "corp", "HQ").otherwise("their Grip")
    line = F.col("line")
    for name, value in (("{p}", F.col("p")), ("{n}", (F.col("event_id") % 9 + 1).cast("string")), ("{t}", F.col("t").cast("string")), ("{hand}", hand)):
        line = F.replace(line, F.lit(name), value)
    chat, ours = F.col("what").startswith("chat"), line.startswith(F.col("p"))
    rest = F.substr(line, F.length("p") + 1)
    timed = F.when(chat, F.array("p", F.lit(STAMP), "p", line)).when(ours, F.array(F.col("p"), F.lit("  " + STAMP), rest)).otherwise(F.array(line, F.lit(STAMP)))
    glued = F.when(chat, F.array("p", "p", line)).when(ours & (F.col("event_id") % 5 == 0), F.array(F.concat("p", F.lit(STAMP), rest))).otherwise(F.array(line))
    e = e.select("game_id", "ts", "event_id", F.posexplode(F.when(F.col("user_id") % 3 == 0, timed).otherwise(glued)).alias("i", "line"))
    return e.select("game_id", F.row_number().over(W.partitionBy("game_id").orderBy("ts", "event_id", "i")).alias("line_no"), "line")


class Log:
    """The steps of one input, each stored once, when it is first asked for."""

    def __init__(self, t):
        self.t, self.keep = t, lambda name, make: t.keep(f"log_{name}", make)

    @property
    def joined(self) -> DataFrame:
        return self.keep("joined", lambda: g.joined(pasted(self.t)))

    @property
    def read(self) -> DataFrame:
        return self.keep("read", lambda: g.read(self.joined))

    @property
    def players(self) -> DataFrame:
        return self.keep("players", lambda: g.players(self.read))

    @property
    def lines(self) -> DataFrame:
        return self.keep("lines", lambda: g.with_sides(self.read, self.players))

    @property
    def pools(self) -> DataFrame:
        return self.keep("pools", lambda: g.pools(self.read, g.credit_events(self.lines)))

    @property
    def agendas(self) -> DataFrame:
        return self.keep("agendas", lambda: g.agenda_events(self.lines))

    @property
    def stats(self) -> DataFrame:
        return self.keep("stats", lambda: g.stats(self.lines))

    @property
    def copies(self) -> DataFrame:
        return self.keep("copies", lambda: c.lifetimes(self.read, self.players, self.lines))

    @property
    def uses(self) -> DataFrame:
        return self.keep("uses", lambda: c.shared_out(c.uses(self.lines), self.copies))

    @property
    def results(self) -> DataFrame:
        return g.results(self.read, self.players, self.lines, self.agendas)

    @property
    def context(self) -> DataFrame:
        return g.context(self.results, self.stats, self.pools, g.trailing(self.agendas, self.players), g.tag_totals(self.stats, self.players), g.damage(self.lines), g.opposing_trashes(self.lines, g.opened(self.lines)))


def _list(values) -> str:
    return "[" + ", ".join("'" + (v or "").replace("'", "''") + "'" for v in values) + "]"


LOG = f"""
WITH RECURSIVE e0 AS (SELECT user_id * 10 + (day(ts) - 1) // 16 AS game_id, user_id, event_id, ts, (event_id * 7 + user_id) % {len(TEMPLATES)} + 1 AS k, event_id % 9 + 1 AS n FROM events),
e1 AS (SELECT *, {_list([x[0] for x in TEMPLATES])}[k] AS what, CASE WHEN {_list([x[1] for x in TEMPLATES])}[k] <> '' THEN {_list([x[1] for x in TEMPLATES])}[k] WHEN event_id % 2 = 0 THEN 'corp' ELSE 'runner' END AS s FROM e0),
e2 AS (SELECT *, CASE s WHEN 'corp' THEN '{NAMES["corp"]}' ELSE '{NAMES["runner"]}' END AS p, CASE WHEN starts_with(what, 'chat') THEN 3 ELSE 1 END AS wide FROM e1),
e3 AS MATERIALIZED (SELECT *, (sum(wide) OVER g - wide)::INTEGER AS line_no, count_if(what = 'start') OVER (PARTITION BY game_id, p ORDER BY ts, event_id) AS t, (count_if(what = 'start') OVER g)::BIGINT AS seq FROM e2 WINDOW g AS (PARTITION BY game_id ORDER BY ts, event_id)),
bound AS (SELECT game_id, p, min(line_no) AS first_line FROM e3 WHERE what IN ('start', 'end') GROUP BY ALL),
acts AS MATERIALIZED (SELECT e3.*, bound.first_line, what IN ('click', 'draw_click', 'untag', 'advance', 'resource', 'purge') AS basic FROM e3 LEFT JOIN bound USING (game_id, p)),
lined AS MATERIALIZED (SELECT *, what NOT IN ('start', 'end', 'win', 'flatlined', 'decked', 'mulligan', 'stranger', 'chat', 'chat_gg', 'chat_oath', 'replay') AND coalesce(first_line < line_no, false) AS known FROM acts),
sided AS MATERIALIZED (SELECT *, CASE WHEN count_if((basic AND known) OR what = 'start') OVER (PARTITION BY game_id, p ORDER BY line_no) > 0 THEN s END AS side FROM lined),
who AS MATERIALIZED (SELECT game_id, p, arg_max(coalesce(side, ''), line_no) AS side, min(line_no) AS first_line, max(t) FILTER (what IN ('start', 'end')) AS rounds FROM sided WHERE known OR what IN ('start', 'end') GROUP BY ALL),
ply AS MATERIALIZED (SELECT x.*, c.p AS corp_p, r.p AS runner_p FROM sided x LEFT JOIN who c ON c.game_id = x.game_id AND c.side = 'corp' AND c.first_line < x.line_no LEFT JOIN who r ON r.game_id = x.game_id AND r.side = 'runner' AND r.first_line < x.line_no WHERE known),
cre AS MATERIALIZED (SELECT game_id, line_no, seq, q.* FROM ply, LATERAL (
    SELECT p AS player, 0 AS place, CASE what WHEN 'click' THEN 1 ELSE n END AS amount, false AS forced WHERE what IN ('click', 'gain', 'kati') UNION ALL
    SELECT coalesce(runner_p, p), 1, n, false WHERE what = 'aside' AND side IS DISTINCT FROM 'runner' UNION ALL
    SELECT p, 2, n, false WHERE what = 'take' UNION ALL
    SELECT coalesce(runner_p, p), 4, -n, true WHERE what = 'lose' UNION ALL
    SELECT p, 5, CASE what WHEN 'shares' THEN -2 ELSE -n END, false WHERE what IN ('play', 'shares', 'untag', 'advance', 'resource', 'rez', 'own_card', 'kati_cost', 'wall_server') UNION ALL
    SELECT coalesce(runner_p, p), 6, -n, false WHERE what = 'force' UNION ALL
    SELECT p, 6, -n, false WHERE what = 'pay' UNION ALL
    SELECT p, 7, n, false WHERE what = 'credit') q),
items AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY game_id, player ORDER BY line_no, place) AS rn FROM (
    SELECT game_id, player, line_no, place, seq, amount, forced, NULL::BIGINT AS printed, NULL::BIGINT AS own FROM cre
    UNION ALL SELECT game_id, p, line_no, -1, seq, 0, false, n, CASE what WHEN 'start' THEN t END FROM e3 WHERE what IN ('start', 'end'))),
fold AS (SELECT game_id, player, line_no, place, seq, rn, printed, printed AS pool, coalesce(own, 0) AS turn, NULL::BIGINT AS change FROM items WHERE rn = 1
    UNION ALL SELECT i.game_id, i.player, i.line_no, i.place, i.seq, i.rn, i.printed, coalesce(i.printed, f.pool + CASE WHEN i.forced THEN greatest(i.amount, least(0, -f.pool)) ELSE i.amount END), coalesce(i.own, f.turn),
        CASE WHEN i.printed IS NULL THEN CASE WHEN i.forced THEN greatest(i.amount, least(0, -f.pool)) ELSE i.amount END END
    FROM fold f JOIN items i ON i.game_id = f.game_id AND i.player = f.player AND i.rn = f.rn + 1),
pools AS MATERIALIZED (SELECT *, count(printed) OVER (PARTITION BY game_id, player ORDER BY rn) AS segment FROM fold),
stretch AS MATERIALIZED (SELECT game_id, player, segment, max(printed) AS start, arg_max(pool, rn) AS last, max(pool) FILTER (place >= 0) AS top, lead(max(printed)) OVER (PARTITION BY game_id, player ORDER BY segment) AS expected FROM pools GROUP BY game_id, player, segment),
agd AS MATERIALIZED (SELECT *, CASE WHEN what = 'forfeit' THEN CASE lag(what) OVER (PARTITION BY game_id, p, title ORDER BY line_no) WHEN 'steal' THEN -2 END ELSE raw END AS points FROM (
    SELECT game_id, p, line_no, t AS turn, seq, what, CASE what WHEN 'score' THEN 3 WHEN 'steal' THEN 2 WHEN 'points' THEN -1 WHEN 'reveal' THEN 2 END AS raw,
        CASE what WHEN 'score' THEN 'project vitruvius' WHEN 'steal' THEN 'hostile takeover' WHEN 'forfeit' THEN 'hostile takeover' WHEN 'reveal' THEN 'longevity serum' END AS title FROM ply WHERE what IN ('score', 'steal', 'points', 'reveal', 'forfeit'))),
fin AS (SELECT game_id, arg_max(p, line_no) FILTER (what = 'win') AS win, arg_max(p, line_no) FILTER (what = 'flatlined') AS flat, arg_max(p, line_no) FILTER (what = 'decked') AS deck, list(DISTINCT p) FILTER (what = 'mulligan') AS mull FROM e3 GROUP BY 1),
con AS (SELECT game_id, arg_max(p, line_no) AS conceded FROM ply WHERE what = 'concede' GROUP BY 1),
pts AS (SELECT game_id, p, coalesce(sum(points), 0)::BIGINT AS final_score FROM agd GROUP BY ALL),
res0 AS (SELECT w.game_id, w.p AS player, nullif(w.side, '') AS side, max(w.rounds) OVER (PARTITION BY w.game_id) AS rounds, coalesce(win = w.p, false) AS won, coalesce(final_score, 0) AS final_score, coalesce(flat = w.p, false) AS flatlined, coalesce(list_contains(mull, w.p), false) AS mulligan, win, flat, deck, conceded
    FROM who w JOIN fin USING (game_id) LEFT JOIN con USING (game_id) LEFT JOIN pts ON pts.game_id = w.game_id AND pts.p = w.p),
res AS MATERIALIZED (SELECT game_id, player, side, rounds, won, final_score, flatlined, mulligan, CASE WHEN win IS NULL THEN NULL WHEN flat <> win THEN 'flatline' WHEN deck <> win THEN 'decked' WHEN conceded <> win THEN 'concede'
    WHEN max(final_score) FILTER (won) OVER (PARTITION BY game_id) >= 7 THEN 'agenda' END AS win_reason FROM res0),
sta AS MATERIALIZED (SELECT game_id, p AS player, count_if(what = 'click') AS click_credits, count_if(what = 'click') AS click_credits_gained, count_if(what = 'draw_click') AS draw_clicks, sum(CASE what WHEN 'nano' THEN 2 ELSE 0 END) AS clicks_gained,
    count_if(what = 'untag') AS tag_removals, sum(n * (what = 'untag')::INTEGER) AS tag_removal_cost, count_if(what = 'resource') AS trash_resources, sum(n * (what = 'resource')::INTEGER) AS trash_resource_cost, count_if(what = 'advance') AS advances, sum(n * (what = 'advance')::INTEGER) AS advance_cost,
    count_if(what = 'purge') AS purges, count_if(what IN ('install', 'own_card')) AS installs, count_if(what = 'rez') AS rezzed, sum(CASE what WHEN 'draw_click' THEN 1 WHEN 'mandatory' THEN 1 WHEN 'draw' THEN 3 ELSE 0 END) AS draws, sum(n * (what = 'give_tags')::INTEGER) AS tags_given, sum(n * (what = 'take_tags')::INTEGER) AS tags_taken,
    count_if(what IN ('run', 'kati_cost')) AS runs, count_if(what = 'play') AS plays, 0 AS access_hq, count_if(what = 'access') AS access_rd, 0 AS access_archives, count_if(what = 'root') AS access_remote, count_if(what = 'breach') AS breach_hq, 0 AS breach_rd, 0 AS breach_archives,
    count(*) FILTER (what IN ('shares', 'wall_server') AND side = 'runner') AS zone_trashes FROM ply GROUP BY ALL),
opn AS MATERIALIZED (SELECT game_id, p AS player, line_no, t AS turn, CASE what WHEN 'rez' THEN 'Wall' ELSE 'Kati Jones' END AS card, what, n FROM ply WHERE what IN ('rez', 'own_card')),
opp AS (SELECT game_id, p AS player, count(*) AS trashes FROM ply WHERE (what IN ('shares', 'wall_server') AND side = 'runner') OR (what IN ('trash_wall', 'wall_server') AND EXISTS (SELECT 1 FROM opn WHERE opn.game_id = ply.game_id AND opn.card = 'Wall' AND opn.line_no <= ply.line_no)) GROUP BY ALL),
dmg AS (SELECT game_id, runner_p AS player, sum(CASE what WHEN 'damage' THEN 3 ELSE 1 END)::BIGINT AS damage_taken FROM ply WHERE what IN ('damage', 'grip') AND runner_p IS NOT NULL GROUP BY ALL),
tag AS (SELECT w.game_id, w.p AS player, CASE w.side WHEN 'runner' THEN coalesce(sum(tags_given), 0) + coalesce(sum(tags_taken) FILTER (sta.player = w.p), 0) WHEN 'corp' THEN coalesce(sum(tags_given), 0) END::BIGINT AS tags FROM who w LEFT JOIN sta ON sta.game_id = w.game_id GROUP BY w.game_id, w.p, w.side),
tra AS (SELECT game_id, me AS player, bool_or(own <= 0 AND theirs >= 6) AS trailed, sum(CASE WHEN p <> me AND points > 0 THEN points ELSE 0 END)::BIGINT AS opponent_gained FROM (
    SELECT *, sum(CASE WHEN p = me THEN points ELSE 0 END) OVER w AS own, sum(CASE WHEN p <> me THEN points ELSE 0 END) OVER w AS theirs FROM (SELECT a.game_id, a.p, a.line_no, a.points, w.p AS me FROM agd a JOIN who w ON w.game_id = a.game_id WHERE points IS NOT NULL) WINDOW w AS (PARTITION BY game_id, me ORDER BY line_no)) GROUP BY ALL)"""


@query("log_01_02_wn_25_src_20_joined_lines", LOG + f""", tx AS (SELECT *, replace(replace(replace(replace({_list([x[2] for x in TEMPLATES])}[k], '{{p}}', p), '{{n}}', n::VARCHAR), '{{t}}', t::VARCHAR), '{{hand}}', CASE s WHEN 'corp' THEN 'HQ' ELSE 'their Grip' END) AS line FROM e3)
SELECT game_id, line_no + i AS line_no, CASE WHEN wide = 3 AND i < 2 THEN p ELSE line END AS line FROM tx, LATERAL (SELECT unnest(range(wide)) AS i)""")
def joined_lines(t):
    return Log(t).joined


@query("log_04_07_wn_12_13_read_lines", LOG + """ SELECT game_id, line_no, CASE WHEN known THEN 'player' WHEN what IN ('start', 'end', 'win', 'flatlined', 'decked', 'mulligan') THEN what END AS kind, p AS player, seq, CASE WHEN known THEN t END AS turn, CASE WHEN known THEN side END AS side,
    CASE WHEN what IN ('start', 'end') THEN n END AS credits, CASE what WHEN 'start' THEN 5 WHEN 'end' THEN 4 END AS hand FROM sided WHERE what NOT IN ('stranger', 'chat', 'chat_gg', 'chat_oath', 'replay')""")
def read_lines(t):
    r, player = Log(t).read, F.col("kind") == "player"
    ours = r.filter(F.col("player").isin(*NAMES.values()))
    return ours.select("game_id", "line_no", "kind", "player", "seq", F.when(player, F.col("turn")).alias("turn"), F.when(player, F.col("side")).alias("side"), "credits", "hand")


@query("log_03_wn_24_chat_badges", LOG + " SELECT game_id, p AS player, bool_or(what = 'chat') AS glhf, bool_or(what = 'chat_gg') AS gg, bool_or(what = 'chat_gg') AS ty, bool_or(what = 'chat_oath') AS egg, bool_or(what = 'replay') AS saved_replay FROM e3 WHERE what IN ('chat', 'chat_gg', 'chat_oath', 'replay') AND (what = 'replay' OR s = 'corp') GROUP BY ALL")
def chat_badges(t):
    """A name with a space in it is not taken for a chat line's."""
    return g.badges(Log(t).joined)


@query("log_22_23_25_26_27_31_credit_events", LOG + " SELECT game_id, player, line_no, seq, place, amount, forced FROM cre")
def credit_events(t):
    return g.credit_events(Log(t).lines)


@query("log_24_45_wn_14_credit_pools", LOG + " SELECT game_id, player, line_no, place, turn, printed, pool, change FROM pools")
def credit_pools(t):
    return Log(t).pools.select("game_id", "player", "line_no", "place", "turn", "printed", "pool", "change")


@query("wn_15_wn_23_pool_segments", LOG + " SELECT game_id, player, segment, start, CASE WHEN expected IS NOT NULL THEN last END AS derived, expected, last = expected AS ok, greatest(start, expected, top + coalesce(least(0, expected - last), 0)) AS peak FROM stretch")
def pool_segments(t):
    return g.segments(Log(t).pools)


@query("log_34_35_36_37_agenda_events", LOG + " SELECT game_id, p AS player, line_no, turn, title, points FROM agd")
def agenda_events(t):
    return Log(t).agendas.select("game_id", "player", "line_no", "turn", "title", "points")


@query("log_20_21_28_30_32_33_stats", LOG + f" SELECT game_id, player, {', '.join(f'{c}::BIGINT AS {c}' for c in g.STATS)} FROM sta")
def stats(t):
    return Log(t).stats


@query("log_29_damage", LOG + " SELECT * FROM dmg")
def damage(t):
    return g.damage(Log(t).lines)


@query("log_48_tag_totals", LOG + " SELECT * FROM tag")
def tag_totals(t):
    log = Log(t)
    return g.tag_totals(log.stats, log.players)


@query("log_05_06_38_49_50_results", LOG + " SELECT * FROM res")
def results(t):
    return Log(t).results


@query("wn_22_trailed_zero_six", LOG + " SELECT * FROM tra")
def trailed(t):
    log = Log(t)
    return g.trailing(log.agendas, log.players)


@query("log_10_log_11_opened_cards", LOG + " SELECT game_id, player, line_no, turn, CASE what WHEN 'rez' THEN 'rez' ELSE 'install' END AS kind, card, CASE what WHEN 'rez' THEN 'HQ' END AS server, n AS cost FROM opn")
def opened_cards(t):
    return g.opened(Log(t).lines).drop("seq")


@query("log_18_opposing_trashes", LOG + " SELECT * FROM opp")
def opposing_trashes(t):
    log = Log(t)
    return g.opposing_trashes(log.lines, g.opened(log.lines))


# copies first in, first out, one event after the other: a list holds the copies in play of a game and card; Wall is the corp's alone, Kati Jones
# the runner's; Kati Jones is never trashed from a server
COPIES = LOG + """, ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY game_id, card ORDER BY line_no, put DESC) AS rn FROM (
    SELECT game_id, card, line_no, turn, n AS cost, true AS put FROM opn UNION ALL
    SELECT game_id, c, line_no, t, 0, false FROM ply, LATERAL (SELECT unnest(CASE what WHEN 'trash_wall' THEN ['Wall', 'Kati Jones'] WHEN 'wall_server' THEN ['Wall'] WHEN 'kati_itself' THEN ['Kati Jones'] ELSE [] END) AS c))),
st AS (SELECT game_id, card, rn, CASE WHEN put THEN [line_no] ELSE []::INTEGER[] END AS here, NULL::INTEGER AS gone, line_no FROM ev WHERE rn = 1
    UNION ALL SELECT e.game_id, e.card, e.rn, CASE WHEN e.put THEN list_append(s.here, e.line_no) ELSE s.here[2:] END, CASE WHEN NOT e.put THEN s.here[1] END, e.line_no FROM st s JOIN ev e ON e.game_id = s.game_id AND e.card = s.card AND e.rn = s.rn + 1),
cop AS MATERIALIZED (SELECT o.game_id, o.player, o.card, o.line_no, o.turn, o.n AS cost, st.line_no AS closed_line,
    CASE WHEN st.line_no IS NOT NULL THEN (SELECT coalesce(max(t), 0) FROM e3 WHERE e3.game_id = o.game_id AND e3.p = o.player AND e3.what = 'start' AND e3.line_no <= st.line_no) END AS left_turn FROM opn o LEFT JOIN st ON st.game_id = o.game_id AND st.card = o.card AND st.gone = o.line_no),
us AS MATERIALIZED (SELECT game_id, p AS player, line_no, t AS turn, CASE WHEN what IN ('kati', 'kati_cost') THEN 'Kati Jones' WHEN what = 'shares' THEN 'Touchstone' ELSE 'Hedge Fund' END AS card, what = 'play' AS plays,
    CASE WHEN what IN ('kati', 'gain', 'shares') THEN n END AS gain, CASE WHEN what IN ('kati_cost', 'play') THEN n END AS cost FROM ply WHERE what IN ('kati', 'kati_cost', 'gain', 'play', 'shares')),
ux AS MATERIALIZED (SELECT *, CASE WHEN len(here) > 0 THEN here[(row_number() OVER (PARTITION BY game_id, player, card, here ORDER BY line_no) - 1) % len(here) + 1] ELSE late END AS copy FROM (
    SELECT us.*, coalesce((SELECT list(c.line_no ORDER BY c.line_no) FROM cop c WHERE c.game_id = us.game_id AND c.player = us.player AND c.card = us.card AND c.line_no < us.line_no AND coalesce(c.closed_line > us.line_no, true)), []) AS here,
        (SELECT arg_max(c.line_no, c.closed_line) FROM cop c WHERE c.game_id = us.game_id AND c.player = us.player AND c.card = us.card AND c.closed_line <= us.line_no AND c.left_turn = us.turn) AS late FROM us))"""


@query(
    "log_40_log_46_installed_rows",
    COPIES
    + """ SELECT c.game_id, c.player, c.card, CASE WHEN count(*) OVER k > 1 THEN (row_number() OVER (k ORDER BY c.line_no))::INTEGER END AS copy, c.turn, c.left_turn, greatest(1, coalesce(c.left_turn, w.rounds) - c.turn + 1) AS turns_in_play,
    coalesce(g, 0)::BIGINT AS gained, (c.cost + coalesce(k, 0))::BIGINT AS cost, (coalesce(g, 0) - c.cost - coalesce(k, 0))::BIGINT AS net FROM cop c JOIN who w ON w.game_id = c.game_id AND w.p = c.player
    LEFT JOIN (SELECT game_id, card, copy, sum(gain) AS g, sum(cost) AS k FROM ux WHERE copy IS NOT NULL GROUP BY ALL) u ON u.game_id = c.game_id AND u.card = c.card AND u.copy = c.line_no WINDOW k AS (PARTITION BY c.game_id, c.player, c.card)""",
)
def installed_rows(t):
    log = Log(t)
    return c.installed_rows(log.copies, log.uses)


@query(
    "log_47_operation_rows",
    COPIES
    + """, oe AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY game_id, player, card, turn ORDER BY line_no) AS rn FROM ux WHERE copy IS NULL),
ow AS (SELECT game_id, player, card, turn, rn, [{'cost': coalesce(cost, 0), 'gain': coalesce(gain, 0), 'settled': gain IS NOT NULL}] AS times FROM oe WHERE rn = 1
    UNION ALL SELECT e.game_id, e.player, e.card, e.turn, e.rn, CASE
        WHEN e.gain IS NOT NULL AND list_position(list_transform(o.times, lambda x: x.settled), false) > 0 THEN list_transform(o.times, lambda x, i: CASE WHEN i = list_position(list_transform(o.times, lambda y: y.settled), false) THEN {'cost': x.cost, 'gain': e.gain, 'settled': true} ELSE x END)
        WHEN e.gain IS NULL AND NOT e.plays THEN list_transform(o.times, lambda x, i: CASE WHEN i = len(o.times) THEN {'cost': x.cost + e.cost, 'gain': x.gain, 'settled': x.settled} ELSE x END)
        ELSE list_append(o.times, {'cost': coalesce(e.cost, 0), 'gain': coalesce(e.gain, 0), 'settled': e.gain IS NOT NULL}) END
    FROM ow o JOIN oe e ON e.game_id = o.game_id AND e.player = o.player AND e.card = o.card AND e.turn = o.turn AND e.rn = o.rn + 1),
ol AS (SELECT game_id, player, card, turn, arg_max(times, rn) AS times FROM ow GROUP BY ALL)
SELECT game_id, player, card, turn, CASE WHEN len(times) > 1 THEN i::INTEGER END AS nth, times[i].cost::BIGINT AS cost, times[i].gain::BIGINT AS gain, (times[i].gain - times[i].cost)::BIGINT AS net FROM ol, LATERAL (SELECT unnest(range(1, len(times) + 1)) AS i)""",
)
def operation_rows(t):
    log = Log(t)
    return c.operation_rows(Log(t).uses)


CONTEXT = LOG + """, pk AS (SELECT game_id, player, max(greatest(start, expected, top + coalesce(least(0, expected - last), 0))) AS peak_pool, arg_max(last, segment) AS final_pool FROM stretch GROUP BY ALL),
ctx AS (SELECT res.*, coalesce(click_credits, 0) AS click_credits, coalesce(draw_clicks, 0) AS draw_clicks, coalesce(trashes, 0) AS trashes, coalesce(sum(trashes) OVER (PARTITION BY game_id), 0) - coalesce(trashes, 0) AS opponent_trashes, coalesce(peak_pool, 0) AS peak_pool, final_pool,
    coalesce(trailed, false) AS trailed, coalesce(opponent_gained, 0) AS opponent_gained, tags, coalesce(damage_taken, 0) AS damage_taken FROM res LEFT JOIN sta USING (game_id, player) LEFT JOIN pk USING (game_id, player) LEFT JOIN tra USING (game_id, player) LEFT JOIN tag USING (game_id, player) LEFT JOIN dmg USING (game_id, player) LEFT JOIN opp USING (game_id, player))"""


@query("log_52_achievement_context", CONTEXT + " SELECT game_id, player, side, won, win_reason, final_score, click_credits, draw_clicks, peak_pool, final_pool, trailed, opponent_gained, tags, trashes::BIGINT AS trashes, opponent_trashes::BIGINT AS opponent_trashes, damage_taken, mulligan FROM ctx")
def achievement_context(t):
    return Log(t).context.select("game_id", "player", "side", "won", "win_reason", "final_score", "click_credits", "draw_clicks", "peak_pool", "final_pool", "trailed", "opponent_gained", "tags", "trashes", "opponent_trashes", "damage_taken", "mulligan")


@query(
    "log_51_53_ach_01_to_26_achievements",
    CONTEXT
    + """, hit AS (SELECT game_id, player, 'no-click-credit' AS a FROM ctx WHERE won AND click_credits = 0 AND side IS NOT NULL UNION ALL SELECT game_id, player, 'no-click-draw' FROM ctx WHERE won AND draw_clicks = 0 AND side IS NOT NULL
    UNION ALL SELECT game_id, player, 'rich' FROM ctx WHERE peak_pool >= 30 AND side IS NOT NULL UNION ALL SELECT game_id, player, 'broke-win' FROM ctx WHERE won AND final_pool = 0 AND side IS NOT NULL
    UNION ALL SELECT game_id, player, 'flatline-win' FROM ctx WHERE side = 'corp' AND won AND win_reason = 'flatline' UNION ALL SELECT game_id, player, 'flatlined-at-six' FROM ctx WHERE side = 'runner' AND flatlined AND final_score = 6
    UNION ALL SELECT game_id, player, 'mill-win' FROM ctx WHERE side = 'runner' AND won AND win_reason = 'decked' UNION ALL SELECT game_id, player, 'mill-win-no-points' FROM ctx WHERE side = 'runner' AND won AND win_reason = 'decked' AND final_score <= 0
    UNION ALL SELECT game_id, player, 'shutout' FROM ctx WHERE won AND win_reason = 'agenda' AND opponent_gained = 0 AND side IS NOT NULL UNION ALL SELECT game_id, player, 'comeback' FROM ctx WHERE won AND trailed AND side IS NOT NULL
    UNION ALL SELECT game_id, player, 'fast-win' FROM ctx WHERE won AND win_reason = 'agenda' AND rounds <= 6 AND side IS NOT NULL UNION ALL SELECT game_id, player, 'tags' FROM ctx WHERE won AND tags >= 10
    UNION ALL SELECT game_id, player, 'trasher' FROM ctx WHERE trashes >= 5 AND side IS NOT NULL UNION ALL SELECT game_id, player, 'attrition-win' FROM ctx WHERE won AND ((side = 'corp' AND opponent_trashes >= 5) OR (side = 'runner' AND damage_taken >= 5))
    UNION ALL SELECT game_id, player, 'mulligan-win' FROM ctx WHERE won AND mulligan AND side IS NOT NULL)
SELECT ctx.game_id, ctx.player, ctx.side, coalesce(list(a ORDER BY a) FILTER (a IS NOT NULL), []) AS earned FROM ctx LEFT JOIN hit USING (game_id, player) GROUP BY ALL""",
)
def achievements(t):
    return g.achievements(Log(t).context)


@query(
    "wn_16_17_19_21_turn_order_series",
    LOG
    + """, spi AS (SELECT w.game_id, w.p AS player, unnest(range(0, (SELECT max(seq) FROM e3 WHERE e3.game_id = w.game_id) + 1)) AS seq FROM who w),
ch AS (SELECT game_id, player, seq, sum(greatest(change, 0)) AS gained, sum(greatest(-change, 0)) AS spent, arg_max(pool, rn) AS pool FROM pools GROUP BY ALL), hd AS (SELECT game_id, p AS player, seq, 5 AS hand FROM e3 WHERE what = 'start'), ap AS (SELECT game_id, p AS player, seq, sum(points) AS points FROM agd GROUP BY ALL),
al AS (SELECT game_id, player, seq, coalesce(gained, 0)::BIGINT AS gained, coalesce(spent, 0)::BIGINT AS spent, pool, hand, coalesce(points, 0) AS points FROM spi LEFT JOIN ch USING (game_id, player, seq) LEFT JOIN hd USING (game_id, player, seq) LEFT JOIN ap USING (game_id, player, seq))
SELECT game_id, player, seq, gained, spent, gained - spent AS net, CASE seq WHEN 0 THEN 5 ELSE greatest(0, coalesce(last_value(pool IGNORE NULLS) OVER w, 5)) END AS pool, coalesce(last_value(hand IGNORE NULLS) OVER w, 5) AS hand, (sum(points) OVER w)::BIGINT AS agenda FROM al WINDOW w AS (PARTITION BY game_id, player ORDER BY seq)""",
)
def turn_order_series(t):
    log = Log(t)
    return g.series(log.read, log.players, log.pools, log.agendas)


@query(
    "wn_20_agenda_by_own_turn",
    LOG
    + """, rd AS (SELECT game_id, max(rounds)::BIGINT AS m FROM who GROUP BY 1), sp AS (SELECT w.game_id, w.p AS player, unnest(range(0, m + 1)) AS turn FROM who w JOIN rd USING (game_id)), bu AS (SELECT a.game_id, a.p AS player, greatest(1, least(m, turn)) AS turn, sum(points) AS points FROM agd a JOIN rd USING (game_id) GROUP BY ALL)
SELECT game_id, player, turn, (sum(coalesce(points, 0)) OVER (PARTITION BY game_id, player ORDER BY turn))::BIGINT AS agenda FROM sp LEFT JOIN bu USING (game_id, player, turn)""",
)
def agenda_by_own_turn(t):
    log = Log(t)
    return g.agenda_by_turn(log.agendas, log.players)


GATED = {"Cards rezzed": ("rezzed", "corp"), "Tags gained": ("tags", "runner"), "Runs made": ("runs", "runner"), "Events played": ("plays", "runner"), "Cards accessed — HQ": ("access_hq", "runner"), "Cards accessed — R&D": ("access_rd", "runner"), "Cards accessed — remote servers": ("access_remote", "runner"),
         "Times accessed HQ": ("breach_hq", "runner"), "Times accessed R&D": ("breach_rd", "runner"), "Times accessed Archives": ("breach_archives", "runner")}
OPEN = {"Credits gained": "gained", "Credits spent": "spent", "Credits by basic action": "click_credits_gained", "Cards drawn": "draws", "Cards drawn by basic action": "draw_clicks", "Clicks gained from cards": "clicks_gained"}
TABLE = LOG + ", cr AS (SELECT game_id, player, sum(greatest(change, 0)) AS gained, sum(greatest(-change, 0)) AS spent FROM pools GROUP BY ALL), tb AS (SELECT w.game_id, w.p AS player, w.side, sta.* EXCLUDE (game_id, player), tags, gained, spent FROM who w LEFT JOIN sta ON sta.game_id = w.game_id AND sta.player = w.p LEFT JOIN tag ON tag.game_id = w.game_id AND tag.player = w.p LEFT JOIN cr ON cr.game_id = w.game_id AND cr.player = w.p)"


@query("log_54_game_stats_table", TABLE + " ".join([" SELECT game_id, player, stat, value FROM (", " UNION ALL ".join([f"SELECT game_id, player, '{k}' AS stat, coalesce({c}, 0)::BIGINT AS value FROM tb" for k, c in OPEN.items()] + [f"SELECT game_id, player, '{k}', CASE WHEN side = '{s}' THEN coalesce({c}, 0)::BIGINT END FROM tb" for k, (c, s) in GATED.items()]), ")"]))
def game_stats_table(t):
    """16 rows a player; what the other side alone can do is NULL."""
    log = Log(t)
    key = ["game_id", "player"]
    credits = log.pools.groupBy(*key).agg(F.sum(F.greatest("change", F.lit(0))).alias("gained"), F.sum(F.greatest(-F.col("change"), F.lit(0))).alias("spent"))
    s = log.players.select(*key, "side").join(log.stats, key, "left").join(g.tag_totals(log.stats, log.players), key, "left").join(credits, key, "left")
    row = lambda name, value: F.struct(F.lit(name).alias("stat"), value.cast("long").alias("value"))
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = [row(k, value(c)) for k, c in OPEN.items()] + [row(k, F.when(F.col("side") == side, value(c))) for k, (c, side) in GATED.items()]
    return s.select(*key, F.explode(F.array(*rows)).alias("r")).select(*key, "r.*")


ACTIONS = {
    "corp": [("Gain 1 credit", "click_credits", "click_credits_gained"), ("Draw 1 card", "draw_clicks", None), ("Install 1 card from HQ", "installs", None), ("Play 1 operation from HQ", "plays", None), ("Advance 1 installed card", "advances", "-advance_cost"), ("Trash 1 resource", "trash_resources", "-trash_resource_cost"), ("Purge virus counters", "purges", None)],
    "runner": [("Gain 1 credit", "click_credits", "click_credits_gained"), ("Draw 1 card", "draw_clicks", None), ("Install 1 card from Grip", "installs", None), ("Play 1 event from Grip", "plays", None), ("Make a run on any server", "runs", None), ("Remove 1 tag", "tag_removals", "-tag_removal_cost")],
}


@query("log_55_basic_action_table", TABLE + " " + " UNION ALL ".join(f"SELECT game_id, player, '{label}' AS label, {count}::BIGINT AS count, {credits or 'NULL'}::BIGINT AS credits FROM tb WHERE side = '{side}' AND {count} IS NOT NULL" for side, rows in ACTIONS.items() for label, count, credits in rows))
def basic_action_table(t):
    log = Log(t)
    s = log.stats.join(log.players.select("game_id", "player", "side"), ["game_id", "player"])
    row = lambda label, count, credits: F.struct(F.lit(label).alias("label"), F.col(count).alias("count"), (F.expr(credits) if credits else F.lit(None)).cast("long").alias("credits"))
    rows = [F.when(F.col("side") == side, F.array(*[row(*r) for r in rows])) for side, rows in ACTIONS.items()]
    return s.select("game_id", "player", F.explode(F.coalesce(*rows)).alias("r")).select("game_id", "player", "r.*")


@query("log_08_clean_names", "SELECT p_partkey, p_name AS name FROM part")
def clean_names(t):
    """Names with what a log hangs onto them, taken off again."""
    tails = [".", " (paying 2 less).", " on Server 1.", " from the Grip.", " from HQ", " from the root of Server 3 and more"]
    tail = F.element_at(F.array(*[F.lit(x) for x in tails]), (F.col("p_partkey") % len(tails) + 1).cast("int"))
    return t.raw("part").select("p_partkey", g.clean_name(F.concat("p_name", tail)).alias("name"))


@query("log_12_log_16_card_amounts", "SELECT p_partkey, upper(p_name) AS card, p_size::INTEGER AS gain, CASE p_partkey % 4 WHEN 3 THEN p_size % 7 END::INTEGER AS cost FROM part")
def card_amounts(t):
    """The card that gives credits and how many, in each of the four wordings, and what using it costs."""
    line = lambda text: F.concat(F.lit("Ann uses "), F.upper("p_name"), F.lit(f" to {text} "), F.col("p_size"), F.lit("."))
    paid = F.concat(F.lit("Ann pays "), F.col("p_size") % 7, F.lit(" to use "), F.upper("p_name"), F.lit(" to trash Wall to gain "), F.col("p_size"), F.lit("."))
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, line("gain")).when(k == 1, line("reveal a card and gain")).when(k == 2, line("draw a card then gain")).otherwise(paid)
    # a table of few bytes is one task's; its lines are read by all cores, each line's clauses once
    p = t.raw("part").repartition(t.spark.sparkContext.defaultParallelism).select("p_partkey", said.alias("line"))
    p, deeds = p.withColumn("deeds", g.clauses(F.col("line"), F.lit("Ann"))), F.col("deeds")
    p = p.withColumn("found", g.gain_of_card(deeds)).withColumn("cost", g.digits(g.paid_for(deeds, "use")))
    return p.select("p_partkey", "found.card", F.col("found.amount").alias("gain"), "cost")
