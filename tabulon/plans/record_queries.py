"""Queries on rules, logs, sources, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions import dates, ratios, text
from tabulon.operators import logs, rules
from tabulon.operators.ranking import ranked
from tabulon.plans.registry import query
from tabulon.sources.adapters import ADAPTER

#: The rules of deck legality for ``judged`` (deck_id, side, identity_card, restriction_id, entry_identity), one issue a row.
RULES = """
listing AS (SELECT j.deck_id, j.restriction_id, j.side, i.faction_id AS own, x.card_id, x.qty, card.card_id IS NULL AS unknown, card.side_id, card.faction_id, card.card_type_id, coalesce(card.deck_limit, 3) AS most,
    coalesce(card.influence_cost, 0) AS cost, coalesce(card.agenda_points, 0) AS agenda, coalesce(v.legal, false) AS legal, coalesce(v.restricted, false) AS restricted, coalesce(v.universal_cost, 0) AS extra, coalesce(v.points, 0) AS points
    FROM judged j JOIN card i ON i.card_id = j.identity_card JOIN deck_card x ON x.deck_id = j.deck_id LEFT JOIN card ON card.card_id = x.card_id LEFT JOIN verdict v ON v.card_id = x.card_id AND v.restriction_id = j.restriction_id),
totals AS (SELECT deck_id, restriction_id, coalesce(sum(qty) FILTER (NOT unknown), 0) AS size, coalesce(sum(cost * qty) FILTER (faction_id <> own AND NOT starts_with(faction_id, 'neutral')), 0) + coalesce(sum(extra * qty), 0) AS influence,
    count_if(restricted) AS restricted, sum(points) AS points, coalesce(sum(agenda * qty) FILTER (card_type_id = 'agenda'), 0) AS agenda FROM listing GROUP BY ALL),
whole AS (SELECT j.*, i.side_id, i.minimum_deck_size AS least, i.influence_limit, r.point_limit, coalesce(t.size, 0) AS size, coalesce(influence, 0) AS influence, coalesce(t.restricted, 0) AS restricted, coalesce(t.points, 0) AS points, coalesce(agenda, 0) AS agenda,
    coalesce(v.legal, false) AS legal, i.card_id IS NULL AS lost FROM judged j LEFT JOIN card i ON i.card_id = j.identity_card LEFT JOIN totals t ON t.deck_id = j.deck_id AND t.restriction_id IS NOT DISTINCT FROM j.restriction_id LEFT JOIN restriction r ON r.restriction_id = j.restriction_id
    LEFT JOIN verdict v ON v.card_id = j.identity_card AND v.restriction_id = j.restriction_id),
issue AS (SELECT deck_id, restriction_id, 0 AS place, '' AS card_id, 'unknown_identity' AS text FROM whole WHERE lost
    UNION ALL SELECT deck_id, restriction_id, 1, '', 'identity_side' FROM whole WHERE side_id <> side
    UNION ALL SELECT deck_id, restriction_id, 2, '', 'identity_not_legal:' || identity_card FROM whole WHERE NOT lost AND NOT legal
    UNION ALL SELECT deck_id, restriction_id, 3, card_id, 'unknown_card:' || card_id FROM listing WHERE unknown
    UNION ALL SELECT deck_id, restriction_id, 3.1, card_id, 'wrong_side:' || card_id FROM listing WHERE side_id <> side
    UNION ALL SELECT deck_id, restriction_id, 3.2, card_id, 'extra_identity:' || card_id FROM listing WHERE card_type_id LIKE '%identity'
    UNION ALL SELECT deck_id, restriction_id, 3.3, card_id, 'copies:' || card_id FROM listing WHERE NOT unknown AND qty > most
    UNION ALL SELECT deck_id, restriction_id, 3.4, card_id, 'not_legal:' || card_id FROM listing WHERE NOT unknown AND NOT legal
    UNION ALL SELECT deck_id, restriction_id, 4, '', 'deck_size' FROM whole WHERE NOT lost AND size < least
    UNION ALL SELECT deck_id, restriction_id, 5, '', 'influence' FROM whole WHERE influence > influence_limit
    UNION ALL SELECT deck_id, restriction_id, 6, '', 'restricted' FROM whole WHERE restricted > 1
    UNION ALL SELECT deck_id, restriction_id, 7, '', 'points' FROM whole WHERE points > point_limit
    UNION ALL SELECT deck_id, restriction_id, 8, '', 'agenda_points' FROM whole WHERE NOT lost AND side = 'corp' AND agenda - 2 * (greatest(size, least) // 5) NOT IN (2, 3)
    UNION ALL SELECT deck_id, restriction_id, 9, '', 'identity_differs_from_entry' FROM whole WHERE entry_identity <> identity_card),
issues AS (SELECT j.deck_id, j.restriction_id, coalesce(string_agg(text, ';' ORDER BY floor(place), issue.card_id, place), '') AS issues FROM judged j LEFT JOIN issue ON issue.deck_id = j.deck_id AND issue.restriction_id IS NOT DISTINCT FROM j.restriction_id GROUP BY ALL)"""

#: An event's own list may be a casual one; every ninth deck's identity is told otherwise by its entry.
ISSUES = f"""{ADAPTER}, judged AS (SELECT deck_id, side, identity_card, CASE WHEN bucket % 5 = 4 THEN 'casual' ELSE restriction_id END AS restriction_id, CASE WHEN entry_no % 9 = 0 THEN 'other' ELSE identity_card END AS entry_identity FROM deck JOIN tournament USING (tid)),{RULES}"""


def ruled_decks(t):
    e = t.tournament.select("tid", F.when(F.col("bucket") % 5 == 4, "casual").otherwise(F.col("restriction_id")).alias("restriction_id"))
    return t.deck.join(e, "tid").select("deck_id", "side", "identity_card", "restriction_id", F.when(F.col("entry_no") % 9 == 0, "other").otherwise(F.col("identity_card")).alias("entry_identity"))


@query("rl_01_to_09_deck_issues", f"{ISSUES} SELECT deck_id, issues FROM issues")
def deck_issues(t):
    return rules.deck_issues(ruled_decks(t), t.deck_card, t.card, t.ruling, t.restriction).select("deck_id", "issues")


@query("ag_25_issue_counts", f"SELECT split_part(u, ':', 1) AS issue, count(*) AS n FROM (SELECT unnest(string_split(issues, ';')) AS u FROM ({ISSUES} SELECT * FROM issues) q WHERE issues <> '') GROUP BY 1")
def issue_counts(t):
    i = deck_issues(t).filter("issues <> ''").select(F.explode(F.split("issues", ";")).alias("u"))
    return i.groupBy(F.substring_index("u", ":", 1).alias("issue")).agg(F.count("*").alias("n"))


@query("jn_14_asof_list_in_force", f"{ADAPTER} SELECT t0.tid, t0.date, r.restriction_id AS list_in_force FROM (SELECT tid, (date - INTERVAL 200 DAY)::DATE AS date FROM tournament) t0 ASOF LEFT JOIN restriction r ON t0.date >= r.date_start")
def asof(t):
    return rules.in_force(t.tournament.select("tid", F.date_sub("date", 200).alias("date")), t.restriction).select("tid", "date", "list_in_force")


#: Two snapshots of each list: the later one counts.
@query("jn_15_latest_snapshot_of_a_list", f"{ADAPTER} SELECT restriction_id, max(date_start + INTERVAL (180 * k) DAY)::DATE AS date_start FROM restriction, (VALUES (0), (1)) v(k) GROUP BY 1")
def latest_snapshot(t):
    s = t.restriction.select("restriction_id", F.explode(F.array("date_start", F.date_add("date_start", 180))).alias("date_start"), "card_pool_id")
    return s.groupBy("restriction_id").agg(F.max_by(F.struct("date_start", "card_pool_id"), "date_start").alias("s")).select("restriction_id", "s.date_start")


@query("jn_13_jn_16_fa_01_legal_pairs", f"{ADAPTER} SELECT restriction_id, count_if(legal)::BIGINT AS cards FROM verdict GROUP BY 1")
def legal_pairs(t):
    """Every card but those that a list bars, so the pairs themselves need not be made."""
    barred = t.ruling.filter("barred").groupBy("restriction_id").agg(F.count("*").alias("barred"))
    every = t.card.agg(F.count("*").alias("every"))
    lists = t.restriction.select("restriction_id").join(barred, "restriction_id", "left").withColumn("one", F.lit(1))
    return lists.join(every.withColumn("one", F.lit(1)), "one").select("restriction_id", (F.col("every") - F.coalesce("barred", F.lit(0))).alias("cards"))


@query("jn_17_banned_pairs", f"{ADAPTER} SELECT card_id, restriction_id FROM verdict WHERE banned")
def banned_pairs(t):
    return t.ruling.filter("banned").select("card_id", "restriction_id")


@query("fa_06_flt_11_card_lists", f"{ADAPTER} SELECT card_id, list(restriction_id ORDER BY restriction_id) FILTER (legal) AS legal_in, list(restriction_id ORDER BY restriction_id) FILTER (banned) AS banned_in FROM verdict GROUP BY 1 HAVING count_if(legal) > 0")
def card_lists(t):
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("restriction_id"))))
    v = t.ruling.groupBy("card_id").agg(some(F.col("barred")).alias("barred_in"), some(F.col("banned")).alias("banned_in"))
    every = t.restriction.agg(F.array_sort(F.collect_list("restriction_id")).alias("every")).withColumn("one", F.lit(1))
    c = t.card.select("card_id", F.lit(1).alias("one")).join(every, "one").join(v, "card_id", "left")
    none = F.array().cast("array<string>")
    c = c.select("card_id", F.array_except("every", F.coalesce("barred_in", none)).alias("legal_in"), F.when(F.size("banned_in") > 0, F.col("banned_in")).alias("banned_in"))
    return c.filter(F.size("legal_in") > 0)


CHOICE = f"""{ADAPTER}, ev AS (SELECT tid, date, CASE bucket % 3 WHEN 0 THEN restriction_id WHEN 1 THEN 'casual' END AS set_list FROM tournament),
sp AS (SELECT *, lead(date_start) OVER (ORDER BY date_start) AS until, lag(restriction_id) OVER (ORDER BY date_start) AS previous, lead(restriction_id) OVER (ORDER BY date_start) AS following FROM restriction),
gv AS (SELECT ev.tid, coalesce(r.restriction_id, sp.restriction_id) AS given, sp.restriction_id AS current, previous, following FROM ev LEFT JOIN sp ON date >= date_start AND (until IS NULL OR date < until) LEFT JOIN restriction r ON r.restriction_id = set_list),
ca AS (SELECT tid, given, candidate, min(place) AS place FROM (SELECT tid, given, unnest([given, current, previous, following]) AS candidate, unnest([0, 1, 2, 3]) AS place FROM gv) WHERE candidate IS NOT NULL GROUP BY ALL),
judged AS (SELECT DISTINCT deck_id, side, identity_card, candidate AS restriction_id, NULL::VARCHAR AS entry_identity FROM deck JOIN ca USING (tid)),{RULES},
good AS (SELECT ca.*, count_if(issues = '') AS legal, count(*) AS decks FROM ca JOIN deck USING (tid) JOIN issues ON issues.deck_id = deck.deck_id AND issues.restriction_id = ca.candidate GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY legal DESC, place) AS k, max(legal) FILTER (place = 0) OVER (PARTITION BY tid) AS was FROM good)"""


@query("rl_11_given_list", f"{CHOICE} SELECT tid, given FROM gv")
def given_list(t):
    return rules.given_list(listed_events(t), t.restriction).select("tid", "given")


def listed_events(t):
    """Organisers set a standard list, a casual one or none."""
    set_list = F.when(F.col("bucket") % 3 == 0, F.col("restriction_id")).when(F.col("bucket") % 3 == 1, "casual")
    return t.tournament.select("tid", "date", set_list.alias("set_list"))


@query("rl_12_wn_09_ag_26_chosen_list", f"{CHOICE} SELECT tid, given, CASE WHEN legal - was >= greatest(2, decks * 0.1) THEN candidate ELSE given END AS chosen, was AS legal_before, legal AS legal_after FROM top WHERE k = 1")
def chosen_list(t):
    return rules.chosen_list(listed_events(t), t.deck, t.deck_card, t.card, t.ruling, t.restriction)


LOG = """WITH l AS (SELECT user_id AS game_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'turn' WHEN 'click' THEN 'gain' WHEN 'purchase' THEN 'spend' WHEN 'view' THEN 'draw' WHEN 'error' THEN 'damage' END AS kind, floor(value)::BIGINT AS amount FROM events),
n0 AS (SELECT *, sum((kind = 'turn')::INTEGER) OVER (PARTITION BY game_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS turn, CASE kind WHEN 'gain' THEN amount WHEN 'spend' THEN -amount ELSE 0 END AS delta FROM l),
n AS (SELECT *, (coalesce(max(CASE WHEN kind = 'turn' THEN amount END) OVER w, 5) + sum(delta) OVER w)::BIGINT AS pool FROM n0 WINDOW w AS (PARTITION BY game_id, turn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def log(t):
    return logs.numbered(logs.lines(t.raw("events")))


@query("wn_12_wn_13_wn_14_running_pool", f"{LOG} SELECT game_id, event_id, kind, turn, delta, pool FROM n")
def running_pool(t):
    return log(t).select("game_id", "event_id", "kind", "turn", "delta", "pool")


@query("wn_15_log_45_segment_check", f"""{LOG}, s AS (SELECT game_id, turn, arg_max(pool, (ts, event_id)) AS derived_end, max(CASE WHEN kind = 'turn' THEN amount END) AS printed FROM n GROUP BY ALL),
c AS (SELECT *, lead(printed) OVER (PARTITION BY game_id ORDER BY turn) AS printed_next FROM s) SELECT game_id, turn, derived_end, printed_next, derived_end = printed_next AS ok FROM c WHERE printed_next IS NOT NULL""")
def segment_check(t):
    return logs.segment_check(log(t))


@query("wn_16_17_18_19_dense_series", f"""{LOG}, p AS (SELECT game_id, turn, sum(CASE WHEN kind = 'gain' THEN amount ELSE 0 END)::BIGINT AS gained, sum(CASE WHEN kind = 'spend' THEN amount ELSE 0 END)::BIGINT AS spent, arg_max(pool, (ts, event_id)) AS e FROM n GROUP BY ALL),
s AS (SELECT game_id, unnest(range(0, max(turn) + 1)) AS turn FROM p GROUP BY game_id), d AS (SELECT s.game_id, s.turn, coalesce(gained, 0) AS gained, coalesce(spent, 0) AS spent, e FROM s LEFT JOIN p ON p.game_id = s.game_id AND p.turn = s.turn)
SELECT game_id, turn, gained, spent, gained - spent AS net, (sum(gained) OVER w)::BIGINT AS total_gained, coalesce(last_value(e IGNORE NULLS) OVER w, 5)::BIGINT AS pool FROM d WINDOW w AS (PARTITION BY game_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def dense_series(t):
    return logs.dense_series(log(t))


@query("wn_10_copy_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INTEGER AS copy FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n > 1")
def copy_numbers(t):
    w = W.partitionBy("user_id", "event_type")
    e = t.raw("events").select("event_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("copy"), F.count("*").over(w).alias("n"))
    return e.filter("n > 1").drop("n")


@query("wn_14_event_type_counts", f"{LOG} SELECT game_id, count(*) FILTER (kind = 'gain') AS gains, count(*) FILTER (kind = 'draw') AS draws, sum(CASE WHEN kind = 'damage' THEN amount ELSE 0 END)::BIGINT AS damage, max(pool) AS peak_pool, max(turn) AS rounds FROM n GROUP BY 1")
def action_counts(t):
    return log(t).groupBy("game_id").agg(F.count_if(F.col("kind") == "gain").alias("gains"), F.count_if(F.col("kind") == "draw").alias("draws"), F.sum(F.when(F.col("kind") == "damage", F.col("amount")).otherwise(0)).alias("damage"), F.max("pool").alias("peak_pool"), F.max("turn").alias("rounds"))


@query("src_20_text_lines", r"SELECT conv_id, turn, count(*) FILTER (trim(u) <> '') AS lines FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS u FROM conversations) GROUP BY 1, 2")
def log_lines(t):
    c = t.raw("conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\r?\n")))
    return c.groupBy("conv_id", "turn").agg(F.count_if(F.trim("col") != "").alias("lines"))


@query("fj_01_json_props", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def json_props(t):
    return t.raw("events").groupBy("event_type").agg(F.sum(F.from_json("props", "k long")["k"]).alias("k"))


@query("src_17_keep_first_rank", f"{ADAPTER} SELECT tid, priority, deck_id FROM (SELECT *, row_number() OVER (PARTITION BY tid, priority ORDER BY entry_no) AS k FROM deck WHERE priority IS NOT NULL) WHERE k = 1")
def keep_first_rank(t):
    return t.deck.filter("priority is not null").withColumn("k", F.row_number().over(W.partitionBy("tid", "priority").orderBy("entry_no"))).filter("k = 1").select("tid", "priority", "deck_id")


@query("src_05_fs_08_alias_fan_out", f"{ADAPTER} SELECT deck_id, unnest([deck_id, substr(sha256(concat_ws('|', tid, entry_no, side)), 1, 16)]) AS alias FROM deck")
def alias_fan_out(t):
    key = F.substring(F.sha2(F.concat_ws("|", "tid", F.col("entry_no").cast("string"), "side"), 256), 1, 16)
    return t.deck.select("deck_id", F.explode(F.array("deck_id", key)).alias("alias"))


_RANK = ["corp_identity", "runner_identity", "agenda", "asset", "event", "operation", "program"]


@query("fs_09_fs_10_so_13_plain_text_decks", f"""{ADAPTER}, rk AS (SELECT deck_id, x.card_id, qty, coalesce(title, x.card_id) AS title, coalesce(list_position({_RANK}, card_type_id), {len(_RANK) + 1}) AS r FROM deck_card x LEFT JOIN card USING (card_id)),
pt AS (SELECT deck_id, coalesce(i.title, identity_card) || chr(10) || (SELECT string_agg(qty || ' ' || title, chr(10) ORDER BY r, title, card_id) FROM rk WHERE rk.deck_id = d.deck_id) AS plain_text FROM deck d LEFT JOIN card i ON i.card_id = identity_card WHERE deck_id IN (SELECT deck_id FROM deck_card))
SELECT deck_id, plain_text, 'sha256:' || sha256(plain_text) AS content_hash FROM pt""")
def plain_text(t):
    """The identity, then the cards by the rank of their type, title and id; an unknown card stands by its id, last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, _RANK)), F.col("card_type_id")), F.lit(0)), F.lit(len(_RANK) + 1))
    titled = F.coalesce("title", "card_id")
    cards = t.deck_card.join(t.card.select("card_id", "title", "card_type_id"), "card_id", "left")
    line = F.struct(rank.alias("r"), titled.alias("t"), "card_id", F.concat_ws(" ", "qty", titled).alias("line"))
    d = cards.groupBy("deck_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("list"))
    own = t.card.select(F.col("card_id").alias("identity_card"), F.col("title").alias("own"))
    d = t.deck.select("deck_id", "identity_card").join(d, "deck_id").join(own, "identity_card", "left").withColumn("plain_text", F.concat_ws("\n", F.coalesce("own", "identity_card"), "list"))
    return d.select("deck_id", "plain_text", F.concat(F.lit("sha256:"), F.sha2("plain_text", 256)).alias("content_hash"))


@query("st_03_multiset_overlap", f"""{ADAPTER}, a AS (SELECT tid, card.faction_id AS f, count(*) AS n FROM deck JOIN card ON card.card_id = identity_card WHERE side = 'corp' GROUP BY ALL), b AS (SELECT tid, card.faction_id AS f, count(*) AS n FROM deck JOIN card ON card.card_id = identity_card WHERE side = 'runner' GROUP BY ALL)
SELECT tid, sum(least(a.n, b.n))::BIGINT AS shared FROM a JOIN b USING (tid, f) GROUP BY tid""")
def multiset_overlap(t):
    d = t.deck.join(t.card.select(F.col("card_id").alias("identity_card"), "faction_id"), "identity_card")
    n = d.groupBy("tid", "faction_id").agg(F.count_if(F.col("side") == "corp").alias("a"), F.count_if(F.col("side") == "runner").alias("b")).filter("a > 0 and b > 0")
    return n.groupBy("tid").agg(F.sum(F.least("a", "b")).alias("shared"))


@query("st_02_jn_21_decks_without_cards", f"{ADAPTER} SELECT deck_id FROM deck EXCEPT SELECT deck_id FROM deck_card")
def decks_without_cards(t):
    return t.deck.select("deck_id").join(t.deck_card.select("deck_id").distinct(), "deck_id", "left_anti")


@query("st_01_key_union", f"{ADAPTER} SELECT tid FROM tournament WHERE date < '1996-06-01' UNION SELECT tid FROM tournament WHERE date > '2000-01-01'")
def key_union(t):
    return t.tournament.filter("date < date'1996-06-01'").select("tid").union(t.tournament.filter("date > date'2000-01-01'").select("tid")).distinct()


@query("st_09_equal_card_lists", f"{ADAPTER}, m AS (SELECT deck_id, string_agg(card_id || ':' || qty, ',' ORDER BY card_id) AS cards FROM deck_card GROUP BY 1) SELECT cards, count(*) AS decks FROM m GROUP BY 1 HAVING count(*) > 1")
def equal_decks(t):
    m = t.deck_card.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("card_id", "qty"))).alias("l"))
    m = m.select(F.array_join(F.transform("l", lambda x: F.concat(x["card_id"], F.lit(":"), x["qty"].cast("string"))), ",").alias("cards"))
    return m.groupBy("cards").agg(F.count("*").alias("decks")).filter("decks > 1")


@query("fs_13_tiers", f"{ADAPTER} SELECT tid, {text.tier_sql('name')} AS tier_of_name FROM tournament")
def tiers(t):
    return t.tournament.select("tid", text.tier(F.col("name")).alias("tier_of_name"))


@query("fs_14_so_09_ql_15_search", f"{ADAPTER}, s AS (SELECT title, card_id, CASE WHEN starts_with(lower(title), 'a') THEN 0 WHEN contains(lower(title), ' a') THEN 1 WHEN contains(lower(title), 'a') THEN 2 END AS score FROM card) SELECT * FROM s WHERE score IS NOT NULL ORDER BY score, title, card_id LIMIT 8")
def search(t):
    s = t.card.select("title", "card_id", text.search_score(F.col("title"), "a").alias("score"))
    return s.filter("score is not null").orderBy("score", "title", "card_id").limit(8)


@query("snk_09_csv_cells", f"""{ADAPTER} SELECT card_id, '"' || replace(CASE WHEN regexp_matches(title, '^[=+\\-@\\t\\r]') THEN '''' || title ELSE title END, '"', '""') || '"' AS cell FROM card""")
def csv_cells(t):
    return t.card.select("card_id", text.csv_cell(F.col("title")).alias("cell"))


_IDS = ["'12'", "'1234567890'", "'0a1b2c3d-0000-4000-8000-00000000000f'", "'0A1B2C3D-0000-4000-8000-00000000000F'", "'a_slug_9'", "'Slug'", "'01234'", "'7' || chr(10)", "''", "NULL"]


@query("fs_05_strict_ids", f"""SELECT p_partkey, CASE WHEN m IN (0, 6) THEN v END AS "int", CASE WHEN m = 2 THEN v END AS uuid, CASE WHEN m IN (0, 1, 4, 6) THEN v END AS slug, CASE WHEN m = 6 THEN v END AS printing
FROM (SELECT p_partkey, p_partkey % 10 AS m, [{", ".join(_IDS)}][p_partkey % 10 + 1] AS v FROM part)""")
def strict_ids(t):
    """Values of each form, and ones that just miss it, also by a trailing newline."""
    value = F.element_at(F.expr(f"array({', '.join(x.replace('|| chr(10)', '|| char(10)') for x in _IDS)})"), (F.col("p_partkey") % 10 + 1).cast("int"))
    return t.raw("part").withColumn("v", value).select("p_partkey", *[text.strict(F.col("v"), form).alias(form) for form in text.STRICT])


@query("fd_01_strict_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN o_orderdate::DATE END AS d FROM orders")
def strict_dates(t):
    """Three spellings, one with a day that is not in the calendar, two that are none, and no date."""
    k = (F.col("o_orderkey") % 7).cast("int")
    forms = [F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy.MM.dd."), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("o_orderdate", "yyyy-'02-30'"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.concat(F.lit("x"), F.date_format("o_orderdate", "yyyy-MM-dd"))]
    spelt = F.when(k < 6, F.element_at(F.array(*forms), F.least(k, F.lit(5)) + 1))
    return t.raw("orders").select("o_orderkey", dates.strict_date(spelt).alias("d"))


@query("fd_03_months", f"{ADAPTER} SELECT tid, strftime(date - INTERVAL 5 MONTH, '%Y-%m') AS before, list_transform(generate_series(date - INTERVAL 2 MONTH, date::TIMESTAMP, INTERVAL 1 MONTH), lambda x: strftime(x, '%Y-%m')) AS months FROM tournament")
def months(t):
    m = dates.month(F.col("date"))
    return t.tournament.select("tid", dates.add_months(m, -5).alias("before"), dates.months_between(dates.add_months(m, -2), m).alias("months"))


@query("fm_01_fm_02_ratio_and_interval", f"SELECT l_orderkey, l_linenumber, CASE WHEN n > 0 THEN {ratios.WILSON_SQL['low']} END AS low, CASE WHEN n > 0 THEN {ratios.WILSON_SQL['high']} END AS high FROM (SELECT l_orderkey, l_linenumber, l_linenumber::DOUBLE - 1 AS n, least(l_quantity, l_linenumber - 1)::DOUBLE AS w FROM lineitem)")
def interval(t):
    n = F.col("l_linenumber").cast("double") - 1
    low, high = ratios.wilson(F.least("l_quantity", n), n)
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high"))


PRIORITY = f"""{ADAPTER}, pq AS (SELECT tid, CASE tier WHEN 'ASIA' THEN 4 WHEN 'EUROPE' THEN 3 WHEN 'AFRICA' THEN 2 ELSE 1 END * 1000.0::DOUBLE + least(players, 999) + CASE WHEN bucket % 3 > 0 THEN greatest(0.0, 365.0 - (DATE '2001-08-01' - date)) / 1000.0 ELSE 0 END AS priority, bucket % 2 AS bonus, date FROM tournament)"""


@query("fm_14_fm_15_event_priority", f"{PRIORITY} SELECT tid, priority::DOUBLE AS base, (priority + bonus * 50000)::DOUBLE AS with_bonus FROM pq")
def priority(t):
    """Tier weight, players and recency where it is known; a bonus is a whole multiple, so the remainder gives the priority back."""
    weight = F.when(F.col("tier") == "ASIA", 4).when(F.col("tier") == "EUROPE", 3).when(F.col("tier") == "AFRICA", 2).otherwise(1)
    recent = F.when(F.col("bucket") % 3 > 0, F.greatest(F.lit(0.0), 365.0 - F.datediff(F.to_date(F.lit("2001-08-01")), "date")) / 1000.0).otherwise(0.0)
    p = weight * 1000.0 + F.least("players", F.lit(999)) + recent
    all_in = p + F.col("bucket") % 2 * 50_000
    return t.tournament.select("tid", F.pmod(all_in, F.lit(50_000.0)).alias("base"), all_in.alias("with_bonus"))


@query("so_12_flt_28_due_queue", f"{PRIORITY} SELECT tid, row_number() OVER (ORDER BY priority + bonus * 50000 DESC, date, tid)::INTEGER AS place FROM pq WHERE date <= DATE '1999-01-01' AND bonus = 1")
def due_queue(t):
    """What is due and not frozen by priority, date and key; numbered over ranges."""
    due = priority(t).join(t.tournament.select("tid", "date", "bucket"), "tid").filter((F.col("date") <= "1999-01-01") & (F.col("bucket") % 2 == 1))
    return ranked(due.select("tid", "with_bonus", "date"), [], [F.desc("with_bonus"), F.asc("date"), F.asc("tid")], "place").select("tid", "place")


@query("fm_16_fm_17_intervals", "SELECT o_orderkey, least(greatest(o_orderkey % 40 * 2, 1), CASE WHEN o_orderkey % 500 < 14 THEN 1 WHEN o_orderkey % 500 < 90 THEN 7 ELSE 30 END) AS days, least(pow(2, o_orderkey % 12), 30)::DOUBLE AS retry_days FROM orders")
def intervals(t):
    age = F.col("o_orderkey") % 500
    most = F.when(age < 14, 1).when(age < 90, 7).otherwise(30)
    return t.raw("orders").select("o_orderkey", F.least(F.greatest(F.col("o_orderkey") % 40 * 2, F.lit(1)), most).alias("days"), F.least(F.pow(F.lit(2.0), F.col("o_orderkey") % 12), F.lit(30.0)).alias("retry_days"))


@query("wn_08_ql_12_ban_periods", f"{ADAPTER} SELECT restriction_id, strftime(date_start, '%Y-%m') AS a, strftime(lead(date_start) OVER (ORDER BY date_start) - INTERVAL 1 MONTH, '%Y-%m') AS b FROM restriction")
def ban_periods(t):
    following = F.lead("date_start").over(W.orderBy("date_start"))
    return t.restriction.select("restriction_id", dates.month(F.col("date_start")).alias("a"), dates.month(F.add_months(following, -1)).alias("b"))


@query("fs_01_02_03_folded_titles")
def folded(t):
    """NFKD has no SQL form; tests hold it against Python."""
    return t.card.select("card_id", text.title_key(F.col("title")).alias("title_key"), text.name_key(F.col("title")).alias("name_key"), text.fold(F.col("title")).alias("folded"))
