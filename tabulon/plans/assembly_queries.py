"""Queries on the assembly of canonical rows: registries' records are derived from the canonical and star-schema tables so that each rule
has rows that meet it and rows that don't."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions import text
from tabulon.operators import assembly as a
from tabulon.operators import rules
from tabulon.operators.ranking import ranked
from tabulon.plans.registry import query
from tabulon.sources.adapters import ADAPTER, pick

SCORES = [3, 0, 1, None, 2]


def score(div: int):
    return F.element_at(F.array(*[F.lit(s) for s in SCORES]), (F.floor(F.col("o_orderkey") / div) % 5 + 1).cast("int"))


def pairings(t):
    """Each entry is paired with the next one, the last with nobody; every 23rd entry is unknown."""
    known = lambda e: F.when(e % 23 != 0, e)
    e, k, has = F.col("entry_no"), F.col("o_orderkey"), F.col("has_next")
    return t._seats.select(
        "tid", F.lit(1).alias("stage"), F.lit(1).alias("round"), e.alias("table"), (e < F.col("cut_size")).alias("elimination"), (F.col("bucket") % 2 == 1).alias("double_sided"),
        e.alias("p1"), F.when(has, e + 1).alias("p2"), known(e).alias("e1"), F.when(has, known(e + 1)).alias("e2"),
        F.element_at(F.array(F.lit("corp"), F.lit("runner"), F.lit("corp"), F.lit(None)), (k % 4 + 1).cast("int")).alias("p1_side"),
        score(1).alias("p1_corp_score"), score(5).alias("p1_runner_score"), score(25).alias("p2_corp_score"), score(125).alias("p2_runner_score"),
        (k % 17 == 0).alias("intentional_draw"), (k % 13 == 0).alias("two_for_one"), F.when(k % 3 != 0, k % 3).cast("int").alias("winner"),
    )


def _s(div: int) -> str:
    return f"[3, 0, 1, NULL, 2][(o_orderkey // {div}) % 5 + 1]"


PAIRED = f"""{ADAPTER}, pr AS (SELECT tid, entry_no AS "table", entry_no < cut_size AS elimination, bucket % 2 = 1 AS double_sided, entry_no AS p1, CASE WHEN entry_no < players THEN entry_no + 1 END AS p2, CASE WHEN entry_no % 23 > 0 THEN entry_no END AS e1,
    CASE WHEN entry_no < players AND (entry_no + 1) % 23 > 0 THEN entry_no + 1 END AS e2, ['corp', 'runner', 'corp', NULL][o_orderkey % 4 + 1] AS p1_side, {_s(1)} AS c1, {_s(5)} AS r1, {_s(25)} AS c2, {_s(125)} AS r2, o_orderkey % 17 = 0 AS drawn, o_orderkey % 13 = 0 AS joint, nullif(o_orderkey % 3, 0) AS winner FROM numbered)"""
SCORE = "CASE WHEN {c} = 3 OR ({c} IS NULL AND {r} = 0) THEN 'corp_win' WHEN {r} = 3 OR ({r} IS NULL AND {c} = 0) THEN 'runner_win' WHEN {c} = 0 AND {r} = 0 THEN NULL WHEN {c} = 1 OR {r} = 1 THEN 'draw' WHEN {c} = 0 THEN 'runner_win' WHEN {r} = 0 THEN 'corp_win' END"


@query("rl_14_score_results", f"SELECT o_orderkey, {SCORE.format(c=_s(1), r=_s(5))} AS result FROM orders")
def score_results(t):
    return t.raw("orders").select("o_orderkey", F.nullif(a.result(score(1), score(5)), F.lit("")).alias("result"))


@query(
    "rl_13_flt_20_games_of_pairings",
    f"""{PAIRED}, fine AS (SELECT * FROM pr WHERE e1 IS NOT NULL AND e2 IS NOT NULL), gm AS (
    SELECT tid, "table", elimination, p1_side AS side, CASE WHEN (winner = 1) = (p1_side = 'corp') THEN 'corp_win' ELSE 'runner_win' END AS result, e1, e2 FROM fine WHERE elimination AND winner IS NOT NULL AND p1_side IS NOT NULL
    UNION ALL SELECT tid, "table", elimination, 'corp', CASE WHEN drawn THEN 'intentional_draw' ELSE {SCORE.format(c="c1", r="r2")} END, e1, e2 FROM fine WHERE NOT elimination AND ((double_sided AND NOT joint) OR (NOT double_sided AND p1_side = 'corp'))
    UNION ALL SELECT tid, "table", elimination, 'runner', CASE WHEN drawn THEN 'intentional_draw' ELSE {SCORE.format(c="c2", r="r1")} END, e1, e2 FROM fine WHERE NOT elimination AND ((double_sided AND NOT joint) OR (NOT double_sided AND p1_side = 'runner')))
SELECT tid, "table", elimination, side, CASE side WHEN 'corp' THEN e1 ELSE e2 END AS corp_entry, CASE side WHEN 'corp' THEN e2 ELSE e1 END AS runner_entry, result FROM gm WHERE result IS NOT NULL""",
)
def games_of_pairings(t):
    return a.games(pairings(t)).drop("stage", "round")


@query(
    "flt_17_flt_18_fd_06_live_events",
    f"""{PAIRED}, un AS (SELECT tid, bool_or(p2 IS NOT NULL AND CASE WHEN elimination THEN winner IS NULL WHEN double_sided THEN c1 IS NULL OR r1 IS NULL OR c2 IS NULL OR r2 IS NULL ELSE c1 IS NULL AND r1 IS NULL END) AS missing FROM pr GROUP BY tid)
SELECT t0.tid, missing AS unreported, date >= today - INTERVAL 3 DAY OR (date >= today - INTERVAL 14 DAY AND missing) AS live FROM (SELECT *, max(date) OVER () AS today FROM tournament) t0 JOIN un USING (tid)""",
)
def live_events(t):
    today = t.tournament.agg(F.max("date").alias("today"))
    e = a.unreported(t.tournament, pairings(t)).join(t.tournament.select("tid", "date"), "tid").withColumn("one", F.lit(1)).join(today.withColumn("one", F.lit(1)), "one")
    return e.select("tid", "unreported", a.live(F.col("date"), F.col("today"), F.col("unreported")).alias("live"))


@query("wn_07_round_numbers", f"""{ADAPTER}, rd AS (SELECT tid, entry_no AS place, o_orderkey % 6 = 0 AS flagged, 3 - (y % 4) AS prelim FROM numbered), sw AS (SELECT *, count_if(NOT flagged) OVER (PARTITION BY tid ORDER BY place) - (NOT flagged)::INTEGER AS plain FROM rd),
el AS (SELECT *, flagged OR (prelim > 0 AND plain >= prelim) AS elimination FROM sw) SELECT tid, place, elimination, elimination::INTEGER + 1 AS stage, count(*) OVER (PARTITION BY tid, elimination ORDER BY place) AS round FROM el""")
def round_numbers(t):
    r = t._seats.select("tid", F.col("entry_no").alias("place"), (F.col("o_orderkey") % 6 == 0).alias("flagged"), (3 - F.col("y") % 4).alias("prelim"))
    return a.numbered_rounds(r)


@query("wn_06_provisional_cut", f"""{PAIRED}, pl AS (SELECT tid, entry_no AS pid, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS rk FROM numbered), inn AS (SELECT tid, p1 AS pid FROM pr WHERE elimination UNION SELECT tid, p2 FROM pr WHERE elimination AND p2 IS NOT NULL)
SELECT tid, pid, row_number() OVER (PARTITION BY tid ORDER BY coalesce(rk, 1000000), pid)::INTEGER AS cut_rank FROM pl JOIN inn USING (tid, pid)""")
def provisional_cut(t):
    players = t._seats.select("tid", F.col("entry_no").alias("pid"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 7).alias("swiss_rank"))
    return a.provisional_cut(players, pairings(t))


@query("flt_19_decks_to_fetch", f"{ADAPTER} SELECT tid, entry_no AS pid FROM numbered WHERE bucket % 3 = 0 OR (bucket % 3 = 1 AND entry_no <= cut_size)")
def decks_to_fetch(t):
    swiss, cut = F.when(F.col("bucket") % 3 == 0, "public").otherwise("private"), F.when(F.col("bucket") % 3 != 2, "public").otherwise("open")
    return a.decks_to_fetch(t._seats.select("tid", F.col("entry_no").alias("pid"), F.when(F.col("entry_no") <= F.col("cut_size"), F.col("entry_no")).alias("cut_rank"), swiss.alias("swiss_visibility"), cut.alias("cut_visibility")))


LISTING = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'startup' WHEN 1 THEN NULL ELSE 'standard' END AS format, CASE WHEN o_orderkey % 11 > 0 THEN 1 ELSE 0 END AS approved, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS concluded, o_orderkey % 13 = 0 AS conflict, (o_orderkey % 20)::INTEGER AS players, o_orderdate::DATE AS date FROM orders"""


def listing(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select(
        "o_orderkey", F.when(k % 7 == 0, "startup").when(k % 7 != 1, "standard").alias("format"), F.when(k % 11 != 0, 1).otherwise(0).alias("approved"), F.when(k % 5 == 1, False).when(k % 5 > 1, True).alias("concluded"), (k % 13 == 0).alias("claim_conflict"), (k % 20).cast("int").alias("players"), F.to_date("o_orderdate").alias("date"),
    )


REASON = "CASE WHEN format IS DISTINCT FROM 'standard' THEN 'not_standard' WHEN approved <> 1 THEN 'unapproved' WHEN concluded IS NOT TRUE THEN 'not_concluded' WHEN conflict THEN 'claim_conflict' WHEN players < 8 THEN 'too_small' WHEN date < '1996-06-01' THEN 'before_window' END"


@query("flt_12_listing_reasons", f"SELECT o_orderkey, {REASON} AS reason FROM ({LISTING})")
def listing_reasons(t):
    return listing(t).select("o_orderkey", a.listing_reason(8, F.to_date(F.lit("1996-06-01"))).alias("reason"))


@query("ag_25_flt_13_skipped_by_reason", f"SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM ({LISTING}) GROUP BY 1")
def skipped_by_reason(t):
    return listing_reasons(t).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


NAMED = ["Spring Startup Open", "STANDARD league", "Winter Draft", "Store Championship", "Start Up night", "Cube", "Standards", "System Gateway 1.1.1.1"]


@query(
    "flt_14_flt_15_not_standard",
    f"""SELECT o_orderkey, CASE WHEN f IS NOT NULL THEN CASE WHEN lower(trim(f)) <> 'standard' THEN 'not_standard' END WHEN linked THEN CASE WHEN lf IS DISTINCT FROM 'standard' THEN 'not_standard' END WHEN n IN (0, 2, 4, 5, 7) THEN 'not_standard_name'
    WHEN idents = 0 THEN CASE WHEN n <> 1 THEN 'format_unknown' END WHEN near IS NOT TRUE THEN 'format_unknown' WHEN illegal THEN 'not_standard_identities' END AS reason
FROM (SELECT o_orderkey, [NULL, ' Standard', 'Eternal', NULL, NULL, NULL][o_orderkey % 6 + 1] AS f, o_orderkey % 4 = 0 AS linked, [NULL, 'standard', 'startup'][o_orderkey % 3 + 1] AS lf, o_orderkey % {len(NAMED)} AS n, o_orderkey % 5 AS idents, [NULL, true, true][o_orderkey // 8 % 3 + 1] AS near, o_orderkey % 9 < 3 AS illegal FROM orders)""",
)
def not_standard(t):
    k = F.col("o_orderkey")
    of = lambda values, index: F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
    e = t.raw("orders").select(
        "o_orderkey", of([None, " Standard", "Eternal", None, None, None], k % 6).alias("format_name"), (k % 4 == 0).alias("linked"), of([None, "standard", "startup"], k % 3).alias("linked_format"), of(NAMED, k % len(NAMED)).alias("name"),
        (k % 5).alias("identities"), of([None, True, True], F.floor(k / 8) % 3).alias("near"), (k % 9 < 3).alias("illegal"),
    )
    return e.select("o_orderkey", a.not_standard_reason().alias("reason"))


@query("flt_16_rl_15_online_and_tier", f"""{ADAPTER} SELECT tid, CASE WHEN own = 'online' AND bucket % 3 > 0 THEN tier ELSE own END AS tier, (bucket % 3 = 1 AND online) OR contains(lower(name), 'online') OR bucket % 3 = 2 AS online FROM (SELECT *, {text.tier_sql('name')} AS own FROM tournament)""")
def online_and_tier(t):
    linked = F.col("bucket") % 3
    return t.tournament.select("tid", a.preferred_tier(text.tier(F.col("name")), F.when(linked > 0, F.col("tier"))).alias("tier"), a.online(F.when(linked == 1, F.col("online")), F.col("name"), F.lit("league"), F.when(linked == 2, F.lit(True))).alias("online"))


#: Two registries of the same events: the second has other ids, some other sizes, events of two days, and of the identity pairs a part.
LINKS = f"""{ADAPTER}, own AS (SELECT tid, row_number() OVER (ORDER BY tid) AS id, date, players AS size, bucket FROM tournament), oth AS (SELECT 1000000 + id AS other_id, (date - INTERVAL (id % 4) DAY)::DATE AS date, CASE WHEN id % 3 = 0 THEN (date + INTERVAL 1 DAY)::DATE END AS end_date, CASE WHEN id % 10 = 9 THEN size + 1 ELSE size END AS size, id, tid FROM own),
op AS (SELECT id, own.tid, coalesce(corp_identity, '') || '/' || coalesce(runner_identity, '') AS pair, entry_no FROM own JOIN entry USING (tid)),
tp AS (SELECT other_id, CASE WHEN oth.id % 5 = 4 AND entry_no % 4 = 0 THEN 'other' ELSE pair END AS pair FROM oth JOIN op ON op.tid = oth.tid WHERE entry_no % 3 > 0 AND oth.id % 7 > 0),
nr AS (SELECT own.id, other_id FROM own JOIN oth ON own.size = oth.size AND own.date BETWEEN oth.date - INTERVAL 1 DAY AND coalesce(end_date, oth.date) + INTERVAL 1 DAY),
ov AS (SELECT nr.id, nr.other_id, sum(t.n) AS known, sum(least(t.n, coalesce(o.n, 0))) AS shared FROM nr JOIN (SELECT other_id, pair, count(*) AS n FROM tp GROUP BY ALL) t USING (other_id) LEFT JOIN (SELECT id, pair, count(*) AS n FROM op GROUP BY ALL) o ON o.id = nr.id AND o.pair = t.pair GROUP BY ALL),
cand AS (SELECT nr.id, nr.other_id, coalesce(known, 0)::BIGINT AS known, coalesce(shared, 0)::BIGINT AS shared FROM nr LEFT JOIN ov USING (id, other_id) WHERE coalesce(shared, 0) >= 0.9 * coalesce(known, 0))"""


def registries(t):
    own = t.keep("numbered_events", lambda: ranked(t.tournament.select("tid", "date", F.col("players").alias("size")), [], [F.col("tid")], "id").select("tid", F.col("id").cast("long").alias("id"), "date", "size"))
    k = F.col("id")
    oth = own.select((k + 1_000_000).alias("other_id"), F.date_sub("date", (k % 4).cast("int")).alias("date"), F.when(k % 3 == 0, F.date_add("date", 1)).alias("end_date"), F.when(k % 10 == 9, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "id", "tid")
    pair = F.concat_ws("/", F.coalesce("corp_identity", F.lit("")), F.coalesce("runner_identity", F.lit("")))
    op = own.join(t.entry, "tid").select("id", "tid", pair.alias("pair"), "entry_no")
    tp = oth.join(op.drop("id"), "tid").filter("entry_no % 3 > 0 and id % 7 > 0").select("other_id", F.when((k % 5 == 4) & (F.col("entry_no") % 4 == 0), "other").otherwise(F.col("pair")).alias("pair"))
    return own, oth, op, tp


@query("jn_18_jn_19_st_03_link_candidates", f"{LINKS} SELECT id, other_id, known, shared FROM cand")
def link_candidates(t):
    own, oth, op, tp = registries(t)
    return a.link_candidates(own.select("id", "date", "size"), oth.drop("id", "tid"), op.select("id", "pair"), tp).select("id", "other_id", "known", "shared")


@query("jn_20_direct_links", f"{LINKS} SELECT id, CASE WHEN id % 6 = 0 THEN other_id END AS other_id, CASE WHEN id % 6 > 0 THEN 'abr_code_unresolved' END AS mismatch FROM oth WHERE id % 6 < 4")
def direct_links(t):
    """Codes: the right one, one of no event, one that is no number, a blank one and none."""
    own, oth, _, _ = registries(t)
    k = F.col("id")
    code = F.when(k % 6 == 0, F.concat(F.lit(" "), (k + 1_000_000).cast("string"))).when(k % 6 == 1, (k + 5_000_000).cast("string")).when(k % 6 == 2, F.concat(F.lit("x"), k.cast("string"))).when(k % 6 == 3, "99999999999999999999").when(k % 6 == 4, " ")
    return a.direct_links(own.withColumn("code", code), oth)


@query("jn_18_t_09_greedy_links")
def greedy_links(t):
    """Resolution in order of ids is sequential and has no SQL form; tests hold it against a loop."""
    own, oth, op, tp = registries(t)
    c = a.link_candidates(own.select("id", "date", "size"), oth.drop("id", "tid"), op.select("id", "pair"), tp).join(own.select("id", "size"), "id")
    return a.resolved_links(c, oth.filter("id % 6 = 0").select("other_id"))


@query("jn_21_unlinked_events", f"{LINKS} SELECT other_id FROM oth WHERE id % 6 > 0")
def unlinked_events(t):
    _, oth, _, _ = registries(t)
    return oth.select("other_id").join(direct_links(t).filter("other_id is not null").select("other_id"), "other_id", "left_anti")


@query("jn_22_matching_entries", f"{ADAPTER} SELECT tid, entry_no, CASE WHEN entry_no % 4 > 0 THEN NOT ((entry_no % 5 = 0 AND corp_identity IS NOT NULL) OR (entry_no % 7 = 0 AND runner_identity IS NOT NULL)) END AS matched FROM entry")
def matching_entries(t):
    e = F.col("entry_no")
    others = t.entry.filter("entry_no % 4 > 0").select("tid", e.alias("rank"), F.when(e % 5 == 0, "zz").when(e % 3 != 0, F.col("corp_identity")).alias("corp"), F.when(e % 7 == 0, "zz").otherwise(F.col("runner_identity")).alias("runner"))
    return a.matching_entries(t.entry, others).select("tid", "entry_no", "matched")


@query("jn_24_jn_25_resolved_cards", f"{ADAPTER} SELECT l_orderkey::VARCHAR AS deck_id, l_linenumber AS place, CASE WHEN l_partkey % 97 = 0 OR l_linenumber % 4 = 3 THEN NULL ELSE l_partkey::VARCHAR END AS card_id FROM lineitem WHERE l_linenumber > 0")
def resolved_cards(t):
    """Rows name a card, a printing, a card that is none with a printing, or neither."""
    place, key = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    rows = t.raw("lineitem").filter("l_linenumber > 0").select(F.col("l_orderkey").cast("string").alias("deck_id"), place.alias("place"), F.when(place % 4 == 0, key).when(place % 4 == 1, "no card").alias("card_ref"), F.when(place % 4 == 3, "no printing").otherwise(F.concat(F.lit("p"), key)).alias("printing_ref"), F.lit(1).alias("qty"))
    printings = t.card.select(F.concat(F.lit("p"), F.col("card_id")).alias("printing_id"), "card_id")
    return a.resolved_cards(rows, printings, t.card).select("deck_id", "place", "card_id")


@query("ag_24_merged_deck_cards", f"{ADAPTER} SELECT l_orderkey::VARCHAR AS deck_id, l_partkey::VARCHAR AS card_id, sum(1 + l_linenumber % 3)::BIGINT AS qty, arg_min('p' || l_linenumber, l_linenumber) AS printing_ref FROM lineitem WHERE l_partkey % 97 > 0 GROUP BY l_orderkey, l_partkey")
def merged_deck_cards(t):
    rows = t.raw("lineitem").select(F.col("l_orderkey").cast("string").alias("deck_id"), F.when(F.col("l_partkey") % 97 != 0, F.col("l_partkey").cast("string")).alias("card_id"), (1 + F.col("l_linenumber") % 3).alias("qty"), F.concat(F.lit("p"), F.col("l_linenumber")).alias("printing_ref"), F.col("l_linenumber").alias("place"))
    return a.merged_cards(rows)


#: Identities are named 'brand key', some with a subtitle; titles ask for the whole, the part before it, a part that several share, or none.
TITLES = f"""{ADAPTER}, idn AS (SELECT card_id, CASE WHEN size % 2 = 0 THEN 'hero ' || card_id || ' the great' ELSE 'hero ' || card_id END AS key FROM card WHERE card_type_id LIKE '%identity'), ask AS (SELECT card_id AS asked, CASE card_id::INTEGER % 4 WHEN 0 THEN key WHEN 1 THEN 'hero ' || card_id WHEN 2 THEN 'hero' ELSE 'hero ' || card_id || ' the' END AS key FROM idn)"""


@query("jn_26_identities_by_title", f"""{TITLES}, pre AS (SELECT ask.asked, count(DISTINCT idn.card_id) AS n, min(idn.card_id) AS sole FROM ask JOIN idn ON starts_with(idn.key, ask.key || ' ') GROUP BY ALL)
SELECT ask.asked, coalesce((SELECT min(card_id) FROM idn WHERE idn.key = ask.key), CASE WHEN n = 1 THEN sole END) AS card_id FROM ask LEFT JOIN pre USING (asked)""")
def identities_by_title(t):
    c = t.card.filter("card_type_id like '%identity'")
    hero = F.concat(F.lit("hero "), F.col("card_id"))
    idn = c.select("card_id", F.when(F.col("size") % 2 == 0, F.concat(hero, F.lit(" the great"))).otherwise(hero).alias("key"))
    k = F.col("card_id").cast("int") % 4
    ask = idn.select(F.col("card_id").alias("asked"), F.when(k == 0, F.col("key")).when(k == 1, hero).when(k == 2, "hero").otherwise(F.concat(hero, F.lit(" the"))).alias("key"))
    return a.identities_by_title(ask, idn).select("asked", "card_id")


@query("jn_27_cards_by_title", f"{ADAPTER}, ky AS (SELECT card_id, title || ' ' || (card_id::INTEGER % 60) AS key FROM card) SELECT key, CASE WHEN count(*) = 1 THEN min(card_id) END AS card_id FROM ky GROUP BY key")
def cards_by_title(t):
    ky = t.card.select("card_id", F.concat_ws(" ", "title", F.col("card_id").cast("int") % 60).alias("key"))
    return a.cards_by_title(ky.select("key").distinct(), ky)


@query("jn_28_matched_players", f"""{ADAPTER}, pl AS (SELECT tid, entry_no AS pid, CASE entry_no % 5 WHEN 4 THEN 'Sam' ELSE 'Player ' || entry_no END AS name FROM entry)
SELECT tid, name, pid FROM (SELECT tid, 'player-' || entry_no AS name, CASE WHEN entry_no % 5 < 4 THEN entry_no END AS pid FROM entry UNION ALL SELECT tid, 'Sam ', CASE WHEN count(*) = 1 THEN min(pid) END FROM pl WHERE name = 'Sam' GROUP BY tid UNION ALL SELECT tid, '?!', NULL FROM tournament)""")
def matched_players(t):
    """Names in another spelling, one that several players share, and one without letters."""
    e = F.col("entry_no")
    players = t.entry.select("tid", e.alias("pid"), F.when(e % 5 == 4, "Sam").otherwise(F.concat(F.lit("Player "), e)).alias("name"))
    names = t.entry.select("tid", F.concat(F.lit("player-"), e).alias("name")).union(players.filter("name = 'Sam'").select("tid", F.lit("Sam ")).distinct()).union(t.tournament.select("tid", F.lit("?!")))
    return a.matched_players(names, players)


@query("jn_29_hd_03_in_bulk_files", """WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS date FROM orders), f AS (SELECT o_orderkey, (date + INTERVAL (o_orderkey % 20 - 3) DAY)::DATE AS day FROM d WHERE o_orderkey % 3 > 0), there AS (SELECT DISTINCT day FROM (SELECT day FROM f UNION ALL SELECT unnest(generate_series(DATE '1994-12-01', DATE '1998-01-01', INTERVAL 1 DAY))::DATE))
SELECT o_orderkey::VARCHAR AS deck_id, CASE WHEN f.day BETWEEN date - INTERVAL 1 DAY AND date + INTERVAL 14 DAY THEN true WHEN (SELECT count(*) FROM there WHERE there.day BETWEEN d.date - INTERVAL 1 DAY AND d.date + INTERVAL 14 DAY) = 16 THEN false END AS found FROM d LEFT JOIN f USING (o_orderkey)""")
def in_bulk_files(t):
    """Published up to 16 days after the event or some before it; after 1997 a day's file is there only if a deck is in it."""
    k = F.col("o_orderkey")
    d = t.raw("orders").select(k.cast("string").alias("deck_id"), F.to_date("o_orderdate").alias("date"), k.alias("k"))
    listed = d.filter("k % 3 > 0").select(F.date_add("date", (F.col("k") % 20 - 3).cast("int")).alias("day"), "deck_id")
    days = t.spark.sql("SELECT explode(sequence(DATE'1994-12-01', DATE'1998-01-01')) AS day, CAST(NULL AS STRING) AS deck_id")
    return a.in_bulk_files(d.select("deck_id", "date"), listed.union(days))


SOURCES = ["import", "cobra", "nrdb_decklist", "nrdb_deck"]


@query(
    "rl_10_st_09_jn_23_so_14_deck_sources",
    f"""{ADAPTER}, per AS (SELECT deck_id, list(card_id || ':' || qty ORDER BY card_id) AS cards FROM deck_card GROUP BY 1), k AS (SELECT d.*, d.deck_id::BIGINT % 6 AS m, cards FROM deck d JOIN per USING (deck_id))
SELECT tid, entry_no, side, CASE m WHEN 0 THEN 'import' WHEN 5 THEN 'nrdb_deck' WHEN 4 THEN 'nrdb_decklist' ELSE 'cobra' END AS source, CASE m WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'cobra_only' ELSE 'nrdb_only' END AS comparison FROM k""",
)
def deck_sources(t):
    """By the deck's key: two equal sources (one without an identity of its own), other cards, another identity, one source of each kind."""
    cards = t.deck_card.groupBy("deck_id").agg(F.map_from_entries(F.collect_list(F.struct("card_id", "qty"))).alias("cards"))
    d = t.deck.join(cards, "deck_id").withColumn("m", F.col("deck_id").cast("long") % 6)
    source = lambda name, identity=F.col("identity_card"), own=F.col("cards"): F.struct(F.lit(name).alias("source"), identity.alias("identity"), own.alias("cards"))
    more = F.map_concat("cards", F.create_map(F.lit("one more"), F.lit(1)))
    m = F.col("m")
    of = (
        F.when(m == 0, F.array(source("cobra", F.lit(None).cast("string")), source("import")))
        .when(m == 1, F.array(source("cobra"), source("nrdb_decklist", own=more)))
        .when(m == 2, F.array(source("nrdb_deck", F.lit("other")), source("cobra")))
        .when(m == 3, F.array(source("cobra")))
        .when(m == 4, F.array(source("nrdb_decklist")))
        .otherwise(F.array(source("nrdb_deck")))
    )
    s = d.select("tid", "entry_no", "side", F.col("identity_card").alias("entry_identity"), F.explode(of).alias("s")).select("tid", "entry_no", "side", "entry_identity", "s.*")
    return rules.comparison(s, SOURCES)


@query("ag_23_decklist_coverage", f"{ADAPTER} SELECT t0.tid, round(coalesce(n, 0)::DOUBLE / nullif(2 * players, 0), 6) AS coverage FROM tournament t0 LEFT JOIN (SELECT tid, count(*) AS n FROM deck WHERE legal GROUP BY 1) USING (tid)")
def decklist_coverage(t):
    n = t.deck.filter("legal").groupBy("tid").agg(F.count("*").alias("n"))
    return t.tournament.join(n, "tid", "left").select("tid", F.round(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), 2.0 * F.col("players")), 6).alias("coverage"))


@query("ag_28_identities_of_an_event", f"{ADAPTER} SELECT tid, coalesce(list(DISTINCT i ORDER BY i) FILTER (i IS NOT NULL), []) AS identities FROM (SELECT tid, unnest([corp_identity, runner_identity]) AS i FROM entry) GROUP BY 1")
def identities_of_an_event(t):
    return t.entry.select("tid", F.explode(F.array("corp_identity", "runner_identity")).alias("i")).groupBy("tid").agg(F.array_sort(F.collect_set("i")).alias("identities"))


@query(
    "rl_16_rl_17_rl_18_two_builds",
    f"""{ADAPTER} SELECT CASE WHEN bucket % 2 = 0 THEN 'c' ELSE 'a' END || tid AS tid, entry_no, CASE WHEN bucket % 2 = 0 THEN made_cut ELSE cut_size > 0 AND entry_no % 6 BETWEEN 1 AND 3 END AS made_cut, CASE WHEN bucket % 2 = 0 THEN points END AS points, CASE WHEN bucket % 2 = 0 THEN entry_no END AS cobra_pid,
    CASE WHEN bucket % 2 = 0 THEN 'swiss:public,cut:open' ELSE 'n/a' END AS deck_visibility FROM entry JOIN tournament USING (tid)""",
)
def two_builds(t):
    """Entries of either registry as one table: the second has no points, and its cut ranks count only above zero in events with a cut."""
    e = t.entry.join(t.tournament.select("tid", "bucket", "cut_size"), "tid")
    rank = F.when(F.col("entry_no") % 6 < 4, F.col("entry_no") % 6)
    first = e.filter("bucket % 2 = 0").select(F.concat(F.lit("c"), F.col("tid")).alias("tid"), "entry_no", "made_cut", "points", F.col("entry_no").alias("cobra_pid"), F.lit("swiss:public,cut:open").alias("deck_visibility"))
    second = e.filter("bucket % 2 = 1").select(F.concat(F.lit("a"), F.col("tid")).alias("tid"), "entry_no", ((F.col("cut_size") > 0) & F.coalesce(rank > 0, F.lit(False))).alias("made_cut"), F.lit("n/a").alias("deck_visibility"))
    return first.unionByName(second, allowMissingColumns=True)


@query("rl_21_phases", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 2 THEN 0 WHEN o_orderkey % 8 = 2 THEN 1 WHEN DATE '2001-08-01' - o_orderdate::DATE <= 90 THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS phase FROM orders""")
def phases(t):
    k = F.col("o_orderkey")
    kind = F.when(k % 8 == 0, "nrdb_catalog").when(k % 8 == 1, "abr_list_recent").otherwise("cobra_tournament")
    return t.raw("orders").select("o_orderkey", a.phase(kind, F.when(k % 8 != 2, F.to_date("o_orderdate")), F.when(k % 3 == 0, "megacity").otherwise("gnk"), F.to_date(F.lit("2001-08-01"))).alias("phase"))


@query("rl_20_backfill_start", f"{ADAPTER}, pool AS (SELECT card_pool_id FROM restriction WHERE year = (SELECT max(year) FROM restriction)) SELECT least(min(date_start), DATE '1999-08-01') AS start FROM restriction r, pool WHERE r.card_pool_id IS NOT DISTINCT FROM pool.card_pool_id")
def backfill_start(t):
    newest = t.restriction.agg(F.max_by(F.struct("card_pool_id"), "year").alias("newest"))
    lists = t.restriction.withColumn("one", F.lit(1)).join(newest.withColumn("one", F.lit(1)), "one")
    return lists.filter(F.col("card_pool_id").eqNullSafe(F.col("newest.card_pool_id"))).agg(F.least(F.min("date_start"), F.to_date(F.lit("1999-08-01"))).alias("start"))


@query("ss_07_hd_02_changed_records", "SELECT o_orderkey, o_orderkey % 4 = 0 AS changed FROM orders WHERE o_orderkey % 9 > 0 UNION ALL SELECT o_orderkey, true FROM orders WHERE o_orderkey % 9 = 0")
def changed_records(t):
    """Records whose watched columns differ from the last run's, or that are new; other columns may change unseen."""
    o = t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    watched = a.fingerprint(["o_orderstatus", "o_totalprice"])
    before = o.filter("o_orderkey % 9 > 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderpriority", F.lit("x")).select("o_orderkey", watched.alias("old"))
    return o.select("o_orderkey", watched.alias("now")).join(before, "o_orderkey", "left").select("o_orderkey", (~F.col("now").eqNullSafe(F.col("old"))).alias("changed"))


@query("hd_12_hd_13_reloaded_records", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'old' WHEN o_orderkey % 5 > 0 THEN 'new' END AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS result FROM orders")
def reloaded_records(t):
    """A reload brings new metadata and keeps the stored results; a name that it lacks is kept, one that is missing is filled in."""
    k = F.col("o_orderkey")
    o = t.raw("orders")
    stored = o.select(k.alias("key"), F.when(k % 3 == 0, "old").alias("old_name"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("result"))
    new = o.select("o_orderkey", F.when(k % 5 != 0, "new").alias("new_name"))
    return new.join(stored, k == F.col("key"), "left").select("o_orderkey", F.coalesce("old_name", "new_name").alias("name"), "result")


IMPORTS = f"""{ADAPTER}, tt AS (SELECT title || ' ' || card_id AS title, card_id, side_id, card_type_id FROM card), rw AS (SELECT d.deck_id::BIGINT AS k, x.card_id, row_number() OVER (PARTITION BY d.deck_id ORDER BY x.card_id) AS n FROM deck d JOIN deck_card x USING (deck_id)),
ln AS (SELECT k, k * 100 + n AS line, CASE WHEN k % 11 = 5 AND n = 2 THEN NULL WHEN card_id LIKE 'x%' THEN NULL ELSE card_id END AS known, CASE WHEN k % 13 = 3 AND n = 1 THEN '0' WHEN k % 13 = 4 AND n = 2 THEN '123' ELSE '2' END AS qty FROM rw),
bd AS (SELECT k, arg_min(CASE WHEN known IS NULL THEN 'unknown_card' ELSE 'bad_count' END, line) AS reason, min(line) AS line FROM ln WHERE known IS NULL OR qty <> '2' GROUP BY 1),
dk AS (SELECT d.deck_id::BIGINT AS k, i.card_id AS ident, i.side_id, i.card_type_id, (SELECT min(line) FROM ln WHERE ln.k = d.deck_id::BIGINT) AS line FROM deck d LEFT JOIN card i ON i.card_id = d.identity_card WHERE d.deck_id IN (SELECT deck_id FROM deck_card))
SELECT k AS deck, CASE WHEN k % 7 = 6 THEN 'player_not_found' WHEN ident IS NULL OR card_type_id NOT LIKE '%identity' THEN 'unknown_identity' WHEN k % 5 = 4 THEN 'identity_differs_from_cobra' ELSE bd.reason END AS reason,
    CASE WHEN k % 7 = 6 OR ident IS NULL OR card_type_id NOT LIKE '%identity' OR k % 5 = 4 THEN dk.line ELSE coalesce(bd.line, dk.line) END AS line FROM dk LEFT JOIN bd USING (k)"""


@query("rl_19_import_checks", IMPORTS)
def import_checks(t):
    return _imports(t).select(F.substring_index("name", " ", -1).cast("long").alias("deck"), "reason", "line")


def _imports(t):
    """A file of a deck a player; some players are unknown, some identities registered otherwise, some cards and counts wrong."""
    k = F.col("k")
    cards = t.card.select(F.concat_ws(" ", "title", "card_id").alias("full"), "card_id", "side_id", "card_type_id")
    cards = cards.withColumn("key", text.title_key(F.col("full")))
    d = t.deck.select(F.col("deck_id").cast("long").alias("k"), "deck_id", "identity_card").join(cards.select(F.col("card_id").alias("identity_card"), F.col("full").alias("identity"), "side_id"), "identity_card", "left").fillna({"identity": "nobody"})
    x = t.deck_card.join(cards.select("card_id", F.col("full").alias("card")), "card_id", "left").fillna({"card": "no such card"})
    n = F.row_number().over(W.partitionBy("deck_id").orderBy("card_id"))
    rows = d.join(x.withColumn("n", n), "deck_id")
    card = F.when((k % 11 == 5) & (F.col("n") == 2), "no such card").otherwise(F.col("card"))
    qty = F.when((k % 13 == 3) & (F.col("n") == 1), "0").when((k % 13 == 4) & (F.col("n") == 2), "123").otherwise("2")
    rows = rows.select((k * 100 + F.col("n")).alias("line"), F.concat(F.lit("Player "), k).alias("name"), F.when(k % 7 != 6, k).alias("pid"), "identity", card.alias("card"), qty.alias("qty"))
    own = lambda s: F.when(F.col("side_id") == s, F.when(k % 5 == 4, "zz").when(k % 5 != 3, F.col("identity_card")))
    players = d.select(k.alias("pid"), own("corp").alias("corp_identity"), own("runner").alias("runner_identity"))
    return a.import_checks(rows, players, cards)


@query("ag_27_import_report", f"SELECT coalesce(reason, 'imported') AS reason, count(*) AS decks, list(line ORDER BY line) AS lines FROM ({IMPORTS}) q GROUP BY 1")
def import_report(t):
    return a.import_report(_imports(t))


@query("fs_06_deck_links", r"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'decklist' WHEN 1 THEN 'deck' END AS kind, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN '0a1b2c3d-0000-4000-8000-' || lpad(o_orderkey::VARCHAR, 12, '0') END AS ref FROM orders""")
def deck_links(t):
    k = F.col("o_orderkey").cast("string")
    uuid = F.concat(F.lit("0a1b2c3d-0000-4000-8000-"), F.lpad(k, 12, "0"))
    host = F.lit("https://decks.example/en/")
    urls = [F.concat(host, F.lit("decklist/"), k, F.lit("/a-name")), F.concat(host, F.lit("deck/view/"), uuid), F.concat(host, F.lit("decklist/"), k, F.lit("?x=1")), F.concat(F.lit("http://decks.example/en/decklist/"), k), F.concat(host, F.lit("decklist/"), k, F.lit("0123456789")), F.concat(host, F.lit("deck/view/"), uuid, F.lit("\n"))]
    o = t.raw("orders").select("o_orderkey", F.element_at(F.array(*urls), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("url"))
    return o.select("o_orderkey", *text.deck_link(F.col("url"), "decks.example"))


@query("snk_09_formula_guard", "SELECT p_partkey, chr(34) || CASE p_partkey % 7 WHEN 0 THEN chr(39) || '=' WHEN 1 THEN chr(39) || '+' WHEN 2 THEN chr(39) || '-' WHEN 3 THEN chr(39) || '@' WHEN 4 THEN chr(39) || chr(9) WHEN 5 THEN '' ELSE 'a' || chr(34) || chr(34) || 'b ' END || p_name || chr(34) AS cell FROM part")
def formula_guard(t):
    prefix = pick(["=", "+", "-", "@", "\t", "", "a\"b "], F.col("p_partkey") % 7)
    return t.raw("part").select("p_partkey", text.csv_cell(F.concat(prefix, F.col("p_name"))).alias("cell"))
