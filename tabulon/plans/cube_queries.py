"""Queries on the count cube and its views."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions.dates import month
from tabulon.functions.ratios import WILSON_SQL, ratio
from tabulon.operators import incremental, views
from tabulon.operators.counts import BASELINE_COLUMNS, CARD_COLUMNS, CELL, IDENTITY_COLUMNS, slices
from tabulon.operators.ranking import ranked
from tabulon.plans.registry import ORACLES, cube, query
from tabulon.sources import adapters, addresses
from tabulon.sources.adapters import ADAPTER, COVERAGE, MIN_ENTRIES, MIN_GAMES, MIN_PLAYERS, MIN_SPLASH, PERIOD, Canonical
from tabulon.storage import shared_folder

COUNTS = adapters.COUNTS + ",\nall_cards AS (SELECT * EXCLUDE (scope) FROM card_count WHERE scope = 'all'),\nall_sides AS (SELECT * EXCLUDE (scope) FROM side_count WHERE scope = 'all')"

SLICE = views.SLICE
Z2 = "(VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y)"


def kind(column: str) -> str:
    return "DOUBLE" if column.endswith(("won", "wins", "wins_all")) else "BIGINT"


def slices_sql(cte: str, columns: list[str], keys: list[str]) -> str:
    by = "".join(f", {k}" for k in keys)
    sums = ", ".join(f"sum({c})::{kind(c)} AS {c}" for c in columns)
    return f"SELECT CASE x WHEN 0 THEN restriction_id ELSE 'all' END AS restriction_id, CASE y WHEN 0 THEN tier ELSE 'all' END AS tier{by}, {sums} FROM {cte}, {Z2} GROUP BY CASE x WHEN 0 THEN restriction_id ELSE 'all' END, CASE y WHEN 0 THEN tier ELSE 'all' END{by}"


def shifted(column: str, months: int) -> str:
    return f"strftime(({column} || '-01')::DATE - INTERVAL {months} MONTH, '%Y-%m')"


SPANS = f""",
spans0 AS (SELECT side, restriction_id, tier, max(month) AS "to", min(month) AS earliest FROM ({slices_sql("all_sides", ["side_decks"], ["side", "month"])}) WHERE side_decks > 0 GROUP BY ALL),
spans AS (SELECT *, {shifted('"to"', PERIOD - 1)} AS "from", {shifted('"to"', PERIOD)} AS prev_to, {shifted('"to"', 2 * PERIOD - 1)} AS prev_from, earliest <= {shifted('"to"', PERIOD)} AS has_prev FROM spans0)"""


def sums_sql(cte: str, columns: list[str], keys: list[str]) -> str:
    by = "".join(f", {k}" for k in keys)
    now, before = 'month BETWEEN "from" AND "to"', "month BETWEEN prev_from AND prev_to"
    parts = ", ".join(f"sum(CASE WHEN {cond} THEN {c} ELSE 0 END)::{kind(c)} AS {p}{c}" for cond, p in ((now, ""), (before, "prev_")) for c in columns)
    return f"SELECT side, restriction_id, tier{by}, {parts} FROM ({slices_sql(cte, columns, ['side', 'month', *keys])}) JOIN spans USING (side, restriction_id, tier) GROUP BY side, restriction_id, tier{by}"


def wilson_sql(which: str, w: str, n: str) -> str:
    text = WILSON_SQL[which].replace("sqrt", "§").replace("greatest", "¶").replace("least", "¤")
    text = text.replace("w", "_w_").replace("n", "_n_").replace("_w_", f"{w}::DOUBLE").replace("_n_", f"{n}::DOUBLE")
    return f"CASE WHEN {n} > 0 THEN {text.replace('§', 'sqrt').replace('¶', 'greatest').replace('¤', 'least')} END"


def plain(name: str, attribute: str, columns: list[str], cte: str, scope: str = "all") -> None:
    @query(name, f"{COUNTS} SELECT {', '.join(columns)} FROM {cte}")
    def _(tables):
        return getattr(cube(tables, scope), attribute).select(*columns)


CARD_DECKS = [*CELL, "card_id", *[c for c in CARD_COLUMNS if not c.startswith("games")]]
ALL, CUT = " WHERE scope = 'all'", " WHERE scope = 'cut'"
plain("flt_01_02_fd_02_events_counted", "events", ["tid", "restriction_id", "tier", "month", "hc", "cut_size"], "counted")
plain("flt_03_jn_01_jn_02_legal_decks", "decks", ["deck_id", "tid", "entry_no", "side", "made_cut", "id_faction", "restriction_id", "tier", "month", "hc", "games", "wins"], "deck_all")
plain("flt_04_flt_05_jn_05_counted_games", "games", ["tid", "side", "entry_no", "restriction_id", "tier", "month", "won"], "half_points JOIN counted USING (tid)")
plain("jn_06_games_of_known_decks", "deck_games", ["deck_id", "tid", "side", "entry_no", "month", "won"], "half_points JOIN (SELECT deck_id, tid, side, entry_no, month FROM deck_all) USING (tid, side, entry_no)")
plain("ag_01_02_03_04_card_deck_counts", "card_counts", CARD_DECKS, "card_count" + ALL)
plain("ag_05_card_game_counts", "card_counts", [*CELL, "card_id", "games_total", "games_won"], "card_count" + ALL)
plain("jn_07_card_counts", "card_counts", [*CELL, "card_id", *CARD_COLUMNS], "card_count" + ALL)
plain("ag_06_faction_counts", "faction_counts", [*CELL, "faction", "decks"], "faction_count" + ALL)
plain("ag_07_side_decks", "side_decks", [*CELL, "side_decks", "side_entries_hc", "side_cut_hc"], "side_count WHERE scope = 'all' AND side_decks > 0")
plain("ag_08_side_games", "side_games", [*CELL, "side_games_all", "side_wins_all"], "side_count WHERE scope = 'all' AND side_games_all > 0")
plain("ag_09_event_counts", "event_counts", ["restriction_id", "tier", "month", "tournaments", "tournaments_hc"], "side_count WHERE scope = 'all' AND side = 'corp'")
plain("jn_08_side_baseline_dense", "side_counts", [*CELL, *BASELINE_COLUMNS], "side_count" + ALL)
plain("wn_01_flt_06_identity_coverage", "identity_entries", ["tid", "entry_no", "side", "identity", "made_cut", "has_cut"], "known_identity")
plain("jn_09_jn_10_ag_10_identity_counts", "identity_counts", [*CELL, "identity", *IDENTITY_COLUMNS], "identity_count")
plain("ag_12_jn_11_card_counts_cut", "card_counts", [*CELL, "card_id", *CARD_COLUMNS], "card_count" + CUT, "cut")
plain("ag_12_side_counts_cut", "side_counts", [*CELL, *BASELINE_COLUMNS], "side_count" + CUT, "cut")
plain("ag_12_faction_counts_cut", "faction_counts", [*CELL, "faction", "decks"], "faction_count" + CUT, "cut")


@query(
    "ag_11_identity_side_totals",
    f"{COUNTS} SELECT side, restriction_id, tier, month, sum(entries)::BIGINT AS side_entries, sum(games_total)::BIGINT AS side_games, sum(games_won) AS side_wins, sum(cut_entries)::BIGINT AS side_cut_entries, sum(cut_made)::BIGINT AS side_cut_made FROM identity_count GROUP BY ALL",
)
def identity_side_totals(tables):
    return cube(tables).identity_side_counts


@query("jn_03_jn_04_legal_deck_cards", f"{COUNTS} SELECT f.deck_id, f.restriction_id, f.card_id, f.qty, card.faction_id FROM card_fact f JOIN card USING (card_id) WHERE scope = 'all'")
def legal_deck_cards(tables):
    c = cube(tables)
    return c.legal_cards(c.decks).select("deck_id", "restriction_id", "card_id", "qty", "faction_id")


@query("ag_13_slices_of_card_counts", COUNTS + " " + slices_sql("all_cards", CARD_COLUMNS, ["side", "month", "card_id"]))
def card_slices(tables):
    return slices(cube(tables).card_counts, CARD_COLUMNS, ["side", "month", "card_id"])


@query("ag_13_slices_of_side_counts", COUNTS + " " + slices_sql("all_sides", BASELINE_COLUMNS, ["side", "month"]))
def side_slices(tables):
    return slices(cube(tables).side_counts, BASELINE_COLUMNS, ["side", "month"])


@query("flt_07_one_slice", f"{COUNTS} SELECT side, month, card_id, sum(decks_with_card)::BIGINT AS decks FROM all_cards WHERE side = 'corp' AND restriction_id = 'r1996' GROUP BY ALL")
def one_slice(tables):
    c = cube(tables).card_counts.filter((F.col("side") == "corp") & (F.col("restriction_id") == "r1996"))
    return c.groupBy("side", "month", "card_id").agg(F.sum("decks_with_card").alias("decks"))


@query("ql_06_wn_05_fd_04_fd_05_periods", f'{COUNTS}{SPANS} SELECT side, restriction_id, tier, "from", "to", prev_from, prev_to, has_prev FROM spans')
def period_spans(tables):
    return views.periods(cube(tables).side_counts, PERIOD).select(*SLICE, "from", "to", "prev_from", "prev_to", "has_prev")


@query("ag_14_flt_08_period_sums", f"{COUNTS}{SPANS} {sums_sql('all_sides', BASELINE_COLUMNS, [])}")
def baseline_sums(tables):
    sides = cube(tables).side_counts
    return views.period_sums(sides, BASELINE_COLUMNS, [], views.periods(sides, PERIOD))


MODE = "CASE WHEN greatest(qty1, qty2, qty3) > 0 THEN CASE greatest(qty1, qty2, qty3) WHEN qty1 THEN 1 WHEN qty2 THEN 2 ELSE 3 END END"
def summary_sql(spans: str, scope: str = "all") -> str:
    counts = COUNTS if scope == "all" else COUNTS.replace("FROM card_count WHERE scope = 'all'", f"FROM card_count WHERE scope = '{scope}'").replace("FROM side_count WHERE scope = 'all'", f"FROM side_count WHERE scope = '{scope}'")
    return f"""{counts}{spans},
base AS ({sums_sql("all_sides", BASELINE_COLUMNS, [])}),
cards AS ({sums_sql("all_cards", CARD_COLUMNS, ["card_id"])}),
r0 AS (SELECT cards.*, base.* EXCLUDE (side, restriction_id, tier), decks_with_card::DOUBLE / nullif(side_decks, 0) AS popularity,
    CASE WHEN has_prev THEN coalesce(prev_decks_with_card::DOUBLE / nullif(prev_side_decks, 0), 0) END AS prev_popularity
    FROM cards JOIN base USING (side, restriction_id, tier) JOIN spans USING (side, restriction_id, tier)),
summary AS (SELECT side, restriction_id, tier, card_id, decks_with_card AS decks, popularity, prev_popularity, (popularity - prev_popularity) * 100 AS change_pp, copies_sum::DOUBLE / nullif(decks_with_card, 0) AS avg_copies,
    {MODE} AS copies_mode, games_total AS games, games_won / nullif(games_total, 0) AS winrate, (games_won / nullif(games_total, 0) - side_wins / nullif(side_games, 0)) * 100 AS winrate_diff_pp,
    {wilson_sql("low", "games_won", "games_total")} AS winrate_low, {wilson_sql("high", "games_won", "games_total")} AS winrate_high,
    CASE WHEN games_total >= {MIN_GAMES} THEN 'ok' ELSE 'insufficient' END AS winrate_status, cut_with_card_hc::DOUBLE / nullif(entries_with_card_hc, 0) AS conversion,
    (cut_with_card_hc::DOUBLE / nullif(entries_with_card_hc, 0)) / nullif(side_cut_hc::DOUBLE / nullif(side_entries_hc, 0), 0) AS conversion_ratio,
    CASE WHEN entries_with_card_hc >= {MIN_ENTRIES} THEN 'ok' ELSE 'insufficient' END AS conversion_status,
    CASE WHEN decks_with_card > 0 THEN row_number() OVER (PARTITION BY side, restriction_id, tier ORDER BY decks_with_card DESC, card_id)::INTEGER END AS rank
    FROM r0 WHERE decks_with_card > 0 OR prev_popularity >= 0.00005)"""


SUMMARY = summary_sql(SPANS)


def summary_of(tables, spans=None, scope="all"):
    c = cube(tables, scope)
    return views.summary(c.card_counts, c.side_counts, PERIOD, MIN_GAMES, MIN_ENTRIES, spans)


@query("ql_01_summary", f"{SUMMARY} SELECT * FROM summary")
def summary(tables):
    """The flagship: QL-01, QL-08, FM-05 to FM-08, FLT-10, WN-02."""
    return summary_of(tables)


#: Slice periods are those of all decks in either scope, so that both show the same months.
CUT_SPANS = SPANS.replace("FROM all_sides", "FROM (SELECT * FROM side_count WHERE scope = 'all')")


@query("ql_01_ag_12_summary_of_the_cut", f"{summary_sql(CUT_SPANS, 'cut')} SELECT * FROM summary")
def cut_summary(tables):
    return summary_of(tables, views.periods(cube(tables).side_counts, PERIOD), "cut")


RANGE = f""",
spans AS (SELECT side, restriction_id, tier, '1997-02' AS "from", '1997-09' AS "to", '1997-01' AS prev_to, '1996-06' AS prev_from, min(month) <= '1997-01' AS has_prev FROM ({slices_sql("all_sides", ["side_decks"], ["side", "month"])}) WHERE side_decks > 0 GROUP BY ALL)"""


@query("ql_08_summary_of_a_range", f"{summary_sql(RANGE)} SELECT * FROM summary")
def range_summary(tables):
    return summary_of(tables, views.given_range(cube(tables).side_counts, "1997-02", "1997-09"))


@query("so_03_movers", f"""{SUMMARY}, up AS (SELECT side, restriction_id, tier, 'riser' AS kind, row_number() OVER (PARTITION BY side, restriction_id, tier ORDER BY change_pp DESC, card_id)::INTEGER AS place, card_id, change_pp FROM summary WHERE change_pp > 0),
down AS (SELECT side, restriction_id, tier, 'faller' AS kind, row_number() OVER (PARTITION BY side, restriction_id, tier ORDER BY change_pp, card_id)::INTEGER AS place, card_id, change_pp FROM summary WHERE change_pp < 0)
SELECT * FROM up WHERE place <= 10 UNION ALL SELECT * FROM down WHERE place <= 10""")
def movers(tables):
    return views.movers(summary_of(tables), 10)


@query("ql_13_flt_22_scatter_points", f"{SUMMARY} SELECT side, restriction_id, tier, card_id, popularity * 100 AS x, winrate_diff_pp AS y FROM summary WHERE decks > 0 AND winrate_diff_pp IS NOT NULL")
def scatter_points(tables):
    s = summary_of(tables).filter("decks > 0 and winrate_diff_pp is not null")
    return s.select(*SLICE, "card_id", (F.col("popularity") * 100).alias("x"), F.col("winrate_diff_pp").alias("y"))


@query("so_04_top_per_axis", f"""{SUMMARY}, p AS (SELECT *, row_number() OVER (PARTITION BY side, restriction_id, tier ORDER BY popularity DESC, card_id) AS a, row_number() OVER (PARTITION BY side, restriction_id, tier ORDER BY winrate_diff_pp DESC, card_id) AS b
    FROM summary WHERE decks > 0 AND winrate_diff_pp IS NOT NULL) SELECT side, restriction_id, tier, card_id, popularity, winrate_diff_pp FROM p WHERE a <= 5 OR b <= 5""")
def top_per_axis(tables):
    s = summary_of(tables).filter("decks > 0 and winrate_diff_pp is not null")
    # a limit a window, so that each task passes on five rows a slice
    first = lambda by: s.withColumn("n", F.row_number().over(W.partitionBy(*SLICE).orderBy(F.desc(by), "card_id"))).filter("n <= 5").drop("n")
    return first("popularity").union(first("winrate_diff_pp")).select(*SLICE, "card_id", "popularity", "winrate_diff_pp").distinct()


@query("so_05_flt_23_winrate_order", f"""{SUMMARY} SELECT side, restriction_id, tier, card_id, games, winrate_status, row_number() OVER (PARTITION BY side, restriction_id, tier ORDER BY (winrate_status <> 'ok')::INTEGER, coalesce(winrate_diff_pp, -1e9) DESC, games DESC, card_id)::INTEGER AS place FROM summary WHERE games > 0""")
def winrate_order(tables):
    s = summary_of(tables).filter("games > 0")
    order = [(F.col("winrate_status") != "ok").cast("int").asc(), F.desc(F.coalesce("winrate_diff_pp", F.lit(-1e9))), F.desc("games"), F.asc("card_id")]
    return ranked(s.select(*SLICE, "card_id", "games", "winrate_status", "winrate_diff_pp"), SLICE, order, "place").drop("winrate_diff_pp")


@query("so_06_nulls_last_sort", f"""{SUMMARY} SELECT side, card_id, conversion, row_number() OVER (PARTITION BY side ORDER BY conversion DESC NULLS LAST, card_id)::INTEGER AS place FROM summary WHERE restriction_id = 'all' AND tier = 'all'""")
def nulls_last_sort(tables):
    s = summary_of(tables).filter("restriction_id = 'all' and tier = 'all'")
    return ranked(s.select("side", "card_id", "conversion"), ["side"], [F.desc_nulls_last("conversion"), F.asc("card_id")], "place")


@query("ql_02_fm_09_wn_03_identities", f"""{COUNTS}{SPANS}, c AS (SELECT * FROM ({sums_sql("identity_count", IDENTITY_COLUMNS, ["identity"])}) WHERE entries > 0)
SELECT side, restriction_id, tier, identity, entries, entries::DOUBLE / nullif(sum(entries) OVER (PARTITION BY side, restriction_id, tier)::DOUBLE, 0) AS share, games_won / nullif(games_total, 0) AS winrate,
    {wilson_sql("low", "games_won", "games_total")} AS winrate_low, {wilson_sql("high", "games_won", "games_total")} AS winrate_high, CASE WHEN games_total >= {MIN_GAMES} THEN 'ok' ELSE 'insufficient' END AS winrate_status,
    cut_made::DOUBLE / nullif(cut_entries, 0) AS conversion, CASE WHEN cut_entries >= {MIN_ENTRIES} THEN 'ok' ELSE 'insufficient' END AS conversion_status,
    row_number() OVER (PARTITION BY side, restriction_id, tier ORDER BY entries DESC, identity)::INTEGER AS rank FROM c""")
def identities(tables):
    c = cube(tables)
    return views.identities(c.identity_counts, c.side_counts, PERIOD, MIN_GAMES, MIN_ENTRIES)


TREND = ["decks_with_card", "copies_sum", "games_total", "games_won"]


@query("ql_03_ag_15_flt_09_trends", f"{COUNTS}, s AS (SELECT side, card_id, month, restriction_id, {', '.join(f'sum({c})::{kind(c)} AS {c}' for c in TREND)} FROM all_cards GROUP BY ALL) SELECT * FROM s WHERE {' OR '.join(f'{c} <> 0' for c in TREND)}")
def trends(tables):
    return views.trends(cube(tables).card_counts, TREND)


@query(
    "ag_15_ql_03_trend_vectors",
    f"""{COUNTS}, sl AS ({slices_sql('all_cards', TREND, ['side', 'month', 'card_id'])}), ax AS (SELECT side, min(month) AS first_month, max(month) AS last_month FROM all_cards GROUP BY side),
m AS (SELECT side, first_month, strftime(unnest(generate_series((first_month || '-01')::TIMESTAMP, (last_month || '-01')::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM ax),
k AS (SELECT DISTINCT side, restriction_id, tier, card_id FROM sl WHERE {' OR '.join(f'{c} <> 0' for c in TREND)})
SELECT k.side, k.restriction_id, k.tier, k.card_id, first_month, {', '.join(f'list(coalesce({c}, 0)::{kind(c)} ORDER BY m.month) AS {c}' for c in TREND)}
FROM k JOIN m USING (side) LEFT JOIN sl ON sl.side = k.side AND sl.restriction_id = k.restriction_id AND sl.tier = k.tier AND sl.card_id = k.card_id AND sl.month = m.month GROUP BY ALL""",
)
def trend_vectors(tables):
    """The trends of every slice as vectors over one axis of months a side."""
    return views.trend_vectors(cube(tables).card_counts, TREND)


@query("ql_09_monthly_series_dense", f"""{COUNTS}, s AS (SELECT side, month, sum(side_decks)::BIGINT AS side_decks, sum(side_games) AS side_games, sum(side_wins) AS side_wins FROM all_sides GROUP BY ALL),
m AS (SELECT side, strftime(unnest(generate_series((min(month) || '-01')::TIMESTAMP, (max(month) || '-01')::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM s GROUP BY side),
p AS (SELECT side, card_id, month, sum(decks_with_card)::BIGINT AS decks, sum(copies_sum) AS copies, sum(decks_in_faction) AS inside, sum(games_total)::BIGINT AS games, sum(games_won) AS won FROM all_cards GROUP BY ALL),
fa AS (SELECT side, month, faction, sum(decks) AS fd FROM faction_count WHERE scope = 'all' GROUP BY ALL),
j AS (SELECT k.side, k.card_id, m.month, coalesce(p.decks, 0) AS decks, coalesce(copies, 0) AS copies, coalesce(inside, 0) AS inside, coalesce(games, 0) AS games, coalesce(won, 0) AS won, coalesce(side_decks, 0) AS side_decks, side_wins / nullif(side_games, 0) AS base, coalesce(fd, 0) AS fd,
    card.faction_id IS NOT NULL AND NOT starts_with(card.faction_id, 'neutral') AND NOT ends_with(card_type_id, 'identity') AS hi, card_type_id
    FROM (SELECT DISTINCT side, card_id FROM all_cards) k JOIN m USING (side) LEFT JOIN card USING (card_id) LEFT JOIN s ON s.side = k.side AND s.month = m.month LEFT JOIN p ON p.side = k.side AND p.card_id = k.card_id AND p.month = m.month LEFT JOIN fa ON fa.side = k.side AND fa.month = m.month AND fa.faction = card.faction_id),
w AS (SELECT *, won / nullif(games, 0) AS winrate, {wilson_sql("low", "games_won", "games_total").replace("games_won", "won").replace("games_total", "games")} AS winrate_low, {wilson_sql("high", "games_won", "games_total").replace("games_won", "won").replace("games_total", "games")} AS winrate_high FROM j)
SELECT side, card_id, month, decks, decks::DOUBLE / nullif(side_decks, 0) AS popularity, CASE WHEN hi THEN inside::DOUBLE / nullif(fd, 0)::DOUBLE END AS popularity_in, CASE WHEN hi AND card_type_id <> 'agenda' THEN (decks - inside)::DOUBLE / nullif(side_decks - fd, 0)::DOUBLE END AS popularity_out,
    copies::DOUBLE / nullif(decks, 0) AS avg_copies, winrate, winrate_low, winrate_high, (winrate - base) * 100 AS winrate_diff_pp, (winrate_low - base) * 100 AS low_diff_pp, (winrate_high - base) * 100 AS high_diff_pp FROM w""")
def monthly_series(tables):
    c = cube(tables)
    return views.monthly_series(c.card_counts, c.side_counts, c.faction_counts, tables.card)


def split_sql(cards: str, factions: str, sides: str, keys: list[str]) -> str:
    by = ", ".join(keys)
    return f"""c AS (SELECT {by}, card_id, sum(decks_with_card)::BIGINT AS decks, sum(decks_in_faction)::BIGINT AS inside FROM {cards} GROUP BY ALL),
f AS (SELECT {by}, faction AS faction_id, sum(decks)::BIGINT AS fd FROM {factions} GROUP BY ALL), s AS (SELECT {by}, sum(side_decks)::BIGINT AS sd FROM {sides} GROUP BY ALL),
j AS (SELECT c.*, coalesce(fd, 0) AS fd, sd, card.faction_id IS NOT NULL AND NOT starts_with(card.faction_id, 'neutral') AND NOT ends_with(card_type_id, 'identity') AS hi, card_type_id
    FROM c JOIN card USING (card_id) LEFT JOIN f ON {" AND ".join(f"f.{k} = c.{k}" for k in keys)} AND f.faction_id = card.faction_id JOIN s ON {" AND ".join(f"s.{k} = c.{k}" for k in keys)}),
split AS (SELECT {by}, card_id, decks, sd AS side_decks, fd AS faction_decks, CASE WHEN hi THEN inside END AS decks_in_faction, CASE WHEN hi THEN coalesce(inside::DOUBLE / nullif(fd, 0), 0) END AS popularity_in,
    CASE WHEN hi AND card_type_id <> 'agenda' THEN coalesce((decks - inside)::DOUBLE / nullif(sd - fd, 0), 0) END AS popularity_out,
    CASE WHEN hi AND card_type_id <> 'agenda' THEN (decks - inside)::DOUBLE / nullif(decks, 0) END AS splash_share,
    CASE WHEN hi AND card_type_id <> 'agenda' THEN CASE WHEN decks >= {MIN_SPLASH} THEN 'ok' ELSE 'insufficient' END END AS splash_status FROM j)"""


ALL_FACTIONS = "(SELECT * EXCLUDE (scope) FROM faction_count WHERE scope = 'all')"
SPLIT = f"{COUNTS}, {split_sql('all_cards', ALL_FACTIONS, 'all_sides', ['side'])}"


@query("fm_10_fm_11_faction_split", f"{SPLIT} SELECT * FROM split")
def faction_split(tables):
    c = cube(tables)
    return views.faction_split(c.card_counts, c.faction_counts, c.side_counts, tables.card, MIN_SPLASH)


@query("ql_01_fm_10_faction_fields_of_slices", f"{COUNTS}, sc AS ({slices_sql('all_cards', ['decks_with_card', 'decks_in_faction'], ['side', 'month', 'card_id'])}), sf AS ({slices_sql(ALL_FACTIONS + ' q', ['decks'], ['side', 'month', 'faction'])}), ss AS ({slices_sql('all_sides', ['side_decks'], ['side', 'month'])}), {split_sql('sc', 'sf', 'ss', SLICE)} SELECT * FROM split")
def faction_fields_of_slices(tables):
    c, by = cube(tables), ["side", "month"]
    cards, factions, sides = slices(c.card_counts, ["decks_with_card", "decks_in_faction"], [*by, "card_id"]), slices(c.faction_counts, ["decks"], [*by, "faction"]), slices(c.side_counts, ["side_decks"], by)
    return views.faction_split(cards, factions, sides, tables.card, MIN_SPLASH, tuple(SLICE))


@query(
    "ql_10_flt_21_wn_04_played_rows",
    f"""{SPLIT}, md AS (SELECT side, card_id, decks, 'all' AS mode, decks::DOUBLE / nullif(side_decks, 0) AS value, decks AS "of", side_decks AS out_of FROM split WHERE decks > 0
    UNION ALL SELECT side, card_id, decks, 'in', popularity_in, decks_in_faction, faction_decks FROM split WHERE popularity_in IS NOT NULL AND decks_in_faction > 0
    UNION ALL SELECT side, card_id, decks, 'out', popularity_out, decks - decks_in_faction, side_decks - faction_decks FROM split WHERE popularity_out IS NOT NULL AND decks > decks_in_faction
    UNION ALL SELECT side, card_id, decks, 'splash', splash_share, decks - decks_in_faction, decks FROM split WHERE splash_share IS NOT NULL AND splash_status = 'ok')
SELECT side, mode, card_id, value, "of", out_of, row_number() OVER (PARTITION BY side, mode ORDER BY value DESC, decks DESC, card_id)::INTEGER AS rank FROM md""",
)
def played_rows(tables):
    return views.played_rows(faction_split(tables))


@query("ql_10_played_in_faction", f"""{COUNTS}, c AS (SELECT side, card_id, sum(decks_with_card)::BIGINT AS decks, sum(decks_in_faction)::BIGINT AS inside FROM all_cards GROUP BY ALL)
SELECT side, card_id, inside, decks, row_number() OVER (PARTITION BY side ORDER BY inside DESC, decks DESC, card_id)::INTEGER AS rank FROM c WHERE inside > 0""")
def played_in_faction(tables):
    c = cube(tables).card_counts.groupBy("side", "card_id").agg(F.sum("decks_in_faction").alias("inside"), F.sum("decks_with_card").alias("decks")).filter("inside > 0")
    return ranked(c, ["side"], [F.desc("inside"), F.desc("decks"), F.asc("card_id")])


@query("ql_03_trends_of_the_cut", f"{COUNTS}, sl AS ({slices_sql('(SELECT * FROM card_count WHERE scope = ' + chr(39) + 'cut' + chr(39) + ') q', TREND, ['side', 'month', 'card_id'])}) SELECT * FROM sl WHERE {' OR '.join(f'{c} <> 0' for c in TREND)}")
def trends_of_the_cut(tables):
    """Of every slice, by month, in the scope of top cuts."""
    t = slices(cube(tables, "cut").card_counts, TREND, ["side", "month", "card_id"])
    return t.filter(" or ".join(f"{c} <> 0" for c in TREND))


@query("ag_17_ql_11_merge_cubes", f"{COUNTS} SELECT side, restriction_id, tier, month, card_id, {', '.join(f'sum({c})::{kind(c)} AS {c}' for c in TREND)} FROM (SELECT * FROM all_cards WHERE tier < 'B' UNION ALL SELECT * FROM all_cards WHERE tier >= 'B') GROUP BY side, restriction_id, tier, month, card_id")
def merge_cubes(tables):
    c = cube(tables).card_counts
    return views.merge_cubes(c.filter("tier < 'B'"), c.filter("tier >= 'B'"), TREND)


@query("ag_18_flt_27_range_sums", f"{COUNTS} SELECT side, {', '.join(f'sum({c})::{kind(c)} AS {c}' for c in BASELINE_COLUMNS)} FROM all_sides WHERE month BETWEEN '1996-01' AND '1998-12' AND restriction_id IN ('r1996', 'r1997') GROUP BY side")
def range_sums(tables):
    s = cube(tables).side_counts.filter(F.col("month").between("1996-01", "1998-12") & F.col("restriction_id").isin("r1996", "r1997"))
    return s.groupBy("side").agg(*[F.sum(c).alias(c) for c in BASELINE_COLUMNS])


ADDRESS = "#r1996/EUROPE/1996-03..1996-11/runner/show:in"


@query("ql_16_ql_17_ql_07_flt_32_addressed_slice", f"{COUNTS} SELECT card_id, {', '.join(f'sum({c})::{kind(c)} AS {c}' for c in CARD_COLUMNS)} FROM card_count WHERE scope = 'all' AND restriction_id = 'r1996' AND tier = 'EUROPE' AND month BETWEEN '1996-03' AND '1996-11' AND side = 'runner' GROUP BY card_id")
def addressed_slice(tables):
    """A slice by its address, from the cube stored by ban list, tier and month."""
    counts = cube(tables).card_counts
    folder = f"{shared_folder(tables.spark)}/tabulon-slices-{uuid.uuid4().hex}"
    addresses.store(counts, folder)
    told = addresses.manifest(counts, "1", {"min_games": MIN_GAMES}, PERIOD)
    rows = addresses.rows(tables.spark, folder, addresses.parse(ADDRESS, told))
    return rows.groupBy("card_id").agg(*[F.sum(c).alias(c) for c in CARD_COLUMNS])


class Yesterday(Canonical):
    """The tables before a hundredth of the orders was corrected: their prices, which place entries, and whether their decks are legal."""

    #: Tables that neither prices nor states go into: those of today.
    SAME = ("deck_card", "ruling")

    def _unplaced(self):
        df = Canonical(self.spark, self.sf_dir)._seats.drop("entry_no", "has_next")
        changed = F.col("o_orderkey") % 100 == 7
        status = F.when(changed, F.when(F.col("o_orderstatus") == "P", "F").otherwise("P")).otherwise(F.col("o_orderstatus"))
        return df.withColumn("o_orderstatus", status).withColumn("o_totalprice", F.when(changed, F.col("o_totalprice") / 2).otherwise(F.col("o_totalprice")))

    def keep(self, name: str, make):
        return super().keep(name if name in self.SAME else f"yesterday_{name}", make)


def updated(tables, name: str):
    """A table of yesterday's cube and what changed since, merged."""
    before = Yesterday(tables.spark, tables.sf_dir)
    decks = before.deck.filter(F.col("deck_id").cast("long") % 100 == 7)
    tids = incremental.touched_events({"deck": decks}, [])
    change = incremental.deltas(before, tables, tids, (name,), min_players=MIN_PLAYERS, coverage=COVERAGE, identity_coverage=COVERAGE / 2)[name]
    return incremental.merged(getattr(cube(before), name), change, name)


@query("src_03_ag_16_card_counts_by_deltas", ORACLES["jn_07_card_counts"])
def card_counts_by_deltas(tables):
    return updated(tables, "card_counts")


@query("src_03_ag_16_side_counts_by_deltas", ORACLES["jn_08_side_baseline_dense"])
def side_counts_by_deltas(tables):
    return updated(tables, "side_counts")


@query("src_03_ag_16_identity_counts_by_deltas", ORACLES["jn_09_jn_10_ag_10_identity_counts"])
def identity_counts_by_deltas(tables):
    return updated(tables, "identity_counts")


@query("ag_19_copies_mode", f"{COUNTS} SELECT side, month, card_id, restriction_id, tier, {MODE} AS copies_mode FROM all_cards")
def copies_mode(tables):
    return cube(tables).card_counts.select(*CELL, "card_id", views.copies_mode(F.col("qty1"), F.col("qty2"), F.col("qty3")).alias("copies_mode"))


@query("fm_12_summary_baseline", f"{COUNTS}{SPANS}, b AS ({sums_sql('all_sides', BASELINE_COLUMNS, [])}) SELECT side, restriction_id, tier, side_wins / nullif(side_games, 0) AS winrate, side_wins_all / nullif(side_games_all, 0) AS winrate_all, side_cut_hc::DOUBLE / nullif(side_entries_hc, 0) AS cut_rate FROM b")
def summary_baseline(tables):
    b = baseline_sums(tables)
    return b.select(*SLICE, ratio(F.col("side_wins"), F.col("side_games")).alias("winrate"), ratio(F.col("side_wins_all"), F.col("side_games_all")).alias("winrate_all"), ratio(F.col("side_cut_hc"), F.col("side_entries_hc")).alias("cut_rate"))


EVENTS = f"{ADAPTER}, n AS (SELECT tid, count(*) AS legal_decks FROM deck WHERE legal GROUP BY tid)"


@query("ql_04_jn_12_so_02_tournaments", f"{EVENTS} SELECT tid, date, name, tier, restriction_id, players, cut_size, coalesce(legal_decks, 0) AS legal_decks, row_number() OVER (ORDER BY date DESC, tid)::INTEGER AS place FROM tournament LEFT JOIN n USING (tid)")
def tournaments(tables):
    n = tables.deck.filter("legal").groupBy("tid").agg(F.count("*").alias("legal_decks"))
    t = tables.tournament.join(n, "tid", "left").fillna({"legal_decks": 0})
    return ranked(t.select("tid", "date", "name", "tier", "restriction_id", "players", "cut_size", "legal_decks"), [], [F.desc("date"), F.asc("tid")], "place")


@query("ql_14_ag_22_flt_24_event_totals", f"{EVENTS} SELECT count(*) AS events, sum(players)::BIGINT AS players, sum(coalesce(legal_decks, 0))::BIGINT AS decklists, sum(coalesce(legal_decks, 0))::DOUBLE / nullif(2 * sum(players), 0)::DOUBLE AS share FROM tournament LEFT JOIN n USING (tid) WHERE strftime(date, '%Y-%m') BETWEEN '1996-01' AND '1999-12' AND cut_size > 0")
def event_totals(tables):
    n = tables.deck.filter("legal").groupBy("tid").agg(F.count("*").alias("legal_decks"))
    t = tables.tournament.filter(month(F.col("date")).between("1996-01", "1999-12") & (F.col("cut_size") > 0)).join(n, "tid", "left")
    decks, players = F.sum(F.coalesce("legal_decks", F.lit(0))), F.sum("players")
    return t.agg(F.count("*").alias("events"), players.alias("players"), decks.alias("decklists"), ratio(decks, 2 * players).alias("share"))


@query("ql_18_ag_20_ag_21_quality_report", f"{ADAPTER} SELECT tier, count(*) AS events, count(*) FILTER (players >= 8) AS counted, count(*) FILTER (cut_size > 0) AS with_cut, round(avg(players), 4) AS players, max(date) AS as_of FROM tournament GROUP BY tier")
def quality_report(tables):
    return tables.tournament.groupBy("tier").agg(F.count("*").alias("events"), F.count_if(F.col("players") >= 8).alias("counted"), F.count_if(F.col("cut_size") > 0).alias("with_cut"), F.round(F.avg("players"), 4).alias("players"), F.max("date").alias("as_of"))


@query("vd_01_st_06_totals_differ", f"{COUNTS}, a AS (SELECT side, tier, sum(side_decks + CASE WHEN month LIKE '%-04' AND tier = 'ASIA' THEN 1 ELSE 0 END)::BIGINT AS published FROM all_sides WHERE NOT (side = 'corp' AND tier = 'EUROPE') GROUP BY ALL), b AS (SELECT side, tier, count(*) AS canonical FROM deck_all GROUP BY ALL) SELECT side, tier, published, canonical FROM a FULL JOIN b USING (side, tier) WHERE published IS DISTINCT FROM canonical")
def totals_differ(tables):
    """Violations of a published cube that is made wrong in one tier and lacks another: total against canonical decks, either way."""
    c = cube(tables)
    wrong = F.col("side_decks") + F.when(F.col("month").like("%-04") & (F.col("tier") == "ASIA"), 1).otherwise(0)
    published = c.side_counts.filter("not (side = 'corp' and tier = 'EUROPE')").groupBy("side", "tier").agg(F.sum(wrong).alias("published"))
    canonical = c.decks.groupBy("side", "tier").agg(F.count("*").alias("canonical"))
    return published.join(canonical, ["side", "tier"], "full").filter(~F.col("published").eqNullSafe(F.col("canonical"))).select("side", "tier", "published", "canonical")


@query("vd_01_faction_totals_differ", f"{COUNTS}, a AS (SELECT side, faction, sum(decks)::BIGINT AS published FROM faction_count WHERE scope = 'all' AND faction <> 'Brand#7' GROUP BY ALL), b AS (SELECT side, id_faction AS faction, count(*) AS canonical FROM deck_all GROUP BY ALL) SELECT side, faction, published, canonical FROM a FULL JOIN b ON a.side = b.side AND a.faction IS NOT DISTINCT FROM b.faction WHERE published IS DISTINCT FROM canonical".replace("SELECT side, faction, published, canonical FROM a", "SELECT coalesce(a.side, b.side) AS side, coalesce(a.faction, b.faction) AS faction, published, canonical FROM a"))
def faction_totals_differ(tables):
    """Every deck must be counted under its identity's faction: one faction is left out, and decks of unknown identities have none."""
    c = cube(tables)
    published = c.faction_counts.filter("faction <> 'Brand#7'").groupBy("side", "faction").agg(F.sum("decks").alias("published"))
    canonical = c.decks.groupBy(F.col("side").alias("s"), F.col("id_faction").alias("f")).agg(F.count("*").alias("canonical"))
    d = published.join(canonical, (F.col("side") == F.col("s")) & F.col("faction").eqNullSafe(F.col("f")), "full").filter(~F.col("published").eqNullSafe(F.col("canonical")))
    return d.select(F.coalesce("side", "s").alias("side"), F.coalesce("faction", "f").alias("faction"), "published", "canonical")


@query("vd_01_in_faction_exceeds_all", f"{COUNTS} SELECT side, tier, month, card_id FROM all_cards WHERE decks_in_faction + CASE WHEN card_id LIKE '%7' THEN 1 ELSE 0 END > decks_with_card")
def in_faction_exceeds_all(tables):
    """A card's decks in its faction are some of its decks; a cube that counts one too many for some cards is caught where none was outside."""
    wrong = F.col("decks_in_faction") + F.when(F.col("card_id").endswith("7"), 1).otherwise(0)
    return cube(tables).card_counts.filter(wrong > F.col("decks_with_card")).select("side", "tier", "month", "card_id")


@query("vd_01_unknown_ids", f"{ADAPTER} SELECT DISTINCT card_id FROM deck_card WHERE card_id NOT IN (SELECT card_id FROM card)")
def unknown_ids(tables):
    """Ids that the catalog lacks."""
    return tables.deck_card.select("card_id").distinct().join(tables.card.select("card_id"), "card_id", "left_anti")


@query("vd_01_too_large_slices", f"{COUNTS}, j AS (SELECT side, tier, restriction_id, sum(length(card_id) + length(month) + 20)::BIGINT AS bytes FROM all_cards GROUP BY ALL) SELECT * FROM j WHERE bytes > 20000")
def too_large_slices(tables):
    """Slices over a limit of bytes, by the length of their rows."""
    size = F.sum(F.length("card_id") + F.length("month") + 20)
    return cube(tables).card_counts.groupBy("side", "tier", "restriction_id").agg(size.alias("bytes")).filter("bytes > 20000")


@query("ql_05_catalog", f"{ADAPTER}, st AS (SELECT card_id, list(restriction_id ORDER BY restriction_id) FILTER (legal) AS legal_in FROM verdict GROUP BY 1) SELECT card_id, title, side_id, faction_id, card_type_id, legal_in FROM card JOIN st USING (card_id) WHERE legal_in IS NOT NULL")
def catalog(tables):
    """Cards legal by one list at least, with the lists they are legal by."""
    barred = tables.ruling.filter("barred").groupBy("card_id").agg(F.collect_set("restriction_id").alias("barred_in"))
    every = tables.restriction.agg(F.array_sort(F.collect_list("restriction_id")).alias("every")).withColumn("one", F.lit(1))
    c = tables.card.withColumn("one", F.lit(1)).join(every, "one").join(barred, "card_id", "left")
    c = c.withColumn("legal_in", F.array_except("every", F.coalesce("barred_in", F.array().cast("array<string>"))))
    return c.filter(F.size("legal_in") > 0).select("card_id", "title", "side_id", "faction_id", "card_type_id", "legal_in")


@query("ag_29_vocabulary", f"{COUNTS} SELECT side, list(DISTINCT restriction_id ORDER BY restriction_id) AS restrictions, min(month) AS first_month, max(month) AS last_month FROM all_sides GROUP BY side")
def vocabulary(tables):
    return cube(tables).side_counts.groupBy("side").agg(F.array_sort(F.collect_set("restriction_id")).alias("restrictions"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
