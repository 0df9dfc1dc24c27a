"""Canonical tables made from the star-schema tables, so that every operator can run at any scale.

An event (tournament) is a region, a calendar quarter and a group of ``GROUP`` customers, so it has some tens of entries whatever the scale;
its entries are the orders of that quarter, ranked by price; an order's line items are its deck. ``ADAPTER`` says the same in DuckDB SQL,
as the common table expressions that the oracles start with, and ``COUNTS`` adds the counts by their definitions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.storage import stored

GROUP = 200
#: p_size goes from 1 to 50 in the star schema.
SIZES = 50
LABELS = ["Circuit Breaker", "Store Championship", "GNK Winter", "Online League", "Regional", "Worlds", "Casual Night", "Seasonal Kit", "National Final", "Meetup"]
RESULTS = ["corp_win", "runner_win", "draw", "intentional_draw"]
TYPES = {"PROMO": "agenda", "LARGE": "asset", "MEDIUM": "event", "SMALL": "operation", "ECONOMY": "program"}

#: Thresholds, as columns of the counted views; they suit the adapter's small events.
MIN_PLAYERS, COVERAGE, MIN_GAMES, MIN_ENTRIES, MIN_SPLASH, PERIOD = 8, 0.6, 4, 2, 4, 3


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def card_name(key: Column) -> Column:
    """A 97th of the parts is unknown to the catalog."""
    return F.when(key % 97 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))


class Canonical:
    """Each attribute is a DataFrame. Tables that many queries share are written when first used and read from then on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def keep(self, name: str, make) -> DataFrame:
        return stored(self.spark, (self.sf_dir, name), make)

    @cached_property
    def _seats(self) -> DataFrame:
        """A row for each order, with its event, its place there and the next entry."""
        return self.keep("seats", self._make_seats)

    def _make_seats(self) -> DataFrame:
        return self._placed(self._unplaced())

    def _placed(self, o: DataFrame) -> DataFrame:
        place = W.partitionBy("tid").orderBy(F.desc("o_totalprice"), "o_orderkey")
        return o.withColumn("entry_no", F.row_number().over(place)).withColumn("has_next", F.lead(F.lit(True), 1, False).over(place))

    def _unplaced(self) -> DataFrame:
        region = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", "r_name")
        # 25 nations: a fixed size
        customer = self.raw("customer").select("c_custkey", "c_nationkey").join(F.broadcast(region), F.col("c_nationkey") == F.col("n_nationkey"))
        o = self.raw("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        o = o.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "r_regionkey", "r_name", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.floor(F.col("o_custkey") / GROUP).cast("int").alias("bucket"))
        o = o.withColumn("tid", F.concat(F.lit("t"), F.col("r_regionkey"), F.lit("-"), F.col("y"), F.lit("q"), F.col("q"), F.lit("-"), F.col("bucket")))
        o = o.withColumn("cut_size", F.when((F.col("r_regionkey") + F.col("q")) % 2 == 0, 4).otherwise(0))
        identity = self.raw("lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"))
        o = o.join(identity, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("identity_card", card_name(F.col("part")))
        return o.withColumn("side", F.when(F.col("o_orderkey") % 2 == 0, "corp").otherwise("runner"))

    @cached_property
    def tournament(self) -> DataFrame:
        def make() -> DataFrame:
            known = F.avg(F.when(F.col("o_orderstatus") != "P", 1.0).otherwise(0.0))
            t = self._seats.groupBy("tid", "r_regionkey", "r_name", "y", "q", "bucket", "cut_size").agg(F.count("*").cast("int").alias("players"), known.alias("decklist_coverage"))
            date = F.make_date("y", F.col("q") * 3 - 2 + F.col("bucket") % 3, F.lit(1) + F.col("bucket") % 28)
            name = F.concat_ws(" ", pick(LABELS, (F.col("y") + F.col("q") + F.col("bucket")) % len(LABELS)), "r_name")
            return t.select("tid", date.alias("date"), F.col("r_name").alias("tier"), F.concat(F.lit("r"), F.col("y")).alias("restriction_id"), "players", "cut_size", "decklist_coverage", name.alias("name"), (F.col("r_regionkey") % 2 == 1).alias("online"), "bucket")

        return self.keep("tournament", make)

    @cached_property
    def entry(self) -> DataFrame:
        own = lambda s: F.when(F.col("side") == s, F.col("identity_card"))
        return self._seats.select("tid", "entry_no", (F.col("entry_no") <= F.col("cut_size")).alias("made_cut"), own("corp").alias("corp_identity"), own("runner").alias("runner_identity"), F.floor("o_totalprice").cast("int").alias("points"))

    @cached_property
    def deck(self) -> DataFrame:
        return self._seats.select(F.col("o_orderkey").cast("string").alias("deck_id"), "tid", "entry_no", "side", "identity_card", (F.col("o_orderstatus") != "P").alias("legal"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))

    @cached_property
    def deck_card(self) -> DataFrame:
        def make() -> DataFrame:
            # few lines an order, so sums before they are dealt would only fill memory
            g = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
            return g.select(F.col("l_orderkey").cast("string").alias("deck_id"), card_name(F.col("l_partkey")).alias("card_id"), (1 + F.col("q").cast("int") % 3).alias("qty"))

        return self.keep("deck_card", make)

    @cached_property
    def game(self) -> DataFrame:
        """Each entry plays the next one of its event."""
        result = pick(RESULTS, (F.col("entry_no") + F.col("o_orderkey")) % 4)
        return self._seats.filter("has_next").select("tid", F.lit(1).alias("round"), F.col("entry_no").alias("table"), F.col("entry_no").alias("corp_entry"), (F.col("entry_no") + 1).alias("runner_entry"), result.alias("result"), (F.col("entry_no") < F.col("cut_size")).alias("elimination"))

    @cached_property
    def card(self) -> DataFrame:
        side = F.when(F.col("p_partkey") % 2 == 0, "corp").otherwise("runner")
        type_ = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("p_type")]
        pools = F.when(F.col("p_size") % 4 == 1, F.array(F.lit("pool0"))).when(F.col("p_size") % 4 == 2, F.array(F.lit("pool1"))).otherwise(F.array(F.lit("pool0"), F.lit("pool1")))
        return self.raw("part").filter("p_partkey % 97 <> 0").select(
            F.col("p_partkey").cast("string").alias("card_id"),
            F.col("p_name").alias("title"),
            side.alias("side_id"),
            F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("neutral_"), side)).otherwise(F.col("p_brand")).alias("faction_id"),
            F.coalesce(type_, F.concat(side, F.lit("_identity"))).alias("card_type_id"),
            (F.col("p_size") % 5).alias("influence_cost"),
            F.when(F.col("p_size") % 7 != 0, F.lit(2)).alias("deck_limit"),
            (F.col("p_size") % 4).alias("agenda_points"),
            (4 + F.col("p_size") % 3).alias("minimum_deck_size"),
            F.when(F.col("p_size") % 9 != 0, 6 + F.col("p_size") % 5).alias("influence_limit"),
            pools.alias("card_pool_ids"),
            F.col("p_size").alias("size"),
        )

    @cached_property
    def restriction(self) -> DataFrame:
        """One row a year: some tens at most, whatever the scale. A null pool takes every card, a null limit any points."""
        y = self.raw("orders").select(F.year("o_orderdate").alias("y")).distinct()
        pool = F.when(F.col("y") % 3 != 0, F.concat(F.lit("pool"), F.col("y") % 2))
        return y.select(F.concat(F.lit("r"), F.col("y")).alias("restriction_id"), F.make_date("y", F.lit(1), F.lit(1)).alias("date_start"), F.col("y").alias("year"), pool.alias("card_pool_id"), F.when(F.col("y") % 4 != 0, F.lit(1)).alias("point_limit"))

    @cached_property
    def ruling(self) -> DataFrame:
        """(card_id, restriction_id, banned, restricted, universal_cost, points, barred): what a list says of a card, where it says anything.
        ``barred`` cards are not legal: banned, or outside the list's pool. Lists rule by size, of which there are fifty."""

        def make() -> DataFrame:
            s = self.restriction.select("restriction_id", "year", "card_pool_id", F.explode(F.sequence(F.lit(1), F.lit(SIZES))).alias("size"))
            k = F.col("size") + F.col("year")
            s = s.select("restriction_id", "card_pool_id", "size", (k % 17 == 0).alias("banned"), (k % 6 == 0).alias("restricted"), F.when(k % 11 == 0, 1).otherwise(0).alias("universal_cost"), F.when(k % 7 == 0, F.col("size") % 3).otherwise(0).alias("points"))
            c = self.card.select("card_id", "size", "card_pool_ids").join(F.broadcast(s), "size")  # fifty rows a list
            barred = F.col("banned") | (F.col("card_pool_id").isNotNull() & ~F.array_contains("card_pool_ids", F.col("card_pool_id")))
            c = c.select("card_id", "restriction_id", "banned", "restricted", "universal_cost", "points", barred.alias("barred"))
            return c.filter("banned or restricted or universal_cost > 0 or points > 0 or barred")

        return self.keep("ruling", make)


def _case(names: list[str], index: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][({index}) + 1]"


ADAPTER = f"""
WITH RECURSIVE part_name AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 97 = 0 THEN 'x' ELSE '' END || p_partkey AS label FROM part),
placed AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, n_regionkey AS region_no, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_custkey // {GROUP} AS bucket,
    CASE o_orderkey % 2 WHEN 0 THEN 'corp' ELSE 'runner' END AS side FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey),
numbered AS MATERIALIZED (SELECT *, format('t{{}}-{{}}q{{}}-{{}}', region_no, y, q, bucket) AS tid, 4 * (1 - (region_no + q) % 2)::INTEGER AS cut_size,
    rank() OVER (PARTITION BY region_no, y, q, bucket ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS entry_no, count(*) OVER (PARTITION BY region_no, y, q, bucket)::INTEGER AS players FROM placed),
tournament AS MATERIALIZED (SELECT tid, make_date(any_value(y)::INTEGER, (any_value(q * 3 - 2 + bucket % 3))::INTEGER, (1 + any_value(bucket) % 28)::INTEGER) AS date, any_value(r_name) AS tier, 'r' || any_value(y) AS restriction_id,
    any_value(players) AS players, any_value(cut_size) AS cut_size, count_if(o_orderstatus <> 'P') / count(*)::DOUBLE AS decklist_coverage,
    {_case(LABELS, f"any_value((y + q + bucket) % {len(LABELS)})")} || ' ' || any_value(r_name) AS name, any_value(region_no) % 2 = 1 AS online, any_value(bucket)::INTEGER AS bucket
    FROM numbered JOIN region ON r_regionkey = region_no GROUP BY tid),
deck_card AS MATERIALIZED (SELECT l_orderkey::VARCHAR AS deck_id, coalesce(label, CASE WHEN l_partkey % 97 = 0 THEN 'x' ELSE '' END || l_partkey) AS card_id, l_partkey AS part, (floor(sum(l_quantity)) % 3 + 1)::INTEGER AS qty
    FROM lineitem LEFT JOIN part_name ON part = l_partkey GROUP BY ALL),
deck AS MATERIALIZED (SELECT o_orderkey::VARCHAR AS deck_id, tid, entry_no, side, (SELECT arg_min(card_id, part) FROM deck_card WHERE deck_id = o_orderkey::VARCHAR) AS identity_card, o_orderstatus <> 'P' AS legal, left(o_orderpriority, 1)::INTEGER AS priority FROM numbered),
entry AS MATERIALIZED (SELECT n.tid, n.entry_no, n.entry_no <= cut_size AS made_cut, CASE WHEN n.side = 'corp' THEN identity_card END AS corp_identity, CASE WHEN n.side = 'runner' THEN identity_card END AS runner_identity,
    floor(o_totalprice)::INTEGER AS points FROM numbered n JOIN deck ON deck_id = o_orderkey::VARCHAR),
game AS MATERIALIZED (SELECT tid, 1 AS round, entry_no AS "table", entry_no AS corp_entry, entry_no + 1 AS runner_entry, {_case(RESULTS, "(entry_no + o_orderkey) % 4")} AS result, entry_no < cut_size AS elimination
    FROM numbered WHERE entry_no < players),
card AS MATERIALIZED (SELECT label AS card_id, p_name AS title, s AS side_id, CASE WHEN p_size % 10 = 0 THEN 'neutral_' || s ELSE p_brand END AS faction_id,
    coalesce(map {{{', '.join(f"'{a}': '{b}'" for a, b in TYPES.items())}}}[p_type], s || '_identity') AS card_type_id, p_size % 5 AS influence_cost, CASE WHEN p_size % 7 > 0 THEN 2 END AS deck_limit, p_size % 4 AS agenda_points,
    4 + p_size % 3 AS minimum_deck_size, CASE WHEN p_size % 9 > 0 THEN 6 + p_size % 5 END AS influence_limit, CASE p_size % 4 WHEN 1 THEN ['pool0'] WHEN 2 THEN ['pool1'] ELSE ['pool0', 'pool1'] END AS card_pool_ids, p_size AS size
    FROM (SELECT *, ['corp', 'runner'][p_partkey % 2 + 1] AS s FROM part JOIN part_name ON part = p_partkey) WHERE label NOT LIKE 'x%'),
restriction AS MATERIALIZED (SELECT 'r' || y AS restriction_id, make_date(y::INTEGER, 1, 1) AS date_start, y AS year, CASE WHEN y % 3 > 0 THEN 'pool' || (y % 2) END AS card_pool_id, CASE WHEN y % 4 > 0 THEN 1 END AS point_limit FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)),
verdict AS MATERIALIZED (SELECT card_id, restriction_id, (size + year) % 17 = 0 AS banned, (size + year) % 6 = 0 AS restricted, ((size + year) % 11 = 0)::INTEGER AS universal_cost, CASE (size + year) % 7 WHEN 0 THEN size % 3 ELSE 0 END AS points,
    (size + year) % 17 > 0 AND (card_pool_id IS NULL OR list_contains(card_pool_ids, card_pool_id)) AS legal FROM card CROSS JOIN restriction)"""

#: The counts by their definitions: facts of decks and of players, each with a scope (all, or cut: those that made a top cut), summed once.
COUNTS = ADAPTER + f""",
counted AS MATERIALIZED (SELECT tid, restriction_id, tier, strftime(date, '%Y-%m') AS month, cut_size, cut_size > 0 AND decklist_coverage >= {COVERAGE} AS hc FROM tournament WHERE players >= {MIN_PLAYERS} AND restriction_id IS NOT NULL),
half_points AS MATERIALIZED (SELECT tid, 'corp' AS side, corp_entry AS entry_no, map {{'corp_win': 1.0, 'draw': 0.5, 'runner_win': 0.0}}[result]::DOUBLE AS won FROM game WHERE result <> 'intentional_draw'
    UNION ALL SELECT tid, 'runner', runner_entry, map {{'corp_win': 0.0, 'draw': 0.5, 'runner_win': 1.0}}[result]::DOUBLE FROM game WHERE result <> 'intentional_draw'),
player_games AS MATERIALIZED (SELECT tid, side, entry_no, count(*) AS games, sum(won) AS wins FROM half_points SEMI JOIN counted USING (tid) GROUP BY tid, side, entry_no),
deck_all AS MATERIALIZED (SELECT k.deck_id, k.tid, k.entry_no, k.side, e.made_cut, card.faction_id AS id_faction, c.restriction_id, c.tier, c.month, c.cut_size, c.hc, coalesce(games, 0) AS games, coalesce(wins, 0)::DOUBLE AS wins
    FROM counted c JOIN deck k USING (tid) JOIN entry e USING (tid, entry_no) LEFT JOIN card ON card_id = k.identity_card LEFT JOIN player_games p ON p.tid = k.tid AND p.side = k.side AND p.entry_no = k.entry_no WHERE k.legal),
deck_fact AS MATERIALIZED (SELECT 'all' AS scope, * FROM deck_all UNION ALL SELECT 'cut', * FROM deck_all WHERE cut_size > 0 AND made_cut),
event_fact AS (SELECT 'all' AS scope, * FROM counted UNION ALL SELECT 'cut', * FROM counted WHERE cut_size > 0),
player_fact AS (SELECT 'all' AS scope, restriction_id, tier, month, side, games, wins FROM player_games JOIN counted USING (tid)
    UNION ALL SELECT 'cut', restriction_id, tier, month, p.side, games, wins FROM player_games p JOIN counted c USING (tid) JOIN entry e USING (tid, entry_no) WHERE cut_size > 0 AND made_cut),
card_fact AS MATERIALIZED (SELECT f.*, x.card_id, x.qty, card.faction_id = id_faction AS inside FROM deck_fact f JOIN deck_card x USING (deck_id) JOIN verdict v ON v.card_id = x.card_id AND v.restriction_id = f.restriction_id AND v.legal JOIN card ON card.card_id = x.card_id),
card_count AS MATERIALIZED (SELECT scope, side, restriction_id, tier, month, card_id, count(*) AS decks_with_card, sum(qty)::BIGINT AS copies_sum, count_if(qty = 1)::BIGINT AS qty1, count_if(qty = 2)::BIGINT AS qty2, count_if(qty > 2)::BIGINT AS qty3,
    sum(games)::BIGINT AS games_total, sum(wins) AS games_won, count_if(hc)::BIGINT AS entries_with_card_hc, count_if(hc AND made_cut)::BIGINT AS cut_with_card_hc, count(DISTINCT CASE WHEN hc THEN tid END) AS tournaments_hc_with_card, count(*) FILTER (inside) AS decks_in_faction
    FROM card_fact GROUP BY ALL),
faction_count AS MATERIALIZED (SELECT scope, side, restriction_id, tier, month, id_faction AS faction, count(*) AS decks FROM deck_fact WHERE id_faction IS NOT NULL GROUP BY ALL),
side_sum AS (SELECT scope, restriction_id, tier, month, side, sum(d)::BIGINT AS side_decks, sum(g)::BIGINT AS side_games, sum(w) AS side_wins, sum(h)::BIGINT AS side_entries_hc, sum(m)::BIGINT AS side_cut_hc, sum(t)::BIGINT AS tournaments, sum(th)::BIGINT AS tournaments_hc, sum(a)::BIGINT AS side_games_all, sum(aw) AS side_wins_all
    FROM (SELECT scope, restriction_id, tier, month, side, 1 AS d, games AS g, wins AS w, hc::INTEGER AS h, (hc AND made_cut)::INTEGER AS m, 0 AS t, 0 AS th, 0 AS a, 0.0::DOUBLE AS aw FROM deck_fact
          UNION ALL SELECT scope, restriction_id, tier, month, unnest(['corp', 'runner']), 0, 0, 0.0, 0, 0, 1, hc::INTEGER, 0, 0.0 FROM event_fact
          UNION ALL SELECT scope, restriction_id, tier, month, side, 0, 0, 0.0, 0, 0, 0, 0, games, wins FROM player_fact) GROUP BY ALL),
side_count AS MATERIALIZED (SELECT * FROM side_sum),
known_identity AS MATERIALIZED (SELECT z.tid, z.entry_no, z.side, z.identity, z.made_cut, z.restriction_id, z.tier, z.month, cut_size > 0 AND share >= {COVERAGE / 2} AS has_cut
    FROM (SELECT c.*, e.entry_no, e.made_cut, s.side, s.identity, avg((s.identity IS NOT NULL)::INTEGER) OVER (PARTITION BY c.tid, s.side) AS share
          FROM counted c JOIN entry e USING (tid), LATERAL (SELECT 'corp' AS side, e.corp_identity AS identity UNION ALL SELECT 'runner', e.runner_identity) s) z
    JOIN verdict v ON v.card_id = z.identity AND v.restriction_id = z.restriction_id AND v.legal),
identity_count AS MATERIALIZED (SELECT k.side, restriction_id, tier, month, identity, count(*) AS entries, coalesce(sum(games), 0)::BIGINT AS games_total, coalesce(sum(wins), 0)::DOUBLE AS games_won, count_if(has_cut)::BIGINT AS cut_entries, count_if(has_cut AND made_cut)::BIGINT AS cut_made
    FROM known_identity k LEFT JOIN player_games p ON p.tid = k.tid AND p.entry_no = k.entry_no AND p.side = k.side GROUP BY ALL)"""
