"""Queries on the catalog's feed, the look-ups made of it, events built from two registries, and the estimate of a load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabulon.operators import assembly, builds, load_plan
from tabulon.plans.registry import query
from tabulon.sources import catalog
from tabulon.sources.adapters import ADAPTER


def item(df, kind: str, **fields):
    return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("item"))


def named(prefix: str, key):
    return F.concat(F.lit(prefix), key.cast("string"))


def feed(t):
    """One feed of all kinds, made from the tables; every fifth set lacks its id, and every third printing is no JSON."""
    k, n, r, c, s = F.col("p_partkey"), F.col("n_nationkey"), F.col("r_regionkey"), F.col("c_custkey"), F.col("s_suppkey")
    start = F.date_format(F.date_add(F.to_date(F.lit("1995-03-01")), (c % 900).cast("int")), "yyyy-MM-dd")
    title = F.concat("p_name", F.lit(" "), "p_size")
    part, nation = t.raw("part"), t.raw("nation")
    cards = item(
        part,
        "cards",
        id=named("card", k),
        title=F.when(k % 7 != 0, title),
        stripped_title=title,
        card_type_id=F.when(k % 10 == 0, "corp_identity").otherwise("program"),
        deck_limit=F.when(k % 4 > 0, (k % 4).cast("string")).otherwise("none"),
        is_unique=k % 2 == 0,
        printing_ids=F.when(k % 6 > 0, F.array(named("p", k), named("p", k + 1))),
    )
    printings = item(part.filter("p_partkey % 3 = 0 and p_partkey % 9 > 0"), "printings", id=named("p", k), card_id=named("card", k + 2), date_release=F.lit("2001-02-30"))
    broken = part.filter("p_partkey % 9 = 0").select(F.lit("printings").alias("kind"), F.concat(F.lit('[{"id": "p'), k, F.lit('"')).alias("item"))
    printings = printings.unionByName(broken)
    sets_ = item(t.raw("supplier"), "card_sets", id=F.when(s % 5 < 4, named("s", s)), name=F.col("s_name"), date_release=F.lit("1998-12-31T00:00:00Z"))
    formats = item(t.raw("region"), "formats", id=F.when(r == 0, "standard").otherwise(named("f", r)), name=F.col("r_name"), snapshot_ids=F.transform(F.sequence(F.lit(0), r.cast("int")), lambda x: x.cast("string")))
    verdicts = F.struct(F.array("n_name").alias("banned"), F.create_map(F.col("n_name"), (n % 3).cast("int")).alias("points"))
    lists = item(nation, "restrictions", id=named("r", n), name=F.repeat("n_name", 20), point_limit=n % 4, verdicts=F.when(n % 2 == 0, verdicts))
    snapshots = item(t.raw("customer"), "snapshots", id=named("v", c), format_id=F.when(c % 3 == 0, "standard").otherwise("f1"), restriction_id=named("r", c % 25), date_start=F.when(c % 4 > 0, start), active=c % 100 == 0)
    return reduce(lambda a, b: a.unionByName(b), [cards, printings, sets_, formats, lists, snapshots])


@query(
    "src_11_six_kinds",
    """SELECT 'cards' AS kind, 'card' || p_partkey AS id, p_name || ' ' || p_size AS label, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END::INTEGER AS number, CASE WHEN p_partkey % 6 > 0 THEN 2 ELSE 0 END::INTEGER AS many, p_partkey % 2 = 0 AS flag, NULL::DATE AS date FROM part
UNION ALL SELECT 'card_sets', 's' || s_suppkey, s_name, NULL, NULL, NULL, DATE '1998-12-31' FROM supplier WHERE s_suppkey % 5 < 4
UNION ALL SELECT 'formats', CASE r_regionkey WHEN 0 THEN 'standard' ELSE 'f' || r_regionkey END, r_name, NULL, r_regionkey + 1, NULL, NULL FROM region
UNION ALL SELECT 'restrictions', 'r' || n_nationkey, left(repeat(n_name, 20), 80), n_nationkey % 4, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END, NULL, NULL FROM nation
UNION ALL SELECT 'snapshots', 'v' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'standard' ELSE 'f1' END, NULL, NULL, c_custkey % 100 = 0, CASE WHEN c_custkey % 4 > 0 THEN DATE '1995-03-01' + (c_custkey % 900)::INTEGER END FROM customer
UNION ALL SELECT 'printings', 'p' || p_partkey, 'card' || (p_partkey + 2), NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 9 > 0
UNION ALL SELECT 'refused', NULL, 'card_sets incomplete', count(*), NULL, NULL, NULL FROM supplier WHERE s_suppkey % 5 = 4
UNION ALL SELECT 'refused', NULL, 'printings not_readable', count(*), NULL, NULL, NULL FROM part WHERE p_partkey % 9 = 0""",
)
def six_kinds(t):
    """Typed rows of every kind, and how many items were refused."""
    f = feed(t)
    of = lambda kind: catalog.rows(f, kind)
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    parts = [
        of("cards").select(F.lit("cards").alias("kind"), "id", F.col("title").alias("label"), F.col("deck_limit").alias("number"), F.size("printing_ids").alias("many"), F.col("is_unique").alias("flag")),
        of("printings").select(F.lit("printings").alias("kind"), "id", F.col("card_id").alias("label"), F.col("date_release").alias("date")),
        of("card_sets").select(F.lit("card_sets").alias("kind"), "id", F.col("name").alias("label"), F.col("date_release").alias("date")),
        of("formats").select(F.lit("formats").alias("kind"), "id", F.col("name").alias("label"), F.size("snapshot_ids").alias("many")),
        of("restrictions").select(F.lit("restrictions").alias("kind"), "id", F.col("name").alias("label"), F.col("point_limit").alias("number"), (size("verdicts.banned") + size("verdicts.points")).alias("many")),
        of("snapshots").select(F.lit("snapshots").alias("kind"), "id", F.col("format_id").alias("label"), F.col("date_start").alias("date"), F.col("active").alias("flag")),
        catalog.refused(f).groupBy(F.concat_ws(" ", "kind", "reason").alias("label")).agg(F.count("*").cast("int").alias("number")).withColumn("kind", F.lit("refused")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.select("kind", "id", "label", "number", "many", "flag", "date")


@query(
    "src_12_catalog_look_ups",
    """WITH c AS (SELECT 'card' || p_partkey AS id, lower(p_name || ' ' || p_size) AS title, p_partkey % 10 = 0 AS head, p_partkey AS k FROM part),
own AS (SELECT 'p' || p_partkey AS printing, 'card' || (p_partkey + 2) AS card FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 9 > 0),
said AS (SELECT 'p' || (k + d) AS printing, min(id) AS card FROM c, (VALUES (0), (1)) x(d) WHERE k % 6 > 0 GROUP BY 1),
s AS (SELECT 'v' || c_custkey AS id, DATE '1995-03-01' + (c_custkey % 900)::INTEGER AS start FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 > 0)
SELECT 'printing' AS look_up, printing AS key, card AS found, NULL::INTEGER AS place FROM own
UNION ALL SELECT 'printing', printing, card, NULL FROM said WHERE printing NOT IN (SELECT printing FROM own)
UNION ALL SELECT 'identity', title, min(id) FILTER (head), NULL FROM c GROUP BY title HAVING count(*) FILTER (head) > 0
UNION ALL SELECT 'title', title, min(id), NULL FROM c GROUP BY title HAVING count(*) = 1
UNION ALL SELECT 'snapshot', id, strftime(start, '%Y-%m-%d'), row_number() OVER (ORDER BY start, id) FROM s""",
)
def look_ups(t):
    """Cards of printings, identities and cards by title, and the standard snapshots in their order."""
    f = feed(t)
    cards = catalog.rows(f, "cards")
    titles = catalog.title_cards(cards)
    one = lambda df, name, key, found: df.select(F.lit(name).alias("look_up"), F.col(key).alias("key"), found.alias("found")).filter("found is not null")
    parts = [
        one(catalog.printing_cards(catalog.rows(f, "printings"), cards), "printing", "printing_id", F.col("card_id")),
        one(titles, "identity", "key", F.col("identity")),
        one(titles, "title", "key", F.col("card_id")),
        catalog.ordered_snapshots(catalog.rows(f, "snapshots")).select(F.lit("snapshot").alias("look_up"), F.col("id").alias("key"), F.col("date_start").cast("string").alias("found"), "place"),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query(
    "src_15_named_references",
    """SELECT 'play_formats' AS kind, r_regionkey::VARCHAR AS id, r_name AS name, NULL AS extra FROM region UNION ALL SELECT 'tournament_types', c_custkey::VARCHAR, c_name, NULL FROM customer
UNION ALL SELECT 'deckbuilding_restrictions', n_nationkey::VARCHAR, CASE WHEN n_nationkey % 5 > 0 THEN left(repeat(n_name, 20), 120) ELSE '' END, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE '' END || '|' || CASE WHEN n_nationkey % 3 > 0 THEN '1998-01-01' ELSE '' END FROM nation""",
)
def named_references(t):
    """Another registry's formats, types and ban lists by id and name."""
    n = F.col("n_nationkey")
    lists = item(t.raw("nation"), catalog.DATED, id=n, name=F.when(n % 5 > 0, F.repeat("n_name", 20)), play_format_id=F.when(n % 2 == 0, F.col("n_regionkey")), date_start=F.when(n % 3 > 0, "1998-01-01"))
    types = item(t.raw("customer"), "tournament_types", id=F.col("c_custkey"), name=F.col("c_name"), date_start=F.lit("1998-01-01"))
    return catalog.references(lists.unionByName(types).unionByName(item(t.raw("region"), "play_formats", id=F.col("r_regionkey"), name=F.col("r_name"))))


#: Events of even buckets come from the first registry, the others from the second.
FIRST = f"{ADAPTER}, b AS (SELECT *, regexp_replace(tid, '[^0-9]', '', 'g')::BIGINT AS id FROM tournament)"


def built(t):
    """Both registries' records, made from the canonical tables, and what is built of them."""
    numbered = t.tournament.withColumn("id", F.regexp_replace("tid", "[^0-9]", "").cast("long"))
    ids = numbered.select("tid", "id", "bucket", "cut_size")
    e = t.entry.join(ids, "tid")
    decks = t.deck.filter("legal").join(ids, "tid")
    games = t.game.join(ids, "tid").filter("corp_entry % 11 > 0 and runner_entry % 11 > 0")
    even = "bucket % 2 = 0"
    first = numbered.filter(even).select(
        F.col("id").alias("cobra_id"), F.when(F.col("bucket") % 3 == 0, F.col("id") + 7).alias("abr_id"), "date", F.lit("store championship").alias("type"), "tier", "restriction_id", F.lit("set1").alias("card_set"),
        F.lit("public").alias("swiss"), F.when(F.col("cut_size") > 0, "open").otherwise("private").alias("cut"), F.when(F.col("bucket") % 4 > 0, F.col("name")).otherwise("").alias("name"), F.lit("single_sided").alias("swiss_format"),
    )
    ranked = F.when(F.col("entry_no") % 11 > 0, F.col("entry_no"))
    players = e.filter(even).select(F.col("id").alias("cobra_id"), (F.col("entry_no") + 100).alias("pid"), ranked.alias("swiss_rank"), F.when(F.col("made_cut"), F.col("entry_no")).alias("cut_rank"), "corp_identity", "runner_identity", "points")
    stages = ids.filter(even).select(F.col("id").alias("cobra_id"), F.explode(F.when(F.col("cut_size") > 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"), F.col("cut_size").alias("size"))
    linked = numbered.filter(f"{even} and bucket % 3 = 0").select((F.col("id") + 7).alias("abr_id"), F.concat(F.lit("Linked "), "tid").alias("title"), F.lit("Nowhere").alias("country"), F.col("online").alias("linked_online"), F.lit(False).alias("online_type"))
    matches = e.filter(f"{even} and entry_no % 3 = 0").select(F.concat(F.lit("c"), "id").alias("tid"), "entry_no", F.col("entry_no").alias("abr_swiss_rank"))
    of = lambda df, prefix: df.withColumn("tid", F.concat(F.lit(prefix), F.col("id")))
    one = builds.first_registry(first, players, stages, linked, matches, of(decks.filter(even), "c"), of(games.filter(even), "c"))
    odd = "bucket % 2 = 1"
    second = numbered.filter(odd).select(
        F.col("id").alias("abr_id"), "date", F.lit("casual").alias("type"), "tier", "restriction_id", F.col("name").alias("title"), F.lit("Here").alias("country"), (F.col("players") + F.when(F.col("bucket") % 5 == 0, 3).otherwise(-1)).alias("players_count"),
        F.col("cut_size").alias("top_count"), F.lit(False).alias("linked_online"), (F.col("bucket") % 7 == 1).alias("online_type"),
    )
    entries = e.filter(odd).select(F.col("id").alias("abr_id"), F.col("entry_no").alias("swiss_rank"), F.when(F.col("entry_no") % 6 < 4, F.col("entry_no") % 6).alias("cut_rank"), "corp_identity", "runner_identity")
    two = builds.second_registry(second, entries, of(decks.filter(odd), "a"))
    return one[0].unionByName(two[0]), one[1].unionByName(two[1])


@query(
    "rl_16_rl_17_built_events",
    f"""{FIRST}, d AS (SELECT tid, count(*) FILTER (entry_no % 11 > 0) AS ranked_decks, count(*) AS decks FROM deck WHERE legal GROUP BY 1), n AS (SELECT tid, count(*) AS entries, count(*) FILTER (entry_no % 11 > 0) AS ranked FROM entry GROUP BY 1),
g AS (SELECT tid, true AS played FROM game WHERE corp_entry % 11 > 0 AND runner_entry % 11 > 0 GROUP BY 1)
SELECT 'c' || id AS tid, id AS cobra_id, CASE WHEN bucket % 3 = 0 THEN id + 7 END AS abr_id, date, 'store championship' AS type, tier, 'standard' AS format, restriction_id, 'set1' AS card_set, CASE WHEN bucket % 3 = 0 THEN 'Nowhere' END AS country,
    (bucket % 3 = 0 AND online) OR (bucket % 4 > 0 AND contains(lower(name), 'online')) AS online, entries::INTEGER AS players, cut_size, coalesce(played, false) AS has_games, CASE WHEN cut_size > 0 THEN 'swiss:public,cut:open' ELSE 'swiss:public,cut:private' END AS deck_visibility,
    coalesce(round(coalesce(ranked_decks, 0)::DOUBLE / nullif(2 * ranked, 0), 6), 0) AS decklist_coverage, CASE WHEN bucket % 4 > 0 THEN name WHEN bucket % 3 = 0 THEN 'Linked ' || tid END AS name, 'single_sided' AS swiss_format
FROM b JOIN n USING (tid) LEFT JOIN d USING (tid) LEFT JOIN g USING (tid) WHERE bucket % 2 = 0
UNION ALL SELECT 'a' || id, NULL, id, date, 'casual', tier, 'standard', restriction_id, NULL, 'Here', contains(lower(name), 'online') OR bucket % 7 = 1, p, cut_size, false, 'n/a', coalesce(round(coalesce(decks, 0)::DOUBLE / nullif(2 * greatest(entries, p), 0), 6), 0), name, NULL
FROM (SELECT *, players + CASE WHEN bucket % 5 = 0 THEN 3 ELSE -1 END AS p FROM b) JOIN n USING (tid) LEFT JOIN d USING (tid) WHERE bucket % 2 = 1""",
)
def built_events(t):
    return built(t)[0]


@query(
    "rl_17_rl_18_built_entries",
    f"""{FIRST} SELECT 'c' || id AS tid, entry_no, CASE WHEN made_cut THEN entry_no END AS cut_rank, made_cut, corp_identity, runner_identity, points, (entry_no + 100)::BIGINT AS cobra_pid, CASE WHEN entry_no % 3 = 0 THEN entry_no END AS abr_swiss_rank FROM entry JOIN b USING (tid) WHERE bucket % 2 = 0 AND entry_no % 11 > 0
UNION ALL SELECT 'a' || id, entry_no, CASE WHEN entry_no % 6 BETWEEN 1 AND 3 THEN entry_no % 6 END, cut_size > 0 AND entry_no % 6 BETWEEN 1 AND 3, corp_identity, runner_identity, NULL, NULL, entry_no FROM entry JOIN b USING (tid) WHERE bucket % 2 = 1""",
)
def built_entries(t):
    return built(t)[1]


DAYS = 731


@query(
    "ag_32_load_estimate",
    f"""WITH i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 2 OR DATE '2001-08-01' - o_orderdate::DATE <= 90 THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS phase FROM orders),
a AS (SELECT 'abr' AS host, phase, 10 AS tenths FROM i WHERE k % 4 = 0 UNION ALL SELECT 'nrdb', phase, k % 7 * 2 FROM i WHERE k % 4 = 0
    UNION ALL SELECT 'cobra', phase, 10 + 10 * CASE k % 3 WHEN 0 THEN coalesce(nullif(k % 40, 0), 0) WHEN 1 THEN least(k % 40, 16) ELSE 0 END FROM i WHERE k % 4 > 0 AND k % 11 > 0
    UNION ALL SELECT 'nrdb', 0, ({DAYS} + 7) * 10 UNION ALL SELECT 'cobra', 0, 120),
s AS (SELECT p.phase, h.host, place, s, ceil(coalesce(sum(tenths), 0) / 10)::BIGINT AS requests FROM (VALUES (0), (1), (2), (3)) p(phase), (VALUES ('abr', 0, 2), ('cobra', 1, 2), ('nrdb', 2, 1)) h(host, place, s) LEFT JOIN a ON a.host = h.host AND a.phase = p.phase GROUP BY ALL)
SELECT phase::INTEGER AS phase, host, requests, requests * s AS seconds, max(requests * s) OVER (PARTITION BY phase) AS duration_s, first_value(host) OVER (PARTITION BY phase ORDER BY requests * s DESC, place) AS slowest FROM s""",
)
def load_estimate(t):
    """Requests by phase and host, had the orders been events to load; twelve lists of the second host were read."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "abr_entries").otherwise("cobra_tournament")
    phase = assembly.phase(kind, F.when(k % 8 != 2, F.to_date("o_orderdate")), F.when(k % 3 == 0, "megacity").otherwise("gnk"), F.to_date(F.lit("2001-08-01")))
    items = t.raw("orders").select(
        kind.alias("kind"), phase.alias("phase"), (k % 11 == 0).alias("frozen"), (k % 7).alias("claims"), F.nullif(k % 40, F.lit(0)).alias("players"),
        F.when(k % 3 == 0, "public").otherwise("open").alias("swiss"), F.when(k % 3 == 1, "public").otherwise("private").alias("cut"),
    )
    return load_plan.estimate(load_plan.requests(items), DAYS, {"cobra": 12})
