"""Queries on scalar functions, arrays, JSON, sorts and sets; their inputs take every branch."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions import dates, links, ratios, text
from tabulon.operators import assembly
from tabulon.operators.ranking import ranked
from tabulon.plans.registry import query
from tabulon.sources.adapters import ADAPTER


def nth(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("fs_04_clean_titles", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a ' || p_name WHEN 1 THEN NULL WHEN 2 THEN repeat('x', 120) ELSE p_name END AS title FROM part")
def clean_titles(t):
    """Control characters and runs of spaces, nothing but them, more than 120 characters, and a clean title."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    raw = F.when(k == 0, F.concat(F.lit("\x01 a\t\n "), name, F.lit(" \x7f"))).when(k == 1, " \x00\t ").when(k == 2, F.lit("x" * 130)).otherwise(name)
    return t.raw("part").select("p_partkey", text.opt_title(raw).alias("title"))


VISIBLE = ["swiss_public", "OPEN", "cut: open", "private", "", None, "publicly"]


@query("fs_11_fs_12_visibility_and_kind", f"SELECT p_partkey, ['public', 'open', 'open', 'private', 'private', 'private', 'private'][p_partkey % 7 + 1] AS visibility, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type END AS kind FROM part")
def visibility_and_kind(t):
    return t.raw("part").select("p_partkey", text.visibility(nth(VISIBLE, F.col("p_partkey") % 7)).alias("visibility"), text.in_list(F.col("p_type"), ["PROMO", "SMALL"]).alias("kind"))


@query("fs_07_record_hashes", """SELECT o_orderkey, sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders""")
def record_hashes(t):
    """Of the fields in order of their names, whatever their order in the record, without those that change with each fetch."""
    fields = sorted(["o_orderstatus", "o_orderpriority"])
    return t.raw("orders").select("o_orderkey", F.sha2(F.to_json(F.struct(*fields)), 256).alias("h"))


@query("fs_15_display_names", f"SELECT p_partkey, coalesce(map {{{', '.join(f'{k!r}: {v!r}' for k, v in text.FACTIONS.items())}}}[f], 'Neutral') AS faction, coalesce(map {{{', '.join(f'{k!r}: {v!r}' for k, v in text.TYPES.items())}}}[y], y) AS type FROM (SELECT p_partkey, {sql_list([*text.FACTIONS, 'unheard_of', None])}[p_partkey % 14 + 1] AS f, {sql_list([*text.TYPES, 'new_type'])}[p_partkey % 12 + 1] AS y FROM part)")
def display_names(t):
    f, y = nth([*text.FACTIONS, "unheard_of", None], F.col("p_partkey") % 14), nth([*text.TYPES, "new_type"], F.col("p_partkey") % 12)
    return t.raw("part").select("p_partkey", text.named(f, text.FACTIONS, F.lit("Neutral")).alias("faction"), text.named(y, text.TYPES, y).alias("type"))


@query("fs_16_event_formats", f"""{ADAPTER} SELECT tid, CASE bucket % 3 WHEN 0 THEN 'Single-sided swiss, ' || c WHEN 1 THEN 'Double-sided swiss, ' || c ELSE upper(c[1]) || c[2:] END AS format FROM (SELECT *, CASE WHEN cut_size > 0 THEN 'top ' || cut_size ELSE 'no cut' END AS c FROM tournament)""")
def event_formats(t):
    swiss = F.when(F.col("bucket") % 3 == 0, "single_sided").when(F.col("bucket") % 3 == 1, "double_sided")
    return t.tournament.select("tid", text.event_format(swiss, F.col("cut_size")).alias("format"))


VALUE = "CASE WHEN p_partkey % 11 > 0 THEN (p_partkey % 401 - 200) / 7.3::DOUBLE / CASE p_partkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 10 ELSE 1 END END"


@query("fs_17_formatters", f"""SELECT p_partkey, coalesce(format('{{:,}}', n), '–') AS whole, coalesce(printf('%.1f', v * 100) || '%', '–') AS pct, coalesce(CASE WHEN printf('%.1f', abs(v)) = '0.0' THEN '±' WHEN v > 0 THEN '+' ELSE '−' END || printf('%.1f', abs(v)) || ' pp', '–') AS pp,
    coalesce(printf('%.2f', v) || '×', '–') AS ratio, coalesce(printf('%.2f', v), '–') AS num FROM (SELECT p_partkey, {VALUE} AS v, CASE WHEN p_partkey % 5 > 0 THEN p_partkey * 7919 END AS n FROM part)""")
def formatters(t):
    k = F.col("p_partkey")
    v = F.when(k % 11 > 0, (k % 401 - 200) / F.lit(7.3) / F.when(k % 3 == 0, 1000).when(k % 3 == 1, 10).otherwise(1))
    p = t.raw("part").select("p_partkey", v.alias("v"), F.when(k % 5 > 0, k * 7919).alias("n"))
    return p.select("p_partkey", text.whole_number(F.col("n")).alias("whole"), text.percent(F.col("v")).alias("pct"), text.signed_points(F.col("v")).alias("pp"), text.times(F.col("v")).alias("ratio"), text.decimals(F.col("v")).alias("num"))


NICE = "CASE WHEN {v} > 0 THEN list_filter(list_transform([1, 2, 2.5, 5, 10], lambda x: x::DOUBLE * pow(10, floor(log10({v})))), lambda x: x >= {v})[1] ELSE 1.0 END"


@query("fm_13_nice_axes", f"""SELECT p_partkey, {NICE.format(v="p_retailprice")} AS nice, step, floor(low / step + 1e-9) * step AS low, ceil(top / step - 1e-9) * step + 0.0 AS high FROM (SELECT *, {NICE.format(v="((top - low) / 4)")} AS step FROM (SELECT *, -p_size::DOUBLE AS low, CASE WHEN p_partkey % 5 = 0 THEN 1.0 - p_size ELSE p_retailprice END AS top FROM part))""")
def nice_axes(t):
    low = -F.col("p_size").cast("double")
    axis = ratios.nice_axis(low, F.when(F.col("p_partkey") % 5 == 0, low).otherwise(F.col("p_retailprice")))
    return t.raw("part").select("p_partkey", ratios.nice_max(F.col("p_retailprice")).alias("nice"), axis.alias("a")).select("p_partkey", "nice", "a.*")


@query("fm_03_exact_rounding")
def exact_rounding(t):
    """Correct rounding of the binary value has no SQL form; a test holds it against the fractions themselves."""
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", ratios.rounded(F.col("l_extendedprice") * F.col("l_discount") / 7, 4).alias("r"))


@query("fa_02_fa_03_fa_04_arrays", """SELECT conv_id, coalesce(max(n) FILTER (role = 'user'), 0) AS users, coalesce(max(n) FILTER (role = 'judge'), 0) AS judges, list(role ORDER BY role) AS roles FROM (SELECT conv_id, role, count(*) AS n FROM conversations WHERE role IS NOT NULL AND conv_id IS NOT NULL GROUP BY ALL) GROUP BY conv_id""")
def arrays(t):
    """Counts from a map with 0 for a missing key; the keys sorted; both come through parallel lists that are zipped again."""
    c = t.raw("conversations").filter("role is not null and conv_id is not null").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    lists = c.groupBy("conv_id").agg(F.collect_list(F.struct("role", "n")).alias("l")).select("conv_id", F.col("l.role").alias("roles"), F.col("l.n").alias("ns"))
    rows = lists.select("conv_id", F.inline(F.arrays_zip("roles", "ns")))
    m = rows.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("roles", "ns"))).alias("m"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    return m.select("conv_id", get("user").alias("users"), get("judge").alias("judges"), F.array_sort(F.map_keys("m")).alias("roles"))


@query("fa_05_dictionary_codes", "WITH d AS (SELECT list(DISTINCT p_brand ORDER BY p_brand) AS words FROM part WHERE p_brand IS NOT NULL) SELECT p_partkey, (list_position(words, p_brand) - 1)::BIGINT AS code, p_brand AS word FROM part, d")
def dictionary_codes(t):
    """Values as places in a sorted dictionary, a row a word, numbered over ranges, and back; rows are joined to their word by the code."""
    p = t.raw("part").select("p_partkey", "p_brand")
    words = ranked(p.filter("p_brand is not null").select("p_brand").distinct(), [], [F.col("p_brand")], "place")
    words = words.select("p_brand", (F.col("place") - 1).cast("long").alias("code"))
    coded = p.join(words, "p_brand", "left").select("p_partkey", "code")
    return coded.join(words.select("code", F.col("p_brand").alias("word")), "code", "left").select("p_partkey", "code", "word")


@query("fa_07_vector_sums", "SELECT l_returnflag, [sum(l_quantity), sum(l_linenumber), sum(l_linenumber % 2)]::DOUBLE[] AS v FROM lineitem GROUP BY 1")
def vector_sums(t):
    """Vectors are added by their elements, as sums of columns, so that partial sums are made before the shuffle."""
    v = F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"), (F.col("l_linenumber") % 2).cast("double"))
    rows = t.raw("lineitem").select("l_returnflag", v.alias("v"))
    return rows.groupBy("l_returnflag").agg(F.array(*[F.sum(F.element_at("v", i + 1)) for i in range(3)]).alias("v"))


@query("fj_02_canonical_json", """SELECT o_orderkey, '{"a":' || (o_orderkey % 3) || ',"b":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || ',"z":[1,' || o_orderkey || ']}' AS j FROM orders""")
def canonical_json(t):
    """Fields by name, compact, nulls written out."""
    values = {"z": F.array(F.lit(1).cast("long"), F.col("o_orderkey")), "b": F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderstatus")), "a": F.col("o_orderkey") % 3}
    return t.raw("orders").select("o_orderkey", F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"}).alias("j"))


COERCED = ["12", " 7 ", "1.5", "null", "", "yes", "TRUE", "0", "01234", None]


@query("fj_03_fj_04_coercions", """SELECT p_partkey, [12, 7, NULL, NULL, NULL, NULL, NULL, 0, 1234, NULL][m] AS whole, ([12.0, 7.0, 1.5, NULL, NULL, NULL, NULL, 0.0, 1234.0, NULL]::DOUBLE[])[m] AS real, [false, false, false, false, false, true, true, false, false, false][m] AS flag,
    CASE m WHEN 9 THEN '01234' END AS printing, CASE WHEN p_partkey % 3 > 0 THEN 'type_id' WHEN p_partkey % 2 > 0 THEN 'type' END AS kind FROM (SELECT p_partkey, p_partkey % 10 + 1 AS m FROM part)""")
def coercions(t):
    """Texts as whole numbers, reals, flags and printing ids, NULL where they are none; 'null' is NULL; a field falls back on its old name."""
    v, k = F.nullif(F.trim("v"), F.lit("null")), F.col("p_partkey")
    p = t.raw("part").select("p_partkey", nth(COERCED, k % 10).alias("v"), F.when(k % 3 > 0, "type_id").alias("type_id"), F.when(k % 2 > 0, "type").alias("type"))
    whole = F.when(v.rlike(r"^-?[0-9]+\z"), v.try_cast("int"))
    return p.select("p_partkey", whole.alias("whole"), v.try_cast("double").alias("real"), F.coalesce(F.lower(v).isin("true", "yes", "1"), F.lit(False)).alias("flag"), text.strict(v, "printing").alias("printing"), F.coalesce("type_id", "type").alias("kind"))


@query("so_01_so_07_so_08_sorted_names", "SELECT p_name, p_brand, row_number() OVER (ORDER BY lower(n), p_brand DESC, p_partkey)::INTEGER AS place FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part) ORDER BY place LIMIT 25")
def sorted_names(t):
    """The first 25 by name, whatever its case, then by brand downward and key: a top-k report."""
    n = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    top = t.raw("part").orderBy(F.lower(n), F.desc("p_brand"), "p_partkey").limit(25)
    return top.select("p_name", "p_brand", F.row_number().over(W.orderBy(F.lower(n), F.desc("p_brand"), "p_partkey")).alias("place"))


@query("so_10_lists_newest_first", f"{ADAPTER} SELECT id, row_number() OVER (ORDER BY id <> 'all', date_start DESC, id DESC)::INTEGER AS place FROM (SELECT restriction_id AS id, CASE WHEN year % 2 = 0 THEN date_start ELSE date_start - INTERVAL 1 YEAR END::DATE AS date_start FROM restriction UNION ALL SELECT 'all', NULL)")
def lists_newest_first(t):
    r = t.restriction.select(F.col("restriction_id").alias("id"), F.when(F.col("year") % 2 == 0, F.col("date_start")).otherwise(F.add_months("date_start", -12)).alias("date_start"))
    r = r.union(t.spark.sql("SELECT 'all', CAST(NULL AS DATE)"))
    return r.select("id", F.row_number().over(W.orderBy(F.col("id") != "all", F.desc("date_start"), F.desc("id"))).alias("place"))


@query("so_11_list_order", f"{ADAPTER} SELECT restriction_id, row_number() OVER (ORDER BY d NULLS LAST, restriction_id)::INTEGER AS place FROM (SELECT restriction_id, min(CASE WHEN year % 3 > 0 THEN date_start - INTERVAL (k * (year % 5) * 300) DAY END)::DATE AS d FROM restriction, (VALUES (0), (1)) v(k) GROUP BY 1)")
def list_order(t):
    """By their first snapshot; lists without one come last."""
    snapshots = t.restriction.filter("year % 3 > 0").select("restriction_id", F.explode(F.array("date_start", F.date_sub("date_start", F.col("year") % 5 * 300))).alias("date"))
    first = snapshots.groupBy("restriction_id").agg(F.min("date").alias("d"))
    return t.restriction.select("restriction_id").join(first, "restriction_id", "left").select("restriction_id", F.row_number().over(W.orderBy(F.asc_nulls_last("d"), "restriction_id")).alias("place"))


@query("st_04_st_05_st_07_sets", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['b', 'a', 'c'] ELSE ['b', 'a'] END AS once, CASE event_id % 3 WHEN 0 THEN ['a', 'b', 'c', 'd'] ELSE ['a', 'b', 'd'] END AS every, ['k'] AS unknown FROM events""")
def sets(t):
    """Values once in order of first appearance; the union with those of another run; fields of a record that aren't declared."""
    seen = F.when(F.col("event_id") % 3 == 0, F.array(*map(F.lit, "babcb"))).otherwise(F.array(*map(F.lit, "bab")))
    unknown = F.array_except(F.json_object_keys("props"), F.array(F.lit("declared")))
    return t.raw("events").select("event_id", F.array_distinct(seen).alias("once"), F.array_sort(F.array_union(seen, F.array(F.lit("a"), F.lit("d")))).alias("every"), unknown.alias("unknown"))


@query("st_08_new_ids", "SELECT p_partkey FROM part WHERE p_partkey % 10 = 3")
def new_ids(t):
    """Ids that the last run's catalog hadn't."""
    p = t.raw("part").select("p_partkey")
    return p.join(p.filter("p_partkey % 10 <> 3"), "p_partkey", "left_anti")


@query("flt_25_name_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red')")
def name_filter(t):
    """Names that contain the words whatever the case and accents; here names are spelt with some."""
    spelt = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.replace("p_name", F.lit("e"), F.lit("é")))
    return t.raw("part").select("p_partkey", text.fold(spelt).alias("n")).filter(F.contains("n", F.lit("red"))).select("p_partkey")


LINKS = "SELECT o_orderkey AS id, o_orderdate AS created, o_orderdate + INTERVAL (o_orderkey % 400) DAY AS hit FROM orders"


def short_links(t):
    created = F.col("o_orderdate").cast("timestamp_ntz")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), created.alias("created"), (created + F.make_dt_interval((F.col("o_orderkey") % 400).cast("int"))).alias("hit"))


NOW = "TIMESTAMP_NTZ'2001-09-01 00:00:00'"


@query("flt_29_kept_links", f"SELECT id FROM ({LINKS}) WHERE hit >= TIMESTAMP '2001-09-01' - INTERVAL 365 DAY")
def kept_links(t):
    """Links last followed within a year; a setting of no days at all would delete everything, so it is refused."""
    return retained(short_links(t), 365)


def retained(links, days: int):
    if days < 1:
        raise ValueError("links must be kept for a day at least")
    return links.filter(f"hit >= {NOW} - INTERVAL '{days}' DAY").select("id")


@query("flt_30_throttled_hits", f"SELECT id, CASE WHEN hit < TIMESTAMP '1999-01-01' - INTERVAL 1 DAY THEN TIMESTAMP '1999-01-01' ELSE hit END AS hit FROM ({LINKS})")
def throttled_hits(t):
    """The last hit is renewed only where it is older than a day."""
    now = "TIMESTAMP_NTZ'1999-01-01 00:00:00'"
    return short_links(t).select("id", F.expr(f"CASE WHEN hit < {now} - INTERVAL '1' DAY THEN {now} ELSE hit END").alias("hit"))


@query("ag_30_daily_cap", f"SELECT count(*) AS made, count(*) >= 5 AS full FROM ({LINKS}) WHERE created > TIMESTAMP '1999-01-02' - INTERVAL 1 DAY AND created <= TIMESTAMP '1999-01-02'")
def daily_cap(t):
    made = F.count("*")
    return short_links(t).filter("created > TIMESTAMP_NTZ'1999-01-01 00:00:00' and created <= TIMESTAMP_NTZ'1999-01-02 00:00:00'").agg(made.alias("made"), (made >= 5).alias("full"))


@query("src_25_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(t):
    return t.raw("orders").filter("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("wn_11_nth_in_turn", "SELECT event_id, CASE WHEN count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY user_id, event_type, day(ts) ORDER BY ts, event_id) END::INTEGER AS nth FROM events WINDOW w AS (PARTITION BY user_id, event_type, day(ts))")
def nth_in_turn(t):
    """Numbers repeats of a kind within a turn (a day), where there are any."""
    w = W.partitionBy("user_id", "event_type", F.dayofmonth("ts"))
    return t.raw("events").select("event_id", F.when(F.count("*").over(w) > 1, F.row_number().over(w.orderBy("ts", "event_id"))).alias("nth"))


@query("flt_26_hide_zero", f"SELECT user_id, event_type, sum(CASE WHEN event_type = 'click' THEN floor(value) ELSE 0 END)::BIGINT AS gained FROM events GROUP BY ALL HAVING gained <> 0")
def hide_zero(t):
    g = t.raw("events").groupBy("user_id", "event_type").agg(F.sum(F.when(F.col("event_type") == "click", F.floor("value")).otherwise(0)).alias("gained"))
    return g.filter("gained <> 0")


@query("snk_02_padded_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN 'a-long-key-of-' || o_orderkey ELSE lpad(o_orderkey::VARCHAR, 12, '0') END, o_orderkey)::INTEGER AS place FROM orders")
def padded_order(t):
    """Numbers in text order by zeros before them, nothing for null, longer keys as they are."""
    k = F.col("o_orderkey")
    key = F.when(k % 9 == 1, F.concat(F.lit("a-long-key-of-"), k)).when(k % 9 != 0, k.cast("string"))
    padded = F.coalesce(F.when(F.length(key) < 12, F.lpad(key, 12, "0")).otherwise(key), F.lit(""))
    return ranked(t.raw("orders").select("o_orderkey", padded.alias("padded")), [], [F.asc("padded"), F.asc("o_orderkey")], "place").drop("padded")


@query("vd_03_vd_04_quarantine", "SELECT event_id, event_id % 7 = 0 AS bad, CASE WHEN event_id % 7 = 0 THEN sha256('{broken ' || event_id) END AS payload_hash, CASE WHEN event_id % 7 > 0 THEN (props->>'$.k')::BIGINT END AS k FROM events")
def quarantine(t):
    """Records that don't parse are kept by key and hash of their text, never by the text; of the others, declared fields only."""
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), F.col("event_id"))).otherwise(F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "secret": "x"}')))
    e = t.raw("events").select("event_id", raw.alias("raw"))
    e = e.withColumn("r", F.from_json("raw", "k long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull()
    return e.select("event_id", bad.alias("bad"), F.when(bad, F.sha2("raw", 256)).alias("payload_hash"), F.when(~bad, F.col("r.k")).alias("k"))


@query("src_07_hidden_input_decks", "SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 'Card ' || page_id || ' & \"Co\"' END AS title, CASE WHEN page_id % 5 > 0 THEN (page_id % 3)::BIGINT END AS qty FROM pages")
def hidden_input_decks(t):
    """The deck in a hidden field's value, entities decoded, read as JSON; no field, no deck. The field is set into each whole page."""
    k = F.col("page_id")
    value = F.concat(F.lit("{&quot;title&quot;: &quot;Card "), k, F.lit(" &amp; \\&quot;Co\\&quot;&quot;, &quot;qty&quot;: "), k % 3, F.lit("}"))
    field = F.when(k % 5 > 0, F.concat(F.lit('<input type="hidden"\n id="corp_deck" value="'), value, F.lit('">'))).otherwise(F.lit('<input id="other" value="{}">'))
    page = F.concat(field, F.coalesce("html", F.lit("")))
    found = F.regexp_extract(page, r"""(?is)<input\b[^>]*\bid=["']corp_deck["'][^>]*\bvalue=["']([^"']*)["']""", 1)
    for entity, plain in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(plain))
    return t.raw("pages").select("page_id", F.from_json(F.nullif(found, F.lit("")), "title string, qty long").alias("d")).select("page_id", "d.title", "d.qty")


@query("src_08_api_documents", "SELECT user_id, event_id::VARCHAR AS id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_id % 4 > 0 UNION ALL SELECT user_id, 'own' || event_id, (props->>'$.k')::BIGINT FROM events WHERE event_id % 4 = 0")
def api_documents(t):
    """Documents of many items: their attributes, with the item's id where the attributes have none."""
    own = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(',"id":"own'), F.col("event_id"), F.lit('"'))).otherwise("")
    item = F.concat(F.lit('{"id":"'), F.col("event_id"), F.lit('","attributes":'), F.expr("left(props, length(props) - 1)"), own, F.lit("}}"))
    docs = t.raw("events").groupBy("user_id").agg(F.concat(F.lit('{"data":['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("doc"))
    data = docs.select("user_id", F.explode(F.from_json("doc", "data array<struct<id: string, attributes: struct<id: string, k: long>>>")["data"]).alias("d"))
    return data.select("user_id", F.coalesce("d.attributes.id", "d.id").alias("id"), F.col("d.attributes.k").alias("k"))


@query("src_18_src_19_deck_lists", f"""{ADAPTER}, x AS (SELECT deck_id, card_id, qty, CASE WHEN card_id LIKE 'x%' THEN 0 ELSE qty END AS n FROM deck_card) SELECT deck_id, (SELECT max(x2.card_id) FROM x x2 JOIN card USING (card_id) WHERE x2.deck_id = x.deck_id AND card_type_id LIKE '%identity') AS identity, coalesce(sum(n) FILTER (card_type_id NOT LIKE '%identity'), 0)::BIGINT AS copies FROM x LEFT JOIN card USING (card_id) GROUP BY deck_id""")
def deck_lists(t):
    """Lists as maps of code to copies: no row for none; the identity apart, of several the last by code."""
    m = t.deck_card.groupBy("deck_id").agg(F.map_from_entries(F.collect_list(F.struct("card_id", F.when(F.col("card_id").startswith("x"), 0).otherwise(F.col("qty"))))).alias("m"))
    rows = m.select("deck_id", F.explode_outer("m").alias("card_id", "n")).join(t.card.select("card_id", "card_type_id"), "card_id", "left")
    identity = F.col("card_type_id").endswith("identity")
    return rows.groupBy("deck_id").agg(F.max(F.when(identity & (F.col("n") > 0), F.col("card_id"))).alias("identity"), F.coalesce(F.sum(F.when(~identity & (F.col("n") > 0), F.col("n"))), F.lit(0)).alias("copies"))


@query("src_05_src_12_first_or_last_wins", """SELECT alias, CASE WHEN n = 2 THEN 'file' ELSE source END AS source FROM (SELECT alias, count(*) AS n, max(source) AS source FROM (SELECT 'o' || o_orderkey AS alias, 'file' AS source FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT 'o' || o_orderkey, 'single' FROM orders WHERE o_orderkey % 3 > 0) GROUP BY 1)
UNION ALL SELECT 'u' || o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'file' ELSE 'single' END FROM orders WHERE o_orderkey % 2 = 0""")
def first_or_last_wins(t):
    """A record is found by its id and, if it has one, by its UUID; by-date files overwrite, single records only fill gaps."""
    k = F.col("o_orderkey")
    aliases = F.array_compact(F.array(F.concat(F.lit("o"), k), F.when(k % 2 == 0, F.concat(F.lit("u"), k))))
    of = lambda rows, source, rank: rows.select(F.explode(aliases).alias("alias"), F.lit(source).alias("source"), F.lit(rank).alias("rank"))
    o = t.raw("orders")
    every = of(o.filter("o_orderkey % 3 < 2"), "file", 0).union(of(o.filter("o_orderkey % 3 > 0"), "single", 1))
    return every.groupBy("alias").agg(F.min_by("source", "rank").alias("source"))


@query("src_24_tier_config", f"{ADAPTER} SELECT tid, tier, [4, 3, 2, 1][list_position(['megacity', 'store', 'gnk', 'online'], g)] AS weight FROM (SELECT *, {text.tier_sql('name')} AS g FROM tournament)")
def tier_config(t):
    """A configuration in JSON as a small table that is joined by group."""
    config = '{"groups": [{"id": "megacity", "weight": 4}, {"id": "store", "weight": 3}, {"id": "gnk", "weight": 2}, {"id": "online", "weight": 1}]}'
    groups = t.spark.sql("SELECT 1").select(F.inline(F.from_json(F.lit(config), "groups array<struct<id: string, weight: int>>")["groups"]))
    return t.tournament.withColumn("id", text.tier(F.col("name"))).join(F.broadcast(groups), "id").select("tid", "tier", "weight")  # four rows


@query("ag_31_drift_merge", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS names, max(o_orderkey) AS last FROM orders GROUP BY 1")
def drift_merge(t):
    """Names seen in either run as one set, and of each key the last run's record."""
    o = t.raw("orders")
    run = lambda rows: rows.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("names"), F.max("o_orderkey").alias("last"))
    a, b = run(o.filter("o_orderkey % 2 = 0")), run(o.filter("o_orderkey % 2 = 1")).select("o_custkey", F.col("names").alias("more"), F.col("last").alias("later"))
    none = F.array().cast("array<string>")
    m = a.join(b, "o_custkey", "full")
    return m.select("o_custkey", F.size(F.array_union(F.coalesce("names", none), F.coalesce("more", none))).cast("long").alias("names"), F.greatest("last", "later").alias("last"))


@query("jn_30_card_metadata", f"{ADAPTER} SELECT deck_id, x.card_id, title FROM deck_card x LEFT JOIN card USING (card_id)")
def card_metadata(t):
    return t.deck_card.join(t.card.select("card_id", "title"), "card_id", "left").select("deck_id", "card_id", "title")


@query("jn_31_list_markers", f"{ADAPTER} SELECT strftime(date_start, '%Y-%m') AS month, restriction_id FROM restriction WHERE date_start BETWEEN '1996-06-01' AND '2000-02-01'")
def list_markers(t):
    """Lists that start in a month of the axis."""
    axis = t.spark.sql("SELECT date_format(d, 'yyyy-MM') AS month FROM (SELECT explode(sequence(DATE'1996-06-01', DATE'2000-02-01', INTERVAL 1 MONTH)) AS d)")
    return t.restriction.select(F.date_format("date_start", "yyyy-MM").alias("month"), "restriction_id").join(axis, "month")


@query("wn_08_ban_periods_of_cards", f"""{ADAPTER}, sp AS (SELECT *, lead(date_start) OVER (ORDER BY date_start) AS nxt FROM restriction), b AS (SELECT v.card_id, sp.* FROM verdict v JOIN sp USING (restriction_id) WHERE v.banned),
i AS (SELECT *, sum(CASE WHEN lag_nxt = date_start THEN 0 ELSE 1 END) OVER (PARTITION BY card_id ORDER BY date_start) AS island FROM (SELECT *, lag(nxt) OVER (PARTITION BY card_id ORDER BY date_start) AS lag_nxt FROM b))
SELECT card_id, greatest(strftime(min(date_start), '%Y-%m'), '1995-03') AS "from", least(coalesce(strftime(max(nxt) - INTERVAL 1 MONTH, '%Y-%m'), '2001-08'), CASE WHEN count(*) > count(nxt) THEN '2001-08' ELSE '9' END, '2001-08') AS "to", list(restriction_id ORDER BY date_start) AS lists FROM i GROUP BY card_id, island""")
def ban_periods_of_cards(t):
    """Months in which a card was banned: lists that follow each other are one period, clipped to the axis."""
    following = F.lead("date_start").over(W.orderBy("date_start"))
    lists = t.restriction.select("restriction_id", "date_start", following.alias("following"))  # some tens of lists
    b = t.ruling.filter("banned").select("card_id", "restriction_id").join(lists, "restriction_id")
    own = W.partitionBy("card_id").orderBy("date_start")
    b = b.withColumn("new", ~F.coalesce(F.lag("following").over(own) == F.col("date_start"), F.lit(False)))
    b = b.withColumn("island", F.sum(F.col("new").cast("int")).over(own))
    to = F.coalesce(F.date_format(F.add_months("following", -1), "yyyy-MM"), F.lit("2001-08"))
    p = b.groupBy("card_id", "island").agg(F.min(F.date_format("date_start", "yyyy-MM")).alias("a"), F.max(to).alias("b"), F.transform(F.array_sort(F.collect_list(F.struct("date_start", "restriction_id"))), lambda x: x["restriction_id"]).alias("lists"))
    return p.select("card_id", F.greatest("a", F.lit("1995-03")).alias("from"), F.least("b", F.lit("2001-08")).alias("to"), "lists")




@query("snk_10_src_21_flt_31_share_links", "SELECT conv_id, turn, coalesce(role, '') AS role, CASE WHEN text IS NULL OR conv_id % 5 = 1 THEN NULL ELSE text END AS text FROM conversations")
def share_links(t):
    """Texts packed into links and read again; every fifth conversation's links are broken."""
    c = t.raw("conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), links.packed(F.col("text")).alias("link"))
    broken = F.when(F.col("conv_id") % 5 == 1, F.regexp_replace("link", r"^gz\.", "zip.")).otherwise(F.col("link"))
    return c.select("conv_id", "turn", "role", links.unpacked(broken).alias("text"))


@query("fs_18_random_ids")
def random_ids(t):
    """Eight characters of 62, seeded; which they are no SQL says, a test checks their form."""
    return t.raw("part").select("p_partkey", F.randstr(8, 7).alias("id"))


@query("src_13_src_15_src_16_listings", f"""{ADAPTER} SELECT tid, CASE WHEN bucket % 4 <> 2 THEN players END AS players, CASE WHEN bucket % 4 <> 2 THEN date END AS date, CASE WHEN bucket % 4 <> 2 THEN bucket % 4 = 1 END AS private, CASE WHEN bucket % 4 = 2 THEN 'not_readable' END AS reason FROM tournament""")
def listings(t):
    """An index in JSON as typed rows; items that don't parse are set apart one by one, the others are kept."""
    item = F.to_json(F.struct("tid", F.col("players").cast("string").alias("players"), F.date_format("date", "yyyy.MM.dd.").alias("date"), (F.col("bucket") % 4 == 1).alias("private")))
    raw = t.tournament.select("tid", F.when(F.col("bucket") % 4 == 2, F.concat(F.lit("["), item)).otherwise(item).alias("raw"))
    r = raw.withColumn("r", F.from_json("raw", "tid string, players string, date string, private boolean, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    fine = F.col("r._bad").isNull()
    return r.select("tid", F.when(fine, text.strict(F.col("r.players"), "int").cast("int")).alias("players"), F.when(fine, dates.strict_date(F.col("r.date"))).alias("date"), F.when(fine, F.col("r.private")).alias("private"), F.when(~fine, "not_readable").alias("reason"))


@query("src_14_exports", f"""{ADAPTER}, rd AS (SELECT tid, o_orderkey, entry_no, (entry_no - 1) // 4 AS place, o_orderkey % 6 = 0 AS flagged, 1 + y % 2 AS prelim FROM numbered), ro AS (SELECT tid, place, prelim, bool_or(flagged) AS flagged FROM rd GROUP BY ALL),
el AS (SELECT *, flagged OR count_if(NOT flagged) OVER (PARTITION BY tid ORDER BY place) - (NOT flagged)::INTEGER >= prelim AS elimination FROM ro), nu AS (SELECT *, count(*) OVER (PARTITION BY tid, elimination ORDER BY place)::INTEGER AS round FROM el)
SELECT tid, elimination::INTEGER + 1 AS stage, round, entry_no AS p1 FROM rd JOIN nu USING (tid, place)""")
def exports(t):
    """Nested exports: an event's rounds are arrays of pairings; which stage a round is of and its number come from the rounds' order."""
    seat = F.struct(F.col("entry_no").alias("p1"), (F.col("o_orderkey") % 6 == 0).alias("eliminationGame"))
    rounds = t._seats.groupBy("tid", "y", F.floor((F.col("entry_no") - 1) / 4).alias("place")).agg(F.collect_list(seat).alias("pairings"))
    docs = rounds.groupBy("tid", "y").agg(F.array_sort(F.collect_list(F.struct("place", "pairings"))).alias("r"))
    docs = docs.select("tid", F.to_json(F.struct((1 + F.col("y") % 2).alias("preliminaryRounds"), F.col("r.pairings").alias("rounds"))).alias("doc"))
    d = docs.select("tid", F.from_json("doc", "preliminaryRounds int, rounds array<array<struct<p1: int, eliminationGame: boolean>>>").alias("d"))
    d = d.select("tid", F.col("d.preliminaryRounds").alias("prelim"), F.posexplode("d.rounds").alias("place", "games"))
    d = d.withColumn("flagged", F.exists("games", lambda g: g["eliminationGame"]))
    n = assembly.numbered_rounds(d.select("tid", "place", "flagged", "prelim"))
    return d.select("tid", "place", F.explode("games").alias("g")).join(n, ["tid", "place"]).select("tid", "stage", "round", F.col("g.p1").alias("p1"))


@query("src_11_catalog_kinds", "SELECT p_partkey, p_partkey % 3 AS k, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS name, CASE p_partkey % 3 WHEN 0 THEN p_size END AS size, CASE p_partkey % 3 WHEN 2 THEN 'card' || p_partkey END AS card FROM part")
def catalog_kinds(t):
    """Items of several kinds in one feed, each read with its kind's own columns."""
    k = F.col("p_partkey") % 3
    body = F.when(k == 0, F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("size")))).when(k == 1, F.to_json(F.struct(F.col("p_name").alias("name")))).otherwise(F.to_json(F.struct(F.concat(F.lit("card"), F.col("p_partkey")).alias("card_id"))))
    feed = t.raw("part").select("p_partkey", k.alias("k"), body.alias("body"))
    read = lambda kind, schema, **columns: feed.filter(F.col("k") == kind).withColumn("r", F.from_json("body", schema)).select("p_partkey", "k", *[F.col(f"r.{v}").alias(n) for n, v in columns.items()])
    cards, sets_, printings = read(0, "title string, size int", name="title", size="size"), read(1, "name string", name="name"), read(2, "card_id string", card="card_id")
    return cards.unionByName(sets_, allowMissingColumns=True).unionByName(printings, allowMissingColumns=True)
