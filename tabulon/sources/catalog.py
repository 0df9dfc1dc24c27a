"""The catalog: a feed of items of six kinds read as typed tables, named references, and the look-ups made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import dates
from tabulon.functions.text import title_key
from tabulon.operators.ranking import ranked

#: The fields of each kind of item, as the sources name them; text unless TYPES says otherwise, as numbers and flags may come as text.
FIELDS = {
    "cards": "id title stripped_title side_id card_type_id faction_id influence_cost influence_limit minimum_deck_size deck_limit agenda_points is_unique card_pool_ids printing_ids",
    "printings": "id card_id card_set_id date_release",
    "card_sets": "id name date_release card_cycle_id",
    "formats": "id name active_snapshot_id snapshot_ids restriction_ids",
    "restrictions": "id name date_start format_id point_limit verdicts",
    "snapshots": "id format_id card_pool_id restriction_id date_start active",
}
LISTS = ["card_pool_ids", "printing_ids", "snapshot_ids", "restriction_ids"]
TYPES = dict.fromkeys(LISTS, "array<string>") | {"verdicts": "struct<banned: array<string>, restricted: array<string>, universal_faction_cost: map<string, int>, global_penalty: array<string>, points: map<string, int>>"}
NUMBERS = ["influence_cost", "influence_limit", "minimum_deck_size", "deck_limit", "agenda_points", "point_limit"]
FLAGS = ["is_unique", "active"]
DATES = ["date_release", "date_start"]
REFERENCE = "id string, name string, play_format_id string, date_start string"
DATED = "deckbuilding_restrictions"
STANDARD = "standard"


def _typed(name: str) -> Column:
    c = F.col(f"r.{name}")
    if name == "title":
        return F.substring(F.coalesce(F.nullif(c, F.lit("")), F.nullif("r.stripped_title", F.lit("")), "r.id"), 1, 120)
    if name == "name":
        return F.substring(F.coalesce(c, F.lit("")), 1, 80)
    if name in NUMBERS:
        return c.try_cast("int")
    if name in FLAGS:
        return F.coalesce(c.try_cast("boolean"), F.lit(False))
    if name in DATES:
        return dates.strict_date(c)
    if name in LISTS:
        return F.coalesce(c, F.array().cast("array<string>"))
    return c


def _read(feed: DataFrame, kind: str) -> DataFrame:
    schema = ", ".join(f"{n} {TYPES.get(n, 'string')}" for n in FIELDS[kind].split())
    return feed.filter(F.col("kind") == kind).withColumn("r", F.from_json("item", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))


def _good(kind: str) -> Column:
    needed = F.col("r.id").isNotNull() & (F.col("r.card_id").isNotNull() if kind == "printings" else F.lit(True))
    return F.coalesce(F.col("r._bad").isNull() & needed, F.lit(False))


def rows(feed: DataFrame, kind: str) -> DataFrame:
    """The items of one kind as a typed table of its own columns. feed: (kind, item: JSON). Items that refused() tells are left out."""
    names = [n for n in FIELDS[kind].split() if n != "stripped_title"]
    return _read(feed, kind).filter(_good(kind)).select(*[_typed(n).alias(n) for n in names])


def refused(feed: DataFrame) -> DataFrame:
    """(kind, reason, payload_hash) of items that aren't JSON objects, lack an id (a printing: its card), or are of no known kind."""
    tell = lambda df, reason: df.select("kind", reason.alias("reason"), F.sha2("item", 256).alias("payload_hash"))
    out = tell(feed.filter(F.col("kind").isNull() | ~F.col("kind").isin(*FIELDS)), F.lit("unknown_kind"))
    for kind in FIELDS:
        unread = F.col("r._bad").isNotNull() | F.col("item").isNull()
        out = out.unionByName(tell(_read(feed, kind).filter(~_good(kind)), F.when(unread, "not_readable").otherwise("incomplete")))
    return out


def unknown_fields(feed: DataFrame) -> DataFrame:
    """(kind, field), each once: fields of items that the kind doesn't name."""
    known = F.create_map(*[x for kind in FIELDS for x in (F.lit(kind), F.array(*map(F.lit, FIELDS[kind].split())))])
    strange = F.array_except(F.json_object_keys("item"), known[F.col("kind")])
    return feed.select("kind", F.explode(strange).alias("field")).distinct()


def references(feed: DataFrame) -> DataFrame:
    """(kind, id, name, extra) of another registry's lists of formats, types and ban lists; what is extra is a ban list's format and start."""
    r = feed.withColumn("r", F.from_json("item", REFERENCE)).filter("r.id is not null")
    extra = F.concat_ws("|", F.coalesce("r.play_format_id", F.lit("")), F.coalesce("r.date_start", F.lit("")))
    return r.select("kind", F.substring("r.id", 1, 80).alias("id"), F.substring(F.coalesce("r.name", F.lit("")), 1, 120).alias("name"), F.when(F.col("kind") == DATED, extra).alias("extra"))


def printing_cards(printings: DataFrame, cards: DataFrame) -> DataFrame:
    """(printing_id, card_id): a printing's own card; a printing that has no item goes to the first card, by id, that lists it."""
    own = printings.select(F.col("id").alias("printing_id"), "card_id", F.lit(0).alias("rank"))
    listed = cards.select(F.explode("printing_ids").alias("printing_id"), F.col("id").alias("card_id"), F.lit(1).alias("rank"))
    return own.unionByName(listed).groupBy("printing_id").agg(F.min(F.struct("rank", "card_id"))["card_id"].alias("card_id"))


def title_cards(cards: DataFrame) -> DataFrame:
    """(key, identity, card_id) by title_key(): the first identity of that title, and the card if it is the only one."""
    is_identity = F.col("card_type_id").endswith("identity")
    by = cards.select(title_key(F.col("title")).alias("key"), "id", "card_type_id").groupBy("key")
    first, last = F.min("id"), F.max("id")
    return by.agg(F.min(F.when(is_identity, F.col("id"))).alias("identity"), F.when(first == last, first).alias("card_id"))


def ordered_snapshots(snapshots: DataFrame, format_id: str = STANDARD) -> DataFrame:
    """The dated snapshots of a format with their place, by start and id."""
    return ranked(snapshots.filter((F.col("format_id") == format_id) & F.col("date_start").isNotNull()), ["format_id"], [F.asc("date_start"), F.asc("id")], "place")
