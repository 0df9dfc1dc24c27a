"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log has rows of (conv_id, turn, sub, seq, kind, role, text). ``kind`` is

- ``message``: the text of the message, whatever it held before;
- ``delta``: streamed text that is added to the message;
- ``edit``: like message, and the later messages of the conversation written before it are dropped;
- ``regenerate``: the message starts anew with this text (mostly empty, deltas follow), and later messages are dropped likewise.

Other kinds change nothing. Events apply by seq, those of equal seq by kind, role and text. A message is the last of its own events
that is no delta, and the deltas after it. Null texts and roles are empty. Messages are told apart by (turn, sub) and ordered by it,
null turns first; render() takes another order.

Conversations of more than ``BLOCK`` rows are dealt by blocks of as many turns, so that a very long one is folded by many tasks; of the
blocks before a block, one number is needed, the last event there that drops later messages. The others are folded and rendered whole
where their rows meet, so they are shuffled once. Only the rendered conversation, one string by nature, comes together in one row.

A table of finished messages is formatted through its log: as_events() writes each message as it would have come to be, streamed in two
deltas, edited from a draft, or regenerated, with a later message that the edit or regeneration drops.

The template writes a turn as ``<s>[role]``, a line feed, the text and ``</s>``. Inside texts and roles the control strings ``<s>``,
``</s>``, ``[INST]``, ``[/INST]`` lose their first character to a backslash and a letter, backslashes are written with a letter too, and so
is what would end a role; unescape() gives back every text as it was. The loss mask has a span a turn, relative to its ``<s>``; it
covers the texts of assistants, and is empty elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.common import checkpointed, table
from tabulon.storage import small

BLOCK = 512
DROPS = ("edit", "regenerate")
RESETS = ("message", *DROPS)
EVENT = "conv_id long, turn long, sub long, seq long, kind string, role string, text string"
NULL_TURN = -(1 << 62)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for control in ("<s>", "</s>"):
        text = F.replace(text, F.lit(control), F.lit("\\l" + control[1:]))
    for control in ("[INST]", "[/INST]"):
        text = F.replace(text, F.lit(control), F.lit("\\i" + control[1:]))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit("\\r"))


def unescape(text: Column) -> Column:
    for letter, plain in (("l", "<"), ("i", "["), ("r", "]"), ("b", "\\")):
        text = F.replace(text, F.lit("\\" + letter), F.lit(plain))
    return text


def reconstruct(events: DataFrame, blocks: bool = True) -> DataFrame:
    """(conv_id, block, turn, sub, role, text): the messages that stand at the end of the log. Without ``blocks`` each conversation is
    folded in one task, and rows that are dealt by conv_id are not dealt again."""
    e = events.withColumn("at", F.coalesce("turn", F.lit(NULL_TURN)))
    drops = F.when(F.col("kind").isin(*DROPS), F.col("seq"))
    inner = W.partitionBy("conv_id", "block").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("conv_id", "block", "at", "sub")
    if blocks:
        e = e.withColumn("block", F.floor(F.col("at") / BLOCK))
        cuts = e.groupBy("conv_id", "block").agg(F.max(drops).alias("cut"))
        before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        cuts = cuts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.max("cut").over(before).alias("before")).filter("before is not null")
        e = e.join(cuts, F.expr("conv_id <=> c and block = b"), "left").drop("c", "b").withColumn("dropped", F.greatest("before", F.max(drops).over(inner)))
    else:
        e = e.withColumn("block", F.lit(0).cast("long")).withColumn("dropped", F.max(drops).over(inner))
    order = F.struct("seq", "kind", "role", "text")
    reset = F.when(F.col("kind").isin(*RESETS), order)
    e = e.filter("dropped is null or seq > dropped").withColumn("reset", F.max(reset).over(own))
    e = e.filter(F.col("reset").isNull() | (order >= F.col("reset"))).filter(F.col("kind").isin("delta", *RESETS))
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    folded = e.groupBy("conv_id", "block", "at", "sub").agg(F.first("turn").alias("turn"), parts.alias("parts"))
    return folded.select("conv_id", "block", "turn", "sub", F.element_at("parts", 1)["role"].alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, order: tuple[str, ...] = ("turn", "sub")) -> DataFrame:
    """(conv_id, formatted, mask): the conversation's text, and for each turn the (start, length) that the loss covers, from its ``<s>``."""
    head = F.concat(F.lit("<s>["), escape_role(F.col("role")), F.lit("]\n"))
    m = messages.withColumn("head", head).withColumn("body", escape(F.col("text")))
    span = F.struct(F.length("head").alias("start"), F.when(F.col("role") == "assistant", F.length("body")).otherwise(0).alias("length"))
    m = m.select("conv_id", F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.concat("head", "body", F.lit("</s>")).alias("piece"), span.alias("span")).alias("m"))
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return m.select("conv_id", F.array_join("m.piece", "").alias("formatted"), F.col("m.span").alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted): role and text of each turn and the texts under the mask, from the formatted text and the mask."""
    pieces = F.split("formatted", "</s>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    f = formatted.withColumn("pieces", pieces)
    turn = lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(5)), "]\n", 1)).alias("role"), unescape(F.substr(p, F.locate("]\n", p) + 2)).alias("text"))
    masked = F.filter(F.zip_with("pieces", "mask", lambda p, s: F.when(s["length"] > 0, F.substr(p, s["start"] + 1, s["length"]))), lambda x: x.isNotNull())
    return f.select("conv_id", F.transform("pieces", turn).alias("turns"), unescape(F.array_join(masked, "")).alias("loss"), "formatted")


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of finished messages: each row is a message of its own, told apart by a number, that reads at the end as it reads here.

    By its turn, a message is streamed in two halves; or a draft is edited to its first half and the rest streamed; or a draft is
    regenerated from nothing in two halves. Edits and regenerations drop a message that was already written for the next turn.
    """
    turn, text = F.coalesce("turn", F.lit(NULL_TURN)), F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.substring(text, 1, half), F.substr(text, half + 1)
    event = lambda step, kind, said, role=F.col("role"), at=F.col("turn"), sub=F.col("sub"): F.struct(at.alias("turn"), sub.alias("sub"), (turn.cast("decimal(20,0)") * 8 + step).cast("decimal(24,0)").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), said.alias("text"))
    draft = F.lit("a draft </s>")
    later = event(1, "message", draft, F.lit("assistant"), F.try_add(F.col("turn"), F.lit(1)), F.lit(-1).cast("long"))
    streamed = F.array(event(0, "message", first), event(2, "delta", rest))
    edited = F.array(event(0, "message", draft), later, event(2, "edit", first), event(3, "delta", rest))
    again = F.array(event(0, "message", draft), later, event(2, "regenerate", F.lit("")), event(3, "delta", first), event(4, "delta", rest))
    way = F.pmod("turn", F.lit(3))
    every = F.when(way == 1, edited).when(way == 2, again).otherwise(streamed)
    e = conversations.select("conv_id", "turn", F.monotonically_increasing_id().alias("sub"), "role", "text")
    return e.select("conv_id", F.explode(every).alias("e")).select("conv_id", "e.*").filter("sub >= 0 or turn is not null")


def formatted(conversations: DataFrame) -> DataFrame:
    """render() of finished messages of (conv_id, turn, role, text), those of one turn ordered by role and text."""
    c = conversations.select("conv_id", "turn", "role", "text")
    long = small(checkpointed(c.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK).select("c")))
    same, order = F.expr("conv_id <=> c"), ("turn", "role", "text")
    whole = reconstruct(as_events(c.join(long, same, "left_anti").repartition("conv_id")), blocks=False)
    return render(whole, order).union(render(reconstruct(as_events(c.join(long, same, "left_semi"))), order))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    rows = rows.union(spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)"))
    back = read_back(formatted(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL BY NAME
           SELECT -7::BIGINT AS conv_id, t::BIGINT AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, replace(replace(replace(replace(replace(text, '\', '\b'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\iINST]'), '[/INST]', '\i/INST]') AS body FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length(role) + length(body) + 10)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
