"""Trie of conversation prefixes, merged from partial tries, with sums rolled up from the leaves.

A node stands for a distinct sequence of first turns. A turn is known by a digest of its role and text; the key of a node is its depth and, in
two lanes of 64 bits, the exclusive or of its turns' digests, each hashed with its place. So the key of a turn's parent is its own without its
last turn, keys are running sums over a conversation, and a conversation of any length is keyed by many tasks.

A partial trie is a table of nodes (key, the parent's key, code points of the last turn, members, smallest member) and a table of end lists: the
ids of members that end at a node, in pieces of ascending ids. ``partial()`` makes it: each map task combines the rows of its nodes, a merge by
key brings those of one node together; ends are dealt by ranges of (key, id), so that each range gives pieces of each list. ``merge()`` sums
the nodes of any number of partial tries by key and makes pieces of their lists together. ``rollup()`` makes the sums of subtrees.

The roll-up goes up by doubled steps: after round k each node holds the sums over the nodes up to 2^k - 1 levels below it, and the key of its
ancestor 2^k levels above, to which these sums are added in the next round. So a trie of depth d takes log2(d) rounds on narrow rows. The root,
an ancestor of all, is summed apart. Sums are made before they are shuffled, so a node of very many children is no task of its own.

The digest of an end list is made of its pieces in order by one reader, which holds one piece at a time.

Turns are ordered by turn (null first), then role, then a digest of role and text; rows alike in all of them are interchangeable. Null roles and
texts are empty. Rows without a conv_id belong to no conversation. A table without conversations has no trie, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.common import checkpointed, table

KEY = ["depth", "x", "y"]
NODE = "depth long, x long, y long, px long, py long, chars long, n_convs long, conv_id long"
#: Ids in one piece of an end list.
PIECE = 20_000


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, chars): narrow rows; texts go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(said.cast("binary"))).alias("digest"), F.length(text).cast("long").alias("chars"))


def carried(dealt: DataFrame, merged, **totals: Column) -> DataFrame:
    """(conv_id, _range, before_<name>..., goes_on): for conversations in several ranges, their totals over the ranges before, and whether
    they go on after this one. Such a conversation begins or ends a range, so there are at most two rows a range: a bound for broadcasts."""
    edges = dealt.groupBy("_range").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    edges = edges.select(F.explode(F.array("lo", "hi")).alias("conv_id"))
    sums = dealt.join(F.broadcast(edges.distinct()), "conv_id").groupBy("conv_id", "_range").agg(*[merged(c).alias(n) for n, c in totals.items()])
    order = W.partitionBy("conv_id").orderBy("_range")
    before = [merged(n).over(order.rowsBetween(W.unboundedPreceding, -1)).alias(f"before_{n}") for n in totals]
    return F.broadcast(checkpointed(sums.select("conv_id", "_range", *before, F.lead("_range").over(order).isNotNull().alias("goes_on"))))


def numbered(rows: DataFrame) -> DataFrame:
    """turns() with the place ``i`` of a turn in its conversation, from 1, and whether it is its ``last``. Rows are dealt by ranges, so that a
    conversation of any length is numbered by many tasks; alike rows too are dealt apart."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = checkpointed(rows.repartitionByRange("conv_id", "turn", "role", "digest", "_row").withColumn("_range", F.spark_partition_id()))
    order = W.partitionBy("_range", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest", "_row")
    ranked = dealt.withColumn("n", F.row_number().over(order)).withColumn("end", F.lead(F.lit(1)).over(order).isNull())
    ranked = ranked.join(carried(dealt, F.sum, n=F.lit(1)), ["conv_id", "_range"], "left")
    i, last = F.coalesce("before_n", F.lit(0)) + F.col("n"), F.col("end") & ~F.coalesce("goes_on", F.lit(False))
    return checkpointed(ranked.select("conv_id", "_range", i.cast("long").alias("i"), last.alias("last"), "digest", "chars"))


def lane(seed: str, place: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(seed), place.cast("long"), digest)


def keyed(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, _range, depth, digest, chars, last, bx, by), with the key of their node and of its parent: the running exclusive or
    of their lanes over the conversation, on top of (bx, by), the key of what stands before its first row here."""
    lanes = checkpointed(rows.select("*", *[lane(c, F.col("depth"), F.col("digest")).alias(f"l{c}") for c in "xy"]))
    order = W.partitionBy("_range", "conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lanes.select("*", *[F.bit_xor(f"l{c}").over(order).alias(f"r{c}") for c in "xy"])
    rows = rows.join(carried(lanes, F.bit_xor, x=F.col("lx"), y=F.col("ly")), ["conv_id", "_range"], "left")
    for c in "xy":
        rows = rows.withColumn(c, F.col(f"r{c}").bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))).bitwiseXOR(F.col(f"b{c}")))
        rows = rows.withColumn(f"p{c}", F.col(c).bitwiseXOR(F.col(f"l{c}")))
    return rows.select("conv_id", *KEY, "px", "py", "chars", "last")


def pieces(ends: DataFrame) -> DataFrame:
    """(key, ids): end lists in pieces of ascending ids, from rows of (key, conv_id)."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            groups = frame.groupby(KEY, sort=False)["conv_id"]
            yield pd.DataFrame([(*key, part[at : at + PIECE]) for key, ids in groups for part in [ids.to_numpy()] for at in range(0, len(part), PIECE)], columns=[*KEY, "ids"])

    dealt = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    return checkpointed(dealt.mapInPandas(cut, "depth long, x long, y long, ids array<long>"))


def combined(nodes: DataFrame) -> DataFrame:
    """One row a key: combined in each map task, then where the rows of a key meet."""
    return nodes.groupBy(*KEY).agg(*[F.min(c).alias(c) for c in ("px", "py", "chars")], F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def partial(rows: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, end lists) of keyed() rows and of all members, (conv_id, empty): those without a turn end at the root."""
    rows = checkpointed(rows)
    nothing = [F.lit(0).cast("long").alias(c) for c in KEY]
    one = rows.select(*KEY, "px", "py", "chars", F.lit(1).cast("long").alias("n_convs"), "conv_id")
    root = members.select(*nothing, *[F.lit(None).cast("long").alias(c) for c in ("px", "py")], nothing[0].alias("chars"), F.lit(1).cast("long").alias("n_convs"), "conv_id")
    ends = rows.filter("last").select(*KEY, "conv_id").union(members.filter("empty").select(*nothing, "conv_id"))
    return checkpointed(combined(one.union(root))), pieces(checkpointed(ends))


def merge(tries: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The trie of the conversations of all tries; each conversation is in one of them."""
    nodes, ends = (reduce(DataFrame.unionByName, part) for part in zip(*tries, strict=True))
    return checkpointed(combined(nodes)), pieces(ends.select(*KEY, F.explode("ids").alias("conv_id")))


def digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the comma-joined ids of each list."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for frame in frames:
            done = []
            for *key, ids in frame.itertuples(index=False):
                if key != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ids)).encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if now:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    dealt = ends.withColumn("first", F.element_at("ids", 1)).repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids")
    return dealt.mapInPandas(read, "depth long, x long, y long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(key, values): each value summed over the subtree of every node but the root."""
    state = nodes.filter("depth > 0").select(*KEY, *[F.when(F.col("depth") > 1, F.col(c)).alias(a) for c, a in (("px", "ax"), ("py", "ay"))], *values)
    state = checkpointed(state)
    deepest = state.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step < deepest:
        above = [(F.col("depth") - step).alias("depth"), F.col("ax").alias("x"), F.col("ay").alias("y")]
        gifts = state.filter("ax is not null").groupBy(*above).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        ancestors = state.filter("ax is not null").select((F.col("depth") + step).alias("low"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ax").alias("next_x"), F.col("ay").alias("next_y"))
        summed = state.join(gifts, KEY, "left").withColumn("low", F.col("depth"))
        summed = summed.select(*KEY, "low", "ax", "ay", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        # nodes without an ancestor so far up are done
        high = summed.filter("ax is null").select(*KEY, "ax", "ay", *values)
        deep = summed.filter("ax is not null").join(ancestors, ["low", "ax", "ay"], "left").select(*KEY, F.col("next_x").alias("ax"), F.col("next_y").alias("ay"), *values)
        state = checkpointed(high.union(deep))
        step *= 2
    return state.select(*KEY, *values)


def rollup(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """A row a node: key, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parents = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    nodes = nodes.join(parents.agg(F.count("*").alias("n_children")), KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = checkpointed(nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")))
    top, low = nodes.filter("depth = 0"), nodes.filter("depth > 0")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    # all children of the root have one key: they meet its row by broadcast
    first = low.filter("depth = 1").join(F.broadcast(above.filter("depth = 1")), ["depth", "px", "py"])
    deep = low.filter("depth > 1").join(above.filter("depth > 1"), ["depth", "px", "py"])
    columns = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
    below = first.union(deep).drop("n_leaves", "saved_tokens").join(sums, KEY).select(columns)
    whole = low.agg(F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    whole = whole.select(*[F.lit(0).cast("long").alias(c) for c in KEY], "*")
    root = top.drop("n_leaves", "saved_tokens").join(F.broadcast(whole), KEY).withColumn("parent_conv_id", F.lit(None).cast("long"))
    every = below.union(root.select(columns))
    return every.join(digests(ends), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def trie(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The partial trie of turns() as they stand."""
    n = numbered(rows)
    own = n.select("conv_id", "_range", F.col("i").alias("depth"), "digest", "chars", "last", *[F.lit(0).cast("long").alias(b) for b in ("bx", "by")])
    return partial(keyed(own), n.filter("i = 1").select("conv_id", F.lit(False).alias("empty")))


def grafted(rows: DataFrame, most: int = 5, share: int = 100) -> tuple[DataFrame, DataFrame]:
    """The partial trie of turns() in which each conversation c begins with the first h turns of conversation c - c % share (all if fewer, none
    if there is no such conversation), and goes on with its own after its first h; h is the CRC-32 of c in decimals modulo most + 1. The
    remainder has the sign of c."""
    n = numbered(rows)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    stem = F.col("conv_id") - F.col("conv_id") % share
    stems = n.filter((F.col("conv_id") % share == 0) & (F.col("i") <= most)).groupBy(F.col("conv_id").alias("stem"))
    stems = stems.agg(F.array_sort(F.collect_list(F.struct("i", "digest", "chars"))).alias("turns"))
    heads = n.groupBy("conv_id").agg(F.max("i").alias("n")).withColumn("h", h).withColumn("stem", stem).join(stems, "stem", "left")
    heads = heads.withColumn("turns", F.slice(F.coalesce("turns", F.array()), 1, F.col("h").cast("int"))).withColumn("m", F.size("turns").cast("long"))
    key = lambda c, d: F.aggregate(F.slice("turns", 1, d), F.lit(0).cast("long"), lambda k, t: k.bitwiseXOR(lane(c, t["i"], t["digest"])))
    heads = checkpointed(heads.select("conv_id", "n", "h", "m", "turns", *[key(c, F.size("turns")).alias(f"b{c}") for c in "xy"]))
    given = heads.select("*", F.explode("turns").alias("t")).withColumn("depth", F.col("t.i"))
    given = given.select("conv_id", "depth", *[key(c, F.col("depth").cast("int")).alias(c) for c in "xy"], *[key(c, F.col("depth").cast("int") - 1).alias(f"p{c}") for c in "xy"], F.col("t.chars").alias("chars"), ((F.col("depth") == F.col("m")) & (F.col("n") <= F.col("h"))).alias("last"))
    own = n.filter(F.col("i") > h).join(heads.select("conv_id", "m", "bx", "by"), "conv_id")
    own = own.select("conv_id", "_range", (F.col("i") - h + F.col("m")).alias("depth"), "digest", "chars", "last", "bx", "by")
    members = heads.select("conv_id", ((F.col("m") == 0) & (F.col("n") <= F.col("h"))).alias("empty"))
    return partial(keyed(own).union(given), members)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = rollup(*grafted(turns(table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# crc32 by its table of 256 remainders; a prefix is the text of its turns, each preceded by its length
ORACLE = """
WITH polynomial AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)::BIGINT[]),
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role)::VARCHAR || ':' || role || text)) AS i FROM c),
v AS (SELECT k.conv_id, k.conv_id - k.conv_id % 100 AS stem, xor(list_reduce(list_concat([4294967295::BIGINT],
             list_transform(regexp_extract_all(hex(k.conv_id::VARCHAR), '..'), lambda d: ('0x' || d)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM c) k, polynomial),
r AS (SELECT v.conv_id, 0 AS part, o.i, o.role, o.text FROM v JOIN o ON o.conv_id = v.stem AND o.i <= v.h
      UNION ALL SELECT v.conv_id, 1, o.i, o.role, o.text FROM v JOIN o ON o.conv_id = v.conv_id AND o.i > v.h),
p AS (SELECT *, row_number() OVER w AS depth, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS prefix
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
q AS (SELECT conv_id, depth, prefix, coalesce(lag(prefix) OVER w, '') AS parent, length(text) AS chars, lead(1) OVER w IS NULL AS last FROM p
      WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
      UNION ALL SELECT conv_id, 0, '', NULL, 0, conv_id NOT IN (SELECT conv_id FROM r) FROM v),
n AS (SELECT depth, prefix, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM q GROUP BY depth, prefix),
k AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, prefix)),
a AS (SELECT q.depth, q.prefix, sum(x.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves
      FROM f x JOIN q z ON z.conv_id = x.conv_id AND z.depth = x.depth JOIN q ON q.conv_id = x.conv_id AND q.depth <= x.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, f.ends_sha256
FROM f JOIN a USING (depth, prefix) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.prefix = f.parent
"""
