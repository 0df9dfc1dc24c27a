"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits, ASCII letters lower-cased. A template of L words is looked for in windows of 2 L words that start
every max(1, L // 2) words, so that each stretch of up to 3/2 L words lies whole in a window. Texts and templates are compared by their
five-word shingles; a shorter template is one shingle of all its words, looked for among the texts' shingles of as many words.

Each of ``BANDS`` bands has one row: the least of the shingles' hashes by that band's hash function. A window that holds the share c of a
template's n shingles has a Jaccard similarity of at least J = c n / (2 n + 4 + n (1 - c)), so some band agrees with probability
1 - (1 - J) ** BANDS: for c = 0.8 at least 0.999 for one shingle (J >= 0.13) and more for longer templates (J towards 0.36). Windows of a
shorter template have at most L + 1 shingles, so J >= 0.2.
A window whose shingles include no template's least in any band cannot agree in a band, so signatures are made for the windows around
such shingles only. Retrieved pairs match where the window holds at least ``CONTAINMENT`` of the template's distinct shingles.

A row of the result is a document and a license found in it, with the best window (the earliest of equally good ones). Null texts hold
nothing. Rows of equal doc_id are scanned alike and reported once. All of it is DataFrame functions; templates are a bounded table, each
of any length.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import checkpointed, table
from tabulon.llm.license_texts import HEADERS, NOTICES, WHOLE

SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8
#: The most templates and the most words of all of them together: their tables are held by each task.
MOST_TEMPLATES, MOST_WORDS = 2_000, 10_000_000
#: Templates of up to so many words in all, some 50 MB of shingles, are broadcast; others are joined by Spark's own choice.
BROADCAST_WORDS = 1_000_000

#: Whole licenses, file headers and notices of a line, the shortest of three words.
TEMPLATES = WHOLE + HEADERS + NOTICES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """array<string>; without words, one empty string."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+", " ")), " ")


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """array<string> of shingles of that many words, repeats included."""
    last = F.size(w) - size
    return F.transform(F.filter(w, lambda x, i: i <= last), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, size)]))


def hashes(w: Column, size: int = SHINGLE) -> Column:
    """array<long>: a hash of the words at each place where a shingle starts, then nulls."""
    return F.transform(w, lambda x, i: F.when(F.get(w, i + size - 1).isNotNull(), F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)])))


def by_size(wide: Column, sizes: list[int], value: Callable[[int], Column]) -> Column:
    """value(size of the shingles of templates of ``wide`` words)."""
    return F.coalesce(*[F.when(F.least(wide, F.lit(SHINGLE)) == k, value(k)) for k in sizes])


def signature(h: Column) -> Column:
    """array<struct<band, least>> of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(h, lambda x: F.xxhash64(x, b))).alias("least")))


def once(value: Column) -> Column:
    """The value as a generated column: Spark then computes it once a row, and never inside the expressions and filters that use it."""
    return F.explode(F.array(value))


def window_starts(places: Column, wide: int) -> Column:
    """array<int>: the starts of the windows, for templates of that many words, that hold a shingle at one of the places."""
    step, size, shingle = max(1, wide // 2), 2 * wide, min(wide, SHINGLE)

    def near(i: Column) -> Column:
        return F.transform(F.sequence(F.ceil(F.greatest(i + shingle - size, F.lit(0)) / step), F.floor(i / step)), lambda k: (k * step).cast("int"))

    return F.array_distinct(F.flatten(F.transform(places, near)))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, wide, n, own, signature, first), a row a template."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates: scan with a part of them at a time")
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)])
    t = spark.sql("SELECT 1").select(F.inline(rows)).select("template", "license", once(words(F.col("text"))).alias("w"))
    sizes = list(range(1, SHINGLE + 1))
    h = F.filter(by_size(F.col("wide"), sizes, lambda k: hashes(F.col("w"), k)), lambda x: x.isNotNull())
    t = t.select("template", "license", F.when(F.get("w", F.lit(0)) != "", F.size("w")).otherwise(0).alias("wide"), "w")
    t = t.select("template", "license", "wide", once(F.array_distinct(by_size(F.col("wide"), sizes, lambda k: shingles(F.col("w"), k)))).alias("own"), "w").select("*", once(F.array_distinct(h)).alias("h"))
    # the hash of the least shingle of each band, by which windows are found
    first = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform("h", lambda x: F.struct(F.xxhash64(x, b).alias("v"), x.alias("x"))))["x"])
    return checkpointed(t.select("template", "license", "wide", F.size("own").alias("n"), "own", signature(F.col("h")).alias("signature"), F.array_distinct(first).alias("first")))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word, last_word)."""
    spark = docs.sparkSession
    t = template_table(spark, templates)
    # the driver gets numbers bounded by the templates and bands
    first: dict[int, set[int]] = {}
    total = 0
    for r in t.select("license", "wide", "first").collect():
        if not r["wide"]:
            raise ValueError(f"{r['license']} has no words")
        total += r["wide"]
        first.setdefault(r["wide"], set()).update(r["first"])
    if total > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words of templates: scan with a part of them at a time")
    sizes = sorted({min(wide, SHINGLE) for wide in first})
    # looked up by hash: Spark turns a long list of literals into a set
    known = {k: sorted(set().union(*[x for wide, x in first.items() if min(wide, SHINGLE) == k])) for k in sizes}
    d = docs.select(F.col(key).alias("doc_id"), once(words(F.col(text))).alias("w")).filter(F.size("w") >= sizes[0])
    for k in sizes:
        d = d.select("*", once(hashes(F.col("w"), k)).alias(f"h{k}"))
    one_of = lambda values: lambda x: x.isin(values)
    d = d.filter(reduce(or_, [F.exists(f"h{k}", one_of(known[k])) for k in sizes]))

    def hit(k: int) -> Column:
        return F.filter(F.transform(f"h{k}", lambda x, i: F.when(x.isin(known[k]), F.struct(i.alias("i"), x.alias("x")))), lambda i: i.isNotNull())

    for k in sizes:
        d = d.select("*", once(hit(k)).alias(f"hit{k}"))

    def windows_of(wide: int) -> Column:
        places = F.transform(F.filter(f"hit{min(wide, SHINGLE)}", lambda p: p["x"].isin(sorted(first[wide]))), lambda p: p["i"])
        return F.transform(window_starts(places, wide), lambda s: F.struct(F.lit(wide).alias("wide"), s.alias("start"), F.slice("w", s + 1, 2 * wide).alias("w")))

    d = d.select("doc_id", F.explode(F.concat(*map(windows_of, sorted(first)))).alias("at")).select("doc_id", "at.wide", "at.start", "at.w")
    d = d.select("doc_id", "wide", "start", "w", once(F.array_distinct(by_size(F.col("wide"), sizes, lambda k: shingles(F.col("w"), k)))).alias("shingles"))
    d = d.select("doc_id", "wide", "start", "shingles", once(F.filter(by_size(F.col("wide"), sizes, lambda k: hashes(F.col("w"), k)), lambda x: x.isNotNull())).alias("h"))
    d = d.select("doc_id", "start", "shingles", "wide", once(signature(F.col("h"))).alias("found"))
    bands = d.select("*", F.explode("found").alias("s")).select("doc_id", "start", "shingles", "wide", "found", "s.*")
    # bounded: BANDS numbers a template, of at most MOST_TEMPLATES
    keys = t.select("template", "wide", F.explode("signature").alias("s")).select("template", "wide", "s.*")
    whole = t.select("template", "license", "n", "own", "signature")
    agree = F.zip_with("found", "signature", lambda a, b: a["least"] == b["least"])
    held = bands.join(F.broadcast(keys), ["wide", "band", "least"]).join(F.broadcast(whole) if total <= BROADCAST_WORDS else whole, "template")
    # a window and a template that agree in several bands are verified at the first of them
    held = held.filter(F.array_position(agree, True) == F.col("band") + 1).withColumn("containment", F.size(F.array_intersect("shingles", "own")) / F.col("n"))
    best = F.struct(F.col("containment"), (-F.col("start")).alias("start"), "wide")
    found = held.filter(F.col("containment") >= containment).groupBy("doc_id", "license").agg(F.max(best).alias("m"))
    return found.select("doc_id", "license", F.col("m.containment").alias("containment"), (-F.col("m.start")).cast("long").alias("first_word"), (2 * F.col("m.wide") - F.col("m.start") - 1).cast("long").alias("last_word"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), TEMPLATES)


_WORDS = r"""string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"""
_SIZES = sorted({min(SHINGLE, len(re.findall(r"\w+", text))) for _, text in TEMPLATES})

ORACLE = (
    "WITH t0(license, text) AS (VALUES "
    + ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in TEMPLATES)
    + f"""),
t1 AS (SELECT license, {_WORDS} AS w FROM t0),
t2 AS (SELECT license, w, len(w) AS wide, least({SHINGLE}, len(w)) AS k FROM t1),
t AS (SELECT license, wide, k, list_distinct(list_transform(range(1, wide - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS own FROM t2),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS ("""
    + " UNION ALL ".join(f"SELECT doc_id, {k} AS k, i - 1 AS place, array_to_string(w[i:i + {k - 1}], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d)" for k in _SIZES)
    + """),
x AS (SELECT license, wide, k, greatest(1, wide // 2) AS step, len(own) AS n, unnest(own) AS shingle FROM t),
hit AS (SELECT doc_id, license, wide, k, step, n, shingle, place FROM s JOIN x USING (k, shingle)),
win AS (SELECT DISTINCT doc_id, license, wide, n, shingle, j * step AS start
        FROM (SELECT *, unnest(range(ceil(greatest(place + k - 2 * wide, 0) / step)::BIGINT, place // step + 1)) AS j FROM hit)),
held AS (SELECT doc_id, license, wide, start, count(*)::DOUBLE / n AS containment FROM win GROUP BY doc_id, license, wide, n, start),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start) AS r FROM held WHERE containment >= 0.8)
SELECT doc_id, license, containment, start::BIGINT AS first_word, (start + 2 * wide - 1)::BIGINT AS last_word FROM best WHERE r = 1
"""
)
