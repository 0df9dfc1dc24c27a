"""Strings: strict ids, titles, searching, display forms."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def opt_title(c: Column) -> Column:
    """Control characters to spaces, runs of spaces to one, 120 characters; NULL if nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), " +", " "))
    return F.nullif(F.trim(F.substring(plain, 1, 120)), F.lit(""))


#: The forms of strict ids.
STRICT = {"int": r"^[0-9]{1,9}\z", "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z", "slug": r"^[a-z0-9_]{1,64}\z", "printing": r"^[0-9]{5}\z"}


def strict(c: Column, form: str) -> Column:
    """The text if it has that form as a whole, else NULL."""
    return F.when(c.rlike(STRICT[form]), c)


def in_list(c: Column, values: list[str]) -> Column:
    return F.when(c.isin(*values), c)


def visibility(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.endswith("public"), "public").when(low.endswith("open"), "open").otherwise("private")


def search_score(title: Column, query: str) -> Column:
    """0 for a prefix, 1 for the prefix of a later word, 2 for any other place, NULL if it isn't in the title."""
    t, q = F.lower(title), query.lower()
    return F.when(t.startswith(q), 0).when(F.contains(t, F.lit(f" {q}")), 1).when(F.contains(t, F.lit(q)), 2)


DASH, MINUS = "–", "−"


def _shown(c: Column, text: Column) -> Column:
    return F.when(c.isNull(), DASH).otherwise(text)


def whole_number(c: Column) -> Column:
    return _shown(c, F.format_number(c, 0))


def percent(c: Column, digits: int = 1) -> Column:
    return _shown(c, F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%")))


def signed_points(c: Column, digits: int = 1) -> Column:
    """With a sign; what is zero as shown has ±."""
    size = F.format_string(f"%.{digits}f", F.abs(c))
    sign = F.when(size.cast("double") == 0, "±").when(c > 0, "+").otherwise(MINUS)
    return _shown(c, F.concat(sign, size, F.lit(" pp")))


def times(c: Column) -> Column:
    return _shown(c, F.concat(F.format_string("%.2f", c), F.lit("×")))


def decimals(c: Column, digits: int = 2) -> Column:
    return _shown(c, F.format_string(f"%.{digits}f", c))


#: Display names.
FACTIONS = {"haas_bioroid": "Haas-Bioroid", "jinteki": "Jinteki", "nbn": "NBN", "weyland_consortium": "Weyland", "anarch": "Anarch", "criminal": "Criminal", "shaper": "Shaper", "neutral_corp": "Neutral", "neutral_runner": "Neutral", "adam": "Adam", "apex": "Apex", "sunny_lebeau": "Sunny Lebeau"}
TYPES = {"agenda": "Agenda", "asset": "Asset", "upgrade": "Upgrade", "operation": "Operation", "ice": "Ice", "event": "Event", "hardware": "Hardware", "resource": "Resource", "program": "Program", "corp_identity": "Identity", "runner_identity": "Identity"}


def named(c: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c), other)


def event_format(swiss: Column, cut_size: Column) -> Column:
    """'Single-sided swiss, top 16' and the like; without a Swiss format the cut alone."""
    kind = F.when(swiss == "single_sided", "Single-sided swiss, ").when(swiss == "double_sided", "Double-sided swiss, ")
    cut = F.when(cut_size > 0, F.concat(F.lit("top "), cut_size.cast("string"))).otherwise("no cut")
    return F.coalesce(F.concat(kind, cut), F.when(cut_size > 0, F.concat(F.lit("Top "), cut_size.cast("string"))).otherwise("No cut"))


def csv_cell(c: Column) -> Column:
    """Quoted, with doubled quotes, and an apostrophe before what a spreadsheet would take for a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def _icu(where: str, method: str, c: Column) -> Column:
    """A static method of the ICU classes that Spark brings along for its collations, called in the JVM; NULL for NULL."""
    return F.when(c.isNotNull(), F.reflect(F.lit(f"com.ibm.icu.{where}"), F.lit(method), c, F.lit(True)))


@cache
def _class(rule: Callable[[str], object]) -> str:
    """The characters beyond ASCII that a rule holds for, as the inside of a regex class. Python's tables make it, so that it doesn't depend
    on the JVM's version of Unicode."""
    points = [p for p in range(128, sys.maxunicode + 1) if rule(chr(p))]
    starts = [p for p, before in zip(points, [-1, *points]) if p != before + 1]
    ends = [p for p, after in zip(points, [*points[1:], -1]) if p != after - 1]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))


def _by_script(c: Column, plain: Callable[[Column], Column], full: Callable[[Column], Column]) -> Column:
    """Texts of ASCII alone need no tables."""
    return F.when(c.rlike(r"^\p{ASCII}*\z"), plain(c)).otherwise(full(_icu("text.Normalizer", "decompose", c)))


def fold(c: Column) -> Column:
    """Lower-case without accents (NFKD without U+0300 to U+036F)."""
    return _by_script(c, F.lower, lambda d: F.lower(F.regexp_replace(d, r"[\u0300-\u036f]", "")))


def title_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits without accents; other ASCII is a space, other letters go; single spaces."""

    def words(ascii_: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(ascii_), "[^a-z0-9]+", " "))

    def full(d: Column) -> Column:
        bare = F.regexp_replace(d, f"[{_class(unicodedata.combining)}]", "")
        return words(F.regexp_replace(F.regexp_replace(bare, f"[{_class(str.isalnum)}]", ""), r"\P{ASCII}", " "))

    return _by_script(c, words, full)


def name_key(c: Column) -> Column:
    """Case-folded letters and digits without accents."""
    full = lambda d: F.regexp_replace(_icu("lang.UCharacter", "foldCase", d), f"[^a-z0-9{_class(str.isalnum)}]", "")
    return _by_script(c, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), full)


#: Which words in an event's label make which tier, in the order in which they are tried.
TIER_WORDS = [
    ("online", ["online", "asynchronous", "community", "casual"]),
    ("gnk", ["gnk", "game night", "ctk", "seasonal"]),
    ("megacity", ["circuit breaker", "cbi", "megacity", "national", "continental", "world"]),
    ("store", ["store", "district", "regional", "circuit opener"]),
]


def tier(label: Column) -> Column:
    out, low = F, F.lower(label)
    for name, words in TIER_WORDS:
        for word in words:
            out = out.when(F.contains(low, F.lit(word)), name)
    return out.otherwise("online")


def tier_sql(label: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({label}), '{w}') THEN '{name}'" for name, words in TIER_WORDS for w in words) + " ELSE 'online' END"


#: The paths of published lists and of shared decks, by number or UUID.
_REF = r"([0-9]{1,9}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
DECK_PATHS = {"decklist": "decklist", "deck": "deck/view"}


def deck_link(url: Column, host: str) -> list[Column]:
    """kind and ref of a link to a deck on that host, in any of its languages; both NULL for any other text."""
    kind, ref = F, F
    for name, path in DECK_PATHS.items():
        pattern = rf"^https://(?:www\.)?{re.escape(host)}/[a-z]{{2}}/{path}/{_REF}(?:/[^?#\s]*)?\z"
        kind, ref = kind.when(url.rlike(pattern), name), ref.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))
    return [kind.alias("kind"), ref.alias("ref")]
