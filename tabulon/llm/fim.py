"""Fill-in-middle transformation over run-length encoded character classes.

A text is cut into units at two places and its parts are written in another order between the marks ``<P>``, ``<S>`` and ``<M>``. A unit is a
code point (``code_points``) or a word with the white space before it (``words``, white space at the end goes with the last word).

A cut is a number of units and has to become a place in the UTF-8 text. For this a text is held as its maximal runs of one character class,
with the units and bytes before each run. A binary search in the units finds the run that holds the cut; within a run all units have the same
width, so the byte offset is a multiplication. With code points a class is the number of bytes of a character, so a text of ASCII is one run
and a text of any length costs its number of runs; with words each word is a run of one unit.

A text stays plain if it is empty or holds a mark, or by a draw; else a draw says whether the suffix comes first (``spm``) or the prefix
(``psm``). The marks begin and end with characters of their own and no mark is in the text, so restore() finds each mark where it was
written and gives back the text from output and form alone. Draws and cuts come from a hash of the key, so reruns agree.

Null texts are empty. A null key draws like an empty one; rows with equal keys and texts have equal results. Bytes that are no UTF-8 belong to
the character before them. The columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import short_batches, table

PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
#: Of 100 texts, those that stay plain, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
CUT = "n long, form string, prefix_units long, middle_units long, output binary"
WORD = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


class Runs:
    """Maximal runs of one class: the unit and byte at which each begins, and the bytes of a unit in it. ``n`` units in all."""

    def __init__(self, units: np.ndarray, starts: np.ndarray, widths: np.ndarray, n: int, end: int):
        self.units, self.starts, self.widths, self.n, self.end = units, starts, widths, n, end

    def offset(self, unit: int) -> int:
        """The byte at which a unit begins; that of unit n is the end of the text."""
        if unit >= self.n:
            return self.end
        run = int(np.searchsorted(self.units, unit, side="right")) - 1
        return int(self.starts[run]) + (unit - int(self.units[run])) * int(self.widths[run])


def runs_of_code_points(text: bytes) -> Runs:
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    begins[:1] = True
    first = np.flatnonzero(begins)
    widths = np.diff(first, append=len(text))
    units = np.flatnonzero(np.diff(widths, prepend=0))
    return Runs(units, first[units], widths[units], len(first), len(text))


def runs_of_words(text: bytes) -> Runs:
    ends = np.array([m.end() for m in WORD.finditer(text)] or ([len(text)] if text else []), dtype=np.int64)
    if len(ends):
        ends[-1] = len(text)
    starts = np.r_[0, ends[:-1]][: len(ends)]
    return Runs(np.arange(len(ends)), starts, ends - starts, len(ends), len(text))


RUNS = {"code_points": runs_of_code_points, "words": runs_of_words}


def transformed(text: bytes, draws: tuple[int, int, int, int], runs_of) -> tuple:
    """(n, form, units of the prefix, of the middle, output)."""
    runs = runs_of(text)
    one, two, plain, order = draws
    if not text or any(mark in text for mark in MARKS) or plain % 100 >= 100 - PLAIN:
        return runs.n, "plain", None, None, text
    a, b = sorted((one % (runs.n + 1), two % (runs.n + 1)))
    x, y = runs.offset(a), runs.offset(b)
    head, inner, tail = text[:x], text[x:y], text[y:]
    if order % 100 < SUFFIX_FIRST:
        return runs.n, "spm", a, b - a, b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, inner))
    return runs.n, "psm", a, b - a, b"".join((PREFIX, head, SUFFIX, tail, MIDDLE, inner))


def restored(output: bytes, form: str) -> bytes:
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(two, len(one))
    to = output.index(MIDDLE, at + len(two))
    first, second, middle = output[len(one) : at], output[at + len(two) : to], output[to + len(MIDDLE) :]
    return first + middle + second if form == "psm" else second + middle + first


def draws(key: Column) -> Column:
    """Four unsigned draws of a key, as a struct: the first four groups of 8 digits of the SHA-256 of ``1:`` and the key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.struct(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "code_points") -> DataFrame:
    """docs with a struct ``_fim``: n units, form, prefix_units, middle_units (null if plain), output (UTF-8 bytes)."""
    runs_of = RUNS[unit]
    short_batches(docs.sparkSession)

    @pandas_udf(CUT)
    def cut(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, h in batches:
            rows = [transformed(t or b"", d, runs_of) for t, d in zip(texts, zip(h["h1"], h["h2"], h["h3"], h["h4"], strict=True), strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_units", "middle_units", "output"])
            yield out.astype({"prefix_units": "Int64", "middle_units": "Int64"})

    return docs.withColumn("_fim", cut(F.col(f"`{text}`").cast("binary"), draws(F.col(f"`{key}`"))))


@pandas_udf(T.BinaryType())
def restore(output: pd.Series, form: pd.Series) -> pd.Series:
    """The text again, from output and form."""
    return pd.Series([restored(o, f) for o, f in zip(output, form, strict=True)], dtype=object)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_fim.*")
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore("output", "form"), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substring(text, 1, a) AS head, substring(text, a + 1, b - a) AS inner_, substring(text, b + 1) AS tail FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || inner_
              ELSE '<S>' || tail || '<P>' || head || '<M>' || inner_ END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
