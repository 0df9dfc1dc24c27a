"""Keys of titles and names against Python's own Unicode tables, on all characters."""

import random
import sys
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabulon.functions import text


def bare(t, keep=lambda c: not unicodedata.combining(c)):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if keep(c))


def plain_fold(t):
    return bare(t, lambda c: not "̀" <= c <= "ͯ").lower()


def plain_title_key(t):
    kept = "".join(c if c.isascii() else "" if c.isalnum() else " " for c in bare(t)).lower()
    return " ".join("".join(c if c.isalnum() else " " for c in kept).split())


def plain_name_key(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t).casefold() if c.isalnum() and not unicodedata.combining(c))


@pytest.fixture(scope="module")
def texts():
    known = [chr(p) for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co")]
    r = random.Random(5)
    marked = [c for c in known if unicodedata.combining(c)]
    mixed = ["".join(r.choice(r.choice([known, marked, "aZ 9-ΣσİßéÉ"])) for _ in range(r.randint(1, 9))) for _ in range(100_000)]
    return [*known, *mixed, "", "  A--b  ", "O’Brian & O'Brian", "ΟΔΟΣ ΣΑΣ"]


def test_all_characters(spark, tmp_path, texts):
    pq.write_table(pa.table({"i": range(len(texts)), "t": texts}), tmp_path / "t.parquet")
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    got = df.select("i", text.fold(F.col("t")).alias("a"), text.title_key(F.col("t")).alias("b"), text.name_key(F.col("t")).alias("c")).toPandas().set_index("i").sort_index()
    for column, f in (("a", plain_fold), ("b", plain_title_key), ("c", plain_name_key)):
        wrong = [(t, g, f(t)) for t, g in zip(texts, got[column]) if g != f(t)]
        assert not wrong, (len(wrong), wrong[:5])


def test_no_python_worker(spark):
    df = spark.createDataFrame([(None,)], "t string").select(text.fold(F.col("t")), text.title_key(F.col("t")), text.name_key(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and tuple(df.first()) == (None, None, None)
