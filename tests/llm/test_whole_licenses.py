"""Whole license texts are found, also cut, edited, tied and in long texts; the query agrees with its SQL on them."""

import duckdb
from pyspark.sql import functions as F

from tabulon.llm import licenses as li

WHOLE = dict(li.WHOLE)


def scanned(spark, rows):
    return {(r.doc_id, r.license): r for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("w", "start", "wide", "n", "own", "h5")])).collect()}


def test_every_whole_text_is_found(spark):
    filler = " ".join(f"w{i}" for i in range(700))
    names = list(WHOLE)
    found = scanned(spark, [(i, f"{filler} Copyright 2020 A. Person {WHOLE[n]} {filler}") for i, n in enumerate(names)])
    for i, n in enumerate(names):
        assert found[i, n].containment == 1, n
        assert found[i, n].first_word <= 704 <= found[i, n].last_word


def test_edited_and_cut_texts(spark):
    """A tenth of the words changed in one place, or the last fifth cut off, still match; half a text doesn't."""
    words = WHOLE["mit"].split()
    n = len(words)
    edited = words[: n // 2] + ["x"] * (n // 10) + words[n // 2 + n // 10 :]
    found = scanned(spark, [(1, " ".join(edited)), (2, " ".join(words[: n * 17 // 20])), (3, " ".join(words[: n // 2]))])
    assert {k for k in found if k[1] == "mit"} == {(1, "mit"), (2, "mit")}
    assert all(0.8 <= found[k, "mit"].containment < 1 for k in (1, 2))


def test_of_equal_windows_the_first_counts(spark):
    """The same license twice, and very far into a text of a million characters."""
    filler = " ".join(f"v{i}" for i in range(1_000))
    text = f"{WHOLE['isc']} {filler} {WHOLE['isc']}"
    far = (filler + " ") * 200 + WHOLE["zlib"]
    found = scanned(spark, [(1, text), (1, text), (None, WHOLE["isc"]), (2, far)])
    assert found[1, "isc"].first_word == 0 and (None, "isc") in found
    assert found[2, "zlib"].last_word >= 200_000


def test_query_agrees_with_its_sql(spark, tmp_path):
    rows = [(i, f"some words {t} and more words") for i, (_, t) in enumerate(li.TEMPLATES)] + [(100, None), (101, ""), (102, "All rights reserved"), (103, "rights reserved all")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(f"select doc_id, license, containment, first_word, last_word from ({li.ORACLE}) q").fetchall()
    got = [(r.doc_id, r.license, r.containment, r.first_word, r.last_word) for r in li.op10_license_scan(spark, str(tmp_path)).collect()]
    assert len(got) >= len(li.TEMPLATES) and sorted(got) == sorted(want)
