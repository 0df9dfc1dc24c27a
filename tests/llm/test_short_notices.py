"""License templates of fewer words than a shingle, and longer than any limit there was."""

import pytest


def test_short_templates(spark, tmp_path):
    from tabulon.llm import licenses as li

    filler = " ".join(f"w{i}" for i in range(100))
    rows = [(1, f"{filler} All rights reserved."), (2, "all RIGHTS reserved"), (3, "all rights"), (4, f"{filler} rights reserved all {filler}"), (5, f"All rights reserved. {filler}"), (6, f"{filler} Licensed under CC BY 4.0. {filler} all rights -- reserved {filler}"), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = li.op10_license_scan(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(1, "all-rights-reserved"), (2, "all-rights-reserved"), (5, "all-rights-reserved"), (6, "all-rights-reserved"), (6, "cc-by-4.0")]
    for r in found:
        assert r.containment == 1
    of = [("one", "rights"), ("two", "Rights reserved"), ("four", "under CC BY 4"), ("five", "Licensed under CC BY 4")]
    assert sorted((r.doc_id, r.license) for r in li.scan(docs, of).collect()) == sorted([(i, "one") for i in range(1, 7)] + [(i, "two") for i in (1, 2, 4, 5, 6)] + [(6, "four"), (6, "five")])
    with pytest.raises(ValueError):
        li.scan(docs, [("none", " -- ")])


def test_long_templates(spark):
    from tabulon.llm import licenses as li

    long = " ".join(f"x{i}" for i in range(5_600))
    docs = spark.createDataFrame([(1, f"before it {long} after it"), (2, long[: len(long) // 2])], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.containment) for r in li.scan(docs, [("long", long)]).collect()] == [(1, "long", 1)]
