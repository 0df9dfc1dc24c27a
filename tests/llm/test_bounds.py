"""What comes to the driver has a bound that is checked; extra columns with clashing names and rows without an id are kept."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, n=12):
    return spark.createDataFrame([(i, f"some words of text {i}", f"l{i}", f"s{i}", 20) for i in range(n)], DOCS)


def test_labels_are_bounded(spark, monkeypatch):
    from tabulon.llm import langid

    monkeypatch.setattr(langid, "MOST_LABELS", 5)
    with pytest.raises(ValueError, match="labels"):
        langid.fit(docs(spark))


def test_sources_are_bounded(spark, monkeypatch):
    from tabulon.llm import mixing

    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    with pytest.raises(ValueError, match="sources"):
        mixing.rates(mixing.measured(docs(spark)).select("_row.*"), mixing.three_one_two)


@pytest.mark.parametrize("op", ["bpe.op3_byte_bpe", "token_counts.op7_token_counts", "simhash.op9_simhash", "mixing.op2_mixing", "sharding.op6_sharding", "licenses.op10_license_scan"])
def test_clashing_columns_change_nothing(spark, tmp_path, op):
    import importlib

    module, name = op.split(".")
    run = getattr(importlib.import_module(f"tabulon.llm.{module}"), name)
    rows = docs(spark).union(spark.createDataFrame([(None, "All rights reserved.", None, None, None), (3, "All rights reserved.", "l1", "s1", 1), (3, "All rights reserved.", "l1", "s1", 1)], DOCS))
    more = rows.select("*", *[F.lit("own").alias(c) for c in ("fp", "size", "place", "n_tokens", "b", "slot", "shard", "row", "w", "license", "ids", "key", "node", "root", "taken", "edited")])
    for folder, df in (("plain", rows), ("more", more)):
        df.coalesce(1).write.parquet(str(tmp_path / folder / "documents.parquet"))
    plain, clash = (sorted(map(repr, run(spark, str(tmp_path / f)).collect())) for f in ("plain", "more"))
    assert plain == clash and plain
