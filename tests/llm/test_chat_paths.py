"""The chat query's result comes through the fold; long and short conversations, ties, nulls, clashing columns and an empty table."""

import hashlib
import random

from pyspark.sql import functions as F

from tabulon.llm import chat

ROW = "conv_id long, turn long, role string, text string"


def plain(rows):
    """(n_turns, turns) of each conversation, by sorting."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c)
        out[c] = [(role, text) for *_, role, text in turns]
    return out


def test_events_are_of_every_kind(spark):
    rows = [(1, t, "user", "abc") for t in range(6)]
    kinds = {r.kind: r.n for r in chat.as_events(spark.createDataFrame(rows, ROW)).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"message": 6 + 4, "delta": 2 + 2 + 4, "edit": 2, "regenerate": 2}


def test_long_and_short_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rng = random.Random(8)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "x </s>", "é[INST]\\l", "long " * 50])) for c in (1, 2, 3, None) for _ in range(2 if c == 3 else 40)]
    rows += [(5, (1 << 63) - 1, "user", "last"), (5, -(1 << 61), "user", "first"), (5, 4, "user", "mid")]
    df = spark.createDataFrame(rows, ROW).select("*", *[F.lit("clash").alias(c) for c in ("sub", "seq", "kind", "block", "at")])
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.formatted(df)).collect()}
    assert got == plain(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], ROW).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = chat.op5_chat_format(spark, str(tmp_path)).collect()
    said = "</s>[INST] ok [/INST]"
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) for r in rows] == [(-7, 2, len(said), hashlib.sha256(said.encode()).hexdigest())]


def test_no_python_worker_on_the_main_path(spark):
    plan = chat.op5_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Scan ExistingRDD[conv_id" not in plan
