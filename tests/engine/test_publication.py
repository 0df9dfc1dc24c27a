"""Addresses and what they read, the form of numbers, and versions whose writers stop anywhere or meet."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabulon.sources import addresses, sinks

MANIFEST = {"restrictions": [{"id": "all"}, {"id": "b_1"}], "tier_groups": [{"id": "all"}, {"id": "t1"}], "months": ["2025-03", "2025-12", "2026-02"], "period_months": 3, "paths": addresses.PATHS, "base_path": "v=7/"}


@pytest.mark.parametrize(
    ("address", "want"),
    [
        (None, ("all", "all", "2025-12", "2026-02", "corp", False, False, "all", None)),
        ("#b_1/t1/2025-05..2025-07/runner/cut/show:in/card:x_1", ("b_1", "t1", "2025-05", "2025-07", "runner", True, True, "in", "x_1")),
        ("no/none/2025-07..2025-05/nobody/show:bad/card:B-A-D", ("all", "all", "2025-12", "2026-02", "corp", False, False, "all", None)),
        ("all/t1/2020-01..2025-04/corp/show:out/show:in/card:no/card:yes", ("all", "t1", "2025-03", "2025-04", "corp", True, False, "out", "yes")),
        ("all/all/2019-01..2020-01/corp", ("all", "all", "2025-12", "2026-02", "corp", False, False, "all", None)),
        ("all/all/2026-01..2027-01x", ("all", "all", "2025-12", "2026-02", "corp", False, False, "all", None)),
    ],
)
def test_addresses(address, want):
    s = addresses.parse(address, MANIFEST, lambda card: card != "no")
    assert (s.restriction, s.tier, s.start, s.end, s.side, s.chosen, s.cut, s.show, s.card) == want
    assert addresses.parse(s.address(), MANIFEST) == s
    assert addresses.parse("x", MANIFEST | {"months": []}).start is None


def test_of_another_side_and_paths():
    s = addresses.parse("#b_1/t1/2025-05..2025-07/runner/show:in/card:x_1", MANIFEST)
    assert s.of_side("corp", lambda c: "runner").card is None and s.of_side("corp", lambda c: "corp").card == "x_1"
    assert s.data_address() == "#b_1/t1/2025-05..2025-07/runner"
    assert addresses.path(MANIFEST, "summary", "runner", "b_1", "t1") == "v=7/summary/runner/b_1/t1.json"
    for bad in ({"kind": "none"}, {"kind": "summary", "side": "x"}, {"kind": "summary", "tier": "../x"}, {"kind": "summary", "restriction": "A"}):
        with pytest.raises(ValueError):
            addresses.path(MANIFEST, **bad)


def test_a_slice_reads_its_own_files(spark, tmp_path):
    counts = spark.createDataFrame([(s, r, t, m, "c", 1) for s in ("corp", "runner") for r in ("b_1", "b_2") for t in ("t1", "t2") for m in MANIFEST["months"]], "side string, restriction_id string, tier string, month string, card_id string, n int")
    addresses.store(counts, str(tmp_path / "cube"))
    df = addresses.rows(spark, str(tmp_path / "cube"), addresses.parse("#b_1/t1/2025-03..2025-12/runner", MANIFEST))
    assert df.count() == 2 and {f.split("month=")[1][:7] for f in df.inputFiles()} >= {"2025-03"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and all(c in plan.split("PartitionFilters: [")[1].split("]")[0] for c in ("restriction_id", "tier", "month"))
    told = addresses.manifest(counts, "7", {"min_games": 30}, 3)
    assert [r["id"] for r in told["restrictions"]] == ["all", "b_1", "b_2"] and told["months"] == MANIFEST["months"] and told["base_path"] == "v=7/"


def test_numbers_as_json(spark):
    values = [0.0, -0.0, 5.0, 100.0, 0.00005, 0.12345, 2.675, -1.5, 123456789.0, 1e15, 0.0001, None, 1 / 3]
    rows = spark.createDataFrame([(v, "a\"é", [1, None], None) for v in values], "x double, s string, a array<int>, n int")
    got = [json.loads(r.value) for r in sinks.json_rows(rows).collect()]
    for v, r in zip(values, got, strict=True):
        assert r == {"x": None if v is None else int(v) if v.is_integer() else round(v, 4), "s": "a\"é", "a": [1, None], "n": None}
        assert v is None or isinstance(r["x"], int) == round(v, 4).is_integer()


class Stop(Exception):
    pass


def test_a_writer_may_stop_anywhere(spark, tmp_path, monkeypatch):
    root, now = str(tmp_path / "snap"), datetime(2026, 1, 1)
    manifest = lambda: json.loads(sinks.contents(spark, f"{root}/manifest"))
    whole = lambda v: [r.value for r in spark.read.text(f"{root}/{v}/s").collect()]
    first = sinks.publish(spark, {"s": spark.range(1)}, root, now)
    last, steps = first, 0
    names = ("claimed_version", "put_if_absent", "overwrite", "advance")
    for name in names:
        for when in ("before", "after"):
            for nth in (1, 2):
                calls, real = [], getattr(sinks, name)

                def stopping(*args, real=real, calls=calls, when=when, nth=nth):
                    calls.append(1)
                    if len(calls) == nth and when == "before":
                        raise Stop
                    out = real(*args)
                    if len(calls) == nth and when == "after":
                        raise Stop
                    return out

                with monkeypatch.context() as m:
                    m.setattr(sinks, name, stopping)
                    try:
                        sinks.publish(spark, {"s": spark.range(2)}, root, now)
                    except Stop:
                        steps += 1
                seen = manifest()["version"]
                assert seen >= last and whole(seen)  # the old one, or the new one whole
                last = sinks.publish(spark, {"s": spark.range(3)}, root, now)
                assert manifest()["version"] == last > seen and len(whole(last)) == 3
    assert steps >= 10


def test_two_writers(spark, tmp_path):
    root, now = str(tmp_path / "snap"), datetime(2026, 1, 1)

    def one(k):
        try:
            return sinks.publish(spark, {"s": spark.range(k)}, root, now, manifest={"k": k})
        except ValueError:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = [v for v in pool.map(one, range(1, 7)) if v]
    assert len(set(got)) == len(got) >= 1 and sinks.current(spark, root) == max(got)
    chain, at = [], "nothing"
    while (v := sinks.contents(spark, f"{root}/_after/{at}")) is not None:
        chain.append(at := v)
    assert sorted(got) == sorted(chain) == chain


def test_csv_and_imports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -2, None), ("plain, \"x\"", 3, " @x")], "a string, n int, b string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv")) == 'a,n,b\n\'=1+1,-2,\n"plain, ""x""",3,\' @x\n'
    decks = lambda rows: spark.createDataFrame(rows, "deck string, cobra_id int")
    sinks.replace_imports(decks([("a", 1), ("b", 2)]), str(tmp_path / "i"))
    sinks.replace_imports(decks([("c", 1)]), str(tmp_path / "i"), spark.createDataFrame([(1,), (2,)], "cobra_id int"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "i")).select("deck", F.col("cobra_id")).collect()] == [("c", 1)]
