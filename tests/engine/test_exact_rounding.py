"""Rounding by the exact binary value against Python's, without a Python worker."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions import ratios


def values():
    r = random.Random(1)
    out = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, -2.5, 2.675, 1.005, 0.285, 1e300, -1e300, 5e-324, math.inf, -math.inf, 2.0**52 + 0.5, 2.0**53 + 2, 1e22, 123456789012345.675]
    out += [r.uniform(-1, 1) * 10 ** r.randint(-8, 18) for _ in range(60_000)]
    out += [r.randint(-(10**7), 10**7) / 10 ** r.randint(1, 6) for _ in range(60_000)]  # near halves
    out += [(r.randint(-(10**6), 10**6) * 2 + 1) / 2 ** r.randint(1, 12) for _ in range(30_000)]  # halves held exactly
    return out + [(2.0**k + r.randint(0, 1 << 20)) / 10**d for d in (2, 4, 6) for k in range(50, 55) for _ in range(1_000)]


@pytest.mark.parametrize("digits", [0, 2, 4, 6])
def test_rounded(spark, digits):
    v = values()
    df = spark.createDataFrame([(x,) for x in v], "v double").select("v", ratios.rounded(F.col("v"), digits).alias("r"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    wrong = [(x.v, x.r, round(x.v, digits)) for x in df.collect() if math.isfinite(x.v) and (x.r != round(x.v, digits) or math.copysign(1, x.r) != math.copysign(1, round(x.v, digits)))]
    assert not wrong, (len(wrong), wrong[:5])


def test_what_is_no_number(spark):
    rows = spark.createDataFrame([(math.nan,), (None,), (math.inf,), (-math.inf,)], "v double").select(ratios.rounded(F.col("v"), 2).alias("r")).collect()
    assert [x.r for x in rows] == [None, None, math.inf, -math.inf]
    with pytest.raises(ValueError):
        ratios.rounded(F.col("v"), 23)
