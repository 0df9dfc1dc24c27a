"""Ratios of sums, intervals and sample status. All stay unrounded; rounding belongs to the writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """NULL where b is zero or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(won: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % score interval within [0, 1]; NULL without trials."""
    n = F.when(n > 0, n.cast("double"))
    p = won / n
    d = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / d
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


WILSON_SQL = {
    "low": f"greatest(0.0, (w / n + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) - {Z} * sqrt(w / n * (1 - w / n) / n + {Z * Z} / (4 * n * n)) / (1 + {Z * Z} / n))",
    "high": f"least(1.0, (w / n + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) + {Z} * sqrt(w / n * (1 - w / n) / n + {Z * Z} / (4 * n * n)) / (1 + {Z * Z} / n))",
}


def status(n: Column, least: int) -> Column:
    return F.when(n >= least, "ok").otherwise("insufficient")


def points(now: Column, before: Column) -> Column:
    """Change in percentage points; NULL where either is."""
    return (now - before) * 100


def nice_max(v: Column) -> Column:
    """The least of 1, 2, 2.5, 5 or 10 times a power of ten that is at least v; 1 for nothing."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    steps = F.transform(F.array(*[F.lit(k) for k in (1.0, 2.0, 2.5, 5.0, 10.0)]), lambda k: k * power)
    return F.when(v > 0, F.element_at(F.filter(steps, lambda k: k >= v), 1)).otherwise(F.lit(1.0))


def nice_axis(low: Column, high: Column, ticks: int = 4) -> Column:
    """struct(low, high, step): an axis of whole nice steps around the values; a flat range gets one more."""
    top = F.when(high <= low, low + 1).otherwise(high)
    step = nice_max((top - low) / ticks)
    return F.struct((F.floor(low / step + 1e-9) * step).alias("low"), (F.ceil(top / step - 1e-9) * step).alias("high"), step.alias("step"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _halves(v: Column) -> tuple[Column, Column]:
    """The upper and the lower half of a double's digits: their sum is the value, and products of halves are exact."""
    upper = v * 134217729.0 - (v * 134217729.0 - v)
    return upper, v - upper


def rounded(c: Column, digits: int) -> Column:
    """To so many digits, 22 at most, by the exact binary value, halves to even; NULL for NaN. (Spark's own functions round the shortest decimal.)

    value * 10^digits is held exactly, as a double and what its rounding left off (Dekker's product), so its distance to the half is known
    exactly too. Whole numbers up to 2^54 are divided again, rounded once; larger products mean doubles that lie so far apart
    that the nearest one is the value itself.
    """
    if not 0 <= digits <= 22:
        raise ValueError("digits must be 0 to 22")
    scale = 10.0**digits
    s = F.lit(scale)

    def scaled(x: Column) -> Column:
        (xu, xl), (su, sl) = _halves(x), _halves(s)
        return _let(x * s, lambda p: F.struct(p.alias("p"), (((xu * su - p) + xu * sl + xl * su) + xl * sl).alias("rest")))

    def near(x: Column, p: Column, rest: Column) -> Column:
        """x to so many digits, from the product of it and the scale and what that left off."""
        whole = F.floor(p)

        def placed(part: Column) -> Column:
            below, rest, odd = part["below"], part["rest"], F.pmod(part["whole"], F.lit(2)) == 1
            # the difference from 0.5 is exact wherever the rest decides; a product that is whole leaves all that counts to the rest
            over = (below - 0.5) + rest
            up = F.when(below > 0, (over > 0) | ((over == 0) & odd)).otherwise((rest > 0.5) | ((rest == 0.5) & odd))
            down = (below == 0) & ((rest < -0.5) | ((rest == -0.5) & odd))
            return part["whole"] + F.when(up, 1).when(down, -1).otherwise(0)

        n = _let(F.struct((p - whole).alias("below"), whole.alias("whole"), rest.alias("rest")), placed)
        # halves below 2^53 are divided exactly rounded; above, as decimals
        back = _let(n, lambda k: F.when(F.abs(k) <= 1 << 53, k.cast("double") / s).otherwise(F.concat(k.cast("string"), F.lit(f"E-{digits}")).cast("double")))
        return F.when(back == 0, x * 0.0).otherwise(back)

    def of(x: Column) -> Column:
        return F.when(F.isnan(x), F.lit(None).cast("double")).when(F.abs(x * s) >= 2.0**54, x).otherwise(_let(scaled(x), lambda y: near(x, y["p"], y["rest"])))

    return _let(c.cast("double"), of)
