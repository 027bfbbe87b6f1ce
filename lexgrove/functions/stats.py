"""Intervals and paired tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share, by Wilson's score interval; null without cases."""
    n, zz = F.nullif(n.cast("double"), F.lit(0.0)), z * z
    p = successes / n
    middle, spread, scale = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    return F.greatest(F.lit(0.0), (middle - spread) / scale), F.least(F.lit(1.0), (middle + spread) / scale)


def _stirling(m: Column) -> Column:
    """ln(m!) less Stirling's approximation, for counts of 1 or more: from the factorial where that fits a long, else by its series, which is exact to 1e-16 there."""
    small = F.ln(F.factorial(F.least(m, F.lit(20.0)).cast("int"))) - 0.5 * F.ln(2 * math.pi * m) - m * F.ln(m) + m
    i = 1 / (m * m)
    return F.when(m <= 20, small).otherwise((1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / m)


def _half_mass(n: Column, k: Column) -> Column:
    """Chance of k heads of n fair tosses, k at most half of n."""
    d, rest = (n - 2 * k) / n, n - k
    deviance = n / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    inner = F.sqrt(n / (2 * math.pi * k * rest)) * F.exp(_stirling(n) - _stirling(k) - _stirling(rest) - deviance)
    return F.when(k == 0, F.exp(-n * math.log(2))).otherwise(inner)


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of b against c discordant pairs, for any counts.

    The tail of k = min(b, c) of n = b + c fair tosses is an incomplete beta function, I(n - k, k + 1) at one half: the chance of k itself times a continued
    fraction, evaluated forwards (Lentz). Next to the middle, where it converges slowest, it takes steps in the order of the cube root of n.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    a, q = n - k, k + 1
    first = 1 / (1 - (a + q) * 0.5 / (a + 1))

    def step(acc: Column, t: Column) -> Column:
        m = F.floor(t / 2).cast("double")
        even = m * (q - m) * 0.5 / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + q + m) * 0.5 / ((a + 2 * m) * (a + 1 + 2 * m))
        term = F.when(t % 2 == 0, even).otherwise(odd)
        low, high = 1 / (1 + term * acc["low"]), 1 + term / acc["high"]
        return F.struct(low.alias("low"), high.alias("high"), (acc["value"] * low * high).alias("value"))

    start = F.struct(first.alias("low"), F.lit(1.0).alias("high"), first.alias("value"))
    steps = F.sequence(F.lit(2), F.ceil(8 * F.cbrt(n) + 60).cast("int"))
    value = F.aggregate(steps, start, step, lambda acc: acc["value"])
    return F.when(n == 0, F.lit(1.0)).when(2 * k >= n - 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), _half_mass(n, k) * value))
