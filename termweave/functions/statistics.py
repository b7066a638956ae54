"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)


def log_factorial(n: Column) -> Column:
    """ln n!: exact up to 20, above it Stirling's series, whose error is below 1e-12 there."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x) + _HALF_LOG_TAU + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tail(total: Column, a: Column, b: Column, observed: Column) -> Column:
    """P(X <= observed) for X documents with both terms, of total documents a with the one and b with the other.

    1 where total, a or b is not positive or observed reaches the most possible; 0 below the least possible.
    """
    n, a, b = total.cast("long"), a.cast("long"), b.cast("long")
    seen = F.greatest(observed.cast("long"), F.lit(0))
    low, high = F.greatest(F.lit(0), a + b - n), F.least(a, b)
    steps = F.when((seen >= low) & (seen < high) & (n > 0) & (a > 0) & (b > 0), F.sequence(low, seen)).otherwise(F.array().cast("array<bigint>"))
    terms = F.transform(steps, lambda x: F.exp(log_choose(a, x) + log_choose(n - a, b - x) - log_choose(n, b)))
    tail = F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))
    return F.when((n <= 0) | (a <= 0) | (b <= 0) | (seen >= high), 1.0).when(seen < low, 0.0).otherwise(tail)


def verdict(q: Column) -> Column:
    """What a modularity tells: 'clear' from 0.5, 'acceptable' from 0.3, 'weak' above 0, else 'none'."""
    return F.when(q >= 0.5, "clear").when(q >= 0.3, "acceptable").when(q > 0, "weak").otherwise("none")
