"""Statistics as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on the series below is exact to twelve digits.
SERIES_FROM = 16


def log_factorial(n: Column) -> Column:
    """ln(n!) in constant time: a table for small n, Stirling's series for others."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(SERIES_FROM)])
    return F.when(n < SERIES_FROM, F.get(table, n.cast("int"))).otherwise(series)


def log_binomial(n: Column, k: Column) -> Column:
    """ln C(n, k) for k in 0..n."""
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def fisher_greater(overlap: Column, query: Column, document: Column, terms: Column) -> Column:
    """One-sided exact test: the chance of at least `overlap` of `query` terms among `document` of `terms`.

    One chance is taken in logarithms, since the binomials of a hundred terms
    are beyond doubles, and its neighbours follow by their ratios. Beyond the
    mean the tail itself is summed, else the other side, so that either sum
    starts at its greatest part.
    """
    o, n, k, size = (x.cast("long") for x in (overlap, query, document, terms))
    most, least = F.least(n, k), F.greatest(F.lit(0), n + k - size)
    rest = size - k - n  # may be negative: i + rest never is for possible i
    chance = lambda i: F.exp(log_binomial(k, i) + log_binomial(size - k, n - i) - log_binomial(size, n))

    def part(first: Column, steps: Column, ratio) -> Column:
        """chance(first) and those that follow it by ratios."""
        one = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("last"))
        add = lambda s, last: F.struct((s["sum"] + last).alias("sum"), last.alias("last"))
        return chance(first) * F.aggregate(steps, one, lambda s, i: add(s, s["last"] * ratio(i)), lambda s: s["sum"])

    span = lambda a, b, step: F.when((b - a) * step >= 0, F.sequence(a, b, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    above = part(o, span(o, most - 1, 1), lambda i: F.try_divide((k - i) * (n - i).cast("double"), (i + 1) * (rest + i + 1)))
    below = part(o - 1, span(o - 1, least + 1, -1), lambda i: F.try_divide(i * (rest + i).cast("double"), (k - i + 1) * (n - i + 1)))
    value = F.when(o * size > n * k, above).otherwise(1 - below)
    return F.when(o <= least, F.lit(1.0)).when(o > most, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def log_or_minus_infinity(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))
