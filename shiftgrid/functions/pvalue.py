"""Two-sided p-value of a correlation coefficient, as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 800  # half steps of the continued fraction; it settles long before


def log_half_beta(a: Column) -> Column:
    """Logarithm of the beta function B(a, 1/2) for a > 0.

    Gamma(a + 1/2) / Gamma(a) is carried up to a + 16 by its recurrence, and read from its asymptotic series there.
    """
    shift = 16
    z = a + F.lit(float(shift))
    series = F.lit(0.5) * F.log(z) - F.lit(1 / 8) / z + F.lit(1 / 192) / F.pow(z, F.lit(3.0)) - F.lit(1 / 640) / F.pow(z, F.lit(5.0)) \
        + F.lit(17 / 14336) / F.pow(z, F.lit(7.0))
    carried = F.aggregate(
        F.sequence(F.lit(0), F.lit(shift - 1)), series, lambda s, i: s - F.log1p(F.lit(0.5) / (a + i.cast("double"))))
    return F.lit(0.5 * math.log(math.pi)) - carried


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(1e-300), F.lit(1e-300)).otherwise(x)


def _fraction(p: Column, q: Column, z: Column) -> Column:
    """Continued fraction of the incomplete beta function, by modified Lentz steps: one step per element."""
    first = F.lit(1.0) / _away_from_zero(F.lit(1.0) - (p + q) * z / (p + F.lit(1.0)))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = F.floor((k + F.lit(1)) / F.lit(2)).cast("double")
        two = p + F.lit(2.0) * m
        even = m * (q - m) * z / ((two - F.lit(1.0)) * two)
        odd = -(p + m) * (p + q + m) * z / (two * (two + F.lit(1.0)))
        by = F.when(k % 2 == 1, even).otherwise(odd)
        d = F.lit(1.0) / _away_from_zero(F.lit(1.0) + by * s["d"])
        c = _away_from_zero(F.lit(1.0) + by / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def correlation_p_value(rho: Column, n: Column) -> Column:
    """Student t test of zero correlation: the regularised incomplete beta function at 1 - rho^2 with (n - 2) / 2 and 1 / 2.

    NULL below three pairs or without a correlation, 0 for a perfect one. One evaluation per reported row, never per data row.
    """
    r, a, b = rho.cast("double"), (n.cast("double") - F.lit(2.0)) / F.lit(2.0), F.lit(0.5)
    x = F.lit(1.0) - r * r
    # the fraction converges fast below the mean; above it the complement does
    swap = x > (a + F.lit(1.0)) / (a + F.lit(2.5))
    p, q, z = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, r * r).otherwise(x)
    front = F.exp(p * F.log(z) + q * F.log1p(-z) - log_half_beta(a))
    value = F.when(z > 0, front * _fraction(p, q, z) / p).otherwise(F.lit(0.0))
    tail = F.when(swap, F.lit(1.0) - value).otherwise(value)
    known = r.isNotNull() & ~F.isnan(r) & (a > 0)
    return F.when(known, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(tail))


def with_p_value(rows: DataFrame, rho: str, n: str, out: str = "p_value") -> DataFrame:
    return rows.withColumn(out, correlation_p_value(F.col(rho), F.col(n)))
