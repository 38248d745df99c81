from __future__ import annotations

import math

import numpy as np
import pytest

from shiftgrid.functions.pvalue import with_p_value


def by_integration(r: float, n: int) -> float:
    """Tail of the t density by the trapezoid rule in u = atan(t)."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    u = np.linspace(math.atan(t), math.pi / 2 - 1e-9, 400_001)
    x = np.tan(u)
    logc = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    y = np.exp(logc - (df + 1) / 2 * np.log1p(x * x / df)) * (1 + x * x)
    return 2 * float(np.sum((y[1:] + y[:-1]) / 2 * np.diff(u)))


@pytest.mark.parametrize("r,n", [(0.5, 12), (-0.5, 12), (0.02, 2000), (0.3, 40), (0.9, 8), (0.11, 5000), (0.0, 10)])
def test_against_integration(spark, r, n):
    got = with_p_value(spark.createDataFrame([(r, n)], "rho double, n int"), "rho", "n").first()["p_value"]
    assert got == pytest.approx(by_integration(r, n), rel=1e-6)


def test_undefined_and_perfect(spark):
    df = spark.createDataFrame([(None, 10), (0.5, 2), (1.0, 10)], "rho double, n int")
    assert [x["p_value"] for x in with_p_value(df, "rho", "n").collect()] == [None, None, 0.0]


def test_against_finite_sums(spark):
    """Whole degrees of freedom: the central probability is a finite sum; small tails keep their relative precision."""
    rows = [(r, n) for n in (3, 4, 5, 6, 7, 30, 31, 400, 23_070) for r in (-0.95, -0.3, 0.004, 0.05, 0.6)]
    got = {(x.rho, x.n): x.p_value for x in with_p_value(spark.createDataFrame(rows, "rho double, n int"), "rho", "n").collect()}
    for r, n in rows:
        df, z = n - 2, 1 - r * r
        if df % 2 == 0:
            central = abs(r) * math.fsum(math.exp(math.lgamma(j + 0.5) - math.lgamma(j + 1) - math.lgamma(0.5)) * z ** j for j in range(df // 2))
        else:
            central = 2 / math.pi * (math.asin(abs(r)) + abs(r) * math.fsum(
                math.exp(math.lgamma(j + 1) + math.lgamma(1.5) - math.lgamma(j + 1.5)) * z ** (j + 0.5) for j in range((df - 1) // 2)))
        assert got[r, n] == pytest.approx(1 - central, abs=2e-11)


def test_no_python_in_the_plan(spark):
    plan = with_p_value(spark.createDataFrame([(0.5, 12)], "rho double, n int"), "rho", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
