"""Tail probabilities against long sums in exact or arbitrary precision."""

import math
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from heliogale.functions import pvalues


def t_tail(r, n):
    """Two-sided tail by the finite sums, in 400 digits (for odd degrees of freedom: 55, those of pi)."""
    getcontext().prec = 400
    df, r = n - 2, Decimal(r)
    square = 1 - r * r
    total, term = Decimal(0), Decimal(1)
    if df % 2 == 0:
        for j in range(df // 2):
            total += term
            term = term * (2 * j + 1) / (2 * j + 2) * square
        return float(1 - abs(r) * total)
    for j in range((df - 1) // 2):
        total += term
        term = term * (2 * j + 2) / (2 * j + 3) * square
    angle, power = Decimal(0), abs(r)  # arcsin by its series
    for j in range(4000):
        angle += power / (2 * j + 1)
        power = power * (2 * j + 1) / (2 * j + 2) * r * r
    pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")
    return float(1 - 2 / pi * (angle + abs(r) * square.sqrt() * total))


def test_correlation_tails(spark):
    cases = [(r, n) for r in (0.001, -0.05, 0.3, 0.5, -0.77, 0.9, 0.95) for n in (3, 4, 5, 10, 51, 52, 400, 1001)]
    df = spark.createDataFrame(cases, "r double, n long")
    for row in df.withColumn("p", pvalues.correlation_p_value(F.col("r"), F.col("n"))).collect():
        want = t_tail(row["r"], row["n"])
        assert row["p"] == pytest.approx(want, rel=1e-9, abs=1e-45 if row["n"] % 2 else 1e-250), row
    edge = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.0, 9), (None, 9), (float("nan"), 9), (0.5, 2), (0.02, 800_000)], "r double, n long")
    got = [r["p"] for r in edge.withColumn("p", pvalues.correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert got[:6] == [0.0, 0.0, 1.0, None, None, None] and 1e-72 < got[6] < 1e-70  # about the normal tail of 17.9


def test_chi_square_tails(spark):
    cases = [(x, k) for x in (1e-6, 0.3, 1.0, 5.0, 12.0, 13.0, 40.0, 300.0) for k in (1, 2, 3, 4, 7, 20, 21)]
    df = spark.createDataFrame(cases, "x double, k int")

    def want(x, k):
        half, s = x / 2, 0.5 if k % 2 else 1.0
        tail = math.erfc(math.sqrt(half)) if k % 2 else math.exp(-half)
        while s < k / 2:
            tail += math.exp(s * math.log(half) - half - math.lgamma(s + 1))
            s += 1
        return tail

    for row in df.withColumn("p", pvalues.chi2_p_value(F.col("x"), F.col("k"))).collect():
        assert row["p"] == pytest.approx(want(row["x"], row["k"]), rel=1e-11, abs=1e-300), row
    edge = spark.createDataFrame([(0.0, 5), (None, 5), (float("nan"), 5), (1.0, 0)], "x double, k int")
    assert [r["p"] for r in edge.withColumn("p", pvalues.chi2_p_value(F.col("x"), F.col("k"))).collect()] == [1.0, None, None, None]


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 2.0, 10.25, 1234.5, 4e5]
    out = spark.createDataFrame([(v,) for v in values], "x double").withColumn("g", pvalues.log_gamma(F.col("x"))).collect()
    assert [r["g"] for r in out] == pytest.approx([math.lgamma(v) for v in values], rel=1e-13, abs=1e-13)
