"""Tail probabilities Spark has no built-in for, as native Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliogale.functions.columns import dbl

_TINY = 1e-300
_SHIFT = 10  # the series below is used from here on


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: its asymptotic series beyond ``_SHIFT``, reached by recurrence."""
    z = x + dbl(_SHIFT)
    # The series' coefficients, B(2k) / (2k (2k - 1)).
    series = dbl(0)
    for coefficient in (1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12):
        series = series / (z * z) + dbl(coefficient)
    stirling = (z - dbl(0.5)) * F.log(z) - z + dbl(0.5 * math.log(2 * math.pi)) + series / z
    product = x
    for k in range(1, _SHIFT):
        product = product * (x + dbl(k))
    return stirling - F.log(product)


def _away(c: Column) -> Column:
    """``c``, moved off zero so that it can divide."""
    return F.when(F.abs(c) > _TINY, c).otherwise(dbl(_TINY))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, front to back; its steps grow with the root of ``a`` and ``b``."""
    one = dbl(1)
    first = one / _away(one - (a + b) * x / (a + one))

    def step(state: Column, k: Column) -> Column:
        m = k.cast("double")
        c, d, total = state["c"], state["d"], state["total"]
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = one / _away(one + num * d)
            c = _away(one + num / c)
            total = total * c * d
        return F.struct(c.alias("c"), d.alias("d"), total.alias("total"))

    steps = (dbl(60) + 3 * F.sqrt(F.greatest(a, b))).cast("int")
    start = F.struct(one.alias("c"), first.alias("d"), first.alias("total"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["total"])


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs; null without a correlation or for fewer than 3 pairs.

    With t = r * sqrt(dof / (1 - r^2)) the usual dof / (dof + t^2) collapses to 1 - r^2, so the tail is the regularised
    incomplete beta function of dof / 2 and 1/2 there. The larger side of it is taken as one less the smaller.
    """
    r, n = r.cast("double"), n.cast("double")
    a, b = (n - 2) / 2, dbl(0.5)
    square = r * r
    front = F.exp(log_gamma(a + b) - log_gamma(a) - dbl(0.5 * math.log(math.pi)) + a * F.log1p(-square) + b * F.log(square))
    near = front * _beta_fraction(b, a, square) / b
    far = front * _beta_fraction(a, b, dbl(1) - square) / a
    tail = F.when(dbl(1) - square < (a + 1) / (a + b + 2), far).otherwise(dbl(1) - near)
    usable = r.isNotNull() & ~F.isnan(r) & (n > 2)
    return F.when(usable & (square >= 1), dbl(0)).when(usable & (square == 0), dbl(1)).when(usable, tail)


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: the series of erf up to 2.5, a continued fraction beyond."""
    square = z * z
    term = lambda s, k: F.struct(
        (s["t"] * 2 * square / (2 * k.cast("double") + 1)).alias("t"), (s["sum"] + s["t"] * 2 * square / (2 * k.cast("double") + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("sum")), term, lambda s: s["sum"])
    near = dbl(1) - dbl(2 / math.sqrt(math.pi)) * F.exp(-square) * series
    fraction = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda f, k: z + k.cast("double") / 2 / f)
    far = F.exp(-square) / fraction / dbl(math.sqrt(math.pi))
    return F.when(z < 2.5, near).otherwise(far)


def chi2_p_value(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom: a finite sum over half-steps, and for
    an odd number the tail of one degree. Null for null, NaN or no degrees of freedom."""
    half, k = x.cast("double") / 2, dof.cast("int")
    odd = k % 2 == 1
    first = F.when(odd, erfc(F.sqrt(half))).otherwise(F.exp(-half))
    start = F.when(odd, dbl(0.5)).otherwise(dbl(1))
    terms = F.floor((k - 1) / 2).cast("int")
    rest = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>")), dbl(0),
        lambda total, j: total + F.exp((start + j) * F.log(half) - half - log_gamma(start + j + 1)))
    usable = x.isNotNull() & ~F.isnan(x.cast("double")) & (k > 0)
    return F.when(usable & (half <= 0), dbl(1)).when(usable, F.least(dbl(1), first + rest))
