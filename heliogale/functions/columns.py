"""Scalar building blocks as native Column expressions (no Python in the hot path)."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliogale.config import ELLIPSOID_A, ELLIPSOID_B, GRAVITY


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    return F.lit(float(x))


# ---- missing data -----------------------------------------------------------
def finite(c) -> Column:
    """NaN and infinities become null, so aggregates and ``least/greatest`` skip them."""
    c = as_col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def has_data(c) -> Column:
    """True where the value is present and not zero (null is "no data", not null)."""
    c = as_col(c)
    return F.coalesce(c != 0, F.lit(False))


def positive(c) -> Column:
    c = as_col(c)
    return F.when(c > 0, c)


def clip(c, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; a null stays null (``least``/``greatest`` alone would hide it)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, dbl(lo)), dbl(hi)))


def safe_ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


# ---- coordinates ------------------------------------------------------------
def lon180(c) -> Column:
    """0..360 -> -180..180 (``pmod`` keeps negatives right)."""
    return F.pmod(as_col(c) + dbl(180), dbl(360)) - dbl(180)


def lon360(c) -> Column:
    return F.pmod(as_col(c), dbl(360))


def lat_band(c, width: float = 6.0) -> Column:
    """Absolute-latitude band, lower edge."""
    return F.floor(F.abs(as_col(c)) / dbl(width)) * F.lit(int(width))


def in_box(lon, lat, bounds) -> Column:
    """Half-open box test: lat in (south, north], lon in [west, east) on the circle.

    A box whose wrapped west edge lies east of its east edge crosses the seam and
    takes two ranges; a box spanning the whole circle has no longitude test.
    """
    minx, miny, maxx, maxy = bounds
    south, north = min(miny, maxy), max(miny, maxy)
    lat, lon = as_col(lat), as_col(lon)
    keep = (lat > dbl(south)) & (lat <= dbl(north))
    if maxx - minx >= 360:
        return keep
    # Plain ranges of the stored column, so that they reach the scan: the box and its images a circle
    # away, for longitudes stored as -180..180 or as 0..360.
    west = minx % 360
    east = west + (maxx - minx) % 360
    images = [(lon >= dbl(west + turn)) & (lon < dbl(east + turn)) for turn in (-720, -360, 0, 360) if east > west]
    return keep & reduce(or_, images, F.lit(False))


def morton(x, y, low: tuple[float, float], span: float, bits: int = 20) -> Column:
    """Z-order key of a point in the square of side ``span`` at ``low``: the bits of both axes in turn."""
    # Shifts and masks that put one empty bit before each bit of a 32-bit number.
    steps = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))

    def spread(c: Column, start: float) -> Column:
        cell = F.floor((c - dbl(start)) / dbl(span) * dbl(1 << bits))
        v = F.least(F.greatest(cell, F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
        for shift, mask in steps:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(as_col(x), low[0]).bitwiseOR(F.shiftleft(spread(as_col(y), low[1]), 1))


# ---- physics / units --------------------------------------------------------
def wind_speed(u, v) -> Column:
    return F.hypot(as_col(u), as_col(v))


def daily_yield_to_cf(c) -> Column:
    """kWh/kWp per day -> capacity factor."""
    return as_col(c) / dbl(24)


def joules_to_watts(c, basis: str = "hourly_mean") -> Column:
    """J/m2 -> W/m2 for an hourly mean or for a daily sum."""
    seconds = {"hourly_mean": 3600, "daily_sum": 86400}
    if basis not in seconds:
        raise ValueError(f"basis must be one of {sorted(seconds)}; got {basis!r}")
    return as_col(c) / dbl(seconds[basis])


def geopotential_to_metres(c) -> Column:
    return as_col(c) / dbl(GRAVITY)


def pixel_area_m2(lat, size: float | Column) -> Column:
    """Ellipsoidal area of a ``size``-degree pixel centred on ``lat``.

    The band between the pixel's two parallels is the difference of the two caps
    measured from the equator; the pixel is ``size/360`` of that band.
    """
    size = size if isinstance(size, Column) else dbl(size)
    ecc = math.sqrt(1 - (ELLIPSOID_B / ELLIPSOID_A) ** 2)
    lat = as_col(lat)

    def cap(edge: Column) -> Column:
        s = F.sin(F.radians(edge))
        up, down = dbl(1) + s * dbl(ecc), dbl(1) - s * dbl(ecc)
        return dbl(math.pi * ELLIPSOID_B**2) * (
            F.ln(up / down) / dbl(2 * ecc) + s / (up * down)
        )

    half = size / dbl(2)
    return F.abs((cap(lat + half) - cap(lat - half)) * size / dbl(360))


# ---- calendar ---------------------------------------------------------------
def is_leap_day(date) -> Column:
    date = as_col(date)
    return (F.month(date) == 2) & (F.dayofmonth(date) == 29)


def noleap_doy(date) -> Column:
    """Day of year 1..365 in a calendar without 29 February."""
    date = as_col(date)
    leap = F.dayofmonth(F.last_day(F.make_date(F.year(date), F.lit(2), F.lit(1)))) == 29
    doy = F.dayofyear(date)
    return doy - F.when(leap & (doy > 59), 1).otherwise(0)


def season_year(date, start_month: int = 7) -> Column:
    """Year in which the 12-month window holding ``date`` begins."""
    date = as_col(date)
    return F.year(date) - F.when(F.month(date) >= start_month, 0).otherwise(1)


# ---- classes ----------------------------------------------------------------
def tertile(c, low: float, high: float) -> Column:
    """L below ``low`` or missing, M in [low, high), H from ``high``."""
    c = as_col(c)
    return F.when(c >= dbl(high), "H").when(c >= dbl(low), "M").otherwise("L")


def resource_level(c) -> Column:
    """Three display levels; a missing value falls in the last one."""
    c = as_col(c)
    return (
        F.when(c <= 0.33, "low").when(c <= 0.67, "medium").otherwise("high")
    )


def histogram_bin(c, lo: float, hi: float, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed so ``hi`` falls in it."""
    return F.least(F.width_bucket(as_col(c), dbl(lo), dbl(hi), F.lit(bins)), F.lit(bins)) - 1


def round_cols(df, digits: int, *names: str):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})
