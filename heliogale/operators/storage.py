"""Long-duration storage: peak energy deficit per cell, season and wind share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliogale.config import ALPHAS
from heliogale.functions import columns as fn

METRICS = {
    "mean": F.avg,
    "p99": lambda c: F.percentile(c, F.lit(0.99)),  # a group holds one value per season
    "max": F.max,
}


def normalise(daily: DataFrame, means: DataFrame, keys: list[str], wind: str, solar: str,
              wind_mean: str, solar_mean: str, ssrd_factor: float = 1.0,
              mask_missing: bool = False) -> DataFrame:
    """Generation relative to the long-term mean of the cell.

    A missing or non-positive mean, or a missing day, counts as no generation; with
    ``mask_missing`` cells without a positive mean are dropped instead. ``ssrd_factor``
    scales the solar mean to the time basis of the daily series.
    """
    w_mean, s_mean = fn.positive(wind_mean), fn.positive(F.col(solar_mean) * fn.dbl(ssrd_factor))
    joined = daily.join(means.select(*keys, wind_mean, solar_mean), keys, "inner" if mask_missing else "left")
    if mask_missing:
        joined = joined.filter(w_mean.isNotNull() & s_mean.isNotNull())
    return joined.withColumns(
        {
            "wind_norm": F.coalesce(F.col(wind) / w_mean, fn.dbl(0)),
            "solar_norm": F.coalesce(F.col(solar) / s_mean, fn.dbl(0)),
        }
    ).drop(wind_mean, solar_mean)


def deficit(
    normalised: DataFrame,
    keys: list[str],
    years: tuple[int, int],
    date: str = "date",
    alphas=ALPHAS,
    cyclic: bool = False,
    coverage: str = "strict",
    start_month: int = 7,
) -> DataFrame:
    """Peak drawdown ``max_t [E(t) - min_{s<=t} E(s)]`` per cell, season and wind share.

    ``E`` is the running sum of ``1 - alpha*wind_norm - (1-alpha)*solar_norm`` over a
    season starting in year Y for ``years[0] <= Y < years[1]``. ``E`` is linear in the
    two running sums, so all shares are read off the same sorted window: the share sweep
    adds columns, not shuffled rows. ``cyclic`` continues the season into a second copy
    of itself, which also catches drawdowns across the season seam.

    ``coverage``: "strict" fails on a season without 365/366 days, "complete" leaves such
    seasons out, "any" takes seasons as they are.
    """
    if coverage not in ("strict", "complete", "any"):
        raise ValueError(f"unknown coverage rule {coverage!r}")
    group = [*keys, "year"]
    ordered = W.partitionBy(*group).orderBy(date)
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy(*group).orderBy(F.col(date).desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)

    # The seasons wanted are one date range, which the scan of a stored table can use.
    first, end = (F.make_date(F.lit(y), F.lit(start_month), F.lit(1)) for y in years)
    base = (
        normalised.filter((F.col(date) >= first) & (F.col(date) < end))
        .select(*keys, date, "wind_norm", "solar_norm", fn.season_year(date, start_month).alias("year"))
        .withColumns(
            {
                "_t": F.row_number().over(ordered),
                "_w": F.sum("wind_norm").over(so_far),
                "_s": F.sum("solar_norm").over(so_far),
            }
        )
    )
    if cyclic:
        base = base.withColumns(
            {f"{c}_end": F.max(c).over(whole) for c in ("_t", "_w", "_s")}
        )

    def level(a: float, end: str = "") -> Column:
        parts = (F.col(f"_t{end}"), F.col(f"_w{end}"), F.col(f"_s{end}"))
        return parts[0] - fn.dbl(a) * parts[1] - fn.dbl(1 - a) * parts[2]

    def drawdown(a: float) -> Column:
        here = level(a)
        low = F.min(here).over(so_far)
        plain = here - low
        if not cyclic:
            return plain
        # Same day in the second copy: the last T days are the rest of the first copy
        # and the second copy so far, the latter raised by the season's total.
        total = level(a, "_end")
        rest = F.min(here).over(later)
        return F.greatest(plain, here + total - F.least(rest, low + total))

    swept = base.withColumns({f"_d{i}": drawdown(a) for i, a in enumerate(alphas)})
    peaks = swept.groupBy(*group).agg(
        *[F.max(f"_d{i}").alias(f"_d{i}") for i in range(len(alphas))],
        F.max("_t").alias("n_days"),
    )
    if coverage == "complete":
        peaks = peaks.filter(F.col("n_days").isin(365, 366))
    points = F.array(
        *[
            F.struct(fn.dbl(a).alias("alpha"), F.col(f"_d{i}").alias("deficit"))
            for i, a in enumerate(alphas)
        ]
    )
    long = peaks.select(*group, "n_days", F.inline(points))
    if coverage == "strict":
        message = F.format_string("season %d has %d days, expected 365 or 366", "year", "n_days")
        checked = F.when(F.col("n_days").isin(365, 366), F.col("deficit")).otherwise(
            F.raise_error(message).cast("double")
        )
        long = long.withColumn("deficit", checked)
    return long.select(*keys, "alpha", "year", "deficit")


def deficit_from_daily(daily: DataFrame, means: DataFrame, keys: list[str], years: tuple[int, int], *,
                       wind: str = "wind", solar: str = "solar", wind_mean: str = "wind_mean",
                       solar_mean: str = "solar_mean", ssrd_factor: float = 1.0,
                       mask_missing: bool = False, **options) -> DataFrame:
    """Normalise and sweep. The join with the means and every window of the sweep share one
    placement of the daily rows by cell: one shuffle, or none when the daily table is
    stored bucketed by cell."""
    ready = normalise(daily, means, keys, wind, solar, wind_mean, solar_mean, ssrd_factor, mask_missing)
    return deficit(ready, keys, years, **options)


def aggregate(
    deficits: DataFrame, keys: list[str], metric: str = "mean",
    fixed_alpha: float | None = None, alphas=ALPHAS,
) -> DataFrame:
    """Across seasons, then the share with the smallest value (smallest share on a tie).

    Null seasons are skipped; a cell without any value keeps null in both outputs. With
    ``fixed_alpha`` that share is reported instead of the best one.
    """
    metric = metric.lower()
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}; got {metric!r}")
    if fixed_alpha is not None:
        if not any(abs(a - fixed_alpha) <= 1e-6 for a in alphas):
            raise ValueError(f"fixed_alpha={fixed_alpha} is not one of {list(alphas)}")
        picked = deficits.filter(F.abs(F.col("alpha") - fn.dbl(fixed_alpha)) <= 1e-6)
        return picked.groupBy(*keys).agg(
            METRICS[metric](F.col("deficit")).alias("duration_metric"),
            F.lit(float(fixed_alpha)).alias("optimal_alpha"),
        )
    per_share = deficits.groupBy(*keys, "alpha").agg(METRICS[metric](F.col("deficit")).alias("_m"))
    best = F.min(F.when(F.col("_m").isNotNull(), F.struct("_m", "alpha")))
    return (
        per_share.groupBy(*keys)
        .agg(best.alias("_best"))
        .select(
            *keys,
            F.col("_best._m").alias("duration_metric"),
            F.col("_best.alpha").alias("optimal_alpha"),
        )
    )
