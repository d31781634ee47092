"""Hourly series -> daily series -> climatologies, and the wind/solar correlation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.config import DAILY_RULE
from heliogale.functions import columns as fn


def year_range(df: DataFrame, ts: str, first: int, last: int) -> DataFrame:
    """First 1 January to last 31 December inclusive, as a half-open range on the stored
    column so that it reaches the parquet scan."""
    lo = F.to_timestamp_ntz(F.lit(f"{first}-01-01 00:00:00"))
    hi = F.to_timestamp_ntz(F.lit(f"{last + 1}-01-01 00:00:00"))
    if dict(df.dtypes)[ts] != "timestamp_ntz":
        lo, hi = lo.cast(dict(df.dtypes)[ts]), hi.cast(dict(df.dtypes)[ts])
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))


def daily(
    df: DataFrame,
    keys: list[str],
    ts: str,
    reduce: dict[str, tuple[str | Column, str]],
    calendar: tuple[str, str] | None = None,
) -> DataFrame:
    """Daily reduction: ``reduce`` maps output name -> (value, "sum" | "mean").

    Sums skip nulls and are 0 when nothing is present; means are null then. ``calendar``
    (first, last day) adds the missing days of every key, as a regular resample would.
    All outputs come from one shuffle, after partial aggregation next to the scan.
    """
    bad = sorted({how for _, how in reduce.values()} - {"sum", "mean"})
    if bad:
        raise ValueError(f"unknown daily reduction {bad}")
    rows = df.select(
        *keys, F.to_date(ts).alias("date"),
        *[fn.as_col(v).alias(f"_{name}") for name, (v, _) in reduce.items()],
    )
    if calendar is not None:
        first, last = (F.to_date(F.lit(d)) for d in calendar)
        days = df.select(*keys).distinct().withColumn("date", F.explode(F.sequence(first, last)))
        rows = rows.filter(F.col("date").between(first, last)).unionByName(
            days, allowMissingColumns=True
        )
    return rows.groupBy(*keys, "date").agg(
        *[
            (
                F.coalesce(F.sum(f"_{name}"), F.lit(0)) if how == "sum" else F.avg(f"_{name}")
            ).alias(name)
            for name, (_, how) in reduce.items()
        ]
    )


def daily_variables(hourly: DataFrame, keys: list[str], variables: list[str], ts: str = "valid_time") -> DataFrame:
    """Daily table of reanalysis variables by their own rules; ``ws100`` is the speed of
    the two wind components, taken per hour before averaging."""
    source = {"ws100": fn.wind_speed("u100", "v100")}
    return daily(
        hourly, keys, ts,
        {v: (source.get(v, F.col(v)), DAILY_RULE.get(v, "mean")) for v in variables},
    )


GATHER_ROWS = 1 << 20  # rows a task holds before it adds them up


def _partial_sums(keys: list[str], values: list[str], gather: int):
    """Adds up the rows of a task by ``keys``, about ``gather`` rows and as many sums at a time."""
    sums = [(v, how) for v in values for how in ("sum", "count")]

    def added(batches: list[pa.RecordBatch], held: pa.Table | None) -> pa.Table:
        table = pa.Table.from_batches(batches).group_by(keys).aggregate(sums)
        if held is None:
            return table
        again = [(f"{v}_{how}", "sum") for v, how in sums]
        both = pa.concat_tables([held, table]).group_by(keys).aggregate(again)
        return both.rename_columns([c.removesuffix("_sum") if c.endswith(("_sum_sum", "_count_sum")) else c for c in both.column_names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows, held = 0, None
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= gather:
                held, waiting, rows = added(waiting, held), [], 0
                if held.num_rows >= gather:
                    yield from held.to_batches()
                    held = None
        if waiting:
            held = added(waiting, held)
        if held is not None:
            yield from held.to_batches()

    return run


def daily_in_place(hourly: DataFrame, keys: list[str], variables: list[str], parts: int, ts: str = "valid_time",
                   gather: int = GATHER_ROWS) -> DataFrame:
    """:func:`daily_variables` with the days of a key together in one of ``parts`` partitions, from one exchange.

    A group-by on key and day would deal rows out by both, and storing the result by key would deal it out
    again. Here every task adds up what it reads by key and day, in Arrow; only those sums are dealt out,
    by key alone, and added up where they arrive.
    """
    source = {"ws100": fn.wind_speed("u100", "v100")}
    rows = hourly.select(*keys, F.to_date(ts).alias("date"), *[source.get(v, F.col(v)).cast("double").alias(v) for v in variables])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in variables]
    partial = rows.mapInArrow(
        _partial_sums([*keys, "date"], variables, gather),
        ", ".join(fields + [f"`{v}_sum` double, `{v}_count` long" for v in variables]))

    def final(v: str) -> Column:
        total, n = F.sum(f"{v}_sum"), F.sum(f"{v}_count")
        return F.coalesce(total, fn.dbl(0)) if DAILY_RULE.get(v, "mean") == "sum" else fn.safe_ratio(total, n)

    return partial.repartition(parts, *[F.col(k) for k in keys]).groupBy(*keys, "date").agg(*[final(v).alias(v) for v in variables])


def noleap(df: DataFrame, date: str = "date") -> DataFrame:
    """Drop 29 February and number the days 1..365."""
    return df.filter(~fn.is_leap_day(date)).withColumn("doy", fn.noleap_doy(date))


def doy_climatology(df: DataFrame, keys: list[str], values: list[str], date: str = "date") -> DataFrame:
    """Mean per day of year over all years, leap days left out."""
    return noleap(df, date).groupBy(*keys, "doy").agg(*[F.avg(v).alias(v) for v in values])


def annual_mean(climatology: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean over the day-of-year climatology."""
    return climatology.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def join_series(a: DataFrame, b: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Inner alignment of two daily series on cell and date."""
    return a.join(b, [*keys, date], "inner")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over pairs where both are present; null when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def complementarity(df: DataFrame, keys: list[str], wind: str, solar: str, date: str = "date") -> DataFrame:
    """Correlation of daily wind and solar per cell, leap days left out."""
    return (
        df.filter(~fn.is_leap_day(date))
        .groupBy(*keys)
        .agg(pearson(F.col(wind), F.col(solar)).alias("complementarity"))
    )


def season_coverage(df: DataFrame, keys: list[str], date: str = "date", start_month: int = 7) -> DataFrame:
    """Distinct days per 12-month window, and whether the window is whole."""
    return (
        df.groupBy(*keys, fn.season_year(date, start_month).alias("year"))
        .agg(F.count_distinct(date).alias("n_days"))
        .withColumn("complete", F.col("n_days").isin(365, 366))
    )


def degree_day_demand(
    daily_kelvin: DataFrame, keys: list[str], temperature: str, date: str = "date",
    heat_below: float = 14.0, cool_above: float = 22.0,
    per_heat: float = 0.6, per_cool: float = 0.7,
) -> DataFrame:
    """Heating and cooling demand summed over the temperature climatology (deg C).

    Days of year run on the calendar as it is (leap days included), as the
    temperature indicator is defined.
    """
    celsius = F.avg(F.col(temperature)) - fn.dbl(273.15)
    clim = daily_kelvin.groupBy(*keys, F.dayofyear(date).alias("doy")).agg(celsius.alias("_t"))
    t = F.col("_t")
    heat = F.when(t < heat_below, (fn.dbl(heat_below) - t) * fn.dbl(per_heat)).otherwise(fn.dbl(0))
    cool = F.when(t > cool_above, (t - fn.dbl(cool_above)) * fn.dbl(per_cool)).otherwise(fn.dbl(0))
    return clim.groupBy(*keys).agg(F.sum(heat + cool).alias("demand_temperature"))
