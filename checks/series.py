"""Daily reduction, climatology, correlation and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import DAILY_SQL, SITES_SQL, daily_series, site_series, table
from heliogale.config import ALPHAS
from heliogale.functions import columns as fn
from heliogale.operators import storage, timeseries

YEARS = (1995, 2001)


@query("daily_resample", """
SELECT CAST(user_id % 50 AS INTEGER) AS cell, ts::DATE AS date,
  round(sum(value), 2) AS total, round(avg(value), 9) AS mean
FROM events WHERE ts >= '2024-01-01' AND ts < '2025-01-01' GROUP BY ALL""")
def daily_resample(spark, sf):
    events = timeseries.year_range(table(spark, sf, "events"), "ts", 2024, 2024)
    rows = events.withColumn("cell", (F.col("user_id") % 50).cast("int"))
    out = timeseries.daily(rows, ["cell"], "ts", {"total": ("value", "sum"), "mean": ("value", "mean")})
    return fn.round_cols(fn.round_cols(out, 2, "total"), 9, "mean")


@query("daily_calendar", """
WITH cells AS (SELECT DISTINCT CAST(user_id AS INTEGER) AS cell FROM events),
days AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY) t(d))
SELECT c.cell, d.date, round(coalesce(sum(value), 0), 2) AS total, round(avg(value), 9) AS mean
FROM cells c CROSS JOIN days d LEFT JOIN events e
  ON e.user_id = c.cell AND e.ts::DATE = d.date
GROUP BY ALL""")
def daily_calendar(spark, sf):
    """Missing days filled: 0 for sums, null for means."""
    rows = table(spark, sf, "events").withColumn("cell", F.col("user_id").cast("int"))
    out = timeseries.daily(
        rows, ["cell"], "ts", {"total": ("value", "sum"), "mean": ("value", "mean")},
        calendar=("2024-01-01", "2024-02-10"),
    )
    return fn.round_cols(fn.round_cols(out, 2, "total"), 9, "mean")


@query("wind_speed", """
SELECT l_returnflag, l_linestatus, count(*) AS n,
  round(avg(sqrt(l_discount * l_discount + l_tax * l_tax)), 6) AS mean_speed,
  round(max(sqrt(l_discount * l_discount + l_tax * l_tax)), 6) AS max_speed,
  round(avg(l_extendedprice / 3600), 4) AS mean_watts,
  round(avg(l_quantity / 9.80665::DOUBLE), 6) AS mean_metres,
  round(avg(l_quantity / 24), 6) AS mean_cf
FROM lineitem GROUP BY ALL""")
def wind_speed(spark, sf):
    rows = table(spark, sf, "lineitem")
    speed = fn.wind_speed("l_discount", "l_tax")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(speed), 6).alias("mean_speed"), F.round(F.max(speed), 6).alias("max_speed"),
        F.round(F.avg(fn.joules_to_watts("l_extendedprice")), 4).alias("mean_watts"),
        F.round(F.avg(fn.geopotential_to_metres("l_quantity")), 6).alias("mean_metres"),
        F.round(F.avg(fn.daily_yield_to_cf("l_quantity")), 6).alias("mean_cf"),
    )


NOLEAP_SQL = f"""
WITH {DAILY_SQL},
v_noleap AS (
  SELECT *, CAST(dayofyear(date) - CASE WHEN dayofyear(make_date(year(date), 12, 31)) = 366
      AND dayofyear(date) > 59 THEN 1 ELSE 0 END AS INTEGER) AS doy
  FROM v_daily WHERE NOT (month(date) = 2 AND day(date) = 29)),
v_clim AS (SELECT cell, doy, avg(wind) AS wind, avg(solar) AS solar FROM v_noleap GROUP BY ALL)"""


def _climatology(spark, sf):
    return timeseries.doy_climatology(daily_series(spark, sf), ["cell"], ["wind", "solar"])


@query("doy_climatology", NOLEAP_SQL + """
SELECT cell, doy, round(wind, 6) AS wind, round(solar, 6) AS solar FROM v_clim""")
def doy_climatology(spark, sf):
    return fn.round_cols(_climatology(spark, sf), 6, "wind", "solar")


@query("annual_mean", NOLEAP_SQL + """
SELECT cell, round(avg(wind), 4) AS wind, round(avg(solar), 3) AS solar FROM v_clim GROUP BY ALL""")
def annual_mean(spark, sf):
    out = timeseries.annual_mean(_climatology(spark, sf), ["cell"], ["wind", "solar"])
    return fn.round_cols(fn.round_cols(out, 4, "wind"), 3, "solar")


@query("complementarity", NOLEAP_SQL + """
SELECT cell, round(corr(wind, solar), 6) AS complementarity FROM v_noleap GROUP BY ALL""")
def complementarity(spark, sf):
    """Two series aligned on cell and date, then correlated."""
    both = daily_series(spark, sf)
    wind, solar = both.select("cell", "date", "wind"), both.select("cell", "date", "solar")
    aligned = timeseries.join_series(wind, solar, ["cell"])
    return fn.round_cols(timeseries.complementarity(aligned, ["cell"], "wind", "solar"), 6, "complementarity")


@query("coverage_check", f"""
WITH {DAILY_SQL}
SELECT cell, CAST(year(date) - CASE WHEN month(date) >= 7 THEN 0 ELSE 1 END AS INTEGER) AS year,
  count(DISTINCT date) AS n_days, count(DISTINCT date) IN (365, 366) AS complete
FROM v_daily GROUP BY ALL""")
def coverage_check(spark, sf):
    return timeseries.season_coverage(daily_series(spark, sf), ["cell"])


# ---- storage ----------------------------------------------------------------
def _lds_sql(source: str) -> str:
    return f"""
WITH {source},
v_doy AS (SELECT cell, dayofyear(date) - CASE WHEN dayofyear(make_date(year(date), 12, 31)) = 366
      AND dayofyear(date) > 59 THEN 1 ELSE 0 END AS doy, avg(wind) AS wind, avg(solar) AS solar
  FROM v_daily WHERE NOT (month(date) = 2 AND day(date) = 29) GROUP BY ALL),
v_mean AS (SELECT cell, avg(wind) AS wind_mean, avg(solar) AS solar_mean FROM v_doy GROUP BY cell),
v_alpha AS (SELECT a / 10::DOUBLE AS alpha FROM range(11) t(a)),
v_season AS (
  SELECT d.cell, d.date, year(date) - CASE WHEN month(date) >= 7 THEN 0 ELSE 1 END AS year, alpha,
    1 - (alpha * coalesce(wind / nullif(wind_mean, 0), 0)
      + (1 - alpha) * coalesce(solar / nullif(solar_mean, 0), 0)) AS gap
  FROM v_daily d JOIN v_mean m USING (cell) CROSS JOIN v_alpha),
v_level AS (
  SELECT *, sum(gap) OVER w AS level, row_number() OVER w AS k,
    count(*) OVER (PARTITION BY cell, year, alpha) AS t,
    sum(gap) OVER (PARTITION BY cell, year, alpha) AS total
  FROM v_season WHERE year >= 1995 AND year < 2001
  WINDOW w AS (PARTITION BY cell, year, alpha ORDER BY date ROWS UNBOUNDED PRECEDING)),
v_drop AS (
  SELECT *, level - min(level) OVER (PARTITION BY cell, year, alpha ORDER BY k ROWS UNBOUNDED PRECEDING) AS down
  FROM v_level),
v_deficit AS (SELECT cell, year, alpha, max(down) AS deficit FROM v_drop GROUP BY ALL)"""


def _deficit(spark, sf, cyclic: bool = False, series=daily_series):
    daily = series(spark, sf)
    clim = timeseries.doy_climatology(daily, ["cell"], ["wind", "solar"])
    means = timeseries.annual_mean(clim, ["cell"], ["wind", "solar"]).toDF("cell", "wind_mean", "solar_mean")
    return storage.deficit_from_daily(daily, means, ["cell"], YEARS, cyclic=cyclic, coverage="any")


_DEFICIT_OUT = """
SELECT cell, alpha, CAST(year AS INTEGER) AS year, round(deficit, 6) AS deficit FROM v_deficit"""


@query("lds_deficit", _lds_sql(DAILY_SQL) + _DEFICIT_OUT)
def lds_deficit(spark, sf):
    return fn.round_cols(_deficit(spark, sf), 6, "deficit")


@query("lds_sites", _lds_sql(SITES_SQL) + _DEFICIT_OUT)
def lds_sites(spark, sf):
    return fn.round_cols(_deficit(spark, sf, series=site_series), 6, "deficit")


@query("lds_cyclic", _lds_sql(DAILY_SQL) + """,
v_twice AS (
  SELECT cell, year, alpha, t, k, level FROM v_level UNION ALL
  SELECT cell, year, alpha, t, k + t, level + total FROM v_level),
v_rolled AS (
  SELECT *, level - min(level) OVER (PARTITION BY cell, year, alpha ORDER BY k
      ROWS BETWEEN (t - 1) PRECEDING AND CURRENT ROW) AS down
  FROM v_twice)
SELECT cell, alpha, CAST(year AS INTEGER) AS year, round(max(down), 6) AS deficit
FROM v_rolled GROUP BY cell, alpha, year""")
def lds_cyclic(spark, sf):
    return fn.round_cols(_deficit(spark, sf, cyclic=True), 6, "deficit")


_AGG = {"mean": "avg(deficit)", "p99": "quantile_cont(deficit, 0.99)", "max": "max(deficit)"}


def _register_aggregate(metric: str) -> None:
    sql = _lds_sql(DAILY_SQL) + f""",
v_agg AS (SELECT cell, alpha, {_AGG[metric]} AS m FROM v_deficit GROUP BY ALL),
v_best AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY m, alpha) AS rn FROM v_agg)
SELECT cell, round(m, 6) AS duration_metric, alpha AS optimal_alpha FROM v_best WHERE rn = 1"""

    @query(f"lds_aggregate_{metric}", sql)
    def run(spark, sf):
        out = storage.aggregate(_deficit(spark, sf), ["cell"], metric)
        return fn.round_cols(out, 6, "duration_metric")


for _metric in _AGG:
    _register_aggregate(_metric)


@query("lds_fixed_alpha", _lds_sql(DAILY_SQL) + """
SELECT cell, round(avg(deficit), 6) AS duration_metric, 0.3::DOUBLE AS optimal_alpha
FROM v_deficit WHERE abs(alpha - 0.3) <= 1e-6 GROUP BY cell""")
def lds_fixed_alpha(spark, sf):
    out = storage.aggregate(_deficit(spark, sf), ["cell"], "mean", fixed_alpha=ALPHAS[3])
    return fn.round_cols(out, 6, "duration_metric")


@query("heating_cooling", f"""
WITH {DAILY_SQL},
v_clim AS (SELECT cell, dayofyear(date) AS doy, avg(255 + wind % 60) - 273.15::DOUBLE AS t FROM v_daily GROUP BY ALL)
SELECT cell, round(sum(CASE WHEN t < 14 THEN 0.6::DOUBLE * (14 - t) ELSE 0 END
  + CASE WHEN t > 22 THEN 0.7::DOUBLE * (t - 22) ELSE 0 END), 4) AS demand_temperature
FROM v_clim GROUP BY cell""")
def heating_cooling(spark, sf):
    kelvin = daily_series(spark, sf).withColumn("t2m", 255 + F.col("wind") % 60)
    out = timeseries.degree_day_demand(kelvin, ["cell"], "t2m")
    return fn.round_cols(out, 4, "demand_temperature")
