import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogale.functions import columns as fn
from heliogale.operators import storage, timeseries


def days(spark, first, last):
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date"))


def test_daily_sum_mean_and_calendar(spark, rows):
    ts = [("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 05:00:00", 3.0), ("a", "2024-01-03 00:00:00", None)]
    df = spark.createDataFrame(ts, "k string, t string, v double").withColumn("ts", F.to_timestamp_ntz("t"))
    out = timeseries.daily(df, ["k"], "ts", {"s": ("v", "sum"), "m": ("v", "mean")}, ("2024-01-01", "2024-01-03"))
    d = dt.date
    assert rows(out) == [("a", d(2024, 1, 1), 4.0, 2.0), ("a", d(2024, 1, 2), 0.0, None), ("a", d(2024, 1, 3), 0.0, None)]
    with pytest.raises(ValueError):
        timeseries.daily(df, ["k"], "ts", {"s": ("v", "median")})


def test_wind_speed_is_taken_per_hour_before_the_mean(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, h), u, 0.0, 2.0) for h, u in ((0, 3.0), (1, -3.0))],
        "k int, valid_time timestamp, u100 double, v100 double, ssrd double")
    r = timeseries.daily_variables(df, ["k"], ["ws100", "ssrd"]).first()
    assert (r["ws100"], r["ssrd"]) == (3.0, 4.0)


def test_year_range_holds_the_whole_last_day_and_is_pushed_down(spark, tmp_path):
    df = spark.createDataFrame(
        [(dt.datetime(2022, 12, 31, 23),), (dt.datetime(2023, 1, 1),), (dt.datetime(2024, 12, 31, 23),), (dt.datetime(2025, 1, 1),)],
        "ts timestamp")
    df.write.parquet(str(tmp_path / "t"))
    out = timeseries.year_range(spark.read.parquet(str(tmp_path / "t")), "ts", 2023, 2024)
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_noleap_day_numbers(spark):
    r = {str(x["date"]): x["doy"] for x in timeseries.noleap(days(spark, "2024-01-01", "2024-12-31")).collect()}
    assert len(r) == 365 and "2024-02-29" not in r
    assert (r["2024-02-28"], r["2024-03-01"], r["2024-12-31"]) == (59, 60, 365)
    plain = {x["doy"] for x in timeseries.noleap(days(spark, "2023-01-01", "2023-12-31")).collect()}
    assert plain == set(range(1, 366))


def test_climatology_and_annual_mean(spark, rows):
    df = days(spark, "2023-01-01", "2024-12-31").withColumns({"k": F.lit(1), "v": F.year("date") - F.lit(2000.0)})
    clim = timeseries.doy_climatology(df, ["k"], ["v"])
    assert clim.count() == 365 and clim.agg(F.min("v"), F.max("v")).first() == (23.5, 23.5)
    assert rows(timeseries.annual_mean(clim, ["k"], ["v"])) == [(1, 23.5)]


def test_complementarity_is_pairwise_and_null_for_constants(spark):
    d = days(spark, "2023-01-01", "2023-01-10").withColumn("i", F.dayofmonth("date").cast("double"))
    d = d.withColumns({"k": F.lit(1), "w": F.when(F.col("i") != 3, F.col("i")), "s": 10 - F.col("i"), "c": F.lit(4.0)})
    assert timeseries.complementarity(d, ["k"], "w", "s").first()[1] == pytest.approx(-1.0)
    assert timeseries.complementarity(d, ["k"], "w", "c").first()[1] is None


def test_season_year_and_coverage(spark, rows):
    df = days(spark, "2023-06-30", "2024-07-01").withColumn("k", F.lit(1))
    got = rows(timeseries.season_coverage(df, ["k"]), "year", "n_days", "complete")
    assert got == [(2022, 1, False), (2023, 366, True), (2024, 1, False)]


def test_degree_days(spark):
    df = days(spark, "2023-01-01", "2023-01-03").withColumns(
        {"k": F.lit(1), "t": F.element_at(F.array(F.lit(283.15), F.lit(293.15), F.lit(303.15)), F.dayofmonth("date"))})
    out = timeseries.degree_day_demand(df, ["k"], "t").first()[1]
    assert out == pytest.approx(0.6 * 4 + 0.7 * 8)


# ---- storage ----------------------------------------------------------------
def season(spark, wind, solar, first="2023-07-01"):
    rows = [(1, i, float(w), float(s)) for i, (w, s) in enumerate(zip(wind, solar))]
    df = spark.createDataFrame(rows, "cell int, i int, wind_norm double, solar_norm double")
    return df.withColumn("date", F.date_add(F.to_date(F.lit(first)), F.col("i")))


def brute(w, s, a, cyclic):
    level = np.cumsum(1 - a * np.asarray(w) - (1 - a) * np.asarray(s))
    t = len(level)
    twice = np.concatenate([level, level + level[-1]])
    down = [twice[i] - twice[max(0, i - t + 1): i + 1].min() for i in range(2 * t if cyclic else t)]
    return max(down)


@pytest.mark.parametrize("cyclic", [False, True])
def test_deficit_equals_brute_force(spark, cyclic):
    rng = np.random.default_rng(3)
    w, s = rng.gamma(2, 0.5, 366), 1 + np.sin(np.arange(366) / 58)
    got = storage.deficit(season(spark, w, s), ["cell"], (2023, 2024), cyclic=cyclic)
    for r in got.collect():
        assert r["deficit"] == pytest.approx(brute(w, s, r["alpha"], cyclic), abs=1e-9)
    assert got.count() == 11


def test_cyclic_sees_a_drawdown_across_the_season_seam(spark):
    w = [0.0, 1.0, 3.0, 1.0, 0.0]
    plain, wrapped = (
        storage.deficit(season(spark, w, w), ["cell"], (2023, 2024), cyclic=c, coverage="any").first()["deficit"]
        for c in (False, True))
    assert (plain, wrapped) == (1.0, 2.0)


def test_deficit_extremes(spark):
    ones, none = [1.0] * 365, [0.0] * 365
    full = storage.deficit(season(spark, ones, ones, "2022-07-01"), ["cell"], (2022, 2023))
    assert full.agg(F.max("deficit")).first()[0] == pytest.approx(0.0, abs=1e-9)
    empty = storage.deficit(season(spark, none, none, "2022-07-01"), ["cell"], (2022, 2023))
    assert empty.agg(F.min("deficit")).first()[0] == 364.0


def test_coverage_rules(spark):
    short = season(spark, [1.0] * 5, [1.0] * 5)
    assert storage.deficit(short, ["cell"], (2023, 2024), coverage="complete").count() == 0
    assert storage.deficit(short, ["cell"], (2023, 2024), coverage="any").count() == 11
    with pytest.raises(Exception, match="has 5 days"):
        storage.deficit(short, ["cell"], (2023, 2024)).collect()
    with pytest.raises(ValueError):
        storage.deficit(short, ["cell"], (2023, 2024), coverage="some")


def test_season_filter_is_half_open(spark):
    two = season(spark, [1.0] * 731, [1.0] * 731)
    got = storage.deficit(two, ["cell"], (2023, 2024))
    assert {r["year"] for r in got.collect()} == {2023}


def test_season_range_reaches_the_scan(spark, tmp_path):
    season(spark, [1.0] * 10, [1.0] * 10).write.parquet(str(tmp_path / "d"))
    out = storage.deficit(spark.read.parquet(str(tmp_path / "d")), ["cell"], (2023, 2024), coverage="any")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2023-07-01)" in plan and "LessThan(date,2024-07-01)" in plan


def test_normalise_missing_and_masking(spark, rows):
    daily = spark.createDataFrame([(1, 4.0, None), (2, 4.0, 4.0), (3, 4.0, 4.0)], "cell int, wind double, solar double")
    means = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.0, 2.0)], "cell int, wm double, sm double")
    args = (["cell"], "wind", "solar", "wm", "sm")
    out = storage.normalise(daily, means, *args, ssrd_factor=2.0)
    assert rows(out, "cell", "wind_norm", "solar_norm") == [(1, 2.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 0.0)]
    assert rows(storage.normalise(daily, means, *args, mask_missing=True), "cell") == [(1,)]


def test_aggregate_tie_takes_the_smallest_share_and_null_stays(spark, rows):
    d = [(1, a, y, v) for a, v in ((0.0, 5.0), (0.1, 3.0), (0.2, 3.0)) for y in (1, 2)]
    d += [(2, 0.0, 1, None), (2, 0.1, 1, None), (3, 0.0, 1, None), (3, 0.1, 1, 8.0)]
    df = spark.createDataFrame(d, "cell int, alpha double, year int, deficit double")
    assert rows(storage.aggregate(df, ["cell"])) == [(1, 3.0, 0.1), (2, None, None), (3, 8.0, 0.1)]
    assert rows(storage.aggregate(df, ["cell"], "max", 0.0)) == [(1, 5.0, 0.0), (2, None, 0.0), (3, None, 0.0)]


def test_aggregate_p99_interpolates_and_rejects_bad_arguments(spark):
    df = spark.createDataFrame([(1, 0.5, y, float(y)) for y in range(11)], "cell int, alpha double, year int, deficit double")
    assert storage.aggregate(df, ["cell"], "p99").first()["duration_metric"] == pytest.approx(9.9)
    with pytest.raises(ValueError):
        storage.aggregate(df, ["cell"], "median")
    with pytest.raises(ValueError):
        storage.aggregate(df, ["cell"], fixed_alpha=0.55)


def test_share_sweep_adds_no_shuffle(spark):
    """The sweep over eleven shares shuffles the daily rows as often as one share does."""
    df = season(spark, [1.0] * 365, [1.0] * 365)

    def shuffles(alphas):
        plan = storage.deficit(df, ["cell"], (2023, 2024), alphas=alphas)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    assert shuffles((0.5,)) == shuffles(tuple(i / 10 for i in range(11))) == 1
    assert fn.season_year("date") is not None


def test_daily_in_place_is_the_same_from_one_exchange(spark, rows):
    import datetime

    hours = [(datetime.datetime(2023, 1, 1 + h // 24, h % 24), c, float(h % 5), 1.0, None if h % 3 else float(h), None if c == 2 else h * 1.5)
             for h in range(72) for c in range(4)]
    df = spark.createDataFrame(hours, "valid_time timestamp_ntz, cell int, u100 float, v100 float, ssrd float, t2m double").repartition(5)
    names = ["ws100", "ssrd", "t2m"]
    want = rows(timeseries.daily_variables(df, ["cell"], names), "cell", "date", *names)
    for gather in (1, 7, 1 << 20):
        out = timeseries.daily_in_place(df, ["cell"], names, 3, gather=gather)
        assert rows(out, "cell", "date", *names) == want
    plan = timeseries.daily_in_place(df, ["cell"], names, 3)._jdf.queryExecution().executedPlan().toString()
    by_cell = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(by_cell) == 1 and "date" not in by_cell[0]
    assert timeseries.daily_in_place(df.limit(0), ["cell"], names, 3).count() == 0
