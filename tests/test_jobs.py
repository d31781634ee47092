"""All batch jobs chained on a small made-up world, from rasters and hours to clusters."""

import pytest
from pyspark.sql import functions as F

from heliogale.config import Grid
from heliogale.operators import country, grid, spatial, storage, timeseries, zones
from heliogale.plans import jobs
from heliogale.sources import notes, readers, sinks

AREA = Grid(0.0, 20.0, 2.0, 12, 10)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")

    def save(df, name):
        df.write.parquet(str(root / name))
        return str(root / name)

    cells = spark.range(AREA.n_lat * AREA.n_lon).select(
        (F.col("id") / AREA.n_lon).cast("int").alias("i"), (F.col("id") % AREA.n_lon).cast("int").alias("j"))
    fine = cells.select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q")).select(
        (F.col("j") * 2 + F.col("q") % 2 - 0.5).alias("x"), (20 - F.col("i") * 2 - F.floor(F.col("q") / 2) + 0.5).alias("y"), "i", "j")
    value = {
        "solar": F.when((F.col("i") < 2) & (F.col("j") < 6), -1.0).otherwise(3.0 + F.col("i") * 0.3),
        "wind": 0.1 + F.col("j") * 0.03,
        "built": (F.col("i") * 7 + F.col("j") * 3) % 11 * 1e6 + 1.0,
    }
    # Settlement is known around the area too, as the kernel reaches beyond it.
    around = spark.range((AREA.n_lat + 2) * (AREA.n_lon + 2)).select(
        (F.floor(F.col("id") / (AREA.n_lon + 2)) - 1).cast("int").alias("i"), (F.col("id") % (AREA.n_lon + 2) - 1).cast("int").alias("j"))
    around = around.select((F.col("j") * 2.0).alias("x"), (20.0 - F.col("i") * 2).alias("y"), "i", "j")
    paths = {n: save((around if n == "built" else fine).select("x", "y", v.cast("float").alias("value")), n) for n, v in value.items()}
    day = F.explode(F.sequence(F.to_date(F.lit("2023-01-01")), F.to_date(F.lit("2024-12-31")))).alias("d")
    doy = F.dayofyear("d")
    hours = cells.select("i", "j", day).select("i", "j", "d", F.explode(F.array(F.lit(0), F.lit(12))).alias("h")).select(
        F.to_timestamp_ntz(F.concat(F.col("d").cast("string"), F.format_string(" %02d:00:00", "h"))).alias("valid_time"),
        (20.0 - F.col("i") * 2).alias("latitude"), F.pmod(F.col("j") * 2.0, F.lit(360.0)).alias("longitude"),
        (6 + F.col("j") * 0.2 + 3 * F.sin(doy / 9 + F.col("i"))).cast("float").alias("u100"), F.lit(0.5).cast("float").alias("v100"),
        ((10 + 6 * F.sin(doy / 58.0)) * 1e5 * (1 + F.col("i") / 20)).cast("float").alias("ssrd"),
        (285 + F.col("i") * 1.5 + F.col("j") * 0.3).cast("float").alias("t2m"))
    paths["hourly"] = save(hours, "hourly")

    def ring(x1, y1, x2, y2):
        return [[(x1, y1), (x2, y1), (x2, y2), (x1, y2)]]

    schema = "country_id string, parent_name string, shape_class string, rings array<array<struct<x: double, y: double>>>"
    shapes = [("AAA", "Aland", "land", ring(-1.3, 0.7, 10.9, 21.3)), ("BBB", "Beland", "land", ring(10.9, 0.7, 16.9, 21.3)),
              ("BBB", "Beland", "maritime", ring(16.9, 0.7, 24.9, 21.3)), ("CCC", "Celand", "maritime", ring(-9.0, -9.0, -8.0, -8.0))]
    paths["shapes"] = save(spark.createDataFrame(shapes, schema), "shapes")
    polygon = "region_id int, gridcode int, rings array<array<struct<x: double, y: double>>>"
    belts = [(1, 11, ring(-1.3, 9.1, 24.9, 21.3)), (2, 21, ring(-1.3, 0.7, 24.9, 9.1)), (3, 32, ring(6.9, 0.7, 12.9, 9.1))]
    paths["climate"] = save(spark.createDataFrame(belts, polygon), "climate")
    (root / "codes.csv").write_text("gridcode,koppen\n11,Af\n21,BSh\n32,Cfb\n")
    paths["gridcodes"] = str(root / "codes.csv")
    steps = cells.select("i", "j", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("step")).select(
        F.make_timestamp_ntz(F.lit(2020), F.col("step"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("valid_time"),
        (20.0 - F.col("i") * 2).alias("latitude"), F.pmod(F.col("j") * 2.0, F.lit(360.0)).alias("longitude"),
        (F.col("i") * 100 * 9.80665 + F.col("step") - 1).alias("z"), (F.col("j") * 0.001).alias("tp"))
    for name in ("z", "tp"):
        paths[name] = save(steps.select("valid_time", "latitude", "longitude", name), name)
    land = [(1, ring(-1.3, 0.7, 16.9, 21.3))]
    paths["land"] = save(spark.createDataFrame(land, "region_id int, rings array<array<struct<x: double, y: double>>>"), "land")
    return jobs.Places(str(root / "run")), paths


def test_chain(spark, world, rows):
    places, p = world
    abundance = jobs.build_abundance(spark, places, p["solar"], p["wind"], AREA, nodata=-1.0)
    assert abundance.count() == 120 and abundance.filter("solar_CF is null").count() == 12
    demand = jobs.build_demand(spark, places, p["built"], AREA)
    assert demand.filter("demand is null").count() == 0

    aggregates = []
    keep = grid.axis_values
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(grid, "axis_values", lambda *a: aggregates.append(a) or keep(*a))
        daily = jobs.build_daily(spark, places, p["hourly"], AREA, ["ws100", "ssrd", "t2m"], buckets=4)
    assert len(aggregates) == 1
    assert daily.count() == 120 * 731
    clim = timeseries.doy_climatology(daily, grid.CELL, ["ws100"])
    sweep = storage.deficit(
        daily.select(*grid.CELL, "date", F.lit(1.0).alias("wind_norm"), F.lit(1.0).alias("solar_norm")), grid.CELL, (2023, 2024))
    for df in (clim, timeseries.annual_mean(clim, grid.CELL, ["ws100"]), sweep):  # buckets stand in for shuffles
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    means = jobs.build_climatology(spark, places, ["ws100", "ssrd", "t2m"])
    assert means.count() == 120
    index = jobs.build_complementarity(spark, places)
    assert index.filter("abs(complementarity) <= 1").count() == 120

    best = jobs.build_storage(spark, places)
    assert best.count() == 120 and best.filter("duration_metric < 0 or optimal_alpha is null").count() == 0
    assert spark.read.parquet(places.at("storage")).count() == 120 * 11

    filled = jobs.fill_solar(spark, places, p["land"], AREA, None, p["climate"], p["gridcodes"])
    assert filled.filter("solar_CF is null").count() == 0  # every gap lies on land
    assert filled.columns == abundance.columns

    cells = jobs.build_cells(spark, places, p["land"], AREA, p["climate"], p["gridcodes"])
    assert rows(cells.groupBy("land", "offshore").count()) == [(False, True, 30), (True, False, 90)]
    # One rasterisation gives what masks and climate give apart.
    edges, belts = spatial.edges(spark.read.parquet(p["land"])), spark.read.parquet(p["climate"])
    apart = spatial.climate_overlay(spatial.with_masks(filled, edges, AREA, "wind_CF"), spatial.edges(belts), AREA,
                                    readers.read_gridcodes(spark, p["gridcodes"]), belts)
    same = [*grid.CELL, "land", "offshore", "climate_code"]
    assert rows(cells, *same) == rows(apart, *same) and {r[-1] for r in rows(cells, *same)} == {1, 2, 3}
    zoned = jobs.build_zones(spark, places)
    assert zoned.filter("zone_detailed is null or base is null").count() == 0
    assert rows(zoned.agg(F.min("resource_availability"), F.max("resource_availability")))[0] == (0.0, 1.0)

    shares = jobs.build_shares(spark, places)
    for scheme, zone in jobs.SCHEMES.items():
        for mask, some in (("all", zoned), ("land", zoned.filter("land"))):
            want = zones.group_share(zones.group(some, zones.groups_for(scheme), zone))
            of = shares.filter((F.col("scheme") == scheme) & (F.col("mask") == mask))
            assert rows(of, "base", "subgroup", "percentage") == rows(want, "base", "subgroup", "percentage")
    table, link = jobs.build_climate(spark, places)
    assert table.count() == 6 * 6 and abs(table.agg(F.sum("percentage")).first()[0] - 100) < 1e-9
    assert table.agg(F.sum("n")).first()[0] == zoned.filter("land and base is not null").count()
    assert 0 <= link.first()["cramers_v"] <= 1 and 0 <= link.first()["p_value"] <= 1

    poor = jobs.build_poor_zones(spark, places, p["shapes"], p["z"], p["tp"], AREA, code="S")
    located = spatial.points_in_regions(zoned, spatial.edges(spark.read.parquet(p["shapes"]).filter("shape_class = 'land'"), "country_id"), AREA)
    want = located.groupBy("region_id").agg(
        F.count("*"), F.count_if(F.expr("land and subgroup = 'S'")), F.avg(F.expr("case when land and subgroup = 'S' then lat_i * 100.0D end")),
        F.avg(F.expr("case when land and subgroup = 'S' then lon_i * 0.001D end")))
    assert rows(poor, "iso3", "all_cells", "poor_cells", "elevation", "precipitation", digits=6) == [
        r for r in rows(want, digits=6) if r[0] and r[2]] != []

    both = jobs.build_country(spark, places, p["shapes"], AREA, extra_groups={"ALL": ["AAA", "BBB"]})
    n = {r["iso3"]: r["n_pixels"] for r in both.collect()}
    # cells whose normalised demand is at the floor are missing, as in the source data
    missing = zoned.filter("demand is null").count()
    assert n["ALL"] == n["AAA"] + n["BBB"] == 120 - missing and "CCC" not in n
    land_only = jobs.build_country(spark, places, p["shapes"], AREA, shape_class="land", name="country_land")
    shifts = country.shift(land_only, both, "iso3", ["avg_storage", "resource_demand_corr", "avg_resource"])
    assert set(r["iso3"] for r in shifts.collect()) <= {"AAA", "BBB"}

    rows_out, summary = jobs.build_clusters(spark, places, k=2)
    assert rows_out.count() == 3 and summary.count() == 2

    mapped = jobs.build_country_map(spark, places, p["shapes"], AREA)
    cluster_of = {r["iso3"]: r["cluster"] for r in rows_out.collect()}
    assert mapped.count() == 120 and all(r["cluster"] == cluster_of.get(r["iso3"]) for r in mapped.collect())
    mix = jobs.build_composition(spark, places)
    assert rows(mix.groupBy("cluster").agg(F.sum("percentage")), digits=6) == [(c, 100.0) for c in sorted({cluster_of["AAA"], cluster_of["BBB"]})]
    shifted, by_cluster = jobs.build_shift(spark, places)
    of_land = {r["iso3"]: r for r in land_only.collect()}
    for r in shifted.collect():
        assert abs(r["avg_resource_shift"] - (next(b for b in both.collect() if b["iso3"] == r["iso3"])["avg_resource"] - of_land[r["iso3"]]["avg_resource"])) < 1e-12
        assert r["cluster"] == cluster_of[r["iso3"]]
    assert by_cluster.agg(F.sum("n")).first()[0] == shifted.count() > 0

    reports = jobs.write_reports(spark, places)
    csv = spark.read.csv(reports["zone_shares_land"], header=True, inferSchema=True)
    assert abs(csv.agg(F.sum("percentage")).first()[0] - 100) < 0.1 and len(reports) == 9
    assert spark.read.csv(reports["climate_crosstab"], header=True).count() == 36

    # A second run finds every table and recomputes nothing.
    again = jobs.build_zones(spark, jobs.Places(places.root))
    assert again.count() == 120
    smaller = Grid(0.0, 20.0, 2.0, 6, 10)
    allowed = spark.createDataFrame([("AAA",)], "country_id string")
    for other in (lambda: jobs.build_zones(spark, jobs.Places(places.root, "hourly_mean")),
                  lambda: jobs.build_storage(spark, places, years=(2022, 2023)),
                  lambda: jobs.build_demand(spark, places, p["built"], AREA, null_window="circle"),
                  lambda: jobs.build_climatology(spark, places, ["ws100"]),
                  lambda: jobs.build_complementarity(spark, places, "ws100", "t2m"),
                  lambda: jobs.build_overlay(spark, places, p["shapes"], AREA, p["climate"], p["gridcodes"]),
                  lambda: jobs.fill_solar(spark, places, p["land"], AREA, smaller, p["climate"], p["gridcodes"]),
                  lambda: jobs.build_cells(spark, places, p["land"], smaller, p["climate"], p["gridcodes"]),
                  lambda: jobs.build_country(spark, places, p["shapes"], AREA, allowed, extra_groups={"ALL": ["AAA", "BBB"]}),
                  lambda: jobs.build_clusters(spark, places, k=3),
                  lambda: jobs.build_composition(spark, places, labelled_only=True),
                  lambda: jobs.build_poor_zones(spark, places, p["shapes"], p["z"], p["tp"], AREA)):
        with pytest.raises(sinks.OtherParameters):
            other()
    assert readers.path_exists(spark, places.at("zones") + "/_SUCCESS")
    sinks.write_report(both, places.at("report"), [F.desc("n_pixels")])


def made(spark, places, name):
    """When the files of a stage were written."""
    return notes.Marks(spark).of(places.at(name))


def test_a_changed_source_is_never_answered_by_an_old_table(spark, world):
    places, p = world
    area, years = AREA, (2023, 2024)
    run = jobs.Places(places.root + "_again")
    w = jobs.World(area, p["solar"], p["wind"], p["built"], p["hourly"], p["land"], p["climate"], p["gridcodes"], p["shapes"], p["z"], p["tp"],
                   -1.0, years, extra_groups={"ALL": ["AAA", "BBB"]}, k=2)
    jobs.build_all(spark, run, w)
    stages = ("abundance", "demand", "daily", "cells", "zones", "country", "climate_crosstab", "composition")
    first = {s: made(spark, run, s) for s in stages}
    jobs.build_all(spark, run, w)
    assert {s: made(spark, run, s) for s in stages} == first

    # Another row of built-up land: demand and what follows from it, nothing else.
    spark.createDataFrame([(0.0, 20.0, 5e7)], "x double, y double, value float").write.mode("append").parquet(p["built"])
    for late in (lambda: jobs.build_zones(spark, run), lambda: jobs.build_composition(spark, run), lambda: jobs.build_shares(spark, run)):
        with pytest.raises(sinks.OutdatedInput, match="built has changed"):
            late()
    jobs.build_all(spark, run, w)
    second = {s: made(spark, run, s) for s in stages}
    assert {s for s in stages if second[s] == first[s]} == {"abundance", "daily"}


def test_a_stopped_stage_answers_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(source)
    build = lambda: spark.read.parquet(source)
    assert sinks.computed_once(spark, path, build, {}, [source]).count() == 3
    notes.begin(spark, path)  # as if the task writing it had been lost
    with pytest.raises(sinks.OutdatedInput, match="not finished"):
        sinks.computed_once(spark, str(tmp_path / "next"), build, {}, [path])
    spark.range(2).write.mode("append").parquet(source)
    assert sinks.computed_once(spark, path, build, {}, [source]).count() == 5
    assert sinks.computed_once(spark, str(tmp_path / "next"), lambda: spark.read.parquet(path), {}, [path]).count() == 5
    spark.range(1).write.mode("overwrite").parquet(path)  # by another hand: its note is older than its files
    assert sinks.computed_once(spark, str(tmp_path / "next"), lambda: spark.read.parquet(path), {}, [path]).count() == 1
