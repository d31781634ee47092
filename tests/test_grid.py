import math

import pytest
from pyspark.sql import functions as F

from heliogale.config import Grid, steps
from heliogale.functions import columns as fn
from heliogale.operators import grid


def test_tiles_cover_the_domain_and_may_overshoot(spark, rows):
    t = grid.tiles(grid.domain(spark, (-20, -10, 10, 20)), 20.0)
    assert rows(t, "minx", "miny", "maxx", "maxy") == [
        (-20.0, -10.0, 0.0, 10.0), (-20.0, 10.0, 0.0, 30.0), (0.0, -10.0, 20.0, 10.0), (0.0, 10.0, 20.0, 30.0)]
    assert grid.tiles(grid.domain(spark, (-180, -60, 180, 80)), 20.0).count() == 126


def test_cells_are_half_open_so_tiling_is_a_partition(spark, rows):
    whole = grid.cells(grid.tiles(grid.domain(spark, (0, 0, 2, 2)), 2.0), 0.5)
    parts = grid.cells(grid.tiles(grid.domain(spark, (0, 0, 2, 2)), 1.0), 0.5)
    assert rows(whole, "latitude", "longitude") == rows(parts, "latitude", "longitude")
    assert whole.count() == 16
    lat = [r[0] for r in whole.select("latitude").distinct().orderBy("latitude").collect()]
    assert lat == [0.5, 1.0, 1.5, 2.0]


def test_cell_count_of_the_default_domain():
    g = Grid.from_bounds((-180.0, -60.0, 180.0, 80.0))
    assert (g.n_lon, g.n_lat) == (1440, 560)
    assert steps(1.0, 0.3) == 4 and steps(0.9, 0.3) == 3


@pytest.mark.parametrize(
    "box,want",
    [
        ((-2, -1, 2, 1), [-2, -1, 0, 1]),  # prime meridian
        ((178, -1, -178, 1), [-180, -179, 178, 179]),  # antimeridian
        ((-180, -1, 180, 1), list(range(-180, 180))),  # whole circle
        ((5, -1, 5, 1), []),  # empty
    ],
)
def test_box_across_the_seams(spark, box, want):
    df = spark.range(-180, 180).select(F.col("id").cast("double").alias("longitude"), F.lit(0.5).alias("latitude"))
    assert [int(r[0]) for r in grid.bbox(df, box).orderBy("longitude").select("longitude").collect()] == want


def test_box_latitude_sides(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "latitude double").withColumn("longitude", F.lit(0.0))
    assert [r[0] for r in grid.bbox(df, (-1, 2, 1, 0)).select("latitude").collect()] == [1.0, 2.0]


def test_pixel_area_matches_the_closed_form_and_the_whole_earth(spark):
    bands = spark.range(720).select(((F.col("id") - 359.5) / 4).alias("lat"))
    total = bands.agg(F.sum(fn.pixel_area_m2("lat", 0.25) * 1440)).first()[0]
    assert total == pytest.approx(5.10065622e14, rel=1e-8)
    poles = spark.range(1).select(fn.pixel_area_m2(F.lit(60.0), 1.0), fn.pixel_area_m2(F.lit(-60.0), 1.0)).first()
    assert poles[0] == pytest.approx(poles[1])


def test_cell_area_uses_the_mean_step_or_a_quarter_degree(spark):
    one = spark.createDataFrame([(10.0,)], "latitude double")
    two = spark.createDataFrame([(10.0,), (10.5,)], "latitude double")
    a = grid.cell_area_km2(one).first()["area_km2"]
    b = grid.cell_area_km2(two).filter("latitude = 10").first()["area_km2"]
    assert b / a == pytest.approx(4.0, rel=1e-3)


def test_snap_ties_take_the_larger_coordinate_and_clamp(spark):
    g = Grid(0.0, 10.0, 1.0, 3, 3)
    df = spark.createDataFrame([(0.5, 9.5), (-7.0, 99.0), (50.0, -99.0), (None, 1.0)], "longitude double, latitude double")
    got = df.select(*[c.alias(k) for k, c in grid.snap(g).items()]).collect()
    assert [tuple(r) for r in got] == [(0, 1), (0, 0), (2, 2), (None, None)]


def test_nearest_and_bilinear(spark, rows):
    g = Grid(0.0, 1.0, 1.0, 2, 2)
    src = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0)], "lat_i int, lon_i int, v double")
    pts = spark.createDataFrame(
        [("mid", 0.5, 0.5), ("edge", 0.0, 1.0), ("far", 0.0, 9.0), ("corner", 0.25, 0.75)],
        "id string, latitude double, longitude double")
    near = {r["id"]: r["v"] for r in grid.nearest_join(pts, src, g, ["v"]).collect()}
    assert near == {"mid": 3.0, "edge": 7.0, "far": 7.0, "corner": 7.0}
    flat = {r["id"]: r["v"] for r in grid.bilinear_join(pts, src, g, "v").collect()}
    assert flat["mid"] == pytest.approx(4.0) and flat["edge"] == pytest.approx(7.0)
    assert flat["far"] is None and flat["corner"] == pytest.approx(1 + 0.75 * 2 + 0.75 * 4)
    holed = grid.bilinear_join(pts, src.filter("v < 7"), g, "v")
    assert all(r["v"] is None for r in holed.filter("id <> 'far'").collect())


def test_raster_average_skips_nodata_and_keeps_all_null_cells_null(spark, rows):
    g = Grid(0.5, -0.5, 2.0, 2, 1)
    px = spark.createDataFrame(
        [(0.0, 0.0, 1.0), (1.0, 0.0, 3.0), (0.0, -1.0, None), (2.0, 0.0, None), (9.0, 0.0, 5.0)],
        "x double, y double, value double")
    assert rows(grid.raster_reduce(px, g, ["value"])) == [(0, 0, 2.0), (0, 1, None)]
    assert rows(grid.raster_reduce(px, g, ["value"], "sum")) == [(0, 0, 4.0), (0, 1, None)]
    with pytest.raises(ValueError):
        grid.raster_reduce(px, g, ["value"], "first")


def test_mode_and_median_of_cells(spark, rows):
    import random
    import statistics

    g = Grid(1.5, -1.5, 4.0, 3, 3)
    rng = random.Random(4)
    px, held = [], {}
    for k in range(3000):  # one cell with most of the pixels, one of nodata only, one of a single value
        i, j = (0, 0) if k % 2 else (rng.randrange(3), rng.randrange(3))
        v = None if (i, j) == (2, 2) or rng.random() < 0.05 else 7.0 if (i, j) == (1, 1) else float(rng.randrange(-4, 9))
        px.append((j * 4.0 + rng.randrange(4), -i * 4.0 - rng.randrange(4), v, float("nan") if v == 3 else v))
        held.setdefault((i, j), []).append((px[-1][2], None if v == 3 else v))
    df = spark.createDataFrame(px, "x double, y double, a double, b double")

    def want(of):
        out = []
        for (i, j), some in held.items():
            columns = [[v[c] for v in some if v[c] is not None] for c in (0, 1)]
            out.append((i, j, *[of(c) if c else None for c in columns]))
        return sorted(out)

    mode = lambda c: min(v for v in set(c) if c.count(v) == max(map(c.count, set(c))))
    assert rows(grid.raster_reduce(df, g, ["a", "b"], "mode"), "lat_i", "lon_i", "a", "b") == want(mode)
    assert rows(grid.raster_reduce(df, g, ["a", "b"], "median"), "lat_i", "lon_i", "a", "b") == want(statistics.median)
    for how in ("mode", "median"):
        assert grid.raster_reduce(df.limit(0), g, ["a"], how).count() == 0


def test_weighted_average_splits_a_pixel_over_cells(spark, rows):
    g = Grid(0.25, 0.0, 1.5, 2, 1)  # cells [-0.5, 1.0) and [1.0, 2.5)
    px = spark.createDataFrame([(0.0, 0.0, 2.0), (1.0, 0.0, 8.0), (2.0, 0.0, 4.0)], "x double, y double, value double")
    got = rows(grid.raster_average_weighted(px, g, "value", 1.0))
    assert got == [(0, 0, round((2 + 0.5 * 8) / 1.5, 9)), (0, 1, round((0.5 * 8 + 4) / 1.5, 9))]


def test_merge_and_prefer_filled_and_duplicates(spark, rows):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "lat_i int, lon_i int, solar double")
    b = spark.createDataFrame([(0, 2, 5.0)], "lat_i int, lon_i int, wind double")
    merged = grid.merge_cells([a, b])
    assert rows(merged) == [(0, 0, 1.0, None), (0, 1, None, None), (0, 2, None, 5.0)]
    filled = spark.createDataFrame([(0, 1, 9.0)], "lat_i int, lon_i int, solar double")
    assert rows(grid.prefer_filled(a, filled, "solar")) == [(0, 0, 1.0), (0, 1, 9.0)]
    assert rows(grid.duplicate_cells(a.union(a))) == [(0, 0, 2), (0, 1, 2)]


def test_longitude_and_clip_and_bands(spark):
    r = spark.range(1).select(
        fn.lon180(F.lit(190.0)), fn.lon180(F.lit(-190.0)), fn.lon360(F.lit(-10.0)), fn.clip(F.lit(None).cast("double"), 0, 1),
        fn.clip(F.lit(3.0), 0, 1), fn.lat_band(F.lit(-13.0)), fn.finite(F.lit(float("nan"))), fn.wind_speed(F.lit(3.0), F.lit(4.0)),
        fn.has_data(F.lit(None).cast("double")), fn.joules_to_watts(F.lit(86400.0), "daily_sum"),
    ).first()
    assert list(r) == [-170.0, 170.0, 350.0, None, 1.0, 12, None, 5.0, False, 1.0]
    with pytest.raises(ValueError):
        fn.joules_to_watts(F.lit(1.0), "weekly")
    assert math.isclose(fn.ELLIPSOID_A, 6378137)


@pytest.mark.parametrize("box", [(10, 0, 20, 5), (-5, 0, 5, 5), (170, 0, 190, 5)])
@pytest.mark.parametrize("stored", [0, -180])
def test_longitude_reaches_the_scan(spark, tmp_path, box, stored):
    path = str(tmp_path / "lon")
    spark.range(360).select((F.col("id") + stored).cast("double").alias("longitude"), F.lit(2.0).alias("latitude")).write.parquet(path)
    out = grid.bbox(spark.read.parquet(path), box)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Or(And(" in plan.split("PushedFilters:")[1].split("ReadSchema")[0].replace("Or(Or(Or(", "Or(").replace("Or(Or(", "Or(")
    want = {x % 360 for x in range(box[0], box[2])}
    assert {int(r["longitude"]) % 360 for r in out.collect()} == want


def test_nearest_cells_of_finer_and_coarser_source(spark, rows):
    g = Grid(0.0, 2.0, 1.0, 3, 3)
    for step, n in ((0.5, 7), (2.0, 3)):
        source = spark.range(n * n).select(
            (3.0 - F.floor(F.col("id") / n) * step).alias("latitude"), (F.col("id") % n * step - 0.5).alias("longitude"), "id")
        out = grid.nearest_cells(source, source, g)
        got = {(r["lat_i"], r["lon_i"]): (r["latitude"], r["longitude"]) for r in out.collect()}
        assert len(got) == out.count() == 9
        lats, lons = [3.0 - k * step for k in range(n)], [k * step - 0.5 for k in range(n)]
        near = lambda x, axis: min(sorted(axis, reverse=True), key=lambda a: abs(a - x))
        assert got == {(i, j): (near(2.0 - i, lats), near(float(j), lons)) for i in range(3) for j in range(3)}
