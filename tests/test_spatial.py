import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogale.config import Grid
from heliogale.operators import spatial

UNIT = Grid(0.0, 9.0, 1.0, 10, 10)  # x = lon_i, y = 9 - lat_i


def polygon_table(spark, shapes):
    """shapes: list of (region_id, [ring, ...]) with rings as vertex lists."""
    schema = "region_id int, rings array<array<struct<x: double, y: double>>>, kind string"
    data = [(r, [[(float(x), float(y)) for x, y in ring] for ring in rings], str(i)) for i, (r, rings) in enumerate(shapes)]
    return spark.createDataFrame(data, schema)


def lattice(spark, g=UNIT):
    return spark.range(g.n_lat * g.n_lon).select(
        (F.col("id") / g.n_lon).cast("int").alias("lat_i"), (F.col("id") % g.n_lon).cast("int").alias("lon_i"))


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def test_random_polygons_match_the_even_odd_rule(spark):
    rnd = random.Random(4)
    shapes = []
    for r in range(12):
        cx, cy = rnd.uniform(0, 9), rnd.uniform(0, 9)
        turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(rnd.randint(3, 9)))
        ring = [(cx + rnd.uniform(0.5, 6) * math.cos(t), cy + rnd.uniform(0.5, 6) * math.sin(t)) for t in turns]
        shapes.append((r, [ring]))
    # a ring with a hole, and a shape reaching far outside the grid
    shapes.append((20, [[(0.5, 0.5), (8.5, 0.5), (8.5, 8.5), (0.5, 8.5)], [(2.5, 2.5), (6.5, 2.5), (6.5, 6.5), (2.5, 6.5)]]))
    shapes.append((21, [[(-50, -50), (60, -40), (4.3, 70)]]))
    got = {tuple(r) for r in spatial.rasterise(spatial.edges(polygon_table(spark, shapes)), UNIT).collect()}
    want = {(r, i, j) for r, rings in shapes for i in range(10) for j in range(10) if inside(j, 9 - i, rings)}
    assert got == want


def test_vertices_on_lattice_rows_and_closed_rings(spark):
    ring = [(1.5, 2.0), (7.5, 2.0), (4.5, 7.0)]
    for variant in (ring, ring + ring[:1], ring[::-1]):
        got = {(r["lat_i"], r["lon_i"]) for r in spatial.rasterise(
            spatial.edges(polygon_table(spark, [(1, [variant])])), UNIT).collect()}
        assert got == {(i, j) for i in range(10) for j in range(10) if inside(j, 9 - i, [ring])}


def test_overlaps_parts_and_boxes(spark, rows):
    square = [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)]
    moved = [(x + 1, y) for x, y in square]
    two = spatial.edges(polygon_table(spark, [(1, [square]), (2, [moved])]))
    low, high = (spatial.cell_regions(two, UNIT, pick=p) for p in ("lowest", "highest"))
    assert rows(low.groupBy("region_id").count()) == [(1, 9), (2, 3)]
    assert rows(high.groupBy("region_id").count()) == [(1, 3), (2, 9)]
    # two overlapping rows of one region are its union when told apart
    union = spatial.edges(polygon_table(spark, [(1, [square]), (1, [moved])]), part="kind")
    assert spatial.cell_regions(union, UNIT).count() == 12
    boxed = spatial.cell_regions(two, UNIT, boxes={1: (1.0, 1.0, 1.0, 9.0)})
    assert rows(boxed.groupBy("region_id").count()) == [(1, 3), (2, 9)]
    with pytest.raises(ValueError):
        spatial.cell_regions(two, UNIT, pick="any")


def test_masks_partition_the_cells_with_data(spark):
    cells = lattice(spark).withColumn(
        "v", F.when(F.col("lon_i") == 0, None).when(F.col("lon_i") == 1, 0.0).otherwise(1.0))
    e = spatial.edges(polygon_table(spark, [(1, [[(-1.0, 4.5), (20.0, 4.5), (20.0, 20.0), (-1.0, 20.0)]])]))
    land, sea = (m(cells, e, UNIT, "v").count() for m in (spatial.land_mask, spatial.offshore_mask))
    assert (land, sea) == (40, 40)
    both = spatial.with_masks(cells, e, UNIT, "v")
    assert both.filter("land").count() == 40 and both.filter("offshore").count() == 40
    assert both.filter("land and offshore").count() == 0 and both.count() == 100


def test_climate_overlay_codes_and_default(spark, rows):
    square = [(-0.5, -0.5), (1.5, -0.5), (1.5, 1.5), (-0.5, 1.5)]
    e = spatial.edges(polygon_table(spark, [(1, [square]), (2, [[(x + 1, y) for x, y in square]]), (3, [square])]))
    regions = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "region_id int, gridcode int")
    codes = spark.createDataFrame([(10, "Af"), (20, "Dfb"), (30, "ocean")], "gridcode int, climate string")
    out = spatial.climate_overlay(lattice(spark), e, UNIT, codes, regions)
    assert rows(out.groupBy("climate_code").count()) == [(0, 94), (1, 2), (4, 4)]


# ---- kernel -----------------------------------------------------------------
def test_weights_are_the_published_kernel():
    w = spatial.kernel_weights(8)
    assert (w > 0).sum() == 197 and w.sum() == pytest.approx(1.0)
    assert 1 / w[8, 8] == pytest.approx(46.848, abs=1e-3)


def brute_kernel(field, radius, symm, square, wrap=False):
    w = spatial.kernel_weights(radius)
    pad_rows = np.pad(field, ((radius, radius), (0, 0)), **({"mode": "symmetric"} if symm else {"constant_values": np.nan}))
    pad = np.pad(pad_rows, ((0, 0), (radius, radius)),
                 **({"mode": "wrap"} if wrap else {"mode": "symmetric"} if symm else {"constant_values": np.nan}))
    out = np.zeros_like(field)
    for i in range(field.shape[0]):
        for j in range(field.shape[1]):
            win = pad[i:i + 2 * radius + 1, j:j + 2 * radius + 1]
            out[i, j] = (w * win).sum() if square else (w * win)[w > 0].sum()
    return out


@pytest.mark.parametrize("symm,square,wrap", [(True, True, False), (False, True, False), (True, False, False), (True, True, True)])
def test_smoothing_over_block_borders(spark, symm, square, wrap):
    rng = np.random.default_rng(5)
    field = rng.random((23, 19))
    field[4, 15] = np.nan
    g = Grid(0.0, 0.0, 1.0, 19, 23)
    data = [(i, j, None if np.isnan(field[i, j]) else float(field[i, j])) for i in range(23) for j in range(19)]
    cells = spark.createDataFrame(data, "lat_i int, lon_i int, v double")
    out = spatial.kernel_smooth(cells, "v", 3, g, "symm" if symm else "null", wrap, block=6,
                                null_window="square" if square else "circle")
    got = np.full(field.shape, 9.9)
    for r in out.collect():
        got[r["lat_i"], r["lon_i"]] = np.nan if r["smoothed"] is None else r["smoothed"]
    np.testing.assert_allclose(got, brute_kernel(field, 3, symm, square, wrap), atol=1e-12)


def test_constant_field_stays_constant_and_absent_cells_are_missing(spark):
    g = Grid(0.0, 0.0, 1.0, 10, 10)
    flat = lattice(spark, g).withColumn("v", F.lit(2.5))
    out = spatial.kernel_smooth(flat, "v", 2, g, "symm")
    assert out.agg(F.min("smoothed"), F.max("smoothed"), F.count("*")).first() == pytest.approx((2.5, 2.5, 100))
    gap = spatial.kernel_smooth(flat.filter("not (lat_i = 5 and lon_i = 5)"), "v", 2, g, "symm")
    assert gap.filter("smoothed is null").count() == 24 and gap.count() == 99
    for bad in ({"boundary": "zero"}, {"null_window": "ring"}):
        with pytest.raises(ValueError):
            spatial.kernel_smooth(flat, "v", 2, g, **bad)


@pytest.mark.parametrize("wrap", [False, True])
def test_kernel_on_grid_smaller_than_radius(spark, wrap):
    g = Grid(0.0, 0.0, 1.0, 5, 3)
    cells = lattice(spark, g).withColumn("v", (F.col("lat_i") * 5 + F.col("lon_i")).cast("double"))
    out = spatial.kernel_smooth(cells, "v", 8, g, "symm", wrap).toPandas().sort_values(["lat_i", "lon_i"])
    field = np.arange(15.0).reshape(3, 5)
    sides = [(8, 8), (0, 0)], [(0, 0), (8, 8)]
    wide = np.pad(np.pad(field, sides[0], "symmetric"), sides[1], "wrap" if wrap else "symmetric")
    w = spatial.kernel_weights(8)
    want = [[(wide[i : i + 17, j : j + 17] * w).sum() for j in range(5)] for i in range(3)]
    np.testing.assert_allclose(out["smoothed"].to_numpy().reshape(3, 5), want, atol=1e-9)


def test_window_equals_whole_field(spark, rows):
    g = Grid(0.0, 0.0, 1.0, 20, 18)
    cells = lattice(spark, g).withColumn("v", F.sin(F.col("lat_i") * 7.0 + F.col("lon_i")))
    whole = spatial.kernel_smooth(cells, "v", 3, g, "symm").filter("lat_i between 0 and 7 and lon_i between 5 and 12")
    part = spatial.buffered_smooth(cells, "v", 3, g, (0, 7, 5, 12), boundary="symm")
    assert rows(part, "lat_i", "lon_i", "smoothed") == rows(whole, "lat_i", "lon_i", "smoothed")


def test_demand_proximity_joins_settlement_and_surroundings(spark):
    g, wide = Grid(0.0, 0.0, 0.5, 12, 12), Grid(-1.0, 1.0, 0.5, 16, 16)
    px = lattice(spark, wide).select(
        (F.col("lon_i") * 0.5 - 1).alias("x"), (1 - F.col("lat_i") * 0.5).alias("y"), F.lit(1e6).alias("value"))
    out = spatial.demand_proximity(px, g, 1.0)
    assert out.count() == 144 and out.filter("demand is null").count() == 0
    r = out.filter("lat_i = 0 and lon_i = 0").first()
    assert r["settlement_m2"] == 1e6 and r["demand"] == pytest.approx(1e6 / 3.0777e9, rel=1e-2)


def test_settlement_density_of_a_cell_on_the_pole(spark, rows):
    grid = Grid(0.0, 90.0, 1.0, 1, 2)  # centres at 90 and 89
    pixels = spark.createDataFrame([(0.0, 90.0, 5.0), (0.0, 89.0, 5.0)], "x double, y double, value double")
    got = rows(spatial.settlement_density(pixels, grid), "lat_i", "settlement_m2", "settlement_share")
    assert got[0] == (0, 5.0, None)
    assert got[1][:2] == (1, 5.0) and got[1][2] > 0
