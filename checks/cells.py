"""Grids, alignment, rasters, masks, smoothing, normalisation and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import (
    CELLS_SQL, EDGES_SQL, GRID_SQL, PIXELS_SQL, grid_cells, grid_of, masked_cells, pixels,
    polygon_edges, polygons, table,
)
from heliogale.config import Grid
from heliogale.functions import columns as fn
from heliogale.operators import grid, ml, nearest, spatial, stats
from heliogale.plans.quantiles import exact_quantiles, grouped_quantiles

# ---- generation -------------------------------------------------------------
_TILES_SQL = f"""
WITH {GRID_SQL},
v_domain AS (
  SELECT country, min(longitude) AS minx, min(latitude) AS miny, max(longitude) AS maxx, max(latitude) AS maxy
  FROM v_grid GROUP BY country),
v_tiles AS (
  SELECT country, CAST(i AS INTEGER) AS tile_lon, CAST(j AS INTEGER) AS tile_lat,
    minx + i * 1.5::DOUBLE AS minx, miny + j * 1.5::DOUBLE AS miny,
    minx + i * 1.5::DOUBLE + 1.5 AS maxx, miny + j * 1.5::DOUBLE + 1.5 AS maxy
  FROM (SELECT *, unnest(generate_series(0, ceil((maxx - minx) / 1.5)::BIGINT - 1)) AS i FROM v_domain)
  CROSS JOIN LATERAL (SELECT unnest(generate_series(0, ceil((maxy - miny) / 1.5)::BIGINT - 1)) AS j))"""


def _tiles(spark, sf):
    domains = grid_cells(spark, sf).groupBy("country").agg(
        F.min("longitude").alias("minx"), F.min("latitude").alias("miny"),
        F.max("longitude").alias("maxx"), F.max("latitude").alias("maxy"),
    )
    return grid.tiles(domains, 1.5)


@query("tile_grid", _TILES_SQL + " SELECT * FROM v_tiles")
def tile_grid(spark, sf):
    """Tiles over the bounding box of each country's cells."""
    return _tiles(spark, sf)


@query("cell_grid", _TILES_SQL + """
SELECT country, tile_lon, tile_lat, maxy - r * 0.5::DOUBLE AS latitude, minx + c * 0.5::DOUBLE AS longitude
FROM v_tiles, range(3) a(r), range(3) b(c)""")
def cell_grid(spark, sf):
    cells = grid.cells(_tiles(spark, sf), 0.5)
    return cells.select("country", "tile_lon", "tile_lat", "latitude", "longitude")


_AREA_SQL = """
v_area AS (
  SELECT cell, latitude, s,
    sin(radians(latitude + s / 2)) AS a, sin(radians(latitude - s / 2)) AS b,
    sqrt(1 - (6356752.3142::DOUBLE / 6378137.0::DOUBLE) ^ 2) AS e
  FROM v_size),
v_km2 AS (
  SELECT cell, latitude, abs(s / 360 * pi() * 6356752.3142::DOUBLE ^ 2 * (
      (ln((1 + e * a) / (1 - e * a)) / (2 * e) + a / ((1 + e * a) * (1 - e * a)))
    - (ln((1 + e * b) / (1 - e * b)) / (2 * e) + b / ((1 + e * b) * (1 - e * b))))) / 1e6::DOUBLE AS area_km2
  FROM v_area)"""


@query("pixel_area", f"""
WITH {GRID_SQL}, v_size AS (SELECT cell, latitude, 0.25::DOUBLE AS s FROM v_grid), {_AREA_SQL}
SELECT cell, round(area_km2, 3) AS area_km2 FROM v_km2""")
def pixel_area(spark, sf):
    cells = grid_cells(spark, sf)
    return cells.select("cell", F.round(fn.pixel_area_m2("latitude", 0.25) / fn.dbl(1e6), 3).alias("area_km2"))


@query("cell_area", f"""
WITH {GRID_SQL},
v_lat AS (SELECT DISTINCT latitude FROM v_grid),
v_step AS (SELECT avg(abs(latitude - prev)) AS s FROM (
  SELECT latitude, lag(latitude) OVER (ORDER BY latitude DESC) AS prev FROM v_lat)),
v_size AS (SELECT cell, latitude, coalesce(s, 0.25) AS s FROM v_grid, v_step), {_AREA_SQL}
SELECT cell, round(area_km2, 3) AS area_km2 FROM v_km2""")
def cell_area(spark, sf):
    """Pixel size taken from the mean latitude step of the table."""
    out = grid.cell_area_km2(grid_cells(spark, sf).select("cell", "latitude"))
    return fn.round_cols(out.select("cell", "area_km2"), 3, "area_km2")


@query("bbox_wrap", f"""
WITH {GRID_SQL}, v_moved AS (SELECT cell, latitude, longitude + 175 AS longitude FROM v_grid)
SELECT cell, latitude, longitude, ((longitude % 360) + 360) % 360 AS lon360,
  ((((longitude + 180) % 360) + 360) % 360) - 180 AS lon180
FROM v_moved WHERE latitude > 60 AND latitude <= 79.5
  AND (((longitude % 360) + 360) % 360 >= 358 OR ((longitude % 360) + 360) % 360 < 3)""")
def bbox_wrap(spark, sf):
    """A box across the prime meridian."""
    moved = grid_cells(spark, sf).select("cell", "latitude", (F.col("longitude") + 175).alias("longitude"))
    return grid.bbox(moved, (-2, 60, 3, 79.5)).withColumns(
        {"lon360": fn.lon360("longitude"), "lon180": fn.lon180("longitude")}
    )


@query("tile_assign", f"""
WITH {GRID_SQL}
SELECT cell, CAST(floor((longitude + 180) / 2) AS INTEGER) AS tile_lon,
  CAST(ceil((latitude + 60) / 2) - 1 AS INTEGER) AS tile_lat FROM v_grid""")
def tile_assign(spark, sf):
    out = grid.with_tile(grid_cells(spark, sf), (-180.0, -60.0, 180.0, 80.0), 2.0)
    return out.select("cell", "tile_lon", "tile_lat")


# ---- rasters ----------------------------------------------------------------
def _coarse(px, size: int) -> Grid:
    """Coarse cells of size x size pixels, centred so that pixel edges line up."""
    lowest = px.agg(F.min("y")).first()[0]
    return Grid((size - 1) / 2, -(size - 1) / 2, float(size), -(-40 // size), int(-lowest // size) + 1)


@query("raster_average", f"""
WITH {PIXELS_SQL}
SELECT CAST(floor(-y / 4) AS INTEGER) AS lat_i, CAST(floor(x / 4) AS INTEGER) AS lon_i,
  round(avg(value), 6) AS value
FROM v_pixels GROUP BY ALL""")
def raster_average(spark, sf):
    px = pixels(spark, sf)
    return fn.round_cols(grid.raster_reduce(px, _coarse(px, 4), ["value"]), 6, "value")


# Classes in fine pixels, with whole cells of nodata and with ties.
_CLASSES_SQL = """v_class AS (
  SELECT CAST(p_partkey // 40 // 8 AS INTEGER) AS lat_i, CAST(p_partkey % 40 // 8 AS INTEGER) AS lon_i,
    CASE WHEN p_partkey % 29 <> 0 AND (p_partkey // 40 // 8 + p_partkey % 40 // 8) % 4 <> 3 THEN (p_size % 7)::DOUBLE END AS value FROM part)"""


def _classes(spark, sf):
    k = F.col("p_partkey")
    nodata = (k % 29 == 0) | ((F.floor(F.floor(k / 40) / 8) + F.floor(k % 40 / 8)) % 4 == 3)
    return table(spark, sf, "part").select(
        (k % 40).cast("double").alias("x"), (-F.floor(k / 40)).cast("double").alias("y"),
        F.when(~nodata, (F.col("p_size") % 7).cast("double")).alias("value"))


@query("raster_mode", f"""
WITH {_CLASSES_SQL},
v_n AS (SELECT lat_i, lon_i, value, count(value) AS n FROM v_class GROUP BY ALL),
v_r AS (SELECT *, row_number() OVER (PARTITION BY lat_i, lon_i ORDER BY n DESC, value) AS k FROM v_n)
SELECT lat_i, lon_i, value FROM v_r WHERE k = 1""")
def raster_mode(spark, sf):
    """The most frequent class of each cell; the smallest of equally frequent ones."""
    px = _classes(spark, sf)
    return grid.raster_reduce(px, _coarse(px, 8), ["value"], "mode")


@query("raster_median", f"""
WITH {_CLASSES_SQL}
SELECT lat_i, lon_i, quantile_cont(value, 0.5) AS value FROM v_class GROUP BY ALL""")
def raster_median(spark, sf):
    px = _classes(spark, sf)
    return grid.raster_reduce(px, _coarse(px, 8), ["value"], "median")


@query("raster_weighted", f"""
WITH {PIXELS_SQL},
v_part AS (
  SELECT greatest(0, least(x + 0.5, (j + 1) * 2.5::DOUBLE - 0.5) - greatest(x - 0.5, j * 2.5::DOUBLE - 0.5))
       * greatest(0, least(-y + 0.5, (i + 1) * 2.5::DOUBLE - 0.5) - greatest(-y - 0.5, i * 2.5::DOUBLE - 0.5)) AS w,
    i, j, value
  FROM v_pixels, range(16) c(j),
    LATERAL (SELECT unnest([floor(-y / 2.5)::BIGINT - 1, floor(-y / 2.5)::BIGINT, floor(-y / 2.5)::BIGINT + 1]) AS i)
  WHERE value IS NOT NULL)
SELECT CAST(i AS INTEGER) AS lat_i, CAST(j AS INTEGER) AS lon_i, round(sum(w * value) / sum(w), 6) AS value
FROM v_part WHERE w > 1e-9 GROUP BY ALL""")
def raster_weighted(spark, sf):
    """Cells of 2.5 pixels: pixels on a cell edge count in part."""
    px = pixels(spark, sf)
    lowest = px.agg(F.min("y")).first()[0]
    cells = Grid(0.75, -0.75, 2.5, 16, int((-lowest + 0.5) // 2.5) + 1)
    return fn.round_cols(grid.raster_average_weighted(px, cells, "value", 1.0), 6, "value")


@query("atlas_resample", f"""
WITH {PIXELS_SQL}
SELECT CAST(floor(-y / 4) AS INTEGER) AS lat_i, CAST(floor(x / 4) AS INTEGER) AS lon_i,
  round(avg(size) / 24, 6) AS "solar_CF", round(avg(value), 6) AS "wind_CF"
FROM v_pixels GROUP BY ALL""")
def atlas_resample(spark, sf):
    wind, solar = pixels(spark, sf), pixels(spark, sf, "p_size")
    out = grid.resample_atlas(solar, wind, _coarse(wind, 4))
    return fn.round_cols(out, 6, "solar_CF", "wind_CF")


# ---- merging and alignment --------------------------------------------------
@query("merge_outer", f"""
WITH {GRID_SQL},
a AS (SELECT lat_i, lon_i, "wind_CF", "solar_CF" FROM v_grid WHERE "wind_CF" IS NOT NULL),
b AS (SELECT lat_i, lon_i, storage FROM v_grid WHERE storage IS NOT NULL),
f AS (SELECT lat_i, lon_i, demand AS filled FROM v_grid WHERE "solar_CF" IS NULL)
SELECT coalesce(m.lat_i, f.lat_i) AS lat_i, coalesce(m.lon_i, f.lon_i) AS lon_i, "wind_CF",
  coalesce(filled, "solar_CF") AS "solar_CF", storage
FROM (SELECT coalesce(a.lat_i, b.lat_i) AS lat_i, coalesce(a.lon_i, b.lon_i) AS lon_i, "wind_CF", "solar_CF", storage
      FROM a FULL JOIN b ON a.lat_i = b.lat_i AND a.lon_i = b.lon_i) m
FULL JOIN f ON m.lat_i = f.lat_i AND m.lon_i = f.lon_i""")
def merge_outer(spark, sf):
    """Tables over different cell sets merged, then gap-filled values preferred."""
    cells = grid_cells(spark, sf)
    a = cells.filter(F.col("wind_CF").isNotNull()).select("lat_i", "lon_i", "wind_CF", "solar_CF")
    b = cells.filter(F.col("storage").isNotNull()).select("lat_i", "lon_i", "storage")
    filled = cells.filter(F.col("solar_CF").isNull()).select("lat_i", "lon_i", F.col("demand").alias("solar_CF"))
    return grid.prefer_filled(grid.merge_cells([a, b]), filled, "solar_CF")


def _half_degree(cells) -> Grid:
    """A coarser lattice shifted by 0.1 degree over the same area."""
    fine = grid_of(cells)
    return Grid(fine.lon0 + 0.1, fine.lat0 - 0.1, 0.5, 20, max(2, (fine.n_lat + 1) // 2))


def _coarse_source(cells):
    """Blocks of two by two cells averaged onto the coarse lattice."""
    return cells.groupBy(
        F.floor(F.col("lat_i") / 2).cast("int").alias("lat_i"),
        F.floor(F.col("lon_i") / 2).cast("int").alias("lon_i"),
    ).agg(F.avg("solar_CF").alias("coarse"))


_COARSE_SQL = f"""
WITH {GRID_SQL},
v_n AS (SELECT greatest(2, (max(lat_i) + 2) // 2) AS n FROM v_grid),
v_src AS (SELECT lat_i // 2 AS i, lon_i // 2 AS j, avg("solar_CF") AS coarse FROM v_grid GROUP BY ALL)"""


@query("nearest_align", _COARSE_SQL + """
SELECT g.cell, round(s.coarse, 6) AS coarse FROM (
  SELECT cell, greatest(0, least(n - 1, ceil((79.9::DOUBLE - latitude) / 0.5 - 0.5))) AS i,
    greatest(0, least(19, floor((longitude + 179.9::DOUBLE) / 0.5 + 0.5))) AS j FROM v_grid, v_n) g
LEFT JOIN v_src s ON s.i = g.i AND s.j = g.j""")
def nearest_align(spark, sf):
    cells = grid_cells(spark, sf)
    lattice = _half_degree(cells)
    target = cells.select("cell", "latitude", "longitude")
    out = grid.nearest_join(target, _coarse_source(cells), lattice, ["coarse"])
    return fn.round_cols(out.select("cell", "coarse"), 6, "coarse")


# Scattered places: customers and suppliers over the globe, with a crowd at one place and exact ties.
def _scattered(df, key):
    crowd = F.col(key) % 10 == 3
    return df.withColumns({
        "longitude": F.when(crowd, fn.dbl(20)).otherwise((F.col(key) * 7919 % 3600).cast("double") / 10 - 180),
        "latitude": F.when(crowd, fn.dbl(10)).otherwise((F.col(key) * 104729 % 280).cast("double") / 2 - 60),
    })


_SCATTERED = """CASE WHEN {k} % 10 = 3 THEN 20.0::DOUBLE ELSE (({k}::BIGINT * 7919) % 3600)::DOUBLE / 10 - 180 END AS {a}lon,
  CASE WHEN {k} % 10 = 3 THEN 10.0::DOUBLE ELSE (({k}::BIGINT * 104729) % 280)::DOUBLE / 2 - 60 END AS {a}lat"""


@query("nearest_scattered", f"""
WITH t AS (SELECT c_custkey, {_SCATTERED.format(k="c_custkey", a="t")} FROM customer),
s AS (SELECT s_suppkey, s_acctbal, {_SCATTERED.format(k="s_suppkey", a="s")} FROM supplier),
d AS (SELECT *, least(abs(slon - tlon), 360 - abs(slon - tlon)) AS dx, slat - tlat AS dy FROM t, s),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dx * dx + dy * dy, slat, slon, s_suppkey, s_acctbal) AS k FROM d)
SELECT c_custkey AS cell, s_suppkey AS site, s_acctbal AS balance, round(dx * dx + dy * dy, 9) AS distance2 FROM r WHERE k = 1""")
def nearest_scattered(spark, sf):
    """Every customer's nearest supplier, around the seam as well."""
    target = _scattered(table(spark, sf, "customer").select(F.col("c_custkey").alias("cell")), "cell")
    source = _scattered(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("balance")), "site")
    out = nearest.nearest_scattered(target, source, ["site", "balance"])
    return fn.round_cols(out.select("cell", "site", "balance", "distance2"), 9, "distance2")


@query("bilinear", _COARSE_SQL + """,
v_pos AS (SELECT cell, (79.9::DOUBLE - latitude) / 0.5 AS y, (longitude + 179.9::DOUBLE) / 0.5 AS x, n FROM v_grid, v_n),
v_sq AS (SELECT *, least(floor(y), n - 2) AS i, least(floor(x), 18) AS j FROM v_pos
  WHERE y >= 0 AND y <= n - 1 AND x >= 0 AND x <= 19)
SELECT p.cell, round(a.coarse * (1 - (q.y - q.i)) * (1 - (q.x - q.j)) + b.coarse * (1 - (q.y - q.i)) * (q.x - q.j)
  + c.coarse * (q.y - q.i) * (1 - (q.x - q.j)) + d.coarse * (q.y - q.i) * (q.x - q.j), 6) AS coarse
FROM v_pos p LEFT JOIN v_sq q USING (cell)
LEFT JOIN v_src a ON a.i = q.i AND a.j = q.j LEFT JOIN v_src b ON b.i = q.i AND b.j = q.j + 1
LEFT JOIN v_src c ON c.i = q.i + 1 AND c.j = q.j LEFT JOIN v_src d ON d.i = q.i + 1 AND d.j = q.j + 1""")
def bilinear(spark, sf):
    cells = grid_cells(spark, sf)
    lattice = _half_degree(cells)
    target = cells.select("cell", "latitude", "longitude")
    out = grid.bilinear_join(target, _coarse_source(cells), lattice, "coarse")
    return fn.round_cols(out.select("cell", "coarse"), 6, "coarse")


# ---- polygons ---------------------------------------------------------------
@query("point_in_polygon", f"""
WITH {GRID_SQL}, {EDGES_SQL}
SELECT cell, (SELECT min(region_id) FROM v_inside i WHERE i.cell = g.cell) AS region_id FROM v_grid g""")
def point_in_polygon(spark, sf):
    cells = grid_cells(spark, sf).select("cell", "lat_i", "lon_i")
    out = spatial.points_in_regions(cells, polygon_edges(spark, sf), grid_of(cells))
    return out.select("cell", "region_id")


@query("polygon_cells", f"""
WITH {GRID_SQL}, {EDGES_SQL} SELECT region_id, lat_i, lon_i FROM v_inside""")
def polygon_cells(spark, sf):
    """Every covered cell of every polygon, overlaps included."""
    cells = grid_cells(spark, sf).select("lat_i", "lon_i")
    covered = spatial.rasterise(polygon_edges(spark, sf), grid_of(cells))
    return covered.join(cells, ["lat_i", "lon_i"], "left_semi").select("region_id", "lat_i", "lon_i")


@query("region_box", f"""
WITH {GRID_SQL}, {EDGES_SQL}
SELECT cell, min(region_id) AS region_id FROM v_inside JOIN v_grid USING (cell)
WHERE region_id <> 4 OR (longitude BETWEEN -179.5 AND -172.5 AND latitude BETWEEN 79.5 AND 79.9)
GROUP BY cell""")
def region_box(spark, sf):
    """One region limited to a box."""
    cells = grid_cells(spark, sf).select("cell", "lat_i", "lon_i")
    found = spatial.points_in_regions(
        cells, polygon_edges(spark, sf), grid_of(cells), boxes={4: (-179.5, 79.5, -172.5, 79.9)})
    return found.filter("region_id is not null").select("cell", "region_id")


@query("land_mask", CELLS_SQL + " SELECT cell FROM v_cells WHERE land")
def land_mask(spark, sf):
    cells = grid_cells(spark, sf)
    return spatial.land_mask(cells, polygon_edges(spark, sf), grid_of(cells), "wind_CF").select("cell")


@query("offshore_mask", CELLS_SQL + " SELECT cell FROM v_cells WHERE offshore")
def offshore_mask(spark, sf):
    cells = grid_cells(spark, sf)
    return spatial.offshore_mask(cells, polygon_edges(spark, sf), grid_of(cells), "wind_CF").select("cell")


@query("masked_values", CELLS_SQL + """
SELECT cell, land, offshore, CASE WHEN land THEN "wind_CF" END AS land_wind,
  CASE WHEN offshore THEN wind_climatology END AS offshore_wind FROM v_cells""")
def masked_values(spark, sf):
    return masked_cells(spark, sf).select(
        "cell", "land", "offshore", F.when(F.col("land"), F.col("wind_CF")).alias("land_wind"),
        F.when(F.col("offshore"), F.col("wind_climatology")).alias("offshore_wind"))


def gridcodes(spark, sf):
    """Class name per grid code: a letter A..F and a detail, one code per part."""
    k = F.col("p_partkey")
    letter = F.substring(F.lit("ABCDEF"), (k % 6 + 1).cast("int"), F.lit(1))
    return table(spark, sf, "part").select(
        k.alias("gridcode"), F.concat(letter, F.lower("p_type")).alias("climate"))


CLIMATE_SQL = f"""
WITH {GRID_SQL}, {EDGES_SQL},
v_code AS (
  SELECT s_suppkey AS region_id, CAST(p_partkey % 6 + 1 AS INTEGER) AS code
  FROM supplier JOIN part ON p_partkey = s_suppkey * 7 WHERE p_partkey % 6 < 5),
v_last AS (SELECT cell, max(region_id) AS region_id FROM v_inside JOIN v_code USING (region_id) GROUP BY cell),
v_climate AS (
  SELECT g.*, coalesce(code, 0) AS climate_code
  FROM v_grid g LEFT JOIN v_last USING (cell) LEFT JOIN v_code USING (region_id))"""


def climate_cells(spark, sf):
    cells = grid_cells(spark, sf)
    shapes = polygons(spark, sf)
    return spatial.climate_overlay(
        cells, spatial.edges(shapes), grid_of(cells), gridcodes(spark, sf), shapes.select("region_id", "gridcode"))


@query("climate_overlay", CLIMATE_SQL + " SELECT cell, climate_code FROM v_climate")
def climate_overlay(spark, sf):
    return climate_cells(spark, sf).select("cell", "climate_code")


# ---- smoothing --------------------------------------------------------------
def _kernel_sql(boundary: str, radius: int, nulls: str) -> str:
    square = f"di BETWEEN -{radius} AND {radius} AND dj BETWEEN -{radius} AND {radius}"
    if boundary == "symm":
        def mirror(x: str, n: str) -> str:
            turn = f"((({x}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
            return f"CASE WHEN {turn} < {n} THEN {turn} ELSE 2 * {n} - 1 - {turn} END"

        at = f"{mirror('g.lat_i + di', 'n')} AS i, {mirror('g.lon_i + dj', '40')} AS j"
    else:
        at = "g.lat_i + di AS i, ((g.lon_i + dj) % 40 + 40) % 40 AS j"
    return f"""
WITH {GRID_SQL},
v_n AS (SELECT max(lat_i) + 1 AS n FROM v_grid),
v_offset AS (
  SELECT CAST(a AS INTEGER) AS di, CAST(b AS INTEGER) AS dj,
    CASE WHEN sqrt(a * a + b * b) > {radius} THEN 0.0::DOUBLE WHEN a = 0 AND b = 0 THEN 1.0::DOUBLE
         ELSE 1 / sqrt(a * a + b * b) END AS w
  FROM range(-{radius}, {radius + 1}) x(a), range(-{radius}, {radius + 1}) y(b)),
v_kernel AS (
  SELECT di, dj, w / sum(w) OVER () AS w, count(*) OVER () AS k FROM v_offset
  WHERE {square} {"" if nulls == "square" else "AND w > 0"}),
v_value AS (SELECT *, CASE WHEN cell % 701 <> 5 THEN demand END AS v FROM v_grid),
v_near AS (SELECT g.cell, g.latitude, g.longitude, {at}, w, k FROM v_value g, v_n, v_kernel),
v_smooth AS (
  SELECT e.cell, any_value(e.latitude) AS latitude, any_value(e.longitude) AS longitude,
    CASE WHEN count(s.v) = max(k) THEN round(sum(w * s.v), 6) END AS smoothed
  FROM v_near e LEFT JOIN v_value s ON s.lat_i = e.i AND s.lon_i = e.j GROUP BY e.cell)"""


def _smooth(spark, sf, radius: int, **options):
    cells = grid_cells(spark, sf)
    holed = cells.withColumn("v", F.when(F.col("cell") % 701 != 5, F.col("demand")))
    near = spatial.kernel_smooth(holed, "v", radius, grid_of(cells), **options)
    out = cells.select("cell", "lat_i", "lon_i", "latitude", "longitude").join(near, ["lat_i", "lon_i"])
    return fn.round_cols(out, 6, "smoothed")


@query("idw_kernel", _kernel_sql("symm", 8, "square") + " SELECT cell, smoothed FROM v_smooth")
def idw_kernel(spark, sf):
    """The full 2-degree kernel with a mirrored edge."""
    return _smooth(spark, sf, 8, boundary="symm").select("cell", "smoothed")


@query("idw_kernel_wrap", _kernel_sql("null", 3, "circle") + " SELECT cell, smoothed FROM v_smooth")
def idw_kernel_wrap(spark, sf):
    """A smaller kernel joined across the east and west ends; nulls spread in the circle only."""
    return _smooth(spark, sf, 3, wrap_lon=True, null_window="circle").select("cell", "smoothed")


@query("kernel_crop", _kernel_sql("symm", 8, "square") + """
SELECT v.cell, smoothed FROM v_smooth v JOIN v_grid g USING (cell) WHERE g.lon_i BETWEEN 10 AND 29""")
def kernel_crop(spark, sf):
    """Smoothed from a window and its surroundings only: equal to the whole field inside the window."""
    cells = grid_cells(spark, sf)
    holed = cells.withColumn("v", F.when(F.col("cell") % 701 != 5, F.col("demand")))
    lattice = grid_of(cells)
    near = spatial.buffered_smooth(holed, "v", 8, lattice, (0, lattice.n_lat - 1, 10, 29), boundary="symm")
    return fn.round_cols(cells.select("cell", "lat_i", "lon_i").join(near, ["lat_i", "lon_i"]), 6, "smoothed").select("cell", "smoothed")


@query("settlement_density", f"""
WITH {PIXELS_SQL},
v_cell AS (SELECT CAST(floor(-y / 4) AS INTEGER) AS lat_i, CAST(floor(x / 4) AS INTEGER) AS lon_i,
  avg(value) AS settlement_m2 FROM v_pixels GROUP BY ALL),
v_size AS (SELECT lat_i * 10 + lon_i AS cell, -1.5::DOUBLE - 4 * lat_i AS latitude, 4::DOUBLE AS s FROM v_cell), {_AREA_SQL}
SELECT lat_i, lon_i, round(settlement_m2, 4) AS settlement_m2, round(settlement_m2 / area_km2, 6) AS per_km2
FROM v_cell JOIN v_km2 ON cell = lat_i * 10 + lon_i""")
def settlement_density(spark, sf):
    px = pixels(spark, sf)
    out = spatial.settlement_density(px, _coarse(px, 4)).withColumn("per_km2", F.col("settlement_share") * fn.dbl(1e6))
    return fn.round_cols(fn.round_cols(out, 4, "settlement_m2"), 6, "per_km2").drop("settlement_share")


# ---- normalisation ----------------------------------------------------------
@query("normalize_demand", f"""
WITH {GRID_SQL}, v_s AS (SELECT min(demand) AS lo, quantile_cont(demand, 0.95) AS hi FROM v_grid),
v_u AS (SELECT cell, least(greatest((demand - lo) / (hi - lo), 1e-6), 1) AS u FROM v_grid, v_s)
SELECT cell, CASE WHEN u > 1e-6 THEN round(u, 6) END AS demand_norm FROM v_u""")
def normalize_demand(spark, sf):
    out = stats.normalize_p95(grid_cells(spark, sf), "demand", "demand_norm")
    return fn.round_cols(out.select("cell", "demand_norm"), 6, "demand_norm")


@query("normalize_by_region", f"""
WITH {GRID_SQL}, v_x AS (SELECT cell, segment, CASE WHEN segment = 'BUILDING' THEN 3.0 ELSE "wind_CF" END AS x FROM v_grid)
SELECT cell, CASE WHEN x IS NULL THEN NULL WHEN hi <= lo THEN 1 ELSE round((x - lo) / (hi - lo), 6) END::DOUBLE AS scaled
FROM v_x JOIN (SELECT segment, min(x) AS lo, max(x) AS hi FROM v_x GROUP BY segment) USING (segment)""")
def normalize_by_region(spark, sf):
    cells = grid_cells(spark, sf).withColumn(
        "x", F.when(F.col("segment") == "BUILDING", fn.dbl(3)).otherwise(F.col("wind_CF")))
    out = stats.normalize_by(cells, "x", "segment", "scaled")
    return fn.round_cols(out.select("cell", "scaled"), 6, "scaled")


@query("composite_demand", f"""
WITH {GRID_SQL}, v_t AS (SELECT max(storage) AS top, quantile_cont(storage, 0.95) AS p95 FROM v_grid)
SELECT cell, round(ln(1 + demand) * (1 + storage / top), 6) AS by_max,
  round(ln(1 + demand) * (1 + CASE WHEN storage IS NOT NULL THEN least(greatest(storage / p95, 0), 1) END), 6) AS by_p95
FROM v_grid, v_t""")
def composite_demand(spark, sf):
    cells = grid_cells(spark, sf)
    out = stats.composite_demand(cells, "demand", "storage", "by_max")
    out = stats.composite_demand(out, "demand", "storage", "by_p95", scale="p95")
    return fn.round_cols(out.select("cell", "by_max", "by_p95"), 6, "by_max", "by_p95")


@query("proximity_fraction", f"""
WITH {GRID_SQL}, v_size AS (SELECT cell, latitude, 0.25::DOUBLE AS s FROM v_grid), {_AREA_SQL},
v_f AS (SELECT cell, least(greatest(demand * 3e8 / (area_km2 * 1e6), 0), 1) AS f FROM v_grid JOIN v_km2 USING (cell)),
v_r AS (SELECT min(f) AS lo, max(f) AS hi FROM v_f)
SELECT cell, round(f, 6) AS fraction, round((f - lo) / (hi - lo), 6) AS fraction_scaled FROM v_f, v_r""")
def proximity_fraction(spark, sf):
    cells = grid_cells(spark, sf).withColumn("built", F.col("demand") * fn.dbl(3e8))
    out = stats.proximity_fraction(cells, "built", "latitude", 0.25)
    return fn.round_cols(out.select("cell", "fraction", "fraction_scaled"), 6, "fraction", "fraction_scaled")


@query("bands_and_buckets", f"""
WITH {GRID_SQL}, v_n AS (SELECT *, cell % 700 - 3 AS n FROM v_grid),
v_l AS (SELECT *, ln(1 + greatest(n, 1)) AS l FROM v_n), v_r AS (SELECT min(l) AS lo, max(l) AS hi FROM v_l)
SELECT cell, CAST(floor(abs(latitude) / 6) * 6 AS BIGINT) AS band,
  CASE WHEN demand <= 0.33 THEN 'low' WHEN demand <= 0.67 THEN 'medium' ELSE 'high' END AS level,
  round(25 + (l - lo) / (hi - lo + 1e-9) * 475, 4) AS size
FROM v_l, v_r""")
def bands_and_buckets(spark, sf):
    cells = grid_cells(spark, sf).withColumn("n", F.col("cell") % 700 - 3)
    out = stats.log_size(cells, "n").select(
        "cell", fn.lat_band("latitude").alias("band"), fn.resource_level("demand").alias("level"), "size")
    return fn.round_cols(out, 4, "size")


# ---- distributions ----------------------------------------------------------
@query("histogram", """
WITH v_r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS t FROM orders),
v_b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 60)), 59) AS bin, count(*) AS n FROM orders, v_r GROUP BY 1)
SELECT b AS bin, round(lo + b * ((hi - lo) / 60), 2) AS left, coalesce(n, 0) AS n,
  round(coalesce(n, 0) / ((hi - lo) / 60) / t * 1e6, 6) AS density
FROM range(60) x(b) CROSS JOIN v_r LEFT JOIN v_b ON v_b.bin = b""")
def histogram(spark, sf):
    out = stats.histogram(table(spark, sf, "orders"), "o_totalprice", 60)
    return out.select("bin", F.round("left", 2).alias("left"), "n", F.round(F.col("density") * 1e6, 6).alias("density"))


@query("kde", """
WITH v_s AS (
  SELECT o_orderstatus AS status, count(*) AS n, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h,
    min(o_totalprice) AS lo, max(o_totalprice) AS hi, sum(count(*)) OVER () AS total
  FROM orders GROUP BY 1),
v_p AS (SELECT status, h, total, CAST(p AS INTEGER) AS point,
  lo - 3 * h + p * ((hi + 3 * h - (lo - 3 * h)) / 39) AS x FROM v_s, range(40) t(p))
SELECT status, point, round(any_value(x), 2) AS x,
  round(sum(exp(-0.5 * ((x - o_totalprice) / h) ^ 2) / (h * sqrt(2 * pi()))) / any_value(total)::DOUBLE * 1e6, 6) AS density
FROM v_p JOIN orders ON o_orderstatus = status GROUP BY status, point""")
def kde(spark, sf):
    out = stats.kde(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "o_totalprice", "status", points=40)
    return out.select("status", "point", F.round("x", 2).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


@query("distribution", """
SELECT mask, count(*) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.33), 4) AS p33,
  round(quantile_cont(v, 0.67), 4) AS p67
FROM (SELECT 'all' AS mask, o_totalprice AS v FROM orders
  UNION ALL SELECT 'open', o_totalprice FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'done', o_totalprice FROM orders WHERE o_orderstatus = 'F')
GROUP BY mask""")
def distribution(spark, sf):
    status = F.col("o_orderstatus")
    out = stats.distribution(table(spark, sf, "orders"), "o_totalprice",
                             {"all": F.lit(True), "open": status == "O", "done": status == "F"})
    return fn.round_cols(out, 4, "mean", "p33", "p67")


@query("country_quantiles", """
SELECT c_nationkey AS country, count(c_acctbal) AS n, round(quantile_cont(c_acctbal, 0.05), 6) AS p5,
  round(quantile_cont(c_acctbal, 1.0::DOUBLE / 3), 6) AS p33, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.95), 6) AS p95
FROM customer GROUP BY 1""")
def country_quantiles(spark, sf):
    """Exact quantiles of every country at once."""
    out = grouped_quantiles(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", [0.05, 1 / 3, 0.5, 0.95])
    columns = [F.col("quantiles")[k].alias(n) for k, n in enumerate(("p5", "p33", "p50", "p95"))]
    return fn.round_cols(out.select(F.col("c_nationkey").alias("country"), "n", *columns), 6, "p5", "p33", "p50", "p95")


@query("mask_quantiles", """
SELECT o_orderstatus AS status, CASE WHEN o_totalprice > 150000 THEN 'large' END AS mask, count(*) AS n,
  round(quantile_cont(o_totalprice, 0.33), 4) AS p33, round(quantile_cont(o_totalprice, 0.67), 4) AS p67
FROM orders GROUP BY ALL""")
def mask_quantiles(spark, sf):
    """Exact quantiles per status and mask, a null mask included."""
    rows = table(spark, sf, "orders").withColumn("mask", F.when(F.col("o_totalprice") > 150000, F.lit("large")))
    out = grouped_quantiles(rows, ["o_orderstatus", "mask"], "o_totalprice", [0.33, 0.67])
    return fn.round_cols(out.select(F.col("o_orderstatus").alias("status"), "mask", "n", F.col("quantiles")[0].alias("p33"),
                                    F.col("quantiles")[1].alias("p67")), 4, "p33", "p67")


@query("quantiles", """
SELECT round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, quantile_cont(l_quantity, 0.5) AS q50, count(*) AS n
FROM lineitem""")
def quantiles(spark, sf):
    """Exact quantiles of a continuous and of a heavily tied column over the largest table."""
    rows = table(spark, sf, "lineitem")
    cut = exact_quantiles(rows, {"price": (F.col("l_extendedprice"), [0.05, 0.5, 0.99]), "qty": (F.col("l_quantity"), [0.5])})
    names = [("p5", cut["price"][0]), ("p50", cut["price"][1]), ("p99", cut["price"][2])]
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        *[F.round(F.lit(v), 4).alias(n) for n, v in names], F.lit(cut["qty"][0]).alias("q50"), "n")


@query("share_above", CELLS_SQL + """
SELECT name, n, round(share_pct, 6) AS share_pct FROM (
  SELECT 'storage_land' AS name, count(storage) AS n, avg(CASE WHEN storage >= 14 THEN 1 ELSE 0 END) * 100 AS share_pct
    FROM v_cells WHERE land AND storage IS NOT NULL
  UNION ALL SELECT 'storage_offshore', count(storage), avg(CASE WHEN storage >= 14 THEN 1 ELSE 0 END) * 100
    FROM v_cells WHERE offshore AND storage IS NOT NULL
  UNION ALL SELECT 'demand', count(demand), avg(CASE WHEN demand >= 0.5 THEN 1 ELSE 0 END) * 100 FROM v_cells)""")
def share_above(spark, sf):
    out = stats.share_above(masked_cells(spark, sf), {
        "storage_land": (F.when(F.col("land"), F.col("storage")), 14.0),
        "storage_offshore": (F.when(F.col("offshore"), F.col("storage")), 14.0),
        "demand": (F.col("demand"), 0.5),
    })
    return fn.round_cols(out, 6, "share_pct")


def _profile_part(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count("{c}") AS n, round(avg("{c}"), 6) AS mean,
  round(stddev_samp("{c}"), 6) AS std, min("{c}") AS min, max("{c}") AS max, count(*) - count("{c}") AS missing FROM v_grid"""


@query("profile", f"WITH {GRID_SQL} " + " UNION ALL ".join(map(_profile_part, ("wind_CF", "solar_CF", "storage"))))
def profile(spark, sf):
    out = stats.profile(grid_cells(spark, sf), ["wind_CF", "solar_CF", "storage"])
    return fn.round_cols(out, 6, "mean", "std")


@query("grid_profile", f"""
WITH {GRID_SQL}
SELECT 'wind_CF' AS variable, min("wind_CF") AS min, round(avg("wind_CF"), 6) AS mean, max("wind_CF") AS max,
  count("wind_CF") AS n_finite, count(*) AS n_total, round(count("wind_CF") * 100 / count(*), 6) AS finite_pct,
  NULL::BIGINT AS n_distinct FROM v_grid
UNION ALL SELECT 'segment', NULL, NULL, NULL, count(segment), count(*), round(count(segment) * 100 / count(*), 6),
  count(DISTINCT segment) FROM v_grid""")
def grid_profile(spark, sf):
    out = stats.grid_profile(grid_cells(spark, sf), ["wind_CF", "segment"])
    return fn.round_cols(out, 6, "mean", "finite_pct")


# ---- regression -------------------------------------------------------------
@query("ols_gap_fill", CELLS_SQL + """,
v_fit AS (SELECT "solar_CF" AS y, wind_climatology AS a, demand AS b FROM v_cells
  WHERE land AND "solar_CF" IS NOT NULL AND wind_climatology IS NOT NULL AND demand IS NOT NULL),
v_m AS (SELECT var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say,
  covar_pop(b, y) AS sby, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM v_fit),
v_c AS (SELECT (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ca,
  (sby * saa - say * sab) / (saa * sbb - sab * sab) AS cb, ma, mb, my FROM v_m)
SELECT cell, round(coalesce("solar_CF", CASE WHEN land THEN
  least(greatest(my + ca * (wind_climatology - ma) + cb * (demand - mb), 0), 1) END), 6) AS filled
FROM v_cells, v_c""")
def ols_gap_fill(spark, sf):
    cells = masked_cells(spark, sf)
    out = ml.ols_fill(cells, "solar_CF", ["wind_climatology", "demand"], F.col("land"), out="filled")
    return fn.round_cols(out.select("cell", "filled"), 6, "filled")
