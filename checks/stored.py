"""Readers and writers on derived tables: each query stores a table in the checkpoint folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import GRID_SQL, grid_cells, table
from heliogale.functions import columns as fn
from heliogale.operators import grid
from heliogale.plans.session import ensure_checkpoint_dir
from heliogale.sources import readers, sinks


def _place(spark) -> str:
    """A new folder that every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/checks-{uuid.uuid4().hex}"


# ---- hourly table ---------------------------------------------------------------------
_HOURLY = """
v_hourly AS (
  SELECT l_shipdate + to_hours(CAST(l_linenumber * 3 AS INTEGER)) AS valid_time, (l_suppkey % 40)::DOUBLE / 2 - 5 AS latitude,
    (l_partkey % 360)::DOUBLE AS longitude, l_quantity AS u100, l_discount * 100 AS v100,
    CASE WHEN l_linenumber <> 5 THEN l_extendedprice END AS ssrd FROM lineitem)"""


def _hourly(spark, sf) -> str:
    """Hours by place, partitioned by year, with NaN for missing radiation and longitudes 0..360."""
    path = _place(spark)
    table(spark, sf, "lineitem").selectExpr(
        "l_shipdate + make_interval(0, 0, 0, 0, l_linenumber * 3) AS valid_time", "(l_suppkey % 40) / 2d - 5d AS latitude",
        "cast(l_partkey % 360 AS DOUBLE) AS longitude", "l_quantity AS u100", "l_discount * 100 AS v100",
        "if(l_linenumber <> 5, l_extendedprice, double('NaN')) AS ssrd", "year(l_shipdate) AS year",
    ).write.partitionBy("year").parquet(path)
    return path


@query("reanalysis_scan", f"""
WITH {_HOURLY}
SELECT latitude, CASE WHEN longitude >= 180 THEN longitude - 360 ELSE longitude END AS longitude, count(*) AS n,
  round(sum(sqrt(u100 * u100 + v100 * v100)), 3) AS wind, round(sum(ssrd), 3) AS radiation
FROM v_hourly WHERE valid_time >= TIMESTAMP '1995-01-01' AND valid_time < TIMESTAMP '1997-01-01'
  AND latitude > 2 AND latitude <= 9 AND (longitude >= 350 OR longitude < 20) GROUP BY ALL""")
def reanalysis_scan(spark, sf):
    """Two years of a box across the meridian; columns, days and places reach the scan."""
    hours = readers.read_reanalysis(spark, _hourly(spark, sf), ["ws100", "ssrd"], (-10, 2, 20, 9), (1995, 1996))
    out = hours.groupBy("latitude", "longitude").agg(
        F.count("*").alias("n"), F.sum(fn.wind_speed("u100", "v100")).alias("wind"), F.sum("ssrd").alias("radiation"))
    return fn.round_cols(out, 3, "wind", "radiation")


@query("empty_selection", f"""
WITH {_HOURLY}
SELECT 'none' AS box, 0::BIGINT AS n, NULL::DOUBLE AS radiation
UNION ALL SELECT 'some', count(*), round(sum(ssrd), 3) FROM v_hourly WHERE latitude > 0 AND latitude <= 2 AND longitude >= 10 AND longitude < 40""")
def empty_selection(spark, sf):
    """A box without rows is an empty table, from which the jobs behind it make an empty result."""
    path, out = _hourly(spark, sf), None
    for name, box in (("none", (10, 60, 40, 70)), ("some", (10, 0, 40, 2))):
        one = readers.read_reanalysis(spark, path, ["ssrd"], box).agg(F.count("*").alias("n"), F.sum("ssrd").alias("radiation"))
        one = one.select(F.lit(name).alias("box"), "n", "radiation")
        out = one if out is None else out.unionByName(one)
    return fn.round_cols(out, 3, "radiation")


# ---- rasters, cells, regions, surfaces ---------------------------------------------------
@query("raster_nodata", """
SELECT (p_partkey % 40)::DOUBLE AS x, count(*) AS n, count(CASE WHEN p_partkey % 7 > 1 THEN 1 END) AS present,
  round(sum(CASE WHEN p_partkey % 7 > 1 THEN p_retailprice END), 3) AS total FROM part GROUP BY 1""")
def raster_nodata(spark, sf):
    """Pixels whose value is the nodata marker or NaN are missing."""
    path = _place(spark)
    table(spark, sf, "part").selectExpr(
        "cast(p_partkey % 40 AS DOUBLE) AS x", "cast(p_partkey div 40 AS DOUBLE) AS y",
        "CASE p_partkey % 7 WHEN 0 THEN -9999d WHEN 1 THEN double('NaN') ELSE p_retailprice END AS value").write.parquet(path)
    pixels = readers.read_raster(spark, path, -9999.0)
    out = pixels.groupBy("x").agg(F.count("*").alias("n"), F.count("value").alias("present"), F.sum("value").alias("total"))
    return fn.round_cols(out, 3, "total")


@query("stitched_cells", f"""WITH {GRID_SQL}
SELECT lat_i, lon_i, round("wind_CF", 9) AS "wind_CF", demand FROM v_grid""")
def stitched_cells(spark, sf):
    """Cells from three files, by their keys; a cell in two of them would be an error."""
    cells = grid_cells(spark, sf).select("cell", *grid.CELL, "wind_CF", "demand")
    paths = [_place(spark) for _ in range(3)]
    for k, path in enumerate(paths):
        cells.filter(F.col("cell") % 3 == k).drop("cell").write.parquet(path)
    return fn.round_cols(readers.read_cells(spark, paths), 9, "wind_CF")


@query("region_scan", """
SELECT n_name AS country_id, r_name AS parent_name FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_nationkey % 3 = 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 5000)""")
def region_scan(spark, sf):
    """Shapes of one class, of the countries on a list that repeats them."""
    path = _place(spark)
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "n_name AS country_id", "r_name AS parent_name", "if(n_nationkey % 3 = 0, 'land', 'maritime') AS shape_class",
        "array(array(named_struct('x', 0d, 'y', 0d))) AS rings").write.parquet(path)
    poor = table(spark, sf, "supplier").filter("s_acctbal < 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    allowed = poor.join(nation, "n_nationkey").select(F.col("n_name").alias("country_id"))
    return readers.read_regions(spark, path, "land", allowed).select("country_id", "parent_name")


@query("surface_scan", """
WITH d AS (SELECT date_trunc('day', ts) AS day, (user_id % 180)::DOUBLE - 90 AS latitude, (user_id * 7 % 360)::DOUBLE AS longitude, value FROM events)
SELECT latitude, CASE WHEN longitude >= 180 THEN longitude - 360 ELSE longitude END AS longitude, round(sum(value), 6) AS z
FROM d WHERE day = (SELECT min(day) FROM d) GROUP BY ALL""")
def surface_scan(spark, sf):
    """The first time step of a field that has many."""
    path = _place(spark)
    table(spark, sf, "events").selectExpr(
        "cast(to_date(ts) AS TIMESTAMP_NTZ) AS valid_time", "user_id % 180 - 90d AS latitude", "cast(user_id * 7 % 360 AS DOUBLE) AS longitude",
        "value AS z").write.parquet(path)
    out = readers.read_surface(spark, path, "z").groupBy("latitude", "longitude").agg(F.sum("z").alias("z"))
    return fn.round_cols(out, 6, "z")


# ---- sinks ------------------------------------------------------------------------------
_TILED = f"""WITH {GRID_SQL}, v_tiled AS (
  SELECT *, CAST(floor((longitude + 180) / 2.5) AS INTEGER) AS tile_lon, CAST(ceil((latitude + 60) / 2.5) - 1 AS INTEGER) AS tile_lat FROM v_grid)"""


def _tiled(spark, sf):
    return grid_cells(spark, sf).select(
        F.floor((F.col("longitude") + 180) / 2.5).cast("int").alias("tile_lon"),
        (F.ceil((F.col("latitude") + 60) / 2.5) - 1).cast("int").alias("tile_lat"), *grid.CELL, "latitude", "longitude", "demand")


@query("tile_layout", _TILED + """
SELECT tile_lon, tile_lat, count(*) AS n, 1::BIGINT AS files, round(sum(demand), 6) AS demand FROM v_tiled
WHERE longitude >= -178 AND longitude < -173 AND latitude > 72 AND latitude <= 79 GROUP BY ALL""")
def tile_layout(spark, sf):
    """A box over a tiled table: of every tile it meets, its cells in the box and the files read for them."""
    path = _place(spark)
    sinks.write_tiles(_tiled(spark, sf), path)
    inside = readers.read_tiles(spark, path, (-178, 72, -173, 79), (-180.0, -60.0), 2.5)
    out = inside.groupBy("tile_lon", "tile_lat").agg(
        F.count("*").alias("n"), F.count_distinct(F.col("_metadata.file_path")).alias("files"), F.sum("demand").alias("demand"))
    return fn.round_cols(out, 6, "demand")


@query("resumed_tiles", _TILED + """
SELECT tile_lon, tile_lat, count(*) AS n, round(sum(demand), 6) AS demand FROM v_tiled GROUP BY ALL""")
def resumed_tiles(spark, sf):
    """A tile job in which one tile fails, and a second run that does only that tile."""
    cells, path, manifest = _tiled(spark, sf), _place(spark), _place(spark)
    tiles = cells.select("tile_lon", "tile_lat").distinct()

    def build(broken):
        def of(some):
            rows = cells.join(some, sinks.TILE, "left_semi")
            bad = (F.col("tile_lon") == 1) & (F.col("tile_lat") == 55)
            return rows.withColumn("demand", F.when(bad, F.raise_error(F.lit("broken tile")).cast("double")).otherwise(F.col("demand"))) if broken else rows

        return of

    failed = sinks.run_tiles(spark, tiles, build(True), path, manifest)
    if failed != [(1, 55)] or sinks.run_tiles(spark, tiles, build(False), path, manifest):
        raise AssertionError(f"tiles that failed: {failed}")
    out = spark.read.parquet(path).groupBy("tile_lon", "tile_lat").agg(F.count("*").alias("n"), F.sum("demand").alias("demand"))
    return fn.round_cols(out, 6, "demand")


@query("report_rows", """
SELECT c_mktsegment AS segment, c_nationkey AS country, max(c_acctbal) AS balance, count(*) AS n
FROM customer GROUP BY ALL ORDER BY balance DESC, segment, country LIMIT 20""")
def report_rows(spark, sf):
    """The first rows of a sorted report, read back from its CSV; its balances have two digits, so rounding leaves them."""
    path = _place(spark)
    largest = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("country")).agg(
        F.max("c_acctbal").alias("balance"), F.count("*").alias("n"))
    sinks.write_report(largest, path, [F.desc("balance"), "segment", "country"], 20)
    return spark.read.csv(path, header=True, schema="segment string, country int, balance double, n bigint")


@query("annual_mean_once", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_quantity), 9) AS quantity FROM lineitem GROUP BY 1""")
def annual_mean_once(spark, sf):
    """A mean that is computed and stored by its first user and read by the second."""
    path, made = _place(spark), []

    def build():
        made.append(1)
        return table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.avg("l_quantity").alias("quantity"))

    for _ in range(2):
        means = sinks.computed_once(spark, path, build, {"variable": "l_quantity"}, [f"{sf}/lineitem.parquet"])
    if len(made) != 1:
        raise AssertionError("the mean was computed again")
    return fn.round_cols(means, 9, "quantity")
