"""The domain tables derived from the driver tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogale.config import Grid
from heliogale.operators import spatial, timeseries

LON0, LAT0, RES, WIDTH = -180.0, 80.0, 0.25, 40


# Declared schemas: no job is spent on reading footers to infer them.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# ---- customer grid ----------------------------------------------------------
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per customer, 40 columns wide, with holes, zeros and threshold ties."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS cell",
        "cast(c_custkey div 40 AS INT) AS lat_i", "cast(c_custkey % 40 AS INT) AS lon_i",
        "80d - 0.25d * (c_custkey div 40) AS latitude", "-180d + 0.25d * (c_custkey % 40) AS longitude",
        "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 0d"
        " ELSE (c_acctbal + 1000) / 22000 END AS wind_CF",
        "CASE WHEN c_custkey % 19 <> 0 THEN 0.1d + (c_custkey % 13) / 100d END AS solar_CF",
        "(c_custkey * 7 % 101) / 100d AS demand",
        "CASE WHEN c_custkey % 31 <> 0 THEN cast(c_custkey * 11 % 29 AS DOUBLE) END AS storage",
        "5d + (c_custkey % 9) / 2d AS wind_climatology",
        "cast((100 + c_custkey % 170) * 3600 AS DOUBLE) AS solar_climatology",
        "c_nationkey AS country", "c_mktsegment AS segment",
    )


GRID_SQL = """
v_grid AS (
  SELECT c_custkey AS cell,
    CAST(c_custkey // 40 AS INTEGER) AS lat_i, CAST(c_custkey % 40 AS INTEGER) AS lon_i,
    80.0::DOUBLE - 0.25::DOUBLE * (c_custkey // 40) AS latitude,
    -180.0::DOUBLE + 0.25::DOUBLE * (c_custkey % 40) AS longitude,
    CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 0.0::DOUBLE
         ELSE (c_acctbal + 1000) / 22000 END AS "wind_CF",
    CASE WHEN c_custkey % 19 <> 0 THEN 0.1::DOUBLE + (c_custkey % 13) / 100::DOUBLE END AS "solar_CF",
    (c_custkey * 7 % 101) / 100::DOUBLE AS demand,
    CASE WHEN c_custkey % 31 <> 0 THEN (c_custkey * 11 % 29)::DOUBLE END AS storage,
    5::DOUBLE + (c_custkey % 9) / 2::DOUBLE AS wind_climatology,
    ((100 + c_custkey % 170) * 3600)::DOUBLE AS solar_climatology,
    c_nationkey AS country, c_mktsegment AS segment
  FROM customer)"""


def grid_of(cells: DataFrame) -> Grid:
    """The lattice the customer cells fill; rows grow with the table."""
    last = cells.agg(F.max("lat_i")).first()[0]
    return Grid(LON0, LAT0, RES, WIDTH, (last or 0) + 1)


# ---- polygons ---------------------------------------------------------------
# One polygon per supplier, so polygons grow with the cells: a triangle, a rectangle or a
# notched shape in cell units around a centre, vertices off the lattice.
SHAPES = (
    ((-2.317, -1.6), (3.083, -0.7), (0.421, 2.7)),
    ((-2.217, -1.3), (2.613, -1.3), (2.613, 1.7), (-2.217, 1.7)),
    ((-2.417, -2.2), (2.717, -2.2), (2.717, 2.3), (0.313, -0.6), (-2.417, 2.3)),
)


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ring(shape) -> str:
        points = ", ".join(
            f"named_struct('x', -180d + 0.25d * (cast(s_suppkey * 17 % 40 AS DOUBLE) + {x}d), "
            f"'y', 80d - 0.25d * (s_suppkey * 0.375d + {y}d))" for x, y in shape)
        return f"array(array({points}))"

    rings = " ".join(f"WHEN {kind} THEN {ring(shape)}" for kind, shape in enumerate(SHAPES))
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS region_id", f"CASE s_suppkey % 3 {rings} END AS rings", "s_suppkey * 7 AS gridcode")


def polygon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.edges(polygons(spark, sf_dir))


def _shape_values() -> str:
    rows = []
    for kind, shape in enumerate(SHAPES):
        for (x1, y1), (x2, y2) in zip(shape, shape[1:] + shape[:1]):
            rows.append(f"({kind}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return ", ".join(rows)


EDGES_SQL = f"""
v_shape(kind, px, py, qx, qy) AS (VALUES {_shape_values()}),
v_edges AS (
  SELECT s_suppkey AS region_id,
    -180::DOUBLE + 0.25::DOUBLE * ((s_suppkey * 17 % 40)::DOUBLE + px) AS x1,
    80::DOUBLE - 0.25::DOUBLE * (s_suppkey * 0.375::DOUBLE + py) AS y1,
    -180::DOUBLE + 0.25::DOUBLE * ((s_suppkey * 17 % 40)::DOUBLE + qx) AS x2,
    80::DOUBLE - 0.25::DOUBLE * (s_suppkey * 0.375::DOUBLE + qy) AS y2
  FROM supplier JOIN v_shape ON kind = s_suppkey % 3),
v_inside AS (
  SELECT c.cell, c.lat_i, c.lon_i, e.region_id FROM v_grid c JOIN v_edges e
    ON (e.y1 > c.latitude) <> (e.y2 > c.latitude)
   AND c.longitude < e.x1 + (c.latitude - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY ALL HAVING count(*) % 2 = 1)"""

MASKS_SQL = """
v_cells AS (
  SELECT g.*,
    coalesce("wind_CF" <> 0, false) AND cell IN (SELECT cell FROM v_inside) AS land,
    coalesce("wind_CF" <> 0, false) AND cell NOT IN (SELECT cell FROM v_inside) AS offshore
  FROM v_grid g)"""

CELLS_SQL = f"WITH {GRID_SQL}, {EDGES_SQL}, {MASKS_SQL}"


def masked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer cells with their land and offshore masks."""
    cells = grid_cells(spark, sf_dir)
    return spatial.with_masks(cells, polygon_edges(spark, sf_dir), grid_of(cells), "wind_CF")


# ---- daily series -----------------------------------------------------------
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily wind and solar stand-ins per region: lineitem through supplier and nation.

    Each supplier's days are summed before the join, so that the join meets at most one
    row per supplier and day however many items a supplier has.
    """
    place = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").alias("cell"), "n_regionkey")
    return (
        site_series(spark, sf_dir).join(place, "cell")
        .groupBy(F.col("n_regionkey").alias("cell"), "date")
        .agg(F.sum("wind").alias("wind"), F.sum("solar").alias("solar"))
    )


DAILY_SQL = """
v_daily AS (
  SELECT n_regionkey AS cell, l_shipdate::DATE AS date,
    sum(l_quantity) AS wind, sum(l_extendedprice) AS solar
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL)"""


def site_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per supplier: as many cells as the table has suppliers, with sparse days."""
    return timeseries.daily(
        table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "cell"), ["cell"], "l_shipdate",
        {"wind": ("l_quantity", "sum"), "solar": ("l_extendedprice", "sum")},
    )


SITES_SQL = """
v_daily AS (
  SELECT l_suppkey AS cell, l_shipdate::DATE AS date,
    sum(l_quantity) AS wind, sum(l_extendedprice) AS solar
  FROM lineitem GROUP BY ALL)"""


# ---- pixels -----------------------------------------------------------------
def pixels(spark: SparkSession, sf_dir: str, value: str = "p_retailprice") -> DataFrame:
    """Fine raster of parts, 40 pixels wide, with nodata holes."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (k % 40).cast("double").alias("x"), (-F.floor(k / 40)).cast("double").alias("y"),
        F.when(k % 29 != 0, F.col(value).cast("double")).alias("value"),
    )


PIXELS_SQL = """
v_pixels AS (
  SELECT (p_partkey % 40)::DOUBLE AS x, -(p_partkey // 40)::DOUBLE AS y,
    CASE WHEN p_partkey % 29 <> 0 THEN p_retailprice END AS value,
    CASE WHEN p_partkey % 29 <> 0 THEN p_size::DOUBLE END AS size
  FROM part)"""
