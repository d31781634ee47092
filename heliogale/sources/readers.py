"""Readers for the long-table data model. Filters and column choice stay declarative so
that they reach the parquet scan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogale.functions import columns as fn
from heliogale.operators import grid, timeseries
from heliogale.sources.notes import finished, path_exists  # noqa: F401 - part of this module's interface

COMPONENTS = {"ws100": ["u100", "v100"]}


def read_reanalysis(
    spark: SparkSession, path: str, variables: list[str], bounds=None,
    years: tuple[int, int] | None = None, keys: list[str] | None = None,
    ts: str = "valid_time", lon: str = "longitude", lat: str = "latitude",
) -> DataFrame:
    """Hourly series of the needed variables inside a box and a range of whole years.

    Only the stored columns the variables need are read. A table partitioned by ``year``
    is pruned by it as well. Stored longitudes may run 0..360; the result has -180..180.
    NaN becomes null. A selection without rows is an empty table.
    """
    df = spark.read.parquet(path)
    if years is not None:
        df = timeseries.year_range(df, ts, *years)
        if "year" in df.columns:
            df = df.filter(F.col("year").between(*years))
    if bounds is not None:
        df = grid.bbox(df, bounds, lon, lat)
    stored = list(dict.fromkeys(c for v in variables for c in COMPONENTS.get(v, [v])))
    return df.select(
        *(keys or []), ts, lat, fn.lon180(lon).alias(lon), *[fn.finite(c).alias(c) for c in stored]
    )


def read_tiles(spark: SparkSession, path: str, bounds, low: tuple[float, float], tile_deg: float,
               lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Rows of a table partitioned by ``tile_lon`` and ``tile_lat`` inside a half-open box.

    ``low`` is the corner the tiles are counted from: longitudes in [low, low + size), latitudes in
    (low, low + size] make tile 0. The box becomes ranges of tile numbers, so only the folders it meets are
    listed, and ranges of the stored places, which skip files and row groups. Boxes across the seam are not cut.
    """
    west, south, east, north = bounds
    first = lambda at, start: math.floor((at - start) / tile_deg)
    last = lambda at, start: math.ceil((at - start) / tile_deg) - 1
    return grid.bbox(
        spark.read.parquet(path).filter(
            F.col("tile_lon").between(first(west, low[0]), last(east, low[0]))
            & F.col("tile_lat").between(first(south, low[1]), last(north, low[1]))),
        bounds, lon, lat)


def read_raster(spark: SparkSession, path: str, nodata: float | None = None, value: str = "value") -> DataFrame:
    """Pixels ``(x, y, value)``; the nodata marker and NaN become null."""
    v = fn.finite(value)
    v = v if nodata is None else F.nullif(v, fn.dbl(nodata))
    return spark.read.parquet(path).select("x", "y", v.alias("value"))


def read_cells(spark: SparkSession, paths: list[str], keys: list[str] | None = None) -> DataFrame:
    """Several cell files stitched by their keys. Repeated cells are an error, raised when
    the result is computed."""
    keys = keys or grid.CELL
    df = spark.read.parquet(*paths)
    values = [c for c in df.columns if c not in keys]
    stitched = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.max(c).alias(c) for c in values]
    )
    message = F.format_string("cell (%s) occurs %d times", F.concat_ws(", ", *keys), "_copies")
    return stitched.filter(
        F.when(F.col("_copies") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    ).drop("_copies")


def read_regions(
    spark: SparkSession, path: str, shape_class: str | None = None, allowed: DataFrame | None = None,
) -> DataFrame:
    """Polygon table ``(country_id, parent_name, shape_class, rings)`` with optional filters."""
    df = spark.read.parquet(path)
    if shape_class is not None:
        df = df.filter(F.col("shape_class") == shape_class)
    if allowed is not None:
        df = df.join(allowed.select("country_id"), "country_id", "left_semi")
    return df


def read_gridcodes(spark: SparkSession, path: str) -> DataFrame:
    """CSV lookup of grid code and class name, in that order, under a header line. The
    declared schema names the columns, whatever the header calls them."""
    return spark.read.csv(path, header=True, schema="gridcode INT, climate STRING")


def read_surface(spark: SparkSession, path: str, value: str, ts: str = "valid_time") -> DataFrame:
    """First time step of a surface field: the smallest stored time, found from a scan of
    one column, then used as a filter on the scan."""
    df = spark.read.parquet(path)
    first = df.agg(F.min(ts)).first()[0]
    return df.filter(F.col(ts) == F.lit(first).cast(dict(df.dtypes)[ts])).select(
        "latitude", fn.lon180("longitude").alias("longitude"), fn.finite(value).alias(value)
    )


def read_preferred(spark: SparkSession, preferred: str, fallback: str) -> DataFrame:
    """The gap-filled table when it has been written to the end, else the raw one."""
    return spark.read.parquet(preferred if finished(spark, preferred) else fallback)
