"""Polygon masks on the grid and distance-weighted neighbourhood smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliogale.config import CLIMATE_CODE, Grid
from heliogale.functions import columns as fn

CELL = ["lat_i", "lon_i"]


# ---- polygons ---------------------------------------------------------------
def edges(
    polygons: DataFrame, region: str = "region_id", rings: str = "rings", part: str | None = None
) -> DataFrame:
    """Edge table of polygons given as rings of ``struct<x, y>`` vertices.

    Rings are closed when their last vertex differs from the first. All rings of a region
    count together, so inner rings are holes. A region given in several rows that may
    overlap needs a ``part`` column telling them apart: it is the union of its parts.
    Horizontal edges never cross a row's
    latitude under the half-open rule and are dropped.
    """
    piece = F.lit(0) if part is None else F.col(part)
    ring = polygons.select(
        F.col(region).alias("region_id"), piece.alias("part"), F.posexplode(rings).alias("ring", "_p")
    )
    closed = F.when(
        F.element_at("_p", 1) == F.element_at("_p", -1), F.col("_p")
    ).otherwise(F.concat("_p", F.slice("_p", 1, 1)))
    n = F.size("_p")
    return (
        ring.filter(F.size("_p") >= 3)
        .withColumn("_p", closed)
        .withColumn("_e", F.explode(F.arrays_zip(
            F.slice("_p", F.lit(1), n - 1).alias("a"), F.slice("_p", F.lit(2), n - 1).alias("b"))))
        .select(
            "region_id", "part", "ring",
            F.col("_e.a.x").alias("x1"), F.col("_e.a.y").alias("y1"),
            F.col("_e.b.x").alias("x2"), F.col("_e.b.y").alias("y2"),
        )
        .filter(F.col("y1") != F.col("y2"))
    )


def _span(low: Column, high: Column) -> Column:
    return F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))))


def rasterise(edge_rows: DataFrame, grid: Grid) -> DataFrame:
    """Grid cells whose centre lies inside each region: ``(region_id, lat_i, lon_i)``, once
    per part that covers the cell.

    Even-odd rule row by row: an edge meets each grid row it spans in one longitude; in a
    row, the sorted longitudes of a region pair up into inside runs ``[enter, leave)``.
    Work and output grow with edges x rows spanned and with covered cells; no cell is ever
    compared with an edge it does not share a row with.
    """
    res, lat0, lon0 = fn.dbl(grid.res), fn.dbl(grid.lat0), fn.dbl(grid.lon0)
    top, bottom = F.greatest("y1", "y2"), F.least("y1", "y2")
    first = F.greatest(F.floor((lat0 - top) / res), F.lit(0))
    last = F.least(F.ceil((lat0 - bottom) / res), F.lit(grid.n_lat - 1))
    lat = lat0 - res * F.col("lat_i")
    meets = F.col("x1") + (lat - F.col("y1")) * (F.col("x2") - F.col("x1")) / (
        F.col("y2") - F.col("y1")
    )
    row = W.partitionBy("region_id", "part", "lat_i").orderBy("enter")
    runs = (
        edge_rows.filter(F.col("y1") != F.col("y2"))
        .withColumn("lat_i", _span(first, last))
        .filter((lat >= bottom) & (lat < top))
        .select("region_id", "part", "lat_i", meets.alias("enter"))
        .withColumns({"leave": F.lead("enter").over(row), "_k": F.row_number().over(row)})
        .filter((F.col("_k") % 2 == 1) & (F.col("enter") < F.col("leave")))
    )
    lo = F.greatest(F.floor((F.col("enter") - lon0) / res), F.lit(0))
    hi = F.least(F.ceil((F.col("leave") - lon0) / res), F.lit(grid.n_lon - 1))
    lon = lon0 + res * F.col("lon_i")
    return (
        runs.withColumn("lon_i", _span(lo, hi))
        .filter((lon >= F.col("enter")) & (lon < F.col("leave")))
        .select("region_id", "lat_i", "lon_i")
    )


def cell_regions(
    edge_rows: DataFrame, grid: Grid, pick: str = "lowest",
    boxes: dict[object, tuple[float, float, float, float]] | None = None,
) -> DataFrame:
    """One region per covered cell; overlaps take the lowest (or highest) region id.

    ``boxes`` keeps only the part of a region inside a lon/lat box (closed on all sides).
    """
    if pick not in ("lowest", "highest"):
        raise ValueError(f"pick must be lowest or highest; got {pick!r}")
    covered = rasterise(edge_rows, grid)
    lon = fn.dbl(grid.lon0) + fn.dbl(grid.res) * F.col("lon_i")
    lat = fn.dbl(grid.lat0) - fn.dbl(grid.res) * F.col("lat_i")
    for region, (minx, miny, maxx, maxy) in (boxes or {}).items():
        covered = covered.filter(
            (F.col("region_id") != F.lit(region))
            | (lon.between(minx, maxx) & lat.between(miny, maxy))
        )
    chosen = (F.min if pick == "lowest" else F.max)("region_id")
    return covered.groupBy(*CELL).agg(chosen.alias("region_id"))


def points_in_regions(cells: DataFrame, edge_rows: DataFrame, grid: Grid, **options) -> DataFrame:
    """Cells with the region they lie in (null outside every region)."""
    return cells.join(cell_regions(edge_rows, grid, **options), CELL, "left")


def land_mask(cells: DataFrame, edge_rows: DataFrame, grid: Grid, value: str) -> DataFrame:
    """Cells with data inside a land polygon."""
    covered = rasterise(edge_rows, grid).select(*CELL)
    return cells.filter(fn.has_data(value)).join(covered, CELL, "left_semi")


def offshore_mask(cells: DataFrame, edge_rows: DataFrame, grid: Grid, value: str) -> DataFrame:
    """Cells with data outside every land polygon."""
    covered = rasterise(edge_rows, grid).select(*CELL)
    return cells.filter(fn.has_data(value)).join(covered, CELL, "left_anti")


def with_masks(cells: DataFrame, edge_rows: DataFrame, grid: Grid, value: str) -> DataFrame:
    """Both masks as boolean columns ``land`` and ``offshore`` from one join."""
    covered = rasterise(edge_rows, grid).select(*CELL).distinct().withColumn("_in", F.lit(True))
    data = fn.has_data(value)
    inside = F.coalesce("_in", F.lit(False))
    return cells.join(covered, CELL, "left").withColumns(
        {"land": data & inside, "offshore": data & ~inside}
    ).drop("_in")


def climate_overlay(
    cells: DataFrame, edge_rows: DataFrame, grid: Grid, gridcodes: DataFrame, regions: DataFrame
) -> DataFrame:
    """Numeric climate class per cell (0 = none).

    ``regions`` maps ``region_id`` to ``gridcode`` and ``gridcodes`` maps ``gridcode`` to a
    class name whose first letter decides the code. Both describe polygons, not cells:
    codes are attached to the polygons before anything touches the grid. Later polygons
    win where polygons overlap.
    """
    letter = F.substring("climate", 1, 1)
    code = F.lit(None).cast("int")
    for k, v in CLIMATE_CODE.items():
        code = F.when(letter == k, v).otherwise(code)
    coded = regions.join(gridcodes, "gridcode", "inner").select("region_id", code.alias("climate_code"))
    ordered = edge_rows.join(coded.filter("climate_code is not null"), "region_id", "inner")
    tagged = ordered.withColumn("region_id", F.struct("region_id", "climate_code"))
    burnt = cell_regions(tagged, grid, pick="highest").select(
        *CELL, F.col("region_id.climate_code").alias("climate_code")
    )
    return cells.join(burnt, CELL, "left").withColumn(
        "climate_code", F.coalesce("climate_code", F.lit(0))
    )


def overlay(land: DataFrame, climate: DataFrame | None, grid: Grid) -> DataFrame:
    """Land and climate of every covered cell from one rasterisation: ``(lat_i, lon_i, on_land, climate_code)``.

    ``land`` is an edge table; ``climate`` one whose rows also have ``climate_code``, with whole numbers as region
    ids, of which the highest wins. Both go through the rows of the grid together, and one group-by makes the cells.
    """
    tag = lambda layer, order, code: F.struct(
        F.lit(layer).alias("layer"), order.cast("long").alias("order"), code.cast("int").alias("code"))
    columns = ["part", "ring", "x1", "y1", "x2", "y2"]
    edges_of = land.select(tag("land", F.xxhash64("region_id"), F.lit(None)).alias("region_id"), *columns)
    if climate is not None:
        known = climate.filter("climate_code is not null")
        edges_of = edges_of.unionByName(known.select(tag("climate", F.col("region_id"), F.col("climate_code")).alias("region_id"), *columns))
    layer = F.col("region_id.layer")
    return rasterise(edges_of, grid).groupBy(*CELL).agg(
        F.coalesce(F.max(layer == "land"), F.lit(False)).alias("on_land"),
        F.coalesce(F.max(F.when(layer == "climate", F.struct("region_id.order", "region_id.code")))["code"], F.lit(0)).alias("climate_code"),
    )


def masked_by(cells: DataFrame, covered: DataFrame, value: str) -> DataFrame:
    """:func:`with_masks` and the climate code (0 = none) from a table of :func:`overlay`."""
    data, inside = fn.has_data(value), F.coalesce("on_land", F.lit(False))
    return cells.join(covered.select(*CELL, "on_land", "climate_code"), CELL, "left").withColumns({
        "land": data & inside, "offshore": data & ~inside, "climate_code": F.coalesce("climate_code", F.lit(0)),
    }).drop("on_land")


def climate_edges(polygons: DataFrame, gridcodes: DataFrame) -> DataFrame:
    """Edge table with ``climate_code`` of polygons ``(region_id, gridcode, rings)`` and a lookup of grid codes."""
    letter = F.substring("climate", 1, 1)
    code = F.lit(None).cast("int")
    for k, v in CLIMATE_CODE.items():
        code = F.when(letter == k, v).otherwise(code)
    coded = polygons.join(gridcodes, "gridcode").select("region_id", code.alias("climate_code"))
    return edges(polygons).join(coded, "region_id")


# ---- kernel -----------------------------------------------------------------
def kernel_weights(radius: int) -> np.ndarray:
    """Inverse-distance weights in a circle of ``radius`` cells, centre distance 1, sum 1."""
    span = np.arange(-radius, radius + 1)
    dist = np.hypot(span[:, None], span[None, :])
    inside = dist <= radius
    dist[radius, radius] = 1.0
    weights = np.where(inside, 1.0 / dist, 0.0)
    return weights / weights.sum()


def kernel_smooth(
    cells: DataFrame, value: str, radius: int, grid: Grid,
    boundary: str = "null", wrap_lon: bool = False, block: int = 64, out: str = "smoothed",
    null_window: str = "square",
) -> DataFrame:
    """Weighted neighbourhood mean of ``value`` on the grid; ``cells`` has one row per cell.

    A missing value makes the result null for every cell whose kernel window holds it:
    the whole square around the circle (as an array convolution does), or only the circle
    with ``null_window="circle"``. Beyond the grid edge, ``boundary="null"``
    has no data and ``"symm"`` mirrors the grid; ``wrap_lon`` joins its west and east ends.

    The grid is cut into square blocks. A cell is copied to the blocks that see it within
    the radius (about 1.6 copies at the default block for radius 8, instead of one row per
    kernel entry), and each block, never more than ``(block + 2*radius)**2`` cells, is
    smoothed as one small array inside its task.
    """
    if boundary not in ("null", "symm"):
        raise ValueError(f"unknown boundary {boundary!r}")
    if null_window not in ("square", "circle"):
        raise ValueError(f"unknown null window {null_window!r}")
    whole = null_window == "square"
    block = max(block, 2 * radius)
    weights = kernel_weights(radius)

    def positions(c: str, n: int, wrap: bool) -> Column:
        """Where a row or column shows up within the radius of the grid: at itself and at all its images, also
        of a grid smaller than the radius. Mirrored rows repeat every 2n, wrapped ones every n."""
        at = F.col(c)
        if wrap:
            images = [at + k * n for k in range(-(radius // n) - 1, radius // n + 2)]
        elif boundary == "symm":
            turns = range(-(radius // (2 * n)) - 1, radius // (2 * n) + 2)
            images = [x + 2 * n * k for k in turns for x in (at, -1 - at)]
        else:
            images = [at]
        return F.explode(F.filter(F.array(*images), lambda x: (x >= -radius) & (x < n + radius)))

    def blocks(c: str, n: int) -> Column:
        lo = F.greatest(F.floor((F.col(c) - radius) / block), F.lit(0))
        hi = F.least(F.floor((F.col(c) + radius) / block), F.lit((n - 1) // block))
        return F.explode(F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))))

    spread = (
        cells.select(
            F.col("lat_i").cast("int"), F.col("lon_i").cast("int"),
            F.col(value).cast("double").alias("_v"),
        )
        .withColumn("_i", positions("lat_i", grid.n_lat, False))
        .withColumn("_j", positions("lon_i", grid.n_lon, wrap_lon))
        .withColumn("_bi", blocks("_i", grid.n_lat))
        .withColumn("_bj", blocks("_j", grid.n_lon))
        .withColumn("_own", (F.col("_i") == F.col("lat_i")) & (F.col("_j") == F.col("lon_i")))
    )
    side = block + 2 * radius

    def smooth_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i = rows["_i"].to_numpy() - key[0] * block + radius
        j = rows["_j"].to_numpy() - key[1] * block + radius
        field = np.full((side, side), np.nan)
        field[i, j] = rows["_v"].to_numpy()
        total = np.zeros((block, block))
        for di in range(2 * radius + 1):
            for dj in range(2 * radius + 1):
                if whole or weights[di, dj]:  # 0 * NaN is NaN
                    total += weights[di, dj] * field[di : di + block, dj : dj + block]
        core = (
            rows["_own"].to_numpy()
            & (i >= radius) & (i < radius + block) & (j >= radius) & (j < radius + block)
        )
        mine = rows.loc[core, ["lat_i", "lon_i"]].copy()
        result = total[i[core] - radius, j[core] - radius]
        mine[out] = pd.Series(result, index=mine.index).where(np.isfinite(result), None)
        return mine

    schema = f"lat_i int, lon_i int, {out} double"
    smoothed = spread.groupBy("_bi", "_bj").applyInPandas(smooth_block, schema)
    # Arrow carries a missing double as NaN; the data model says null.
    return smoothed.withColumn(out, fn.finite(out))


def buffered_smooth(
    cells: DataFrame, value: str, radius: int, grid: Grid, window: tuple[int, int, int, int], **options,
) -> DataFrame:
    """:func:`kernel_smooth` of the cells in ``window`` (first and last row, first and last column) from
    their surroundings: only cells within the radius are read, and only the window is returned.

    The edge rule holds at the edge of the widened window, so it matters only where the grid ends.
    """
    top, bottom = max(0, window[0] - radius), min(grid.n_lat - 1, window[1] + radius)
    west, east = max(0, window[2] - radius), min(grid.n_lon - 1, window[3] + radius)
    part = Grid(grid.lon0 + west * grid.res, grid.lat0 - top * grid.res, grid.res, east - west + 1, bottom - top + 1)
    near = cells.filter(F.col("lat_i").between(top, bottom) & F.col("lon_i").between(west, east))
    moved = near.withColumns({"lat_i": F.col("lat_i") - top, "lon_i": F.col("lon_i") - west})
    back = kernel_smooth(moved, value, radius, part, **options).withColumns(
        {"lat_i": (F.col("lat_i") + top).cast("int"), "lon_i": (F.col("lon_i") + west).cast("int")})
    return back.filter(F.col("lat_i").between(*window[:2]) & F.col("lon_i").between(*window[2:]))


def settlement_density(pixels: DataFrame, grid: Grid, value: str = "value", how: str = "avg") -> DataFrame:
    """Built-up area per cell and its share of the cell's ellipsoidal area, null for a cell without area (centred on a pole)."""
    from heliogale.operators.grid import raster_reduce

    lat = fn.dbl(grid.lat0) - fn.dbl(grid.res) * F.col("lat_i")
    return raster_reduce(pixels, grid, [value], how).select(
        *CELL, F.col(value).alias("settlement_m2"),
        fn.safe_ratio(F.col(value), fn.pixel_area_m2(lat, grid.res)).alias("settlement_share"),
    )


def demand_proximity(
    pixels: DataFrame, grid: Grid, radius_deg: float, value: str = "value", boundary: str = "symm", **options,
) -> DataFrame:
    """Settlement smoothed over its surroundings, with the settlement itself.

    Pixels are reduced on a grid that is wider by the radius, smoothed there and cropped, so the edge of
    ``grid`` sees the real surroundings; the edge rule only acts beyond those. A grid around the whole
    circle is not widened but joined at its ends.
    """
    radius = int(radius_deg / grid.res)
    around = abs(grid.n_lon * grid.res - 360) < 1e-9
    side = 0 if around else radius
    wide = Grid(grid.lon0 - side * grid.res, grid.lat0 + radius * grid.res, grid.res, grid.n_lon + 2 * side, grid.n_lat + 2 * radius)
    density = settlement_density(pixels, wide, value)
    window = (radius, radius + grid.n_lat - 1, side, side + grid.n_lon - 1)
    near = buffered_smooth(density, "settlement_share", radius, wide, window, out="demand",
                           **{"boundary": boundary, "wrap_lon": around, **options})
    inside = density.filter(F.col("lat_i").between(*window[:2]) & F.col("lon_i").between(*window[2:]))
    both = inside.select(*CELL, "settlement_m2").join(near, CELL, "left")
    return both.withColumns({
        "lat_i": (F.col("lat_i") - radius).cast("int"), "lon_i": (F.col("lon_i") - side).cast("int")})
