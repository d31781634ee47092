"""Tiles, cells, alignment between grids, raster reduction and grid merging.

Cells are addressed by integer row/column keys, so every alignment is an equi-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogale.config import RESOLUTION_DEG, TILE_DEG, Grid
from heliogale.functions import columns as fn
from heliogale.plans.joins import dim_join
from heliogale.plans.order import running
from heliogale.plans.session import pinned

CELL = ["lat_i", "lon_i"]


# ---- generation -------------------------------------------------------------
def domain(spark: SparkSession, bounds) -> DataFrame:
    """One-row domain table from ``(minx, miny, maxx, maxy)``."""
    names = ("minx", "miny", "maxx", "maxy")
    return spark.range(1).select(*[fn.dbl(v).alias(n) for n, v in zip(names, bounds)])


def _count_until(start: Column, stop: Column, step: float) -> Column:
    """Number of points start, start+step, ... strictly before ``stop``."""
    ratio = (stop - start) / fn.dbl(step)
    whole = F.round(ratio)
    near = F.abs(ratio - whole) < 1e-9
    return F.when(near, whole).otherwise(F.ceil(ratio)).cast("int")


def tiles(domains: DataFrame, tile_size: float = TILE_DEG) -> DataFrame:
    """Non-overlapping tiles covering each domain row, longitude-major.

    The last tile may reach past the domain's upper edge. Columns of ``domains`` other
    than the bounds are kept; ``tile_lon``/``tile_lat`` number the tiles per domain.
    """
    keep = [c for c in domains.columns if c not in ("minx", "miny", "maxx", "maxy")]
    size = fn.dbl(tile_size)

    def numbers(low: str, high: str) -> Column:
        n = _count_until(F.col(low), F.col(high), tile_size)
        return F.when(n > 0, F.sequence(F.lit(0), n - 1))

    return (
        domains.withColumn("tile_lon", F.explode(numbers("minx", "maxx")))
        .withColumn("tile_lat", F.explode(numbers("miny", "maxy")))
        .withColumn("west", F.col("minx") + F.col("tile_lon") * size)
        .withColumn("south", F.col("miny") + F.col("tile_lat") * size)
        .select(
            *keep, "tile_lon", "tile_lat",
            F.col("west").alias("minx"), F.col("south").alias("miny"),
            (F.col("west") + size).alias("maxx"), (F.col("south") + size).alias("maxy"),
        )
    )


def cells(tile_rows: DataFrame, resolution: float = RESOLUTION_DEG) -> DataFrame:
    """Cells of each tile: longitudes in [minx, maxx) ascending, latitudes in (miny, maxy]
    descending, so neighbouring tiles never share a cell.

    Tiles are spread over tasks first; one task holds one tile's cells at a time.
    """
    res = fn.dbl(resolution)
    n_lon = _count_until(F.col("minx"), F.col("maxx"), resolution)
    n_lat = _count_until(-F.col("maxy"), -F.col("miny"), resolution)
    spread = tile_rows.repartition(*[F.col(c) for c in tile_rows.columns])
    return (
        spread.withColumn("row", F.explode(F.when(n_lat > 0, F.sequence(F.lit(0), n_lat - 1))))
        .withColumn("col", F.explode(F.when(n_lon > 0, F.sequence(F.lit(0), n_lon - 1))))
        .withColumn("latitude", F.col("maxy") - F.col("row") * res)
        .withColumn("longitude", F.col("minx") + F.col("col") * res)
    )


def with_tile(df: DataFrame, bounds, tile_size: float = TILE_DEG) -> DataFrame:
    """Attach the tile a cell belongs to (longitude half-open east, latitude half-open south)."""
    minx, miny, _, _ = bounds
    return df.withColumns(
        {
            "tile_lon": F.floor((F.col("longitude") - fn.dbl(minx)) / fn.dbl(tile_size)).cast("int"),
            "tile_lat": (
                F.ceil((F.col("latitude") - fn.dbl(miny)) / fn.dbl(tile_size)) - 1
            ).cast("int"),
        }
    )


def bbox(df: DataFrame, bounds, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Rows inside a half-open box; boxes across either meridian seam work, and an empty
    box simply gives no rows."""
    return df.filter(fn.in_box(lon, lat, bounds))


def cell_area_km2(df: DataFrame, lat: str = "latitude") -> DataFrame:
    """Area per latitude row, pixel size = mean latitude step of the table.

    The mean of consecutive differences telescopes to span / (rows - 1), so no ordered
    window over all rows is needed; a single row falls back to the default resolution.
    """
    row = df.agg(
        F.min(lat).alias("lo"), F.max(lat).alias("hi"), F.count_distinct(lat).alias("n")
    ).first()
    step = (row["hi"] - row["lo"]) / (row["n"] - 1) if row["n"] > 1 else RESOLUTION_DEG
    return df.withColumn("area_km2", fn.pixel_area_m2(lat, step) / fn.dbl(1e6))


# ---- snapping and alignment -------------------------------------------------
def snap(grid: Grid, lon="longitude", lat="latitude", clamp: bool = True) -> dict[str, Column]:
    """Row/column keys of the nearest grid point; a tie goes to the larger coordinate.

    With ``clamp`` points outside the grid take the edge row or column (nearest without
    tolerance); otherwise their keys lie outside 0..n-1.
    """
    res = fn.dbl(grid.res)
    j = F.floor((fn.as_col(lon) - fn.dbl(grid.lon0)) / res + fn.dbl(0.5))
    i = F.ceil((fn.dbl(grid.lat0) - fn.as_col(lat)) / res - fn.dbl(0.5))
    if clamp:
        j = F.least(F.greatest(j, F.lit(0)), F.lit(grid.n_lon - 1))
        i = F.least(F.greatest(i, F.lit(0)), F.lit(grid.n_lat - 1))
    null_safe = fn.as_col(lon).isNotNull() & fn.as_col(lat).isNotNull()
    return {
        "lat_i": F.when(null_safe, i).cast("int"),
        "lon_i": F.when(null_safe, j).cast("int"),
    }


def nearest_axis(source: list[float], start: float, step: float, n: int) -> dict[float, list[int]]:
    """Source coordinate -> the target positions ``start + step * k`` it is nearest to; a tie goes to the
    larger coordinate. A finer source leaves coordinates out, a coarser one serves several positions."""
    ordered = sorted(source, reverse=True)
    out: dict[float, list[int]] = {}
    for k in range(n if ordered else 0):
        out.setdefault(min(ordered, key=lambda x: abs(x - (start + step * k))), []).append(k)
    return out


def axis_values(axes: DataFrame, lon: str = "longitude", lat: str = "latitude") -> dict[str, list[float]]:
    """Distinct longitudes and latitudes of a lattice from one aggregate over its rows; both lists are as long as
    the lattice's edges."""
    row = axes.agg(F.collect_set(lon).alias("lon"), F.collect_set(lat).alias("lat")).first()
    return {lon: sorted(row["lon"]), lat: sorted(row["lat"])}


def nearest_cells(rows: DataFrame, axes: DataFrame, grid: Grid, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """``rows`` on the cells of ``grid``: every cell takes the rows of its nearest source cell, no others.

    ``axes`` holds the coordinates of the regular source lattice, such as one time step. Its distinct
    latitudes and longitudes, found by one aggregate, are bounded by the lattice's edges and not by its rows;
    they become literal maps in a projection, so the hours are neither joined nor shuffled.
    """
    held = axis_values(axes, lon, lat)

    def keys(axis: str, start: float, step: float, n: int) -> Column:
        found = nearest_axis(held[axis], start, step, n)
        pairs = [x for at, cells in found.items() for x in (fn.dbl(at), F.array(*[F.lit(c) for c in cells]))]
        return F.explode(F.try_element_at(F.create_map(*pairs), F.col(axis).cast("double")) if pairs else F.array().cast("array<int>"))

    by_row = rows.withColumn("lat_i", keys(lat, grid.lat0, -grid.res, grid.n_lat))
    return by_row.withColumn("lon_i", keys(lon, grid.lon0, grid.res, grid.n_lon))


def nearest_join(target: DataFrame, source: DataFrame, grid: Grid, values: list[str]) -> DataFrame:
    """Every target row gets the values of the nearest source cell.

    ``target`` has ``latitude``/``longitude``; ``source`` has ``lat_i``/``lon_i`` on
    ``grid``. Keys are computed, so this is a plain equi-join. Many fine target rows may
    share one source cell: the join is salted.
    """
    keyed = target.withColumns({f"_{k}": c for k, c in snap(grid).items()})
    src = source.select(
        F.col("lat_i").alias("_lat_i"), F.col("lon_i").alias("_lon_i"), *values
    )
    return dim_join(keyed, src, ["_lat_i", "_lon_i"], spread=["latitude", "longitude"]).drop("_lat_i", "_lon_i")


def bilinear_join(target: DataFrame, source: DataFrame, grid: Grid, value: str) -> DataFrame:
    """Bilinear interpolation of ``source`` (on ``grid``) at each target point.

    Null outside the hull of the grid points or when any of the four corners is missing.
    The coarse source is first gathered into one row per grid square (4 copies of the
    small side), then each target row needs a single equi-join.
    """
    res = fn.dbl(grid.res)
    corners = [(di, dj) for di in (0, 1) for dj in (0, 1)]
    squares = (
        source.filter(F.col(value).isNotNull())
        .select("lat_i", "lon_i", F.col(value).cast("double").alias("_v"))
        .withColumn(
            "_corner",
            F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in corners])),
        )
        .groupBy(
            (F.col("lat_i") - F.col("_corner.di")).alias("_qi"),
            (F.col("lon_i") - F.col("_corner.dj")).alias("_qj"),
        )
        .agg(
            *[
                F.max(F.when((F.col("_corner.di") == a) & (F.col("_corner.dj") == b), F.col("_v")))
                .alias(f"_c{a}{b}")
                for a, b in corners
            ]
        )
    )
    y = (fn.dbl(grid.lat0) - F.col("latitude")) / res
    x = (F.col("longitude") - fn.dbl(grid.lon0)) / res
    hull = (y >= 0) & (y <= grid.n_lat - 1) & (x >= 0) & (x <= grid.n_lon - 1)
    keyed = target.withColumns(
        {
            "_y": y, "_x": x,
            # At the far edge the last full square is used with weight 1.
            "_qi": F.when(hull, F.least(F.floor(y), F.lit(grid.n_lat - 2))).cast("int"),
            "_qj": F.when(hull, F.least(F.floor(x), F.lit(grid.n_lon - 2))).cast("int"),
        }
    )
    squares = squares.select(
        F.col("_qi").cast("int"), F.col("_qj").cast("int"), *[f"_c{a}{b}" for a, b in corners]
    )
    fy, fx = F.col("_y") - F.col("_qi"), F.col("_x") - F.col("_qj")
    blend = (
        F.col("_c00") * (1 - fy) * (1 - fx) + F.col("_c01") * (1 - fy) * fx
        + F.col("_c10") * fy * (1 - fx) + F.col("_c11") * fy * fx
    )
    joined = dim_join(keyed, squares, ["_qi", "_qj"], spread=["latitude", "longitude"])
    return joined.withColumn(value, blend).select(*target.columns, value)


# ---- raster reduction -------------------------------------------------------
def raster_reduce(
    pixels: DataFrame, grid: Grid, values: list[str], how: str = "avg", x: str = "x", y: str = "y"
) -> DataFrame:
    """Fine pixels -> coarse cells centred on the grid points; nodata (null) is skipped and
    a cell with only nodata is null. Pixels off the grid are dropped.

    A pixel belongs to the cell that holds its centre. ``how`` is avg, sum, min, max, mode or median. One
    group-by with map-side partial aggregation (for mode and median of counts per value), so dense cells cost no
    more than sparse ones.
    """
    reducers = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    by_value = {"mode": _most_frequent, "median": _middle}
    if how not in reducers and how not in by_value:
        raise ValueError(f"how must be one of {sorted([*reducers, *by_value])}; got {how!r}")
    keyed = pixels.withColumns(snap(grid, x, y, clamp=False)).filter(
        F.col("lat_i").between(0, grid.n_lat - 1) & F.col("lon_i").between(0, grid.n_lon - 1)
    )
    if how in by_value:
        return by_value[how](keyed, values)
    return keyed.groupBy(*CELL).agg(*[reducers[how](F.col(v)).alias(v) for v in values])


def _value_counts(keyed: DataFrame, values: list[str]) -> DataFrame:
    """cell, name, value, n: how often each value of each column occurs in a cell, and n = 0 for a null value.

    Counts merge next to the scan, so a cell or a value that holds a third of all pixels is a few rows.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), fn.finite(v).alias("value")) for v in values])
    return keyed.select(*CELL, F.inline(pairs)).groupBy(*CELL, "name", "value").agg(F.count("value").alias("n"))


def _spread_out(chosen: DataFrame, values: list[str]) -> DataFrame:
    """One row per cell with a column for each name of ``chosen`` (cell, name, value)."""
    return chosen.groupBy(*CELL).agg(*[F.max(F.when(F.col("name") == v, F.col("value"))).alias(v) for v in values])


def _most_frequent(keyed: DataFrame, values: list[str]) -> DataFrame:
    """The most frequent value of a cell, the smallest of equally frequent ones; null in a cell of nodata."""
    best = _value_counts(keyed, values).groupBy(*CELL, "name").agg(
        (-F.max(F.when(F.col("n") > 0, F.struct("n", (-F.col("value")).alias("v"))))["v"]).alias("value"))
    return _spread_out(best, values)


def _middle(keyed: DataFrame, values: list[str]) -> DataFrame:
    """The median of a cell, the mean of the two middle values of an even number; null in a cell of nodata.

    Running counts over value ranges say which values hold the middle ranks, whatever the size of a cell.
    """
    counts = pinned(_value_counts(keyed, values))
    placed = running(counts.filter("n > 0"), [*CELL, "name"], "value", "n")
    holds = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
    last = F.col("whole") - 1
    low, high = F.floor(last / 2), F.ceil(last / 2)
    middle = placed.groupBy(*CELL, "name").agg(
        ((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2).alias("value"))
    nothing = counts.filter("n = 0").select(*CELL, "name", F.lit(None).cast("double").alias("value"))
    return _spread_out(middle.unionByName(nothing), values)


def raster_average_weighted(
    pixels: DataFrame, grid: Grid, value: str, pixel_size: float, x: str = "x", y: str = "y"
) -> DataFrame:
    """Area-fraction average for pixel edges that do not line up with cell edges.

    Each pixel is split over the (at most four, when pixels are smaller than cells) cells
    it overlaps; the overlap share is its weight.
    """
    if pixel_size > grid.res:
        raise ValueError("pixels must not be larger than cells")
    res, half = fn.dbl(grid.res), fn.dbl(pixel_size / 2)
    # In units of cells, cell k covers [k, k+1): shift by half a cell.
    left = (F.col(x) - half - fn.dbl(grid.lon0)) / res + 0.5
    top = (fn.dbl(grid.lat0) - F.col(y) - half) / res + 0.5
    width = fn.dbl(pixel_size / grid.res)

    def parts(start: Column) -> Column:
        first = F.floor(start)
        share = F.least(fn.dbl(1), (first + 1 - start) / width)
        return F.array(
            F.struct(first.cast("int").alias("k"), share.alias("w")),
            F.struct((first + 1).cast("int").alias("k"), (fn.dbl(1) - share).alias("w")),
        )

    split = (
        pixels.filter(F.col(value).isNotNull())
        .select(F.col(value).alias("_v"), parts(left).alias("_xs"), parts(top).alias("_ys"))
        .withColumn("_x", F.explode("_xs"))
        .withColumn("_y", F.explode("_ys"))
        .select(
            F.col("_y.k").alias("lat_i"), F.col("_x.k").alias("lon_i"),
            (F.col("_x.w") * F.col("_y.w")).alias("_w"), "_v",
        )
        .filter(
            (F.col("_w") > 1e-12)
            & F.col("lat_i").between(0, grid.n_lat - 1)
            & F.col("lon_i").between(0, grid.n_lon - 1)
        )
    )
    return split.groupBy(*CELL).agg(
        fn.safe_ratio(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias(value)
    )


def resample_atlas(solar: DataFrame, wind: DataFrame, grid: Grid) -> DataFrame:
    """Capacity factors on the grid: solar from daily yield (/24), wind as stored.

    Both rasters reduce first; the small cell tables merge afterwards.
    """
    s = raster_reduce(solar, grid, ["value"]).select(
        *CELL, fn.daily_yield_to_cf("value").alias("solar_CF")
    )
    w = raster_reduce(wind, grid, ["value"]).select(*CELL, F.col("value").alias("wind_CF"))
    return merge_cells([s, w])


# ---- merging ----------------------------------------------------------------
def merge_cells(frames: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Full-outer merge of cell tables with distinct value columns.

    A union followed by one group-by shuffles each input once, where a chain of full
    joins would shuffle the growing result again for every input. A column in several tables is an
    error, and so is a cell that one table holds twice; the latter is raised when the result is computed.
    """
    keys = keys or CELL
    named = [c for f in frames for c in f.columns if c not in keys]
    twice = sorted({c for c in named if named.count(c) > 1})
    if twice:
        raise ValueError(f"columns {twice} occur in several tables")
    marked = [f.withColumn("_table", F.lit(k)) for k, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    most = F.greatest(*[F.count(F.when(F.col("_table") == k, 1)) for k in range(len(frames))], F.lit(0))
    merged = stacked.groupBy(*keys).agg(most.alias("_copies"), *[F.max(v).alias(v) for v in named])
    message = F.format_string("cell (%s) occurs %d times in a table", F.concat_ws(", ", *keys), "_copies")
    return merged.filter(
        F.when(F.col("_copies") <= 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    ).drop("_copies")


def prefer_filled(raw: DataFrame, filled: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Gap-filled value where there is one, else the raw value."""
    keys = keys or CELL
    merged = merge_cells([raw, filled.select(*keys, F.col(value).alias("_filled"))], keys)
    return merged.withColumn(value, F.coalesce("_filled", value)).drop("_filled")


def duplicate_cells(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cell keys occurring more than once: the stitch check after a multi-file scan."""
    keys = keys or CELL
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
