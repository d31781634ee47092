"""End-to-end batch jobs: each reads stored tables, writes stored tables, and leaves the
next job a file to start from, so that a lost executor or a stopped run costs one stage.

Every stage notes its parameters and the marks of all that it reads, so the notes form a graph from the sources
to the reports. A stage asked for with other parameters is an error; one whose inputs have changed is made again;
and a stage that would read an outdated table raises instead. :func:`build_all` runs the graph in order, so a
changed source costs the stages behind it and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliogale import config
from heliogale.config import Grid
from heliogale.functions import columns as fn
from heliogale.operators import country, grid, ml, spatial, stats, storage, timeseries, zones
from heliogale.sources import notes, readers, sinks

CELL = grid.CELL


@dataclass(frozen=True)
class Places:
    """Where a run keeps its tables; ``root`` is a folder every executor can reach.

    ``ssrd_basis`` says what the daily radiation of the run is; storage and zones both go by it. The
    default is the daily sum of hourly energies that :func:`build_daily` stores.
    """

    root: str
    ssrd_basis: str = config.SSRD_BASIS

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def once(self, spark: SparkSession, name: str, make, reads: tuple[str, ...] = (), sources: tuple[str | None, ...] = (),
             **parameters) -> DataFrame:
        """The stage ``name``, made from other stages (``reads``) and paths (``sources``)."""
        inputs = [self.at(r) for r in reads] + [p for p in sources if p]
        return sinks.computed_once(spark, self.at(name), make, parameters, inputs)


def build_abundance(spark: SparkSession, places: Places, solar: str, wind: str, area: Grid,
                    nodata: float | None = None) -> DataFrame:
    """Atlas rasters to capacity factors per cell."""
    return places.once(spark, "abundance", lambda: grid.resample_atlas(
        readers.read_raster(spark, solar, nodata), readers.read_raster(spark, wind, nodata), area),
        (), (solar, wind), solar=solar, wind=wind, area=area, nodata=nodata)


def build_demand(spark: SparkSession, places: Places, settlement: str, area: Grid,
                 nodata: float | None = None, **options) -> DataFrame:
    """Settlement raster to smoothed demand proximity per cell, from pixels up to a radius beyond ``area``."""
    return places.once(spark, "demand", lambda: spatial.demand_proximity(
        readers.read_raster(spark, settlement, nodata), area, config.KERNEL_RADIUS_DEG, **options),
        (), (settlement,), settlement=settlement, area=area, nodata=nodata, **options)


def build_daily(spark: SparkSession, places: Places, hourly: str, area: Grid, variables: list[str],
                years=config.YEARS, bounds=None, buckets: int | None = None) -> DataFrame:
    """Hourly reanalysis to daily values per cell: the one pass over the largest input,
    with all variables reduced together. Every cell of ``area`` takes its nearest source cell; ``bounds``
    (default: the area and one source step around it) limits what is read. Stored bucketed by cell and
    sorted by day, so that the climatology, the correlation and the storage sweep need no shuffle of it.

    The lattice's axes come from one aggregate over the hours' coordinates; then the hours are read once and dealt
    out once, as daily sums by cell. ``buckets`` follows from the bytes of the result if it is not given."""
    days = 366 * (years[1] - years[0] + 1)
    n = buckets or sinks.pieces(area.n_lat * area.n_lon * days, 8 * len(variables) + 12)
    edge = max(area.res, 1.0)
    box = bounds or (area.lon0 - edge, area.lat0 - area.res * area.n_lat - edge,
                     area.lon0 + area.res * area.n_lon + edge, area.lat0 + edge)

    def make() -> DataFrame:
        rows = readers.read_reanalysis(spark, hourly, variables, box, years)
        # The lattice of all hours: the first one may lack rows or columns of it.
        return timeseries.daily_in_place(grid.nearest_cells(rows, rows, area), CELL, variables, n)

    made_with = {"hourly": hourly, "area": area, "variables": variables, "years": years, "bounds": box}
    return sinks.bucketed_once(spark, places.at("daily"), make, CELL, n, [*CELL, "date"], made_with, [hourly], True)


def _daily(spark: SparkSession, places: Places) -> DataFrame:
    """The stored daily table, with its buckets."""

    def missing() -> DataFrame:
        raise FileNotFoundError(f"{places.at('daily')}: run build_daily first")

    return sinks.bucketed_once(spark, places.at("daily"), missing, CELL)


def build_climatology(spark: SparkSession, places: Places, variables: list[str]) -> DataFrame:
    """Day-of-year climatology of the daily table, and its annual mean."""
    daily = _daily(spark, places)
    clim = places.once(spark, "climatology", lambda: timeseries.doy_climatology(daily, CELL, variables),
                       ("daily",), variables=variables)
    return places.once(spark, "annual_mean", lambda: timeseries.annual_mean(clim, CELL, variables),
                       ("climatology",), variables=variables)


def build_complementarity(spark: SparkSession, places: Places, wind: str = "ws100", solar: str = "ssrd") -> DataFrame:
    daily = _daily(spark, places)
    return places.once(spark, "complementarity", lambda: timeseries.complementarity(daily, CELL, wind, solar),
                       ("daily",), wind=wind, solar=solar)


def build_storage(spark: SparkSession, places: Places, years=config.YEARS, metric: str = "mean", **options) -> DataFrame:
    """Deficit per cell, season and share, then the best share per cell."""
    daily = _daily(spark, places)
    factor = config.SSRD_FACTOR[places.ssrd_basis]
    made_with = {"years": years, "ssrd_basis": places.ssrd_basis, **options}

    def make() -> DataFrame:
        means = spark.read.parquet(places.at("annual_mean")).select(
            *CELL, F.col("ws100").alias("wind_mean"), F.col("ssrd").alias("solar_mean"))
        return storage.deficit_from_daily(daily, means, CELL, years, wind="ws100", solar="ssrd", ssrd_factor=factor, **options)

    deficits = places.once(spark, "storage", make, ("daily", "annual_mean"), **made_with)
    return places.once(spark, f"storage_{metric}", lambda: storage.aggregate(deficits, CELL, metric), ("storage",), **made_with)


def build_overlay(spark: SparkSession, places: Places, land: str, area: Grid, climate: str | None = None,
                  gridcodes: str | None = None) -> DataFrame:
    """Land and climate class of the cells, from one pass over both polygon layers. ``climate`` holds polygons
    ``(region_id, gridcode, rings)`` and ``gridcodes`` the CSV of their codes; without them all classes are 0."""

    def make() -> DataFrame:
        belts = None if climate is None else spatial.climate_edges(
            spark.read.parquet(climate), readers.read_gridcodes(spark, gridcodes))
        return spatial.overlay(spatial.edges(spark.read.parquet(land)), belts, area)

    return places.once(spark, "overlay", make, (), (land, climate, gridcodes), land=land, area=area, climate=climate, gridcodes=gridcodes)


def fill_solar(spark: SparkSession, places: Places, land: str, area: Grid, source: Grid | None = None,
               climate: str | None = None, gridcodes: str | None = None) -> DataFrame:
    """Gap-filled solar capacity factors from annual radiation and temperature.

    ``source`` is the grid of the annual means where it is not ``area``; the predictors are then
    interpolated to the cells."""
    covered = build_overlay(spark, places, land, area, climate, gridcodes)

    def make() -> DataFrame:
        raw = spark.read.parquet(places.at("abundance"))
        means = spark.read.parquet(places.at("annual_mean")).select(*CELL, "ssrd", "t2m")
        if source is None or source == area:
            known = raw.join(means, CELL, "left")
        else:
            known = raw.withColumns(_centres(area))
            for predictor in ("ssrd", "t2m"):
                known = grid.bilinear_join(known, means, source, predictor)
        masked = spatial.masked_by(known, covered, "wind_CF")
        filled = ml.ols_fill(masked, "solar_CF", ["ssrd", "t2m"], F.col("land"))
        return filled.select(*raw.columns)

    return places.once(spark, "abundance_filled", make, ("abundance", "annual_mean", "overlay"), area=area, source=source)


def _centres(area: Grid) -> dict[str, Column]:
    return {"latitude": fn.dbl(area.lat0) - fn.dbl(area.res) * F.col("lat_i"),
            "longitude": fn.dbl(area.lon0) + fn.dbl(area.res) * F.col("lon_i")}


def build_cells(spark: SparkSession, places: Places, land: str, area: Grid, climate: str | None = None,
                gridcodes: str | None = None) -> DataFrame:
    """The merged cell table with masks, climate, normalised demand and mean storage."""
    covered = build_overlay(spark, places, land, area, climate, gridcodes)
    filled = readers.finished(spark, places.at("abundance_filled"))

    def make() -> DataFrame:
        abundance = readers.read_preferred(spark, places.at("abundance_filled"), places.at("abundance"))
        demand = spark.read.parquet(places.at("demand")).select(*CELL, F.col("demand").alias("demand_raw"))
        means = spark.read.parquet(places.at("annual_mean")).select(
            *CELL, F.col("ws100").alias("wind_climatology"), F.col("ssrd").alias("solar_climatology"))
        held = spark.read.parquet(places.at("storage_mean")).select(
            *CELL, F.col("duration_metric").alias("storage"), "optimal_alpha")
        merged = grid.merge_cells([abundance, stats.normalize_p95(demand, "demand_raw", "demand"), means, held])
        return spatial.masked_by(merged, covered, "wind_CF").withColumns(_centres(area))

    # Filling the gaps later changes what the cells are made from.
    reads = ("abundance_filled" if filled else "abundance", "demand", "annual_mean", "storage_mean", "overlay")
    return places.once(spark, "cells", make, reads, area=area)


def build_zones(spark: SparkSession, places: Places, thresholds: dict | None = None) -> DataFrame:
    """All four classifications, the detailed groups and the resource score per cell."""

    def make() -> DataFrame:
        cells = spark.read.parquet(places.at("cells"))
        median = stats.quantile_threshold(cells, "demand", config.DETAILED.demand_quantile)
        out = cells
        for spec in (config.ABUNDANCE, config.ABUNDANCE_OFFSHORE_WIND, config.FULL, config.DETAILED):
            out = zones.classify(out, spec, thresholds, ssrd_basis=places.ssrd_basis,
                                 demand_threshold=median, out=f"zone_{spec.name}")
        labelled = zones.group(out, zones.groups_for("detailed"), "zone_detailed")
        return zones.resource_availability(labelled, zone="zone_detailed")

    return places.once(spark, "zones", make, ("cells",), thresholds=thresholds, ssrd_basis=places.ssrd_basis)


def _located(spark: SparkSession, places: Places, regions: DataFrame, area: Grid) -> DataFrame:
    """The zoned cells with the country of ``regions`` they lie in, as ``region_id``."""
    edges = spatial.edges(regions, region="country_id", part="shape_class")
    return spatial.points_in_regions(spark.read.parquet(places.at("zones")), edges, area, boxes=config.REGION_BOXES)


def build_country(spark: SparkSession, places: Places, shapes: str, area: Grid, allowed: DataFrame | None = None,
                  shape_class: str | None = None, name: str = "country",
                  extra_groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Rank correlation of resource and demand per country.

    Every shape row is a region; a country may have several (land, maritime), which count
    as one. Run it for all shapes and for land only to study the shift between the two. ``allowed`` is told
    apart by the countries it lists.
    """

    def make() -> DataFrame:
        regions = readers.read_regions(spark, shapes, shape_class, allowed)
        metrics = country.correlate(
            _located(spark, places, regions, area).select(
                F.col("region_id").alias("iso3"), F.col("resource_availability").alias("resource"), "demand", "storage"),
            "iso3", "resource", "demand", ("storage",), extra_groups=extra_groups)
        return _named(metrics, regions).withColumnRenamed("corr", "resource_demand_corr")

    listed = None if allowed is None else notes.content_mark(allowed.select("country_id").distinct())
    return places.once(spark, name, make, ("zones",), (shapes,), shapes=shapes, area=area, shape_class=shape_class,
                       extra_groups=extra_groups, allowed=listed)


def _named(metrics: DataFrame, regions: DataFrame) -> DataFrame:
    """``metrics`` by ``iso3`` with the name of each country, or its code where it has none."""
    names = regions.groupBy(F.col("country_id").alias("iso3")).agg(F.min("parent_name").alias("country_name"))
    return metrics.join(names, "iso3", "left").withColumn("country_name", F.coalesce("country_name", "iso3"))


FEATURES = ["avg_storage", "resource_demand_corr", "avg_resource"]


def build_clusters(spark: SparkSession, places: Places, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """Country clusters with canonical ids, and their summary."""

    def make() -> DataFrame:
        metrics = stats.min_max(spark.read.parquet(places.at("country")), "avg_storage", "avg_storage")
        rows, centres = ml.canonical_clusters(*ml.kmeans(metrics, FEATURES, k))
        return rows.join(centres.select("cluster", F.struct(*FEATURES).alias("centroid")), "cluster").select(
            *metrics.columns, "cluster", "centroid")

    stored = places.once(spark, "clusters", make, ("country",), k=k)
    centres = stored.select("cluster", "centroid").distinct().select("cluster", "centroid.*")
    rows = stored.drop("centroid")
    return rows, country.cluster_summary(rows, centres)


# ---- from zones and clusters to reports ---------------------------------------------------------
SCHEMES = {"detailed": "zone_detailed", "full": "zone_full"}


def build_shares(spark: SparkSession, places: Places) -> DataFrame:
    """Shares of the zone groups: scheme, mask (all, land), base, subgroup, n, percentage.

    One scan and one group-by over labels serve every scheme and mask; groups are looked up on the few labels.
    """

    def make() -> DataFrame:
        cells = spark.read.parquet(places.at("zones"))
        schemes = F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(z).alias("zone")) for s, z in SCHEMES.items()])
        labels = cells.select("land", F.inline(schemes)).groupBy("scheme", "zone", "land").agg(F.count("*").alias("n"))
        grouped = None
        for scheme in SCHEMES:
            of = zones.group(labels.filter(F.col("scheme") == scheme), zones.groups_for(scheme))
            grouped = of if grouped is None else grouped.unionByName(of)
        masks = F.array_compact(F.array(F.lit("all"), F.when(F.col("land"), F.lit("land"))))
        counts = grouped.filter("base is not null").withColumn("mask", F.explode(masks)).groupBy(
            "scheme", "mask", "base", "subgroup").agg(F.sum("n").alias("n"))
        whole = F.sum("n").over(Window.partitionBy("scheme", "mask"))  # a few dozen groups
        return counts.withColumn("percentage", F.col("n") / whole * 100)

    return places.once(spark, "shares", make, ("zones",), schemes=SCHEMES)


def build_climate(spark: SparkSession, places: Places) -> tuple[DataFrame, DataFrame]:
    """Base zones of land against climate classes: the crosstab with its shares, and the strength of the link.

    ``climate_crosstab`` has every pair of the land bases and all classes, "Undefined" included, with its share of
    all, and within a base and within a class where the class is known. ``climate_association`` is Cramer's V over
    the known classes.
    """
    bases, names = list(config.LAND_BASES), list(config.CLIMATE_NAME.values())
    known = names[1:]

    def named() -> DataFrame:
        name = F.create_map(*[F.lit(x) for item in config.CLIMATE_NAME.items() for x in item])
        return spark.read.parquet(places.at("zones")).filter("land and base is not null").select(
            "base", name[F.col("climate_code")].alias("climate"))

    def crosstab() -> DataFrame:
        counts = stats.climate_share(named(), "base", "climate", bases, names)
        n = F.when(F.col("climate") != names[0], F.col("n"))
        return counts.withColumns({
            "of_base": fn.safe_ratio(n, F.sum(n).over(Window.partitionBy("base"))),
            "of_climate": fn.safe_ratio(n, F.sum(n).over(Window.partitionBy("climate"))),
        })

    table = places.once(spark, "climate_crosstab", crosstab, ("zones",))
    link = places.once(spark, "climate_association", lambda: stats.cramers_v(named(), "base", "climate", bases, known), ("zones",))
    return table, link


def build_poor_zones(spark: SparkSession, places: Places, shapes: str, elevation: str, precipitation: str, area: Grid,
                     shape_class: str | None = "land", code: str = "P") -> DataFrame:
    """Countries with cells of the poor zone ``code`` on land: means of latitude, height and precipitation over
    those cells, their number, all cells of the country and the share.

    Both surfaces are put on the cells once, from their first time step and nearest source cell.
    """

    def surface() -> DataFrame:
        fields = []
        for path, stored, name in ((elevation, "z", "elevation"), (precipitation, "tp", "precipitation")):
            rows = readers.read_surface(spark, path, stored)
            value = fn.geopotential_to_metres(stored) if stored == "z" else F.col(stored)
            fields.append(grid.nearest_cells(rows, rows, area).select(*CELL, value.alias(name)))
        return grid.merge_cells(fields)

    def make() -> DataFrame:
        regions = readers.read_regions(spark, shapes, shape_class)
        cells = _located(spark, places, regions, area).join(held, CELL, "left")
        on_land = cells.withColumns({c: F.when(F.col("land"), F.col(c)) for c in ("subgroup", "elevation", "precipitation")})
        metrics = country.poor_zone_stats(on_land.withColumnRenamed("region_id", "iso3"), "iso3", code=code)
        return _named(metrics, regions)

    held = places.once(spark, "surface", surface, (), (elevation, precipitation), elevation=elevation, precipitation=precipitation, area=area)
    return places.once(spark, "poor_zones", make, ("zones", "surface"), (shapes,), shapes=shapes, area=area, shape_class=shape_class, code=code)


def build_country_map(spark: SparkSession, places: Places, shapes: str, area: Grid) -> DataFrame:
    """Country metrics and cluster carried back to the cells."""

    def make() -> DataFrame:
        cells = _located(spark, places, readers.read_regions(spark, shapes), area).select(
            *CELL, F.col("region_id").alias("iso3"), "base", "subgroup")
        metrics = spark.read.parquet(places.at("clusters")).select("iso3", "resource_demand_corr", "avg_resource", "avg_storage", "cluster")
        return country.back_project(cells, metrics, "iso3", metrics.columns[1:])

    return places.once(spark, "country_map", make, ("zones", "clusters"), (shapes,), shapes=shapes, area=area)


def build_composition(spark: SparkSession, places: Places, labelled_only: bool = False) -> DataFrame:
    """Share of each base zone among the cells of a cluster."""
    return places.once(spark, "composition", lambda: country.composition(
        spark.read.parquet(places.at("country_map")), labelled_only=labelled_only), ("country_map",), labelled_only=labelled_only)


def build_shift(spark: SparkSession, places: Places, land: str = "country_land", both: str = "country") -> tuple[DataFrame, DataFrame]:
    """What the sea adds to a country: its metrics with it less those of land only, and the mean by cluster.

    Storage of both tables is scaled by the range of the one with the sea."""

    def make() -> DataFrame:
        with_sea = spark.read.parquet(places.at(both))
        scaled = [stats.min_max(t, "avg_storage", "avg_storage", scale_of=with_sea).select("iso3", *FEATURES)
                  for t in (spark.read.parquet(places.at(land)), with_sea)]
        cluster = spark.read.parquet(places.at("clusters")).select("iso3", "country_name", "cluster")
        return country.shift(*scaled, "iso3", FEATURES).join(cluster, "iso3", "left")

    shifts = places.once(spark, "shift", make, (land, both, "clusters"), land=land, both=both)
    means = places.once(spark, "shift_by_cluster", lambda: shifts.filter("cluster is not null").groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.avg(f"{m}_shift").alias(f"{m}_shift") for m in FEATURES]), ("shift",))
    return shifts, means


def write_reports(spark: SparkSession, places: Places, digits: int = 2) -> dict[str, str]:
    """The CSV reports of a run, by name; each is a small table or states how many rows it keeps."""
    read = lambda name: spark.read.parquet(places.at(name))
    stored = read("clusters")
    summary = country.cluster_summary(stored, stored.select("cluster", "centroid").distinct().select("cluster", "centroid.*"))
    share = lambda scheme, mask: read("shares").filter((F.col("scheme") == scheme) & (F.col("mask") == mask)).drop("scheme", "mask")
    wanted = {
        "zone_shares_land": (share("detailed", "land"), [F.desc("percentage"), "subgroup"], None),
        "zone_shares_all": (share("detailed", "all"), [F.desc("percentage"), "subgroup"], None),
        "poor_zones": (read("poor_zones"), [F.desc("percentage"), "iso3"], 120),
        "country_metrics": (read("country"), ["iso3"], None),
        "country_land_metrics": (read("country_land"), ["iso3"], None),
        "cluster_summary": (summary, ["cluster"], None),
        "climate_crosstab": (read("climate_crosstab"), ["base", "climate"], None),
        "composition": (read("composition"), ["cluster", F.desc("percentage"), "base"], None),
        "shift_by_cluster": (read("shift_by_cluster"), ["cluster"], None),
    }
    out = {}
    for name, (table, order, n) in wanted.items():
        out[name] = places.at(f"reports/{name}")
        sinks.write_report(table, out[name], order, n, digits)
    return out


@dataclass(frozen=True)
class World:
    """Paths of all sources of a run and what is asked of them."""

    area: Grid
    solar: str
    wind: str
    settlement: str
    hourly: str
    land: str
    climate: str
    gridcodes: str
    shapes: str
    elevation: str
    precipitation: str
    nodata: float | None = None
    years: tuple[int, int] = config.YEARS
    thresholds: dict | None = None
    extra_groups: dict | None = None
    k: int = 4
    variables: tuple[str, ...] = ("ws100", "ssrd", "t2m")


def build_all(spark: SparkSession, places: Places, world: World) -> dict[str, str]:
    """The whole chain, from rasters and hours to the reports. Stages that still follow from their sources are read."""
    w, variables = world, list(world.variables)
    build_abundance(spark, places, w.solar, w.wind, w.area, w.nodata)
    build_demand(spark, places, w.settlement, w.area, w.nodata)
    build_daily(spark, places, w.hourly, w.area, variables, w.years)
    build_climatology(spark, places, variables)
    build_complementarity(spark, places)
    build_storage(spark, places, w.years)
    fill_solar(spark, places, w.land, w.area, None, w.climate, w.gridcodes)
    build_cells(spark, places, w.land, w.area, w.climate, w.gridcodes)
    build_zones(spark, places, w.thresholds)
    build_shares(spark, places)
    build_climate(spark, places)
    build_poor_zones(spark, places, w.shapes, w.elevation, w.precipitation, w.area)
    build_country(spark, places, w.shapes, w.area, extra_groups=w.extra_groups)
    build_country(spark, places, w.shapes, w.area, shape_class="land", name="country_land")
    build_clusters(spark, places, w.k)
    build_country_map(spark, places, w.shapes, w.area)
    build_composition(spark, places)
    build_shift(spark, places)
    return write_reports(spark, places)
