"""Fixed values that define result semantics, plus small config types."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values (must equal the published workflow for equal results) ----
RESOLUTION_DEG = 0.25
TILE_DEG = 20.0
DOMAIN = (-180.0, -60.0, 180.0, 80.0)  # minx, miny, maxx, maxy
YEARS = (2023, 2024)
KERNEL_RADIUS_DEG = 2.0
ALPHAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
MIN_PIXELS = 50
LARGE_COUNTRY_PIXELS = 400
GRAVITY = 9.80665
ELLIPSOID_A = 6378137.0
ELLIPSOID_B = 6356752.3142

# Daily reduction per reanalysis variable: accumulated fluxes sum, states average.
DAILY_RULE = {"ws100": "mean", "t2m": "mean", "ssrd": "sum", "tp": "sum"}

# What the stored daily radiation is (from the rule above), and its factor to a daily sum.
SSRD_BASIS = "daily_sum"
SSRD_FACTOR = {"daily_sum": 1.0, "hourly_mean": 24.0}

THRESHOLDS = {
    "solar": {"low": 0.15, "high": 0.20},
    "wind_onshore": {"low": 0.25, "high": 0.35},
    "wind_offshore": {"low": 7.0, "high": 8.5},
    "solar_offshore": {"low": 150.0, "high": 225.0},
    "storage": {"land": 14.0, "offshore": 14.0},
}

# Descriptive cluster name, metric, comparison, bound.
CLUSTER_NAMES = (
    ("high resource", "avg_resource", ">=", 0.7),
    ("modest resource", "avg_resource", "<", 0.3),
    ("long storage", "avg_storage", ">=", 0.5),
    ("short storage", "avg_storage", "<", 0.3),
    ("high mismatch", "resource_demand_corr", "<", -0.2),
    ("match", "resource_demand_corr", ">=", 0.1),
)
# Position of a centroid in ascending correlation order -> published cluster id.
CLUSTER_ID_BY_POSITION = {0: 2, 1: 0, 2: 1, 3: 3}

# Non-standard country abbreviations -> three-letter codes.
ABBREVIATION_TO_CODE3 = {
    "N": "NOR", "F": "FRA", "J": "JPN", "S": "ZAF", "A": "AUS", "D": "DEU",
    "L": "THA", "B": "BRA", "P": "PAK", "E": "ESP", "I": "ITA", "NM": "MKD",
    "KO": "XKX", "INDO": "IDN", "SLO": "SVN", "DRC": "COD", "BiH": "BIH",
}
EXTRA_COUNTRIES = (
    "SWE", "BEL", "LUX", "CHE", "KHM", "LAO", "PRT", "AUT", "JAM", "ISR", "MLT",
)

CLIMATE_CODE = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5}
CLIMATE_NAME = {
    0: "Undefined", 1: "A (Tropical)", 2: "B (Dry)", 3: "C (Temperate)",
    4: "D (Continental)", 5: "E (Polar)",
}
LAND_BASES = ("A", "W", "Ws", "S", "Sw", "P")
# Mainland box applied to one country before its cells are analysed.
REGION_BOXES = {"USA": (-130.0, 20.0, -60.0, 55.0)}
# ---- end of fixed values ----


@dataclass(frozen=True)
class Grid:
    """A regular lat/lon lattice addressed by integers.

    ``latitude = lat0 - res * lat_i`` (rows run north to south) and
    ``longitude = lon0 + res * lon_i``. Joins use the integers, never floats.
    """

    lon0: float
    lat0: float
    res: float
    n_lon: int
    n_lat: int

    @classmethod
    def from_bounds(cls, bounds, res: float = RESOLUTION_DEG) -> "Grid":
        """Grid of a box: longitudes in [minx, maxx), latitudes in (miny, maxy]."""
        minx, miny, maxx, maxy = bounds
        return cls(minx, maxy, res, steps(maxx - minx, res), steps(maxy - miny, res))


def steps(span: float, res: float) -> int:
    """How many points ``start + k*res`` lie before ``start + span`` (end excluded)."""
    whole = round(span / res)
    if abs(whole * res - span) < 1e-9 * max(1.0, abs(span)):
        return int(whole)
    return int(span // res) + 1


@dataclass(frozen=True)
class ZoneSpec:
    """Which characters a zone label carries, in the order wind, solar, storage, demand."""

    name: str
    wind_land: bool = True
    solar_land: bool = True
    storage: bool = False
    demand: bool = False
    offshore: bool = False
    offshore_solar: bool = False
    demand_quantile: float = 0.5


ABUNDANCE = ZoneSpec("abundance", offshore=True, offshore_solar=True)
ABUNDANCE_OFFSHORE_WIND = ZoneSpec("abundance_offshore_wind", offshore=True)
DETAILED = ZoneSpec("detailed", storage=True, demand=True, offshore=True)
FULL = ZoneSpec("full", storage=True, demand=True, offshore=True, offshore_solar=True)
