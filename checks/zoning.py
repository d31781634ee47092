"""Zone labels, groups, shares, crosstabs and resource availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cells import CLIMATE_SQL, climate_cells
from checks.registry import query
from checks.views import CELLS_SQL, EDGES_SQL, GRID_SQL, MASKS_SQL, grid_cells, masked_cells
from heliogale import config
from heliogale.functions import columns as fn
from heliogale.operators import stats, zones

SPECS = {
    "abundance": config.ABUNDANCE,
    "abundance_offshore_wind": config.ABUNDANCE_OFFSHORE_WIND,
    "detailed": config.DETAILED,
    "full": config.FULL,
}


def _class(c: str, low, high) -> str:
    return f"CASE WHEN {c} >= {high} THEN 'H' WHEN {c} >= {low} THEN 'M' ELSE 'L' END"


_TAIL = """ || CASE WHEN storage < 14 THEN 'R' WHEN storage >= 14 THEN 'V' END
  || CASE WHEN demand >= (SELECT quantile_cont(demand, 0.5) FROM v_cells) THEN 'h' ELSE 'l' END"""


def zone_sql(scheme: str) -> str:
    """A ``v_zone`` table over ``v_cells`` for one scheme."""
    tail = _TAIL if scheme in ("detailed", "full") else ""
    sun = " || " + _class("solar_climatology / 3600", 150, 225) if scheme in ("abundance", "full") else ""
    return f"""
v_zone AS (
  SELECT *, CASE
    WHEN offshore THEN 'offshore_' || {_class("wind_climatology", 7, 8.5)}{sun}{tail}
    WHEN land THEN {_class('"wind_CF"', 0.25, 0.35)} || {_class('"solar_CF"', 0.15, 0.2)}{tail} END AS zone
  FROM v_cells)"""


# Base and suffix from the characters of a label, independently of the pattern lists.
def grouped_sql(scheme: str) -> str:
    body = "replace(zone, 'offshore_', '')"
    pair = f"substring({body}, 1, 2)"
    wind_only = scheme in ("detailed", "abundance_offshore_wind")
    off_base = f"CASE WHEN {body} LIKE 'L%' THEN 'o' ELSE 'O' END"
    land_base = f"""CASE WHEN {pair} IN ('HH', 'MM') THEN 'A' WHEN {pair} IN ('HL', 'ML') THEN 'W'
      WHEN {pair} = 'HM' THEN 'Ws' WHEN {pair} IN ('LH', 'LM') THEN 'S' WHEN {pair} = 'MH' THEN 'Sw' ELSE 'P' END"""
    base = f"CASE WHEN zone LIKE 'offshore%' THEN {off_base} ELSE {land_base} END" if wind_only else land_base
    suffix = "''"
    if scheme in ("detailed", "full"):
        suffix = """CASE right(zone, 2) WHEN 'Rh' THEN '' WHEN 'Rl' THEN '_L'
          WHEN 'Vh' THEN CASE WHEN base IN ('P', 'o') THEN '' ELSE '_V' END
          ELSE CASE WHEN base IN ('P', 'o') THEN '_L' ELSE '_VL' END END"""
    return f"""
v_base AS (SELECT *, CASE WHEN zone IS NOT NULL THEN {base} END AS base FROM v_zone),
v_grouped AS (SELECT *, base || {suffix} AS subgroup FROM v_base)"""


def labelled(spark, sf, scheme: str = "detailed"):
    """Labels; the demand median needs the cells only, not their masks."""
    spec = SPECS[scheme]
    median = stats.quantile_threshold(grid_cells(spark, sf), "demand", 0.5) if spec.demand else None
    return zones.classify(masked_cells(spark, sf), spec, demand_threshold=median)


def grouped(spark, sf, scheme: str = "detailed"):
    return zones.group(labelled(spark, sf, scheme), zones.groups_for(scheme))


def _register_scheme(scheme: str) -> None:
    short = {"abundance_offshore_wind": "offshore_wind"}.get(scheme, scheme)

    @query(f"classify_{short}", f"{CELLS_SQL}, {zone_sql(scheme)} SELECT cell, zone FROM v_zone")
    def run_labels(spark, sf):
        return labelled(spark, sf, scheme).select("cell", "zone")

    @query(f"group_zones_{short}",
           f"{CELLS_SQL}, {zone_sql(scheme)}, {grouped_sql(scheme)} SELECT cell, base, subgroup FROM v_grouped")
    def run_groups(spark, sf):
        return grouped(spark, sf, scheme).select("cell", "base", "subgroup")


for _scheme in SPECS:
    _register_scheme(_scheme)

DETAILED_SQL = f"{CELLS_SQL}, {zone_sql('detailed')}, {grouped_sql('detailed')}"


@query("classify_quantile", CELLS_SQL + f""",
v_q AS (SELECT
  quantile_cont(CASE WHEN land THEN wind_climatology END, 1.0::DOUBLE / 3) AS wl,
  quantile_cont(CASE WHEN land THEN wind_climatology END, 2.0::DOUBLE / 3) AS wh,
  quantile_cont(CASE WHEN land THEN solar_climatology END, 1.0::DOUBLE / 3) AS sl,
  quantile_cont(CASE WHEN land THEN solar_climatology END, 2.0::DOUBLE / 3) AS sh,
  quantile_cont(CASE WHEN offshore THEN wind_climatology END, 1.0::DOUBLE / 3) AS ol,
  quantile_cont(CASE WHEN offshore THEN wind_climatology END, 2.0::DOUBLE / 3) AS oh FROM v_cells)
SELECT cell, CASE WHEN offshore THEN 'offshore_' || {_class("wind_climatology", "ol", "oh")}
  WHEN land THEN {_class("wind_climatology", "wl", "wh")} || {_class("solar_climatology", "sl", "sh")} END AS zone
FROM v_cells, v_q""")
def classify_quantile(spark, sf):
    return zones.classify_quantile(masked_cells(spark, sf)).select("cell", "zone")


# ---- groups -----------------------------------------------------------------
@query("group_percent", DETAILED_SQL + """
SELECT base, subgroup, round(count(*) * 100 / sum(count(*)) OVER ()::DOUBLE, 6) AS percentage
FROM v_grouped WHERE subgroup IS NOT NULL GROUP BY ALL""")
def group_percent(spark, sf):
    return fn.round_cols(zones.group_share(grouped(spark, sf)), 6, "percentage")


@query("group_percent_land", DETAILED_SQL + """
SELECT base, round(sum(n) * 100 / sum(sum(n)) OVER ()::DOUBLE, 6) AS percentage
FROM (SELECT base, subgroup, count(*) AS n FROM v_grouped WHERE land AND subgroup IS NOT NULL GROUP BY ALL)
GROUP BY base""")
def group_percent_land(spark, sf):
    """Land cells only, by base zone."""
    shares = zones.group_share(grouped(spark, sf).filter("land"))
    return fn.round_cols(zones.base_share(shares), 6, "percentage")


@query("group_matrix", DETAILED_SQL + """,
v_pct AS (SELECT base, subgroup, count(*) * 100 / sum(count(*)) OVER ()::DOUBLE AS p
  FROM v_grouped WHERE land AND subgroup IS NOT NULL GROUP BY ALL)
SELECT base, """ + ", ".join(
    f"""round(coalesce(sum(p) FILTER (subgroup = '{g}'), 0), 6) AS "{g}\""""
    for g in zones.land_only(zones.groups_for("detailed"))) + " FROM v_pct GROUP BY base")
def group_matrix(spark, sf):
    columns = list(zones.land_only(zones.groups_for("detailed")))
    shares = zones.group_share(grouped(spark, sf).filter("land"))
    return fn.round_cols(stats.pivot_share(shares, "base", "subgroup", "percentage", columns), 6, *columns)


@query("pattern_match", DETAILED_SQL + """
SELECT DISTINCT zone, subgroup FROM v_grouped WHERE subgroup IS NOT NULL""")
def pattern_match(spark, sf):
    """Labels met with the wildcard patterns themselves; the distinct labels are few."""
    found = stats.distinct_values(labelled(spark, sf), "zone")
    pairs = [F.struct(F.lit(p).alias("pattern"), F.lit(g).alias("subgroup"))
             for g, patterns in zones.groups_for("detailed").items() for p in patterns]
    return found.select("zone", F.inline(F.array(*pairs))).filter(
        zones.matches("zone", "pattern")).select("zone", "subgroup")


@query("unmatched_labels", DETAILED_SQL + """
SELECT DISTINCT zone FROM v_grouped WHERE zone IS NOT NULL AND base NOT IN ('A', 'W', 'Ws', 'S', 'Sw', 'P')""")
def unmatched_labels(spark, sf):
    """Against land groups only, every offshore label is left over."""
    return zones.unmatched(labelled(spark, sf), zones.land_only(zones.groups_for("detailed")))


@query("label_top10", DETAILED_SQL + """
SELECT zone, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER ()::DOUBLE, 6) AS percentage
FROM v_zone WHERE zone IS NOT NULL GROUP BY zone ORDER BY n DESC, zone LIMIT 10""")
def label_top10(spark, sf):
    return fn.round_cols(zones.label_counts(labelled(spark, sf)), 6, "percentage")


@query("distinct_labels", DETAILED_SQL + " SELECT DISTINCT zone FROM v_zone WHERE zone IS NOT NULL")
def distinct_labels(spark, sf):
    return stats.distinct_values(labelled(spark, sf), "zone")


@query("label_difference", f"""
WITH {GRID_SQL}, {EDGES_SQL}, {MASKS_SQL}, {zone_sql('full')},
v_old AS (SELECT DISTINCT zone FROM v_zone WHERE zone IS NOT NULL),
v_new AS (SELECT DISTINCT CASE WHEN offshore THEN 'offshore_' || {_class("wind_climatology", 7, 8.5)}{_TAIL}
    WHEN land THEN {_class('"wind_CF"', 0.25, 0.35)} || {_class('"solar_CF"', 0.15, 0.2)}{_TAIL} END AS zone FROM v_cells)
SELECT zone FROM v_old EXCEPT SELECT zone FROM v_new""")
def label_difference(spark, sf):
    """Labels of the full scheme that the detailed scheme does not produce."""
    full = stats.distinct_values(labelled(spark, sf, "full"), "zone")
    return full.subtract(stats.distinct_values(labelled(spark, sf), "zone"))


# ---- resource availability --------------------------------------------------
RESOURCE_SQL = DETAILED_SQL + """,
v_body AS (SELECT *, upper(replace(zone, 'offshore_', '')) AS body FROM v_grouped),
v_class AS (SELECT *,
  CASE substring(body, 1, 1) WHEN 'L' THEN 1 WHEN 'M' THEN 2 WHEN 'H' THEN 3 END::DOUBLE AS wind_class,
  CASE WHEN zone LIKE 'offshore_%' AND substring(body, 2, 1) IN ('R', 'V') THEN NULL
    ELSE CASE substring(body, 2, 1) WHEN 'L' THEN 1 WHEN 'M' THEN 2 WHEN 'H' THEN 3 END END::DOUBLE AS solar_class,
  (cell % 11) / 10::DOUBLE AS optimal_alpha FROM v_body),
"""


def _scaled_sql(raw: str) -> str:
    return RESOURCE_SQL + f"""
v_raw AS (SELECT *, {raw} AS raw FROM v_class),
v_ends AS (SELECT land, offshore, min(raw) AS lo, max(raw) AS hi FROM v_raw WHERE land OR offshore GROUP BY ALL),
v_resource AS (SELECT v.*, CASE WHEN raw IS NULL THEN NULL WHEN hi <= lo THEN 1 ELSE (raw - lo) / (hi - lo) END AS resource
  FROM v_raw v LEFT JOIN v_ends e ON v.land = e.land AND v.offshore = e.offshore)"""


MAX_RESOURCE_SQL = _scaled_sql(
    "CASE WHEN wind_class IS NULL THEN solar_class WHEN solar_class IS NULL THEN wind_class "
    "WHEN wind_class > solar_class THEN wind_class ELSE solar_class END")
_RESOURCE_OUT = " SELECT cell, wind_class, solar_class, round(resource, 6) AS resource_availability FROM v_resource"


def resource_cells(spark, sf, method: str = "max_abundance", **options):
    cells = grouped(spark, sf).withColumn("optimal_alpha", F.col("cell") % 11 / 10)
    return zones.resource_availability(cells, method, **options)


def _resource_out(df):
    return fn.round_cols(
        df.select("cell", "wind_class", "solar_class", "resource_availability"), 6, "resource_availability")


@query("resource_availability_max", MAX_RESOURCE_SQL + _RESOURCE_OUT)
def resource_availability_max(spark, sf):
    return _resource_out(resource_cells(spark, sf))


@query("resource_availability_alpha", _scaled_sql("""CASE WHEN wind_class IS NOT NULL OR solar_class IS NOT NULL THEN
  least(greatest(optimal_alpha, 0.2), 0.8) * coalesce(wind_class, 0)
  + (1 - least(greatest(optimal_alpha, 0.2), 0.8)) * coalesce(solar_class, 0) END""") + _RESOURCE_OUT)
def resource_availability_alpha(spark, sf):
    return _resource_out(resource_cells(spark, sf, "optimal_alpha", alpha_limits=(0.2, 0.8)))


# ---- crosstabs --------------------------------------------------------------
CLIMATE_ZONE_SQL = f"""{CLIMATE_SQL},
v_cells AS (
  SELECT c.*, coalesce("wind_CF" <> 0, false) AND cell IN (SELECT cell FROM v_inside) AS land,
    coalesce("wind_CF" <> 0, false) AND cell NOT IN (SELECT cell FROM v_inside) AS offshore
  FROM v_climate c), {zone_sql('abundance')}, {grouped_sql('abundance')},
v_pairs AS (SELECT base, climate_code FROM v_grouped WHERE base IS NOT NULL),
v_frame AS (SELECT b AS base, k AS climate_code FROM (VALUES ('A'), ('W'), ('Ws'), ('S'), ('Sw'), ('P')) x(b),
  (VALUES (0), (1), (2), (3), (4), (5)) y(k)),
v_count AS (SELECT f.base, f.climate_code, count(p.base) AS n FROM v_frame f LEFT JOIN v_pairs p
  ON p.base = f.base AND p.climate_code = f.climate_code GROUP BY ALL)"""
CODES = [1, 2, 3, 4, 5]


def climate_zones(spark, sf):
    """Base zone and climate class of every cell."""
    climate = climate_cells(spark, sf).select("cell", "climate_code")
    return grouped(spark, sf, "abundance").join(climate, "cell").select("cell", "base", "climate_code")


def _crosstab_sql(side: str) -> str:
    return CLIMATE_ZONE_SQL + f"""
SELECT base, climate_code, n, round(n / nullif(sum(n) OVER (PARTITION BY {side}), 0)::DOUBLE, 6) AS fraction
FROM v_count WHERE climate_code > 0"""


@query("crosstab_rows", _crosstab_sql("base"))
def crosstab_rows(spark, sf):
    out = stats.crosstab(climate_zones(spark, sf), "base", "climate_code", list(config.LAND_BASES), CODES, "row")
    return fn.round_cols(out, 6, "fraction")


@query("crosstab_norm", _crosstab_sql("climate_code"))
def crosstab_norm(spark, sf):
    out = stats.crosstab(climate_zones(spark, sf), "base", "climate_code", list(config.LAND_BASES), CODES, "column")
    return fn.round_cols(out, 6, "fraction")


@query("cramers_v", CLIMATE_ZONE_SQL + """,
v_e AS (SELECT n, sum(n) OVER (PARTITION BY base) * sum(n) OVER (PARTITION BY climate_code) / sum(n) OVER ()::DOUBLE AS e,
  sum(n) OVER () AS total FROM v_count WHERE climate_code > 0)
SELECT round(sum((n - e) ^ 2 / e), 6) AS chi2, CAST(max(total) AS BIGINT) AS n, 20 AS dof,
  round(sqrt(sum((n - e) ^ 2 / e) / (max(total) * 4)), 6) AS cramers_v
FROM v_e WHERE e > 0""")
def cramers_v(spark, sf):
    out = stats.cramers_v(climate_zones(spark, sf), "base", "climate_code", list(config.LAND_BASES), CODES, p_value=False)
    return fn.round_cols(out, 6, "chi2", "cramers_v")


@query("cramers_v_p", CLIMATE_ZONE_SQL + """,
v_e AS (SELECT n, sum(n) OVER (PARTITION BY base) * sum(n) OVER (PARTITION BY climate_code) / sum(n) OVER ()::DOUBLE AS e,
  sum(n) OVER () AS total FROM v_count WHERE climate_code > 0),
v_x AS (SELECT sum((n - e) ^ 2 / e) AS chi2, CAST(max(total) AS BIGINT) AS n FROM v_e WHERE e > 0)
SELECT round(chi2, 6) AS chi2, n, 20 AS dof, round(sqrt(chi2 / (n * 4)), 6) AS cramers_v,
  -- 20 degrees of freedom: ten terms of a Poisson sum
  round(list_sum(list_transform(range(10), lambda j: exp(j * ln(chi2 / 2) - chi2 / 2 - lgamma(j + 1)))), 9) AS p_value
FROM v_x""")
def cramers_v_p(spark, sf):
    """With the p-value of the link between climate and base zone."""
    out = stats.cramers_v(climate_zones(spark, sf), "base", "climate_code", list(config.LAND_BASES), CODES)
    return fn.round_cols(fn.round_cols(out, 6, "chi2", "cramers_v"), 9, "p_value")


@query("climate_share", CLIMATE_ZONE_SQL + """
SELECT climate_code, base, n, round(n * 100 / sum(n) OVER ()::DOUBLE, 6) AS percentage FROM v_count""")
def climate_share(spark, sf):
    out = stats.climate_share(climate_zones(spark, sf), "base", "climate_code", list(config.LAND_BASES), [0, *CODES])
    return fn.round_cols(out, 6, "percentage")
