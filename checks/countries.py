"""Country statistics, clusters and their way back to the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import GRID_SQL, grid_cells, table
from checks.zoning import DETAILED_SQL, MAX_RESOURCE_SQL, grouped, resource_cells
from heliogale.functions import columns as fn
from heliogale.operators import country, ml, stats

METRICS = ["avg_storage", "resource_demand_corr", "avg_resource"]

# ---- correlation ------------------------------------------------------------
_RANK_SQL = """
v_rank AS (
  SELECT *, rank() OVER (PARTITION BY country ORDER BY x) + (count(*) OVER (PARTITION BY country, x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY country ORDER BY y) + (count(*) OVER (PARTITION BY country, y) - 1) / 2.0::DOUBLE AS ry
  FROM v_complete)"""
_CORR_OUT = """ count(*) AS n_pixels, round(avg(x), 9) AS avg_x, round(avg(y), 9) AS avg_y, round(avg(s), 9) AS avg_s"""


def _xys(cells, x: str):
    return cells.select("country", F.col(x).alias("x"), F.col("demand").alias("y"), F.col("storage").alias("s"))


def _complete_sql(x: str, source: str) -> str:
    return f"""v_complete AS (SELECT country, {x} AS x, demand AS y, storage AS s FROM {source}
  WHERE {x} IS NOT NULL AND demand IS NOT NULL AND storage IS NOT NULL)"""


def _rounded(df):
    return fn.round_cols(fn.round_cols(df, 9, "avg_x", "avg_y", "avg_s"), 6, "corr")


@query("country_corr_spearman", f"""
WITH {GRID_SQL}, {_complete_sql('"wind_CF"', 'v_grid')}, {_RANK_SQL}
SELECT country, {_CORR_OUT}, round(corr(rx, ry), 6) AS corr FROM v_rank GROUP BY country HAVING count(*) >= 50""")
def country_corr_spearman(spark, sf):
    return _rounded(country.correlate(_xys(grid_cells(spark, sf), "wind_CF"), "country", "x", "y", ("s",), p_value=False))


@query("country_corr_pearson", f"""
WITH {GRID_SQL}, {_complete_sql('"wind_CF"', 'v_grid')}
SELECT country, {_CORR_OUT}, round(corr(x, y), 6) AS corr FROM v_complete GROUP BY country HAVING count(*) >= 50""")
def country_corr_pearson(spark, sf):
    return _rounded(country.correlate(
        _xys(grid_cells(spark, sf), "wind_CF"), "country", "x", "y", ("s",), method="pearson", p_value=False))


# The two-sided tail of Student's t for whole degrees of freedom, as the finite sums of even and of odd ones.
_P_SQL = """CASE WHEN df % 2 = 0 THEN 1 - abs(r) * coalesce(list_sum(list_transform(range(df // 2),
    lambda j: exp(lgamma(j + 0.5::DOUBLE) - lgamma(j + 1)) / sqrt(pi()) * (1 - r * r) ** j)), 0)
  ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * coalesce(list_sum(list_transform(range((df - 1) // 2),
    lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5::DOUBLE)) * (1 - r * r) ** j)), 0)) END"""


@query("country_corr_p_value", f"""
WITH {GRID_SQL}, {_complete_sql('"wind_CF"', 'v_grid')}, {_RANK_SQL},
v_corr AS (SELECT country, {_CORR_OUT}, corr(rx, ry) AS r, count(*) - 2 AS df FROM v_rank GROUP BY country HAVING count(*) >= 50)
SELECT country, n_pixels, avg_x, avg_y, avg_s, round(r, 6) AS corr, round({_P_SQL}, 9) AS p_value FROM v_corr""")
def country_corr_p_value(spark, sf):
    """With the two-sided p-value of each country's rank correlation."""
    out = country.correlate(_xys(grid_cells(spark, sf), "wind_CF"), "country", "x", "y", ("s",))
    return fn.round_cols(_rounded(out), 9, "p_value")


GROUPS = {"pair": ["3", "7"], "large": ["1", "2", "3", "4", "5", "6"]}


@query("extra_groups", f"""
WITH {GRID_SQL}, v_one AS (SELECT * REPLACE (country::VARCHAR AS country) FROM v_grid),
v_all AS (SELECT * FROM v_one UNION ALL
  SELECT * REPLACE ('pair' AS country) FROM v_one WHERE country IN ('3', '7') UNION ALL
  SELECT * REPLACE ('large' AS country) FROM v_one WHERE country IN ('1', '2', '3', '4', '5', '6')),
{_complete_sql('"wind_CF"', 'v_all')}, {_RANK_SQL}
SELECT country, {_CORR_OUT}, round(corr(rx, ry), 6) AS corr FROM v_rank GROUP BY country HAVING count(*) >= 50""")
def extra_groups(spark, sf):
    cells = _xys(grid_cells(spark, sf), "wind_CF").withColumn("country", F.col("country").cast("string"))
    return _rounded(country.correlate(cells, "country", "x", "y", ("s",), extra_groups=GROUPS, p_value=False))


@query("resource_demand_corr", MAX_RESOURCE_SQL + f""", {_complete_sql('resource', 'v_resource')}, {_RANK_SQL}
SELECT country, {_CORR_OUT}, round(corr(rx, ry), 6) AS corr FROM v_rank GROUP BY country HAVING count(*) >= 20""")
def resource_demand_corr(spark, sf):
    """Ranks of the zone-based resource score, where most cells share a few values."""
    cells = _xys(resource_cells(spark, sf), "resource_availability")
    return _rounded(country.correlate(cells, "country", "x", "y", ("s",), min_n=20, p_value=False))


@query("sign_counts", f"""
WITH {GRID_SQL}, {_complete_sql('"wind_CF"', 'v_grid')},
v_corr AS (SELECT country, corr(x, y) AS c FROM v_complete GROUP BY country HAVING count(*) >= 20)
SELECT count(*) FILTER (c > 0) AS positive, count(*) FILTER (c < 0) AS negative FROM v_corr""")
def sign_counts(spark, sf):
    out = country.correlate(_xys(grid_cells(spark, sf), "wind_CF"), "country", "x", "y", ("s",),
                            method="pearson", min_n=20, p_value=False)
    return stats.sign_counts(out, "corr")


# ---- country tables ---------------------------------------------------------
def country_metrics(spark, sf):
    """One row per country in the shape the clustering works on."""
    cells = _xys(grid_cells(spark, sf), "wind_CF")
    found = country.correlate(cells, "country", "x", "y", ("s",), method="pearson", min_n=1, p_value=False)
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("country"), F.col("n_name").alias("country_name"))
    return found.join(names, "country").select(
        "country", "country_name", "n_pixels", F.col("corr").alias("resource_demand_corr"),
        F.col("avg_x").alias("avg_resource"), F.col("avg_y").alias("avg_demand"), F.col("avg_s").alias("avg_storage"))


COUNTRY_SQL = f"""
WITH {GRID_SQL}, {_complete_sql('"wind_CF"', 'v_grid')},
v_country AS (
  SELECT country, n_name AS country_name, count(*) AS n_pixels, corr(x, y) AS resource_demand_corr,
    avg(x) AS avg_resource, avg(y) AS avg_demand, avg(s) AS avg_storage, CAST(country % 4 AS INTEGER) AS cluster
  FROM v_complete JOIN nation ON n_nationkey = country GROUP BY country, n_name)"""


def clustered(spark, sf):
    """Rule-derived clusters, so that results do not hang on a random start."""
    return country_metrics(spark, sf).withColumn("cluster", (F.col("country") % 4).cast("int"))


@query("country_scaled", COUNTRY_SQL + """,
v_r AS (SELECT min(avg_storage) AS lo, max(avg_storage) AS hi FROM v_country)
SELECT country, round((avg_storage - lo) / (hi - lo), 6) AS storage_scaled,
  round((avg_resource * 10 - lo) / (hi - lo), 6) AS on_same_scale FROM v_country, v_r""")
def country_scaled(spark, sf):
    """Min-max of one metric, and a second table's metric on the first one's scale."""
    metrics = country_metrics(spark, sf)
    out = stats.min_max(metrics, "avg_storage", "storage_scaled")
    other = out.withColumn("_other", F.col("avg_resource") * 10)
    scale = metrics.select(F.col("avg_storage").alias("_other"))
    out = stats.min_max(other, "_other", "on_same_scale", scale_of=scale)
    return fn.round_cols(out.select("country", "storage_scaled", "on_same_scale"), 6, "storage_scaled", "on_same_scale")


@query("poor_zone_stats", DETAILED_SQL + """
SELECT country, round(avg(latitude) FILTER (subgroup = 'P'), 6) AS latitude,
  round(avg(solar_climatology / 9.80665::DOUBLE) FILTER (subgroup = 'P'), 3) AS elevation,
  round(avg(demand) FILTER (subgroup = 'P'), 9) AS precipitation,
  count(*) FILTER (subgroup = 'P') AS poor_cells, count(*) AS all_cells,
  round(count(*) FILTER (subgroup = 'P') * 100 / count(*)::DOUBLE, 6) AS percentage
FROM v_grouped GROUP BY country HAVING count(*) FILTER (subgroup = 'P') > 0""")
def poor_zone_stats(spark, sf):
    out = fn.round_cols(_poor(spark, sf), 6, "latitude", "percentage")
    return fn.round_cols(fn.round_cols(out, 9, "precipitation"), 3, "elevation")


def _poor(spark, sf):
    cells = grouped(spark, sf).withColumns(
        {"elevation": fn.geopotential_to_metres("solar_climatology"), "precipitation": F.col("demand")})
    return country.poor_zone_stats(cells, "country")


@query("top_countries", DETAILED_SQL + """
SELECT country, poor_cells, round(p, 2) AS percentage FROM (
  SELECT country, count(*) FILTER (subgroup = 'P') AS poor_cells,
    count(*) FILTER (subgroup = 'P') * 100 / count(*)::DOUBLE AS p
  FROM v_grouped GROUP BY country HAVING count(*) FILTER (subgroup = 'P') > 0)
ORDER BY p DESC, country LIMIT 12""")
def top_countries(spark, sf):
    out = _poor(spark, sf).select("country", "poor_cells", "percentage")
    return country.top_countries(out, 12, tie="country")


@query("country_code_normalise", """
WITH v_code AS (SELECT n_nationkey, CASE n_nationkey % 5
    WHEN 0 THEN 'NM' WHEN 1 THEN upper(substring(n_name, 1, 3)) WHEN 2 THEN upper(substring(r_name, 1, 2))
    WHEN 3 THEN 'J' ELSE 'zz' END AS code
  FROM nation JOIN region ON r_regionkey = n_regionkey),
v_two AS (SELECT upper(substring(r_name, 1, 2)) AS alpha2, min(upper(substring(r_name, 1, 3))) AS alpha3 FROM region GROUP BY 1)
SELECT n_nationkey, code, CASE WHEN code = 'NM' THEN 'MKD' WHEN code = 'J' THEN 'JPN'
  WHEN length(code) = 3 THEN code ELSE alpha3 END AS iso3
FROM v_code LEFT JOIN v_two ON alpha2 = code""")
def country_code_normalise(spark, sf):
    return _coded(spark, sf)


def _coded(spark, sf):
    region = table(spark, sf, "region")
    k = F.col("n_nationkey") % 5
    codes = table(spark, sf, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        "n_nationkey",
        F.when(k == 0, "NM").when(k == 1, F.upper(F.substring("n_name", 1, 3)))
        .when(k == 2, F.upper(F.substring("r_name", 1, 2))).when(k == 3, "J").otherwise("zz").alias("code"))
    two = region.groupBy(F.upper(F.substring("r_name", 1, 2)).alias("alpha2")).agg(
        F.min(F.upper(F.substring("r_name", 1, 3))).alias("alpha3"))
    return country.code3(codes, "code", two)


@query("valid_countries", """
SELECT DISTINCT iso3 FROM (
  SELECT 'MKD' AS iso3 UNION ALL SELECT 'JPN' UNION ALL SELECT upper(substring(n_name, 1, 3)) FROM nation WHERE n_nationkey % 5 = 1
  UNION ALL SELECT alpha3 FROM (SELECT upper(substring(r_name, 1, 2)) AS alpha2, min(upper(substring(r_name, 1, 3))) AS alpha3
    FROM region GROUP BY 1) WHERE alpha2 IN (SELECT upper(substring(r_name, 1, 2)) FROM nation JOIN region ON r_regionkey = n_regionkey
      WHERE n_nationkey % 5 = 2)
  UNION ALL SELECT unnest(['SWE', 'BEL', 'LUX', 'CHE', 'KHM', 'LAO', 'PRT', 'AUT', 'JAM', 'ISR', 'MLT']))""")
def valid_countries(spark, sf):
    return country.valid_countries(_coded(spark, sf))


@query("allowed_cells", f"""
WITH {GRID_SQL} SELECT cell, country FROM v_grid WHERE country IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)""")
def allowed_cells(spark, sf):
    allowed = table(spark, sf, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("country"))
    return country.restrict(grid_cells(spark, sf), allowed, "country").select("cell", "country")


# ---- grid <-> country -------------------------------------------------------
@query("backproject", COUNTRY_SQL + """
SELECT cell, round(resource_demand_corr, 6) AS resource_demand_corr, cluster
FROM v_grid LEFT JOIN v_country USING (country)""")
def backproject(spark, sf):
    out = country.back_project(grid_cells(spark, sf), clustered(spark, sf), "country", ["resource_demand_corr", "cluster"])
    return fn.round_cols(out.select("cell", "resource_demand_corr", "cluster"), 6, "resource_demand_corr")


@query("cluster_composition", DETAILED_SQL + """,
v_count AS (SELECT CAST(country % 4 AS INTEGER) AS cluster, base, count(*) AS n FROM v_grouped GROUP BY ALL),
v_pct AS (SELECT *, n * 100 / sum(n) OVER (PARTITION BY cluster)::DOUBLE AS p FROM v_count)
SELECT cluster, base, n, round(p, 6) AS percentage FROM v_pct WHERE base IS NOT NULL""")
def cluster_composition(spark, sf):
    cells = country.back_project(grouped(spark, sf), _clusters_of(spark, sf), "country", ["cluster"])
    return fn.round_cols(country.composition(cells), 6, "percentage")


def _clusters_of(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("country"), (F.col("n_nationkey") % 4).cast("int").alias("cluster"))


# ---- shifts and clusters ----------------------------------------------------
SHIFT_SQL = DETAILED_SQL + """,
v_a AS (SELECT country, corr("wind_CF", demand) AS resource_demand_corr, avg(storage) AS avg_storage,
  avg("wind_CF") AS avg_resource FROM v_grouped
  WHERE land AND "wind_CF" IS NOT NULL AND demand IS NOT NULL AND storage IS NOT NULL GROUP BY country),
v_b AS (SELECT country, corr("wind_CF", demand) AS resource_demand_corr, avg(storage) AS avg_storage,
  avg("wind_CF") AS avg_resource FROM v_grouped
  WHERE "wind_CF" IS NOT NULL AND demand IS NOT NULL AND storage IS NOT NULL GROUP BY country),
v_shift AS (SELECT country, CAST(country % 4 AS INTEGER) AS cluster, b.resource_demand_corr - a.resource_demand_corr AS c,
  b.avg_storage - a.avg_storage AS s, b.avg_resource - a.avg_resource AS r
  FROM v_a a JOIN v_b b USING (country)
  WHERE a.resource_demand_corr IS NOT NULL AND b.resource_demand_corr IS NOT NULL)"""


def _shifts(spark, sf):
    cells = grouped(spark, sf)

    def metrics(rows):
        out = country.correlate(_xys(rows, "wind_CF"), "country", "x", "y", ("s",), method="pearson", min_n=1, p_value=False)
        return out.select("country", F.col("corr").alias("resource_demand_corr"),
                          F.col("avg_s").alias("avg_storage"), F.col("avg_x").alias("avg_resource"))

    return country.shift(metrics(cells.filter("land")), metrics(cells), "country", METRICS)


@query("metric_shift", SHIFT_SQL + """
SELECT country, round(c, 6) AS resource_demand_corr_shift, round(s, 6) AS avg_storage_shift,
  round(r, 6) AS avg_resource_shift FROM v_shift""")
def metric_shift(spark, sf):
    names = [f"{m}_shift" for m in METRICS]
    return fn.round_cols(_shifts(spark, sf).select("country", *names), 6, *names)


@query("shift_by_cluster", SHIFT_SQL + """
SELECT cluster, count(*) AS n, round(avg(c), 6) AS resource_demand_corr_shift, round(avg(s), 6) AS avg_storage_shift,
  round(avg(r), 6) AS avg_resource_shift FROM v_shift GROUP BY cluster""")
def shift_by_cluster(spark, sf):
    out = country.shift_by_cluster(_shifts(spark, sf), _clusters_of(spark, sf), "country", METRICS)
    return fn.round_cols(out, 6, *[f"{m}_shift" for m in METRICS])


_LISTS_SQL = """
v_lists AS (SELECT cluster,
  coalesce(string_agg(country_name, ', ' ORDER BY country_name) FILTER (n_pixels > 55), '') AS large_countries,
  coalesce(string_agg(country_name, ', ' ORDER BY country_name) FILTER (n_pixels <= 55), '') AS small_countries
  FROM v_country GROUP BY cluster)"""
_CENTROID_SQL = """
v_centroid AS (SELECT cluster, round(avg(avg_storage) / 28, 9) AS avg_storage,
  round(avg(resource_demand_corr), 9) AS resource_demand_corr, round(avg(avg_resource), 9) AS avg_resource
  FROM v_country GROUP BY cluster),
v_named AS (SELECT *, coalesce(nullif(concat_ws(' / ',
  CASE WHEN avg_resource >= 0.7 THEN 'high resource' END, CASE WHEN avg_resource < 0.3 THEN 'modest resource' END,
  CASE WHEN avg_storage >= 0.5 THEN 'long storage' END, CASE WHEN avg_storage < 0.3 THEN 'short storage' END,
  CASE WHEN resource_demand_corr < -0.2 THEN 'high mismatch' END,
  CASE WHEN resource_demand_corr >= 0.1 THEN 'match' END), ''), 'Cluster ' || cluster) AS cluster_name FROM v_centroid)"""


def _centroids(spark, sf):
    """Rounded, so that a mean on a naming bound does not hang on the order of a sum."""
    means = clustered(spark, sf).groupBy("cluster").agg(
        (F.avg("avg_storage") / 28).alias("avg_storage"), F.avg("resource_demand_corr").alias("resource_demand_corr"),
        F.avg("avg_resource").alias("avg_resource"))
    return fn.round_cols(means, 9, *METRICS)


@query("cluster_lists", COUNTRY_SQL + "," + _LISTS_SQL + " SELECT * FROM v_lists")
def cluster_lists(spark, sf):
    return country.cluster_lists(clustered(spark, sf), large=55)


@query("cluster_names", COUNTRY_SQL + "," + _CENTROID_SQL + " SELECT cluster, cluster_name FROM v_named")
def cluster_names(spark, sf):
    return country.cluster_names(_centroids(spark, sf)).select("cluster", "cluster_name")


@query("cluster_summary", COUNTRY_SQL + "," + _CENTROID_SQL + "," + _LISTS_SQL + """
SELECT cluster, cluster_name, round(avg_storage, 6) AS avg_storage, round(resource_demand_corr, 6) AS resource_demand_corr,
  round(avg_resource, 6) AS avg_resource, large_countries, small_countries FROM v_named JOIN v_lists USING (cluster)""")
def cluster_summary(spark, sf):
    out = country.cluster_summary(clustered(spark, sf), _centroids(spark, sf), large=55)
    return fn.round_cols(out, 6, *METRICS)


@query("cluster_table", COUNTRY_SQL + "," + _CENTROID_SQL + "," + _LISTS_SQL + """,
v_tall AS (SELECT cluster, m.measure, m.value FROM v_named JOIN v_lists USING (cluster), LATERAL (SELECT unnest([
  {'measure': 'cluster_name', 'value': cluster_name}, {'measure': 'large_countries', 'value': large_countries},
  {'measure': 'small_countries', 'value': small_countries}]) AS m))
SELECT measure, max(value) FILTER (cluster = 0) AS cluster_0, max(value) FILTER (cluster = 1) AS cluster_1,
  max(value) FILTER (cluster = 2) AS cluster_2, max(value) FILTER (cluster = 3) AS cluster_3 FROM v_tall GROUP BY measure""")
def cluster_table(spark, sf):
    summary = country.cluster_summary(clustered(spark, sf), _centroids(spark, sf), large=55)
    return country.summary_table(summary, [0, 1, 2, 3], rows=("cluster_name", "large_countries", "small_countries"))


# Lloyd's rounds as a recursion over lists of centres, from the same starts.
_DISTANCE = "(({c}[1] - p[1]) * ({c}[1] - p[1]) + ({c}[2] - p[2]) * ({c}[2] - p[2]) + ({c}[3] - p[3]) * ({c}[3] - p[3]))"
_KMEANS_SQL = COUNTRY_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
v_m AS (SELECT country, country_name, n_pixels, resource_demand_corr AS f2, avg_resource AS f3,
  (avg_storage - min(avg_storage) OVER ()) / nullif(max(avg_storage) OVER () - min(avg_storage) OVER (), 0) AS f1 FROM v_country),
v_s AS (SELECT avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3, sqrt(var_pop(f1) * count(f1) / (count(*) - 1)) AS s1,
  sqrt(var_pop(f2) * count(f2) / (count(*) - 1)) AS s2, sqrt(var_pop(f3) * count(f3) / (count(*) - 1)) AS s3 FROM v_m),
v_p AS (SELECT v_m.*, [coalesce((f1 - m1) / s1, 0), coalesce((f2 - m2) / s2, 0), coalesce((f3 - m3) / s3, 0)] AS p FROM v_m, v_s),
v_d AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS pos, count(*) OVER () AS m FROM (SELECT DISTINCT p FROM v_p)),
v_start(run, centres) AS (
  SELECT r, [p] FROM v_d, range(10) t(r) WHERE pos = r * m // 10
  UNION ALL
  SELECT run, list_append(any_value(centres), first(p ORDER BY list_min(list_transform(centres, lambda c: {_DISTANCE.format(c="c")})) DESC, p))
  FROM v_start, v_p WHERE len(centres) < 4 GROUP BY run, len(centres)),
v_lloyd(run, it, centres) AS (
  SELECT run, 0, centres FROM v_start WHERE len(centres) = 4
  UNION ALL
  SELECT run, it + 1, list(c ORDER BY i) FROM (
    SELECT run, it, i, [avg(p[1]), avg(p[2]), avg(p[3])] AS c FROM (
      SELECT run, it, p, list_position(ds, list_min(ds)) AS i FROM (
        SELECT run, it, p, list_transform(centres, lambda c: {_DISTANCE.format(c="c")}) AS ds FROM v_lloyd, v_p WHERE it < 30))
    GROUP BY run, it, i) GROUP BY run, it),
v_cost AS (SELECT run, any_value(centres) AS centres, sum(list_min(list_transform(centres, lambda c: {_DISTANCE.format(c="c")}))) AS cost
  FROM v_lloyd, v_p WHERE it = 30 GROUP BY run),
v_best AS (SELECT centres FROM v_cost WHERE cost <= (SELECT min(cost) FROM v_cost) * (1 + 1e-9) ORDER BY run LIMIT 1),
v_order AS (SELECT i, row_number() OVER (ORDER BY centres[i][2], i) AS position FROM v_best, range(1, 5) t(i)),
v_in AS (SELECT country, list_transform(centres, lambda c: {_DISTANCE.format(c="c")}) AS ds FROM v_p, v_best)
SELECT v_m.country, country_name, n_pixels, round(f1, 6) AS avg_storage, round(f2, 6) AS resource_demand_corr, round(f3, 6) AS avg_resource,
  [2, 0, 1, 3][position]::INTEGER AS cluster
FROM v_m JOIN v_in USING (country) JOIN v_order ON i = list_position(ds, list_min(ds))"""


@query("kmeans_clusters", _KMEANS_SQL)
def kmeans_clusters(spark, sf):
    """Four clusters of countries with canonical ids."""
    metrics = stats.min_max(country_metrics(spark, sf), "avg_storage", "avg_storage")
    rows, _ = ml.canonical_clusters(*ml.kmeans(metrics, METRICS))
    return fn.round_cols(rows.select("country", "country_name", "n_pixels", *METRICS, "cluster"), 6, *METRICS)
