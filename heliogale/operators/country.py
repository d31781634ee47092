"""Per-country statistics, and results carried back to the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliogale.config import (
    ABBREVIATION_TO_CODE3, CLUSTER_NAMES, EXTRA_COUNTRIES, LARGE_COUNTRY_PIXELS, MIN_PIXELS,
)
from heliogale.functions import columns as fn
from heliogale.functions.pvalues import correlation_p_value
from heliogale.plans.joins import dim_join, heavy_limit, heavy_split_join
from heliogale.plans.ranks import rank_table
from heliogale.plans.session import pinned


def _with_groups(df: DataFrame, region: str, extra: dict[str, list[str]] | None) -> DataFrame:
    """Rows once for their region and once for each extra group holding it."""
    if not extra:
        return df
    groups = F.array(*[F.when(F.col(region).isin(m), F.lit(g)) for g, m in extra.items()])
    ids = F.array_compact(F.concat(F.array(F.col(region).cast("string")), groups))
    return df.withColumn(region, F.explode(ids))


def correlate(
    df: DataFrame, region: str, x: str, y: str, averages: tuple[str, ...] = (),
    method: str = "spearman", min_n: int = MIN_PIXELS,
    extra_groups: dict[str, list[str]] | None = None, p_value: bool = True,
) -> DataFrame:
    """Correlation of ``x`` and ``y`` per region with pixel count and averages.

    Only rows complete in every used column count, and regions with fewer than ``min_n``
    of them are left out. ``extra_groups`` adds unions of regions as further rows. A
    constant side gives a null correlation.

    Spearman is the correlation of average ranks. The rows collapse to distinct (x, y)
    pairs per region, and ranks come from a table of distinct values, so neither a country
    holding a third of all cells nor a value shared by a third of them lands in one task.
    The pairs are pinned: the input is evaluated once however often they are used.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method!r}")
    used = list(dict.fromkeys([x, y, *averages]))
    rows = _with_groups(
        df.select(region, *used).na.drop(subset=[region, *used]), region, extra_groups
    )
    n = F.count(F.lit(1)).alias("n_pixels")
    if method == "pearson":
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        corr = fn.safe_ratio(F.covar_pop(x, y), spread).alias("corr")
        result = rows.groupBy(region).agg(n, *[F.avg(c).alias(f"avg_{c}") for c in used], corr)
        result = result.filter(F.col("n_pixels") >= min_n)
    else:
        sums = [F.sum(c).alias(f"_sum_{c}") for c in used]
        pairs = pinned(
            rows.groupBy(region, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
            .agg(F.count(F.lit(1)).alias("_w"), *sums)
        )
        n = F.sum("_w").alias("n_pixels")
        result = (
            pairs.groupBy(region)
            .agg(n, *[(F.sum(f"_sum_{c}") / F.sum("_w")).alias(f"avg_{c}") for c in used])
            .filter(F.col("n_pixels") >= min_n)
            .join(_rank_correlation(pairs.select(region, "_x", "_y", "_w"), region), region, "left")
        )
    if p_value:
        result = result.withColumn("p_value", correlation_p_value(F.col("corr"), F.col("n_pixels")))
    return result


def _rank_correlation(pairs: DataFrame, region: str) -> DataFrame:
    """Correlation of average ranks per region from weighted distinct (_x, _y) pairs."""
    sides = F.array(
        *[F.struct(F.lit(s).alias("_side"), F.col(s).alias("_v")) for s in ("_x", "_y")]
    )
    values = pairs.select(region, F.inline(sides), "_w")
    ranks = pinned(rank_table(values, [region, "_side"], "_v", "_w"))
    sizes = {
        r["_side"]: r
        for r in ranks.groupBy("_side").agg(F.sum("ties").alias("n"), F.max("ties").alias("top")).collect()
    }
    for side in sizes:
        # The mean rank is (n + 1) / 2 exactly, ties or not.
        centred = ranks.filter(F.col("_side") == side).select(
            region, F.col("_v").alias(side), "ties",
            (F.col("avg_rank") - (F.col("group_n") + 1) / 2).alias(f"_r{side}"),
        )
        limit = heavy_limit(sizes[side]["n"])
        if sizes[side]["top"] > limit:
            pairs = heavy_split_join(pairs, centred, [region, side], "ties", limit).drop("ties")
        else:
            pairs = pairs.join(centred.drop("ties"), [region, side])
    if not sizes:
        return pairs.select(region, F.lit(None).cast("double").alias("corr"))
    w, rx, ry = F.col("_w"), F.col("_r_x"), F.col("_r_y")
    spread = F.sqrt(F.sum(w * rx * rx)) * F.sqrt(F.sum(w * ry * ry))
    return pairs.groupBy(region).agg(fn.safe_ratio(F.sum(w * rx * ry), spread).alias("corr"))


# ---- country codes ----------------------------------------------------------
def code3(df: DataFrame, code: str, two_letter: DataFrame, out: str = "iso3") -> DataFrame:
    """Three-letter code: known abbreviations first, then codes already three long, then the
    ``two_letter`` lookup (columns ``alpha2``, ``alpha3``), else null."""
    known = F.create_map(*[F.lit(v) for kv in ABBREVIATION_TO_CODE3.items() for v in kv])
    found = dim_join(
        df, two_letter.select(F.col("alpha2").alias(code), F.col("alpha3").alias("_alpha3")), [code]
    )
    return found.withColumn(
        out,
        F.coalesce(
            F.try_element_at(known, F.col(code)), F.when(F.length(code) == 3, F.col(code)), "_alpha3"
        ),
    ).drop("_alpha3")


def valid_countries(coded: DataFrame, iso3: str = "iso3") -> DataFrame:
    """Distinct known codes plus the fixed additions."""
    extra = coded.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, EXTRA_COUNTRIES))).alias(iso3))
    return coded.select(iso3).filter(F.col(iso3).isNotNull()).union(extra).distinct()


def restrict(df: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the allowed list (at most one list row per key)."""
    return dim_join(df, allowed.select(on).distinct(), [on], "inner")


# ---- grid <-> country -------------------------------------------------------
def back_project(cells: DataFrame, metrics: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Country values on every cell of the country; null where there is none."""
    return dim_join(cells, metrics.select(on, *columns), [on])


def composition(cells: DataFrame, cluster: str = "cluster", base: str = "base", labelled_only: bool = False) -> DataFrame:
    """Percentage of each base zone among a cluster's cells.

    Cells without a zone count in the denominator unless ``labelled_only``.
    """
    rows = cells.filter(F.col(cluster).isNotNull())
    if labelled_only:
        rows = rows.filter(F.col(base).isNotNull())
    counts = rows.groupBy(cluster, base).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(cluster))  # a few classes per cluster
    return counts.withColumn("percentage", F.col("n") / total * 100).filter(F.col(base).isNotNull())


def poor_zone_stats(cells: DataFrame, region: str, subgroup: str = "subgroup", code: str = "P",
                    means: tuple[str, ...] = ("latitude", "elevation", "precipitation")) -> DataFrame:
    """Per country with poor-zone cells: their means and count, all its cells, percentage.

    One group-by answers both the poor cells and the country total.
    """
    poor = F.col(subgroup) == code
    return (
        cells.filter(F.col(region).isNotNull())
        .groupBy(region)
        .agg(
            *[F.avg(F.when(poor, F.col(c))).alias(c) for c in means],
            F.count_if(poor).alias("poor_cells"), F.count(F.lit(1)).alias("all_cells"),
        )
        .filter(F.col("poor_cells") > 0)
        .withColumn("percentage", F.col("poor_cells") / F.col("all_cells") * 100)
    )


def top_countries(stats: DataFrame, n: int = 120, digits: int = 2, tie: str = "country") -> DataFrame:
    """Largest percentages first, floating columns rounded."""
    doubles = [c for c, t in stats.dtypes if t == "double"]
    return fn.round_cols(stats.orderBy(F.desc("percentage"), tie).limit(n), digits, *doubles)


# ---- clusters ---------------------------------------------------------------
def shift(a: DataFrame, b: DataFrame, on: str, metrics: list[str]) -> DataFrame:
    """Metric differences ``b - a`` of countries complete in both tables."""
    left = a.select(on, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(on, *[F.col(m).alias(f"{m}_b") for m in metrics])
    both = left.join(right, on, "inner").na.drop()
    return both.withColumns({f"{m}_shift": F.col(f"{m}_b") - F.col(f"{m}_a") for m in metrics})


def shift_by_cluster(shifts: DataFrame, clusters: DataFrame, on: str, metrics: list[str]) -> DataFrame:
    """Mean shift and country count per cluster."""
    joined = shifts.join(clusters.select(on, "cluster"), on, "left").filter("cluster is not null")
    return joined.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"{m}_shift").alias(f"{m}_shift") for m in metrics]
    )


def cluster_lists(countries: DataFrame, name: str = "country_name", large: int = LARGE_COUNTRY_PIXELS) -> DataFrame:
    """Sorted member names per cluster, split by size. The input is a country table, so a
    list holds country names only."""

    def members(cond: Column) -> Column:
        return F.concat_ws(", ", F.sort_array(F.collect_list(F.when(cond, F.col(name)))))

    return countries.groupBy("cluster").agg(
        members(F.col("n_pixels") > large).alias("large_countries"),
        members(F.col("n_pixels") <= large).alias("small_countries"),
    )


def cluster_names(centroids: DataFrame, rules=CLUSTER_NAMES) -> DataFrame:
    """Descriptive name from every rule a centroid meets, else ``Cluster i``."""
    met = []
    for label, metric, sign, bound in rules:
        if metric in centroids.columns:
            hit = F.col(metric) >= bound if sign == ">=" else F.col(metric) < bound
            met.append(F.when(hit, F.lit(label)))
    plain = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    name = F.coalesce(F.nullif(F.concat_ws(" / ", *met), F.lit("")), plain) if met else plain
    return centroids.withColumn("cluster_name", name)


def cluster_summary(countries: DataFrame, centroids: DataFrame, **options) -> DataFrame:
    """One row per cluster: name, centroid, member lists."""
    return cluster_names(centroids).join(cluster_lists(countries, **options), "cluster", "left")


def summary_table(summary: DataFrame, clusters: list[int],
                  rows=("avg_resource", "avg_storage", "resource_demand_corr", "large_countries", "small_countries")) -> DataFrame:
    """The summary turned: one row per measure, one text column per cluster."""
    tall = summary.select(
        "cluster",
        F.inline(F.array(*[F.struct(F.lit(r).alias("measure"), F.col(r).cast("string").alias("value")) for r in rows])),
    )
    pivoted = tall.groupBy("measure").pivot("cluster", clusters).agg(F.first("value"))
    return pivoted.toDF("measure", *[f"cluster_{c}" for c in clusters])
