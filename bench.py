"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up, then BENCH_RUNS times (default 3); the median counts.
Results are fully computed on the executors through a no-op sink, not collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "daily_resample", "wind_speed", "doy_climatology", "complementarity",
    "lds_deficit", "lds_sites", "lds_cyclic", "lds_aggregate_mean", "lds_aggregate_p99",
    "raster_average", "atlas_resample", "merge_outer", "nearest_align", "bilinear",
    "point_in_polygon", "masked_values", "climate_overlay", "idw_kernel",
    "normalize_demand", "classify_detailed", "classify_full", "classify_quantile", "group_percent",
    "resource_availability_max", "crosstab_norm", "cramers_v", "histogram", "kde", "distribution", "quantiles",
    "ols_gap_fill", "country_corr_spearman", "country_corr_pearson", "resource_demand_corr",
    "poor_zone_stats", "backproject", "cluster_composition", "metric_shift", "cluster_summary", "kmeans_clusters",
)


def main() -> None:
    from checks import QUERIES
    from checks.local import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = session()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "sum of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
