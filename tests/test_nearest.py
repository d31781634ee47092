import random

import pytest
from pyspark.sql import functions as F

from heliogale.operators import nearest

POINT = "latitude double, longitude double"


def plain(targets, sources, wrap):
    out = []
    for t, lat, lon in targets:
        found = [((least := (abs(x - lon) if not wrap else min(abs(x - lon), 360 - abs(x - lon)))) * least + (y - lat) * (y - lat), y, x, v)
                 for v, y, x in sources if y is not None and x is not None] if lat is not None and lon is not None else []
        best = min(found) if found else (None, None, None, None)
        out.append((t, best[3], best[0]))
    return sorted(out)


def clustered(rng, n, wide):
    """A third of the rows at one place, a third in a crowd, the rest anywhere; some on a coarse lattice, so with ties."""
    rows = []
    for k in range(n):
        if k % 3 == 0:
            rows.append((k, 10.0, 20.0))
        elif k % 3 == 1:
            rows.append((k, 10 + rng.uniform(-0.01, 0.01), 20 + rng.uniform(-0.01, 0.01)))
        else:
            rows.append((k, float(rng.randrange(-60, 80)), float(rng.randrange(-180, 180))) if k % 2 else (k, rng.uniform(-60, 80), rng.uniform(-wide, wide)))
    return rows


@pytest.mark.parametrize("wrap", [True, False])
@pytest.mark.parametrize("sizes", [(400, 300), (50, 1), (1, 500), (300, 700)])
def test_equals_all_pairs(spark, sizes, wrap):
    rng = random.Random(sum(sizes))
    targets = clustered(rng, sizes[0], 180) + [(9000, None, 1.0), (9001, 1.0, None), (9002, 85.0, 179.99), (9003, 10.0, 20.0)]
    sources = [(f"s{k:04d}", y, x) for k, y, x in clustered(rng, sizes[1], 179)] + [("none", None, 1.0)]
    out = nearest.nearest_scattered(
        spark.createDataFrame(targets, f"t int, {POINT}").withColumn("cell", F.lit("x")), spark.createDataFrame(sources, f"v string, {POINT}"),
        ["v"], wrap, leaf=4, fan=3)
    assert sorted((r["t"], r["v"], r["distance2"]) for r in out.collect()) == plain(targets, sources, wrap)


def test_empty_sides_and_clashing_names(spark):
    some = spark.createDataFrame([(1, 2.0, 3.0)], f"t int, {POINT}")
    none = spark.createDataFrame([], f"v string, {POINT}")
    assert [tuple(r) for r in nearest.nearest_scattered(some, none, ["v"]).collect()] == [(1, 2.0, 3.0, None, None)]
    assert nearest.nearest_scattered(some.limit(0), some.withColumnRenamed("t", "v"), ["v"]).count() == 0
    with pytest.raises(ValueError, match="already has"):
        nearest.nearest_scattered(some, some, ["t"])


def test_no_pairs_of_all_rows(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(k, rng.uniform(-60, 80), rng.uniform(-180, 180)) for k in range(3000)], f"t int, {POINT}")
    out = nearest.nearest_scattered(points, points.withColumnRenamed("t", "v"), ["v"], leaf=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter("v != t or distance2 != 0").isEmpty()
    assert "Join Cross" not in plan and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
