import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliogale.operators import country, ml


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(7)
    n = 700
    region = np.where(rng.random(n) < 0.5, "BIG", rng.choice(["AAA", "BBB", "CCC"], n))
    x = rng.integers(0, 5, n) / 4  # few values, many ties
    y = x * 0.5 + rng.normal(size=n).round(3)
    pdf = pd.DataFrame({"r": region, "x": x, "y": y, "s": rng.random(n)})
    pdf.loc[::29, "y"] = None
    pdf.loc[::41, "s"] = None
    return pdf


def expected(pdf, method, groups=None, min_n=50):
    full = pdf.dropna()
    for g, members in (groups or {}).items():
        full = pd.concat([full, pdf.dropna()[pdf.dropna()["r"].isin(members)].assign(r=g)])
    out = {}
    for r, d in full.groupby("r"):
        if len(d) >= min_n:
            a, b = (d["x"].rank(), d["y"].rank()) if method == "spearman" else (d["x"], d["y"])
            out[r] = (len(d), d["x"].mean(), d["y"].mean(), d["s"].mean(), np.corrcoef(a, b)[0, 1])
    return out


@pytest.mark.parametrize("method", ["spearman", "pearson"])
@pytest.mark.parametrize("groups", [None, {"PAIR": ["AAA", "BIG"], "NONE": ["ZZZ"]}])
def test_correlation_equals_pandas(spark, cells, method, groups):
    df = spark.createDataFrame(cells.astype(object).where(cells.notna(), None), "r string, x double, y double, s double")
    got = country.correlate(df, "r", "x", "y", ("s",), method, extra_groups=groups).collect()
    want = expected(cells, method, groups)
    assert {r["r"] for r in got} == set(want)
    for r in got:
        values = (r["n_pixels"], r["avg_x"], r["avg_y"], r["avg_s"], r["corr"])
        assert values == pytest.approx(want[r["r"]], abs=1e-12)
        assert 0 <= r["p_value"] <= 1


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_minimum_size_and_constant_side(spark, method):
    data = [("n49", float(i), float(i)) for i in range(49)] + [("n50", float(i), float(i)) for i in range(50)]
    data += [("flat", 1.0, float(i)) for i in range(60)]
    df = spark.createDataFrame(data, "r string, x double, y double")
    got = {r["r"]: r["corr"] for r in country.correlate(df, "r", "x", "y", method=method).collect()}
    assert set(got) == {"n50", "flat"}
    assert got["n50"] == pytest.approx(1.0) and got["flat"] is None
    with pytest.raises(ValueError):
        country.correlate(df, "r", "x", "y", method="kendall")


def test_codes(spark, rows):
    df = spark.createDataFrame([("NM",), ("USA",), ("SE",), ("S",), ("??",), ("BiH",)], "c string")
    two = spark.createDataFrame([("SE", "SWE"), ("NM", "XXX")], "alpha2 string, alpha3 string")
    got = {r["c"]: r["iso3"] for r in country.code3(df, "c", two).collect()}
    assert got == {"NM": "MKD", "USA": "USA", "SE": "SWE", "S": "ZAF", "??": None, "BiH": "BIH"}
    valid = [r[0] for r in country.valid_countries(country.code3(df, "c", two)).orderBy("iso3").collect()]
    assert len(valid) == len(set(valid)) == 5 + 10 and "SWE" in valid


def test_back_projection_composition_and_restriction(spark, rows):
    cells = spark.createDataFrame([("A", "W"), ("A", None), ("B", "P"), ("C", "W"), (None, "W")], "iso3 string, base string")
    metrics = spark.createDataFrame([("A", 1), ("B", 1), ("D", 2)], "iso3 string, cluster int")
    on_grid = country.back_project(cells, metrics, "iso3", ["cluster"])
    assert rows(on_grid, "iso3", "cluster") == [(None, None), ("A", 1), ("A", 1), ("B", 1), ("C", None)]
    assert rows(country.composition(on_grid)) == [(1, "P", 1, round(100 / 3, 9)), (1, "W", 1, round(100 / 3, 9))]
    assert rows(country.composition(on_grid, labelled_only=True), "percentage") == [(50.0,), (50.0,)]
    assert rows(country.restrict(cells, metrics, "iso3"), "iso3") == [("A",), ("A",), ("B",)]


def test_poor_zone_stats_and_top(spark, rows):
    data = [("X", "P", 10.0, 100.0, 1.0), ("X", "P", 20.0, 300.0, 3.0), ("X", "A", 99.0, 0.0, 0.0), ("Y", "A", 1.0, 1.0, 1.0),
            ("Z", "P", 5.0, 6.0, 7.0), (None, "P", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "country string, subgroup string, latitude double, elevation double, precipitation double")
    out = country.poor_zone_stats(df, "country")
    assert rows(out) == [("X", 15.0, 200.0, 2.0, 2, 3, round(200 / 3, 9)), ("Z", 5.0, 6.0, 7.0, 1, 1, 100.0)]
    assert [r["country"] for r in country.top_countries(out, 1).collect()] == ["Z"]


def test_shift_by_cluster(spark, rows):
    a = spark.createDataFrame([("A", 1.0), ("B", None), ("C", 5.0)], "iso3 string, m double")
    b = spark.createDataFrame([("A", 3.0), ("B", 4.0), ("C", 4.0), ("D", 1.0)], "iso3 string, m double")
    s = country.shift(a, b, "iso3", ["m"])
    assert rows(s) == [("A", 1.0, 3.0, 2.0), ("C", 5.0, 4.0, -1.0)]
    clusters = spark.createDataFrame([("A", 0)], "iso3 string, cluster int")
    assert rows(country.shift_by_cluster(s, clusters, "iso3", ["m"])) == [(0, 1, 2.0)]


def test_names_lists_and_summary(spark, rows):
    centroids = spark.createDataFrame(
        [(0, 0.7, 0.1, -0.3), (1, 0.5, 0.4, 0.0), (2, 0.2, 0.5, 0.1)],
        "cluster int, avg_resource double, avg_storage double, resource_demand_corr double")
    names = {r["cluster"]: r["cluster_name"] for r in country.cluster_names(centroids).collect()}
    assert names == {0: "high resource / short storage / high mismatch", 1: "Cluster 1", 2: "modest resource / long storage / match"}
    lands = spark.createDataFrame([("b", 0, 401), ("a", 0, 500), ("c", 0, 400), (None, 1, 900)], "country_name string, cluster int, n_pixels int")
    assert rows(country.cluster_lists(lands)) == [(0, "a, b", "c"), (1, "", "")]
    summary = country.cluster_summary(lands, centroids)
    table = {r["measure"]: tuple(r)[1:] for r in country.summary_table(summary, [0, 1, 2]).collect()}
    assert table["large_countries"] == ("a, b", "", None) and table["avg_resource"] == ("0.7", "0.5", "0.2")


# ---- regression and clustering ----------------------------------------------
def test_ols_equals_lstsq_and_fills_only_masked_gaps(spark):
    rng = np.random.default_rng(8)
    p = rng.normal(1e6, 3e5, 200), rng.normal(288, 9, 200)
    y = 0.1 + 2e-7 * p[0] - 1e-3 * p[1] + rng.normal(0, 0.01, 200)
    land = rng.random(200) < 0.8
    gap = rng.random(200) < 0.2
    data = [(i, None if gap[i] else float(y[i]), float(p[0][i]), float(p[1][i]), bool(land[i])) for i in range(200)]
    data += [(900, None, None, 280.0, True), (901, None, 9e9, 280.0, True)]
    df = spark.createDataFrame(data, "i int, solar double, ssrd double, t2m double, land boolean")
    use = land & ~gap
    want = np.linalg.lstsq(np.column_stack([p[0][use], p[1][use], np.ones(use.sum())]), y[use], rcond=None)[0]
    slopes, intercept = ml.ols_fit(df, "solar", ["ssrd", "t2m"], F.col("land"))
    assert [*slopes, intercept] == pytest.approx(list(want), rel=1e-8)
    got = {r["i"]: r["solar"] for r in ml.ols_fill(df, "solar", ["ssrd", "t2m"], F.col("land")).collect()}
    for i in range(200):
        if not gap[i]:
            assert got[i] == y[i]
        elif not land[i]:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(np.clip(want @ [p[0][i], p[1][i], 1], 0, 1), rel=1e-8)
    assert got[900] is None and got[901] == 1.0
    with pytest.raises(ValueError):
        ml.ols_fit(df.filter("i > 899"), "solar", ["ssrd"])
    twin = ml.ols_fit(df.withColumn("same", F.col("ssrd") * 2), "solar", ["ssrd", "same"])
    assert np.isfinite(twin[0]).all()


def test_kmeans_recovers_separated_groups_in_original_units(spark, rows):
    rng = np.random.default_rng(9)
    centres = np.array([[0.1, -0.5, 0.9], [0.5, 0.0, 0.5], [0.9, 0.3, 0.2], [0.2, 0.6, 0.7]])
    data = [(int(k), *map(float, centres[k] + rng.normal(0, 0.01, 3))) for k in range(4) for _ in range(8)]
    data[0] = (0, data[0][1], data[0][2], None)  # imputed by the mean
    df = spark.createDataFrame(data, "truth int, avg_storage double, resource_demand_corr double, avg_resource double")
    features = ["avg_storage", "resource_demand_corr", "avg_resource"]
    assigned, centroids = ml.kmeans(df, features, runs=3)
    final, centres_out = ml.canonical_clusters(assigned, centroids)
    # ascending correlation: groups 0, 1, 2, 3 -> ids 2, 0, 1, 3
    counts = rows(final.filter("avg_resource is not null").select("truth", "cluster").distinct())
    assert counts == [(0, 2), (1, 0), (2, 1), (3, 3)]
    by_id = {r["cluster"]: r for r in centres_out.collect()}
    assert by_id[0]["resource_demand_corr"] == pytest.approx(0.0, abs=0.02)
    assert by_id[3]["avg_storage"] == pytest.approx(0.2, abs=0.02)


def test_kmeans_certificates(spark):
    """Every row is in its nearest cluster, every centroid is the mean of its rows, and reruns agree."""
    rng = np.random.default_rng(11)
    data = [(k, *map(float, rng.normal(size=3))) for k in range(200)] + [(300 + k, 1.0, 1.0, None) for k in range(100)]
    data += [(500, None, float("nan"), 2.0)]
    features = ["a", "b", "c"]
    df = spark.createDataFrame(data, "k int, a double, b double, c double")
    assigned, centroids = ml.kmeans(df, features, k=5)
    centre = {r["cluster"]: np.array([r[f] for f in features]) for r in centroids.collect()}
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in data], dtype=float)
    mean = np.nanmean(x, axis=0)
    x = np.where(np.isnan(x), mean, x)
    std = x.std(axis=0, ddof=1)
    cluster = {r["k"]: r["cluster"] for r in assigned.collect()}
    z = lambda v: (v - mean) / std
    for r, row in zip(data, x):
        d = {c: float(((z(row) - z(m)) ** 2).sum()) for c, m in centre.items()}
        assert d[cluster[r[0]]] <= min(d.values()) + 1e-9
    for c, m in centre.items():
        assert np.allclose(m, x[[cluster[r[0]] == c for r in data]].mean(axis=0), atol=1e-9)
    again = {r["k"]: r["cluster"] for r in ml.kmeans(df.repartition(9), features, k=5)[0].collect()}
    assert again == cluster
    few = spark.createDataFrame([(k, float(k % 2), 0.0, 0.0) for k in range(9)], "k int, a double, b double, c double")
    rows_, centres_ = ml.kmeans(few, features, k=4)
    assert centres_.count() == 2 and {(r["k"] % 2, r["cluster"]) for r in rows_.collect()} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})
    assert ml.kmeans(few.limit(0), features)[0].count() == 0
