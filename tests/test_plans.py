"""Exact quantiles, ranks and skew-safe joins against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogale.plans.joins import dim_join, heavy_limit, heavy_split_join
from heliogale.plans.quantiles import exact_quantiles, grouped_quantiles
from heliogale.plans.ranks import rank_table


@pytest.mark.parametrize("accuracy,steps", [(10_000, 512), (100, 16), (20, 8), (10, 4)])
def test_quantiles_equal_numpy_with_ties_and_refinement(spark, accuracy, steps):
    rng = np.random.default_rng(1)
    # a third of all rows share one value, the rest is continuous with an outlier
    x = np.concatenate([np.full(1000, 0.25), rng.normal(size=2000), [1e12]])
    rng.shuffle(x)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.6, 0.95, 0.999, 1.0]
    got = exact_quantiles(df, {"v": (F.col("v"), probs)}, accuracy, steps)["v"]
    assert got == pytest.approx([float(np.quantile(x, p)) for p in probs], rel=1e-12)


def test_quantiles_skip_null_and_nan_and_answer_empty(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 1), (None, 1), (3.0, 1)], "v double, k int")
    got = exact_quantiles(df, {"all": (F.col("v"), [0.5]), "none": (F.when(F.col("k") == 2, F.col("v")), [0.5])})
    assert got == {"all": [2.0], "none": [None]}


def test_quantile_single_value(spark):
    df = spark.createDataFrame([(7.0,)] * 5, "v double")
    assert exact_quantiles(df, {"v": (F.col("v"), [0.0, 0.3, 1.0])})["v"] == [7.0, 7.0, 7.0]


@pytest.mark.parametrize("accuracy", [10_000, 5])
def test_grouped_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {"large": np.concatenate([np.full(1500, 0.5), rng.normal(size=3000)]), "equal": np.full(40, 7.0), "two": np.repeat([1.0, 2.0], [30, 31]),
              "one": np.array([4.0]), None: rng.normal(size=99).round(1), "wide": np.array([1e300, -1e300, 0.0, 5.0])}
    rows = [(g, float(v)) for g, some in groups.items() for v in some] + [("large", None), ("large", float("nan")), ("none", None)]
    rng.shuffle(rows)
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.95, 1.0, 0.5]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double").repartition(7)
    plan = grouped_quantiles(df, ["g"], "v", probs, accuracy)
    got = {r["g"]: (r["n"], r["quantiles"]) for r in plan.collect()}
    assert set(got) == set(groups)
    for g, some in groups.items():
        assert got[g] == (len(some), pytest.approx([float(np.quantile(some, p)) for p in probs], rel=1e-12, abs=1e-12))
    assert grouped_quantiles(df.limit(0), ["g"], "v", probs).count() == 0


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_average_ranks_equal_pandas_with_a_hot_group_and_a_hot_value(spark, ranges):
    import pandas as pd

    rng = np.random.default_rng(2)
    g = np.concatenate([np.zeros(900, int), rng.integers(1, 6, 300)])
    v = np.where(rng.random(1200) < 0.4, 5.0, rng.normal(size=1200).round(2))
    pdf = pd.DataFrame({"g": g, "v": v, "w": 1})
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rank_table(spark.createDataFrame(pdf), ["g"], "v", "w").toPandas()
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    pdf["r"] = pdf.groupby("g")["v"].rank()
    want = pdf.drop_duplicates(["g", "v"]).merge(got, on=["g", "v"])
    assert len(want) == len(got)
    assert (want["r"] == want["avg_rank"]).all()
    assert got["ties"].sum() == 1200


@pytest.mark.parametrize("limit", [0, 50, 10**9])
def test_heavy_split_join_is_the_whole_join(spark, rows, limit):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k int, i int")
    table = left.groupBy("k").agg(F.count("*").alias("n"))
    got = heavy_split_join(left, table, ["k"], "n", limit)
    assert rows(got, "k", "i", "n") == rows(left.join(table, "k"), "k", "i", "n")


def test_dim_join_keeps_unmatched_rows_and_never_duplicates(spark, rows):
    fact = spark.createDataFrame([(i % 3, i) for i in range(60)] + [(None, 99)], "k int, i int")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k int, d string")
    out = dim_join(fact, dim, ["k"])
    assert out.count() == 61
    assert rows(out.groupBy("d").count()) == [(None, 21), ("a", 20), ("b", 20)]
    assert dim_join(fact, dim, ["k"], "inner").count() == 40
    with pytest.raises(ValueError):
        dim_join(fact, dim, ["k"], "full")


def test_heavy_keys_are_few_by_counting():
    for total in (10, 10**6, 10**12):
        assert total / heavy_limit(total) <= 1000
    assert heavy_limit(10) == 100_000


def test_rank_correlation_with_heavy_keys_equals_the_plain_join(spark, monkeypatch):
    import heliogale.operators.country as country

    df = spark.range(400).select(
        F.lit("r").alias("r"), (F.col("id") % 3).cast("double").alias("x"), (F.col("id") * 7 % 101).cast("double").alias("y"))
    plain = country.correlate(df, "r", "x", "y").first()["corr"]
    monkeypatch.setattr(country, "heavy_limit", lambda n: 100)
    assert country.correlate(df, "r", "x", "y").first()["corr"] == pytest.approx(plain, abs=1e-12)
