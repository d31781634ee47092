"""Regression gap fill and country clustering."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliogale.config import CLUSTER_ID_BY_POSITION
from heliogale.functions import columns as fn
from heliogale.plans.order import numbered
from heliogale.plans.session import pinned


# ---- least squares ----------------------------------------------------------
def ols_fit(df: DataFrame, target: str, predictors: list[str], mask: Column | None = None) -> tuple[list[float], float]:
    """Least-squares slopes and intercept over rows complete in target and predictors.

    One aggregate of centred second moments (k^2 numbers) fits any number of rows; the
    k-by-k system is solved with minimum norm when predictors are collinear.
    """
    cols = [fn.finite(c) for c in (target, *predictors)]
    use = cols[0].isNotNull()
    for c in cols[1:]:
        use = use & c.isNotNull()
    if mask is not None:
        use = use & mask
    names = ["_y", *[f"_x{i}" for i in range(len(predictors))]]
    rows = df.filter(use).select(*[c.alias(n) for c, n in zip(cols, names)])
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(n).alias(f"m{n}") for n in names],
        *[F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate(names) for b in names[i:]],
    ).first()
    if not moments["n"]:
        raise ValueError("no complete rows to fit")
    xs = names[1:]
    gram = np.empty((len(xs), len(xs)))
    for i, a in enumerate(xs):
        for j in range(i, len(xs)):
            gram[i, j] = gram[j, i] = moments[f"c{a}{xs[j]}"]
    rhs = np.array([moments[f"c_y{x}"] for x in xs])
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    slopes = np.linalg.lstsq(gram / np.outer(scale, scale), rhs / scale, rcond=None)[0] / scale
    intercept = moments["m_y"] - float(sum(s * moments[f"m{x}"] for s, x in zip(slopes, xs)))
    return [float(s) for s in slopes], intercept


def ols_fill(
    cells: DataFrame, target: str, predictors: list[str], mask: Column,
    limits: tuple[float, float] = (0.0, 1.0), out: str | None = None,
) -> DataFrame:
    """Fill missing ``target`` in masked cells from a fit over the masked complete cells."""
    slopes, intercept = ols_fit(cells, target, predictors, mask)
    predicted: Column = fn.dbl(intercept)
    for slope, name in zip(slopes, predictors):
        predicted = predicted + fn.finite(name) * fn.dbl(slope)
    filled = F.coalesce(fn.finite(target), F.when(mask, fn.clip(predicted, *limits)))
    return cells.withColumn(out or target, filled)


# ---- k-means ----------------------------------------------------------------
def _scaling(df: DataFrame, features: list[str]) -> list[tuple[float, float]]:
    """Mean and sample deviation of each feature after missing values have taken the mean, from one aggregate."""
    values = {f"_f{i}": fn.finite(f) for i, f in enumerate(features)}
    row = df.agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}{k}") for k, c in values.items() for n, f in (
        ("n", F.count), ("m", F.avg), ("v", F.var_pop))]).first()
    out = []
    for k in values:
        if row[f"n{k}"]:
            # An imputed row adds nothing to the squares, but counts.
            spread = math.sqrt(row[f"v{k}"] * row[f"n{k}"] / max(1, row["rows"] - 1))
            out.append((row[f"m{k}"], spread))
        else:
            out.append((0.0, 0.0))
    return out


def _distance(p: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(p, c, lambda a, b: (a - b) * (a - b)), fn.dbl(0), lambda total, x: total + x)


def _nearest(centres: list[list[list[float]]]) -> Column:
    """Per run the squared distance to the nearest centre and its number (the lowest of equally near ones)."""
    point = F.col("_p")
    # The centres are one literal of runs x k x features numbers, so every round runs the same compiled code.
    return F.transform(F.lit(centres), lambda run: F.array_min(
        F.transform(run, lambda c, i: F.struct(_distance(point, c).alias("d"), i.alias("i")))))


def _starts(points: DataFrame, k: int, runs: int) -> list[list[list[float]]]:
    """``runs`` sets of ``k`` starting centres that depend on the points alone.

    The first centre of a run is one of ``runs`` points spread evenly along the order of all distinct points; each
    further one is the point farthest from the run's centres so far, the first in order of equally far ones.
    """
    places = numbered(pinned(points.select("_p").distinct()), [], [F.col("_p")])
    spread = F.array(*[F.floor(F.col("n") * r / runs) for r in range(runs)])
    firsts = places.filter(F.array_contains(spread, F.col("pos"))).orderBy("pos").collect()  # at most ``runs``
    centres = [[list(r["_p"])] for r in firsts]
    for _ in range(min(k, firsts[0]["n"] if firsts else 0) - 1):
        backwards = F.transform("_p", lambda x: -x)
        nearest = points.select(backwards.alias("_b"), _nearest(centres).alias("_near"))
        row = nearest.agg(*[F.max(F.struct(F.col("_near")[r]["d"], F.col("_b"))).alias(f"r{r}") for r in range(len(centres))]).first()
        centres = [c + [[-x for x in row[f"r{r}"]["_b"]]] for r, c in enumerate(centres)]
    return centres


def _lloyd(points: DataFrame, centres: list[list[list[float]]], width: int, max_iter: int) -> list[list[float]] | None:
    """The centres of the cheapest run after all runs have settled; None without points."""
    best = centres[0] if centres else None
    for _ in range(max_iter if centres else 0):
        near = points.select("_p", F.posexplode(_nearest(centres)).alias("run", "near"))
        means = near.groupBy("run", F.col("near.i").alias("i")).agg(
            F.sum("near.d").alias("cost"), F.array(*[F.avg(F.col("_p")[f]) for f in range(width)]).alias("mean")).collect()
        costs = [0.0] * len(centres)
        moved = [[list(c) for c in run] for run in centres]
        for r in means:
            costs[r["run"]] += r["cost"]
            moved[r["run"]][r["i"]] = list(r["mean"])
        best = centres[next(r for r, cost in enumerate(costs) if cost <= min(costs) * (1 + 1e-9))]
        shift = max(abs(x - y) for a, b in zip(centres, moved) for c, d in zip(a, b) for x, y in zip(c, d))
        centres = moved
        if shift <= 1e-12:
            break
    return best


def kmeans(df: DataFrame, features: list[str], k: int = 4, runs: int = 10, max_iter: int = 50) -> tuple[DataFrame, DataFrame]:
    """Cluster rows on mean-imputed, standardised features; best of ``runs`` deterministic starts.

    Returns (rows with ``cluster``, centroids in original units with ``cluster``). All runs take their rounds
    together: one aggregate over the rows gives the means of every cluster of every run, and only those runs x k
    centres reach the driver. The same rows give the same clusters on every run and cluster layout; of runs that
    cost the same (to 1e-9) the first is taken. With fewer than ``k`` distinct points there are as many clusters.
    """
    held = pinned(df)
    scaling = _scaling(held, features)
    scaled = [F.coalesce((fn.finite(f) - fn.dbl(m)) / fn.dbl(s), fn.dbl(0)) if s > 0 else fn.dbl(0) for f, (m, s) in zip(features, scaling)]
    points = held.withColumn("_p", F.array(*scaled))
    cached = points.select("_p").persist()  # over the pinned table, so a lost part is read again
    try:
        best = _lloyd(cached, _starts(cached, k, runs), len(features), max_iter)
    finally:
        cached.unpersist()
    schema = "cluster int, " + ", ".join(f"`{f}` double" for f in features)
    if best is None:
        return held.withColumn("cluster", F.lit(None).cast("int")), df.sparkSession.createDataFrame([], schema)
    assigned = points.withColumn("cluster", _nearest([best])[0]["i"]).select(*df.columns, "cluster")
    rows = [(i, *[x * s + m for x, (m, s) in zip(c, scaling)]) for i, c in enumerate(best)]
    return assigned, df.sparkSession.createDataFrame(rows, schema)


def canonical_clusters(
    assigned: DataFrame, centroids: DataFrame, order_by: str = "resource_demand_corr",
    id_of=CLUSTER_ID_BY_POSITION,
) -> tuple[DataFrame, DataFrame]:
    """Cluster ids that do not depend on the fit: position in ascending order of one
    centroid value, then the published numbering of positions."""
    order = F.row_number().over(W.orderBy(order_by, "cluster")) - 1  # k rows
    position = centroids.withColumn("_pos", order)
    final = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(v) for kv in id_of.items() for v in kv]), F.col("_pos")), F.col("_pos"))
    renamed = position.withColumn("_new", final)
    mapping = renamed.select("cluster", "_new")
    rows = assigned.join(F.broadcast(mapping), "cluster").withColumn("cluster", F.col("_new")).drop("_new")
    return rows, renamed.withColumn("cluster", F.col("_new")).drop("_new", "_pos")

