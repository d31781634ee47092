"""Exact quantiles of whole tables with bounded memory everywhere.

``percentile`` keeps every distinct value of a group in one buffer, which a global
quantile over a grid cannot afford. Here a mergeable sketch brackets each wanted rank, and
aggregates count exactly around the bracket and sketch the values inside it, from which the next,
narrower bracket is taken, until an end of it is the wanted value. Nothing is gathered: ends of
brackets are counted, not kept, and what a round returns does not grow with the data.

:func:`grouped_quantiles` answers many groups at once in the same spirit: brackets for every group from
one sketch, then running counts over the few values inside them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.plans.order import running
from heliogale.plans.session import pinned

ACCURACY = 10_000
STEPS = 512  # a bracket is cut into so many parts for the next round


@dataclass
class _Rank:
    """One order statistic being pinned down: the value at ``rank`` lies in [lo, hi]."""

    col: str
    rank: int
    lo: float = math.nan
    hi: float = math.nan
    above: float = -math.inf  # proven: the value lies above this,
    below: float = math.inf  # and below this
    value: float | None = None


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[Column, list[float]]],
    accuracy: int = ACCURACY,
    steps: int = STEPS,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per named expression; nulls and NaN are ignored.

    All expressions are answered by the same passes over ``df``. Like other fitted
    statistics in Spark this runs when called; what reaches the driver is a handful of
    numbers per quantile. A name without values gives ``None``.
    """
    names = list(wanted)
    values = df.select(
        *[_usable(wanted[n][0]).alias(f"v{i}") for i, n in enumerate(names)]
    )
    ranges = values.agg(
        *[
            F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
            for c in values.columns
        ],
        *[
            F.percentile_approx(c, _fences(wanted[n][1], accuracy), accuracy).alias(f"q_{c}")
            for c, n in zip(values.columns, names)
        ],
    ).first()

    plan: dict[tuple[str, int], _Rank] = {}
    for i, name in enumerate(names):
        col = f"v{i}"
        n, low, high = ranges[col]["n"], ranges[col]["lo"], ranges[col]["hi"]
        for k, q in enumerate(wanted[name][1]):
            for rank in _ranks(n, q):
                lo, hi = ranges[f"q_{col}"][2 * k : 2 * k + 2]
                lo = low if q * accuracy < 3 else lo
                hi = high if (1 - q) * accuracy < 3 else hi
                plan.setdefault((col, rank), _Rank(col, rank, lo, hi))

    _resolve(values, list(plan.values()), accuracy, steps)

    result: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        col, n = f"v{i}", ranges[f"v{i}"]["n"]
        result[name] = []
        for q in wanted[name][1]:
            ranks = _ranks(n, q)
            if not ranks:
                result[name].append(None)
                continue
            ends = [plan[(col, r)].value for r in ranks]
            result[name].append(ends[0] + (ends[-1] - ends[0]) * ((n - 1) * q % 1.0))
    return result


def _usable(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def _ranks(n: int, q: float) -> list[int]:
    if n == 0:
        return []
    at = (n - 1) * q
    return sorted({math.floor(at), math.ceil(at)})


def _fences(probs: list[float], accuracy: int) -> Column:
    """Sketch positions just outside each wanted position (beyond the sketch error)."""
    pad = 3 / accuracy
    return F.array(
        *[F.lit(p) for q in probs for p in (max(0.0, q - pad), min(1.0, q + pad))]
    )


def _resolve(values: DataFrame, ranks: list[_Rank], accuracy: int, steps: int) -> None:
    """Narrow the brackets until each rank is at an end of its own. Every round proves narrower bounds: the bracket
    itself, or where it missed its rank, the part of the former bounds on that side of it."""
    cuts = F.array(*[F.lit(k / steps) for k in range(steps + 1)])
    open_ranks = ranks
    while open_ranks:
        aggs = []
        for i, r in enumerate(open_ranks):
            v, lo, hi = F.col(r.col), F.lit(r.lo), F.lit(r.hi)
            inner = F.when((v > lo) & (v < hi), v)
            aggs += [
                F.count(F.when(v < lo, 1)).alias(f"b{i}"),
                F.count(F.when(v == lo, 1)).alias(f"l{i}"),
                F.count(inner).alias(f"i{i}"),
                F.count(F.when((v == hi) & (hi > lo), 1)).alias(f"h{i}"),
            ]
            if r.lo < r.hi:
                aggs.append(F.percentile_approx(inner, cuts, accuracy).alias(f"c{i}"))
        row = values.agg(*aggs).first().asDict()
        left = []
        for i, r in enumerate(open_ranks):
            start = row[f"b{i}"] + row[f"l{i}"]
            inside = row[f"i{i}"]
            if r.rank < row[f"b{i}"]:
                r.below = r.lo
                r.lo, r.hi = r.above, r.below
                left.append(r)
            elif r.rank < start:
                r.value = r.lo
            elif r.rank < start + inside:
                r.above, r.below = r.lo, r.hi
                # Some parts on either side cover the sketch's error; of few values every one is a cut.
                at = (r.rank - start) / max(1, inside - 1) * steps
                pad = 0 if 2 * inside <= min(steps, accuracy) else min(steps // 4, 2 + 2 * steps / accuracy)
                cut = row[f"c{i}"]
                r.lo, r.hi = cut[max(0, math.floor(at - pad))], cut[min(steps, math.ceil(at + pad))]
                left.append(r)
            elif r.rank < start + inside + row[f"h{i}"]:
                r.value = r.hi
            else:
                r.above = r.hi
                r.lo, r.hi = r.above, r.below
                left.append(r)
        open_ranks = left


def grouped_quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """Linear-interpolation quantiles of every group: keys, ``n`` and an array ``quantiles`` along ``probs``.

    Nulls and NaN are ignored; a group without a value has no row; null keys form a group. A sketch of each
    group brackets the wanted ranks. The rows inside a bracket (all of a small group, a few ten-thousandths
    of a large one) collapse to distinct values, whose running counts over value ranges give the value at each
    rank. A rank that its bracket missed is looked for among all values of its group. No group is gathered.
    """
    v = _usable(F.col(value) if isinstance(value, str) else value)
    rows = df.select(*keys, v.alias("_v")).filter("_v IS NOT NULL")
    fences = _fences(probs, accuracy)
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", fences, accuracy).alias("_f"))
    wanted = []
    for k, q in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(q))
        lo = F.col("_low") if q * accuracy < 3 else F.col("_f")[2 * k]
        hi = F.col("_high") if (1 - q) * accuracy < 3 else F.col("_f")[2 * k + 1]
        wanted.append(F.struct(F.lit(k).alias("k"), F.floor(at).alias("first"), F.ceil(at).alias("last"), lo.alias("lo"), hi.alias("hi")))
    brackets = pinned(sketch.select(*keys, "n", F.inline(F.array(*wanted))))
    found = _between(rows, brackets, keys)
    missed = found.filter("_first IS NULL OR _last IS NULL").select(*keys, "k")
    if not missed.isEmpty():
        infinite = F.lit(math.inf)
        again = _join_same(brackets, missed, [*keys, "k"]).withColumns({"lo": -infinite, "hi": infinite})
        found = found.filter("_first IS NOT NULL AND _last IS NOT NULL").unionByName(_between(rows, pinned(again), keys))
    probability = F.array(*[F.lit(float(q)) for q in probs])[F.col("k")]
    share = F.pmod((F.col("n") - 1) * probability, F.lit(1.0))
    one = F.struct("k", (F.col("_first") + (F.col("_last") - F.col("_first")) * share).alias("v"))
    return found.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_set(one))["v"].alias("quantiles"))


def _join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join where null equals null; ``right``'s keys are dropped."""
    other = right.select(*[F.col(c).alias(f"_{c}_") for c in keys], *[c for c in right.columns if c not in keys])
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in keys], how).drop(*[f"_{c}_" for c in keys])


def _between(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, k and the values ``_first`` and ``_last`` at a bracket's ranks, null where they are not inside."""
    lists = brackets.groupBy(*keys).agg(F.collect_list(F.struct("k", "lo", "hi")).alias("_b"))  # one entry per quantile
    # Each row meets its group's few brackets: the exact count below each, and the row itself where it is inside.
    met = _join_same(rows, lists, keys).select(*keys, "_v", F.inline("_b"))
    below = met.groupBy(*keys, "k").agg(F.count_if(F.col("_v") < F.col("lo")).alias("_below"))
    inner = met.filter("_v BETWEEN lo AND hi").groupBy(*keys, "k", "_v").agg(F.count("*").alias("_ties"))
    counted = _join_same(running(inner, [*keys, "k"], "_v", "_ties"), below, [*keys, "k"])
    start = F.col("_below") + F.col("before")
    placed = _join_same(counted.select(*keys, "k", "_v", start.alias("_start"), (start + F.col("_ties")).alias("_end")), brackets, [*keys, "k"])
    at = lambda rank: F.max(F.when((F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end")), F.col("_v")))
    values = placed.groupBy(*keys, "k").agg(at("first").alias("_first"), at("last").alias("_last"))
    return _join_same(brackets.select(*keys, "n", "k"), values, [*keys, "k"], "left")
