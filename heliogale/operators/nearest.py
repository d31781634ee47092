"""Nearest neighbours among scattered points, exactly and without comparing all pairs.

Both sides are put in Z-order and cut into runs of ``LEAF`` points with a bounding box each. Over the runs of the
source lie levels of boxes, ``FAN`` to one, up to a single root. A run of targets descends from the root: of the
boxes it meets it keeps those that may hold the nearest point of any of its targets, which are the ones no farther
from its own box than the farthest corner of the best box so far. In the last step its targets look at the points
of the few source runs that are left. The unit of work is a run, so neither a crowded place nor one that very
many targets share makes a large task; levels grow with the logarithm of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.functions import columns as fn
from heliogale.plans.joins import dim_join
from heliogale.plans.order import numbered
from heliogale.plans.session import pinned

LEAF = 32
FAN = 16
SLACK = 1 + 1e-9  # boxes are compared in rounded numbers, points exactly
BOX = ["x1", "x2", "y1", "y2"]


def _runs(points: DataFrame, ends: dict[str, float], leaf: int) -> DataFrame:
    """``points`` (x, y, ...) in Z-order with the number of their run, stored."""
    span = max(ends["x2"] - ends["x1"], ends["y2"] - ends["y1"], 1e-9) * SLACK
    keyed = pinned(points.withColumn("_z", fn.morton("x", "y", (ends["x1"], ends["y1"]), span)))
    # One order for points that share a key: by all that tells them apart.
    placed = numbered(keyed, [], [F.col("_z"), F.col("y"), F.col("x")])
    return pinned(placed.withColumn("run", F.floor(F.col("pos") / leaf)).drop("_z", "pos", "n"))


def _boxes(rows: DataFrame, by: Column, low: tuple[str, str], high: tuple[str, str]) -> DataFrame:
    return rows.groupBy(by.alias("node")).agg(
        F.min(low[0]).alias("x1"), F.max(high[0]).alias("x2"), F.min(low[1]).alias("y1"), F.max(high[1]).alias("y2"))


def _gap(box: Column) -> Column:
    """Smallest squared distance of a row's own box (``BOX`` columns) and another."""
    zero = fn.dbl(0)
    dx = F.greatest(box["x1"] - F.col("x2"), F.col("x1") - box["x2"], zero)
    dy = F.greatest(box["y1"] - F.col("y2"), F.col("y1") - box["y2"], zero)
    return dx * dx + dy * dy


def _reach(box: Column) -> Column:
    """Largest squared distance of points in both boxes."""
    dx = F.greatest(F.abs(box["x2"] - F.col("x1")), F.abs(F.col("x2") - box["x1"]))
    dy = F.greatest(F.abs(box["y2"] - F.col("y1")), F.abs(F.col("y2") - box["y1"]))
    return dx * dx + dy * dy


def nearest_scattered(
    target: DataFrame, source: DataFrame, values: list[str], wrap: bool = True, leaf: int = LEAF, fan: int = FAN,
    lon: str = "longitude", lat: str = "latitude",
) -> DataFrame:
    """``target`` with the ``values`` of the nearest source point and its squared ``distance2`` in degrees.

    ``wrap`` joins -180 and 180 degrees: the source is searched in three copies, a turn apart. Of source points
    equally near the one with the smaller latitude, then longitude, then values is taken; source rows without a
    place are left out. A target without a place, or an empty source, gives null values. Targets keep all their
    columns, which ``values`` must not repeat; both sides may hold any number of rows at one place.
    """
    clash = sorted({*values, "distance2"} & set(target.columns))
    if clash:
        raise ValueError(f"target already has {clash}")
    there = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    # Rows at one place count as one, on both sides.
    spots = source.filter(there).groupBy(x.alias("lon"), y.alias("lat")).agg(F.min(F.struct(*values)).alias("value"))
    if wrap:
        spots = spots.withColumn("turn", F.explode(F.array(*[fn.dbl(t) for t in (-360, 0, 360)])))
        spots = spots.withColumn("x", F.col("lon") + F.col("turn")).drop("turn")
    else:
        spots = spots.withColumn("x", F.col("lon"))
    spots = pinned(spots.withColumn("y", F.col("lat")))
    places = pinned(target.filter(there).select(x.alias("x"), y.alias("y")).distinct())
    ends = lambda t: t.agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("n")).first().asDict()
    there_s, there_t = ends(spots), ends(places)
    picked = None
    if there_s["n"] and there_t["n"]:
        picked = _search(_runs(places, there_t, leaf), _runs(spots, there_s, leaf), -(-there_s["n"] // leaf), fan, wrap)
    else:
        picked = places.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(None).cast("double").alias("distance2"),
                               F.lit(None).cast(spots.schema["value"].dataType).alias("value"))
    keyed = target.withColumns({"_x": x, "_y": y})
    out = dim_join(keyed, picked, ["_x", "_y"], spread=target.columns)
    return out.select(*target.columns, *[F.col("value")[v].alias(v) for v in values], "distance2")


def _search(places: DataFrame, spots: DataFrame, leaves: int, fan: int, wrap: bool) -> DataFrame:
    """_x, _y, value, distance2 of each of the ``places`` (x, y, run), from ``spots`` (x, y, lon, lat, value, run)."""
    levels = [pinned(_boxes(spots, F.col("run"), ("x", "y"), ("x", "y")))]
    while leaves > 1:
        levels.append(pinned(_boxes(levels[-1], F.floor(F.col("node") / fan), ("x1", "y1"), ("x2", "y2"))))
        leaves = -(-leaves // fan)
    box = F.struct("node", *BOX)
    cells = _boxes(places, F.col("run"), ("x", "y"), ("x", "y")).withColumnRenamed("node", "cell").select(
        "cell", *BOX, F.array(F.lit(0).cast("long")).alias("open"), fn.dbl(float("inf")).alias("bound"))
    for level in reversed(levels[:-1]):
        below = level.groupBy(F.floor(F.col("node") / fan).alias("parent")).agg(F.collect_list(box).alias("inner"))
        met = cells.select("cell", *BOX, "bound", F.explode("open").alias("parent")).join(below, "parent")
        met = met.withColumn("bound", F.least("bound", F.array_min(F.transform("inner", _reach)) * SLACK))
        near = met.withColumn("inner", F.filter("inner", lambda b: _gap(b) <= F.col("bound")))
        cells = (
            near.groupBy("cell", *BOX).agg(F.min("bound").alias("bound"), F.flatten(F.collect_list("inner")).alias("inner"))
            .withColumn("open", F.filter("inner", lambda b: _gap(b) <= F.col("bound"))["node"]).drop("inner")
        )
        cells = pinned(cells)
    runs = spots.groupBy("run").agg(F.collect_list(F.struct("x", "y", "lon", "lat", "value")).alias("points"))
    last = cells.select("cell", *BOX, "bound", F.explode("open").alias("run")).join(runs, "run")
    point_box = lambda p: {"x1": p["x"], "x2": p["x"], "y1": p["y"], "y2": p["y"]}
    able = F.filter("points", lambda p: _gap(point_box(p)) <= F.col("bound"))
    choice = last.select("cell", able.alias("points")).groupBy("cell").agg(F.flatten(F.collect_list("points")).alias("points"))
    asked = places.withColumnRenamed("run", "cell").join(choice, "cell")

    def measured(p: Column) -> Column:
        dx, dy = F.abs(p["lon"] - F.col("x")), p["lat"] - F.col("y")
        dx = F.least(dx, 360 - dx) if wrap else dx
        return F.struct((dx * dx + dy * dy).alias("distance2"), p["lat"].alias("lat"), p["lon"].alias("lon"), p["value"].alias("value"))

    best = asked.select("x", "y", F.array_min(F.transform("points", measured)).alias("best"))
    return best.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "best.value", "best.distance2")
