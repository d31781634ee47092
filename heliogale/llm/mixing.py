"""Mix sources to target weights by entropy balancing.

Among all rates ``r`` per word that meet the word targets of the sources, take the one closest to
"every word once" in relative entropy. Its dual is convex, one multiplier per source: minimise
``sum(size * exp(lambda) - target * lambda)``. Words of a document share one rate, so a document's
rate is the exponential tilt ``exp(lambda of its source)``. Newton steps on the dual only need each
source's word sum, which is summed on the executors once.

Weighing the entropy by words, not by documents, keeps long documents as likely as short ones.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its
own, last in order; repeated rows are mixed as the rows they are; an empty table gives an empty
result. Extra columns are ignored, whatever their names. Rows of one source and size are ordered by id (null
first), then by a digest of id and text, so reruns draw the same texts where ids are null or repeated; only rows
equal in both are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliogale.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS = 64  # one step lowers the multiplier by up to 1, so rates down to exp(-60) are reached
ROWS_PER_RANK = 50_000  # rows that are ranked together, about; groups of one size are cut by digest into parts of so many


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_mark(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.concat(F.lit("t"), text), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """One row per source: source, source_size, target.

    The weights repeat along the sources in code point order, null last. Targets are
    ``least(cap * size, weight * level)``, and the level is set so that they sum to all words: the
    same as resharing the excess of capped sources by weight until none is above. The result of the
    grouping has one row per source; only that is ordered in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_room = Window.orderBy("room", "place")
    done = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limit = F.lit(float(cap)) * F.col("source_size")
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("room", F.col("limit") / F.col("weight"))
        # The level if exactly the sources before this one stopped at their limit.
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(done), F.lit(0.0)))
                    / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(done), F.lit(0.0))))
        # It holds for the first source that it leaves below its limit.
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "place", "level"))).over(whole)["level"])
        .select("source", "source_size", F.least("limit", F.col("weight") * F.col("level")).alias("target"))
    )


def dual_multiplier(size: Column, target: Column, steps: int = NEWTON_STEPS) -> Column:
    """Newton's method on the dual of one source, from 0; null where the target is 0."""
    ratio = target / size
    step = lambda x, _: x - F.lit(1.0) + ratio * F.exp(-x)  # noqa: E731  gradient over curvature
    return F.when(target > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step))


def extra_copies(groups: DataFrame) -> DataFrame:
    """``groups`` (source, size, part, n, rate, target) with ``whole`` copies for every row and ``extra`` rows
    of the group that get one more.

    Systematic rounding along the sizes of a source spreads the rates' fractions; what the sum of words
    then lacks or exceeds is made up from the smallest sizes on, so the error is below one document.
    """
    along = Window.partitionBy("source").orderBy("size", "part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    source = Window.partitionBy("source")
    whole = F.floor("rate")
    fraction = F.col("rate") - whole
    zero = F.lit(0)
    return (
        groups.withColumn("before", F.coalesce(F.sum("n").over(before), zero))
        .withColumn("whole", whole)
        .withColumn("even", F.floor(fraction * (F.col("before") + F.col("n")) + 0.5) - F.floor(fraction * F.col("before") + 0.5))
        .withColumn("lacks", F.col("target") - F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("even"))).over(source))
        .withColumn("room", F.when(F.col("lacks") < 0, F.col("even")).when(F.col("rate") > F.col("whole"), F.col("n") - F.col("even")).otherwise(zero))
        .withColumn("used", F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), zero))
        .withColumn("change", F.when(F.col("size") > 0, F.floor((F.abs("lacks") - F.col("used")) / F.col("size"))).otherwise(zero))
        .withColumn("change", F.greatest(zero, F.least("change", "room")))
        .withColumn("extra", F.col("even") + F.when(F.col("lacks") < 0, -F.col("change")).otherwise(F.col("change")))
        .drop("before", "even", "lacks", "room", "used", "change")
    )


def _planned(docs: DataFrame, weights: Sequence[float], cap: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sizes of all rows, the parts of each (source, size) and the copies of each (source, size, part)."""
    sizes = stored(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), row_mark(F.col("doc_id"), F.col("text")).alias("mark")))
    counts = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    parts = counts.select("source", "size", F.ceil(F.col("n") / ROWS_PER_RANK).cast("long").alias("parts"))
    tilt = F.exp(dual_multiplier(F.col("source_size"), F.col("target")))
    rates = source_targets(sizes, weights, cap).withColumn("rate", F.round(F.coalesce(tilt, F.lit(0.0)), 9))
    groups = _placed(sizes, parts).groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    return sizes, parts, extra_copies(_same(groups, rates, "source"))


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return _same(rows, parts, "source", "size").withColumn("part", F.pmod("mark", "parts")).drop("parts")


def _copied(rows: DataFrame, parts: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, mark, ...) with their copies: ``extra`` of a group's ``n`` rows, evenly along
    their ids, get one copy over the whole number."""
    number = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id", "mark"))
    share = lambda k: F.floor(F.col("extra") * k / F.col("n"))
    return _same(_placed(rows, parts).withColumn("number", number), plan, "source", "size", "part").withColumn(
        "copies", (F.col("whole") + share(F.col("number")) - share(F.col("number") - 1)).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate of every row of ``docs``.

    Rates become whole copies per (source, size, part) group, so taken words meet the target to within a
    document, and no row has over ``cap`` copies (``cap`` is a whole number). A size that very many rows
    share is cut in parts, so no group that is ranked outgrows a task.
    """
    sizes, parts, plan = _planned(docs, weights, cap)
    return _copied(sizes, parts, plan).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def take(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    _, parts, plan = _planned(docs, weights, cap)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       row_mark(F.col("doc_id"), F.col("text")).alias("mark"), F.struct(*docs.columns).alias("row"))
    return _copied(rows, parts, plan).select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("_")).select("row.*")


def _same(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join on keys where null equals null; ``right`` has one row per key."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, on, "left").drop(*[f"_{k}" for k in keys])
