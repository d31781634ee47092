"""Numbers of rows along a total order, without one task that sees all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliogale.llm.store import stored


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order`` inside each ``group``) and ``n`` (rows of the group).

    Rows are dealt by value ranges of group and order, so a group with a third of all rows lies in many
    tasks. A row's number is the rows of its group in earlier ranges plus its place in its own range; only
    one count per group and range is summed. Ranges are sampled, so ``rows`` should be a stored table.
    ``group`` may hold nulls, which form a group. Rows equal in ``order`` are numbered in any order; give an
    order in which only identical rows are equal.
    """
    keys = [F.col(c) for c in group]
    in_order = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The id counts up inside a task's rows, from the task's number shifted by 33 bits.
    placed = stored(in_order.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_{c}") for c in group], F.col("_range").alias("_part"), "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    return (
        placed.join(offsets, [*same, F.col("_range") == F.col("_part")])
        .withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first"))
        .select(*rows.columns, "pos", "n")
    )
