"""Average ranks inside groups, without ever sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogale.plans.order import running


def rank_table(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Distinct ``(keys, value)`` with ``ties`` (rows sharing it), ``avg_rank`` (1-based)
    and ``group_n``. ``df`` has ``weight`` equal rows per row; ``value`` is a double.

    Ties collapse first, so a value that a third of the rows share is one row; the rest is a running
    count over value ranges (:func:`heliogale.plans.order.running`), whatever the size of a group.
    """
    ties = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("ties"))
    counted = running(ties, keys, value, "ties")
    return counted.select(
        *keys, value, "ties", (F.col("before") + (F.col("ties") + 1) / F.lit(2.0)).alias("avg_rank"), F.col("whole").alias("group_n"))
