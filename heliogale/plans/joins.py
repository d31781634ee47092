"""Joins that stay balanced when one key holds a large part of the rows.

None of these carries a broadcast hint for data of unknown size: Spark broadcasts a
side by itself when its measured size is below ``autoBroadcastJoinThreshold``; the
salted or split shuffle join is the other way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
HEAVY_SHARE = 1000  # a key above 1/1000 of all rows is heavy, so at most 1000 keys are
HEAVY_ROWS = 100_000  # and it has at least this many rows


def dim_join(
    fact: DataFrame, dim: DataFrame, on: list[str], how: str = "left",
    spread: list[str] | None = None, salts: int = SALTS,
) -> DataFrame:
    """Join many ``fact`` rows per key to at most one ``dim`` row per key.

    ``dim`` is repeated once per salt and fact rows pick a salt from a hash of their
    ``spread`` columns, so a hot key is spread over ``salts`` tasks. The salt is a pure
    function of the row: a recomputed task yields the same rows. By default rows are told
    apart by their cell (``lat_i``, ``lon_i``) where they have one, which keeps column
    pruning intact, else by all their columns.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"dim_join supports inner and left; got {how!r}")
    cell = [c for c in ("lat_i", "lon_i") if c in fact.columns]
    spread = spread or (cell if len(cell) == 2 else fact.columns)
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def heavy_limit(total: int, heavy_rows: int = HEAVY_ROWS) -> int:
    """Rows above which a key is heavy, in a table of ``total`` rows."""
    return max(heavy_rows, total // HEAVY_SHARE)


def heavy_split_join(
    rows: DataFrame, table: DataFrame, on: list[str], weight: str, limit: int
) -> DataFrame:
    """Inner join where ``table`` knows how many rows (``weight``) each of its keys has.

    With ``limit`` from :func:`heavy_limit`, keys above it are at most ``HEAVY_SHARE`` by
    counting, so they are broadcast and their rows never shuffle; every other key is light
    enough for an ordinary shuffle join. Both parts together are the whole join. ``table``
    is read more than once and should be a stored or pinned table.
    """
    heavy = F.broadcast(table.filter(F.col(weight) > limit))
    part_heavy = rows.join(heavy, on, "inner")
    part_light = rows.join(heavy.select(*on), on, "left_anti").join(
        table.filter(F.col(weight) <= limit), on, "inner")
    return part_heavy.unionByName(part_light)
