"""Bounded samples of labelled rows for training; everything else covers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def drawn(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows, those of the smallest hash of ``key``: the same rows on every run.

    A first cut of the hash, set from the number of rows, leaves little over ``limit`` rows to be ordered.
    """
    point = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 32))
    share = min(1.0, (1.2 * limit + 100) / max(1, rows.count()))
    return rows.filter(point < int(share * (1 << 32))).orderBy(point, key).limit(limit)
