"""Texts grouped in blocks, and exchanges of whole arrays between blocks and buckets.

Operators that compare windows or shingles of all texts would shuffle one row per word. Instead a block of
texts (a few MB, chosen by document id) sends one array per bucket of hash values; a bucket compares the
arrays of all blocks and answers each block. Spark groups and shuffles the rows; numpy works inside a group.
Groups stay small when data grows: there are as many blocks and buckets as the bytes of text ask for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.llm.wordhash import mix

BLOCK_BYTES = 4 << 20


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def block_of(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int")


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """block, doc_id, text, shuffled by block. Uses in one plan share the shuffle."""
    return docs.select(block_of(F.col("doc_id"), blocks).alias("block"), "doc_id", "text").repartition("block")


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups ``keys`` by bucket and sorts them inside, and the first place of each bucket."""
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))
