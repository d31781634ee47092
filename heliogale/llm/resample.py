"""Importance resampling towards a target distribution of hashed n-grams.

A text is lower-cased in ASCII, everything but letters, digits and other scripts becomes a space, and runs of
spaces collapse to one. One overlapped regular-expression scan then stands at every word in turn: its boundary
lookarounds make it match the runs of 1 to 3 words that begin there, and each run's CRC-32 (continued from that
of the shorter run) falls into one of ``buckets``. Bucket counts of all documents and of all target texts give
each bucket a log-ratio gain; a document's weight is the sum of its gains, and weights with Gumbel noise drawn
from the id turn "the highest scores" into sampling without replacement.

A text is scanned once: its buckets are stored, two bytes for each of its runs, and counted and weighed from
there. Only the ``buckets`` counts meet at the driver. The draw numbers rows by value ranges.

Defined results: a null or empty text has no features, weight 0 and is not eligible for the draw; the noise of
a null id is that of an empty one, and null ids come last among ties; rows that share id and score follow a hash
of their text, and identical rows are drawn as the rows they are; empty tables are allowed on either side. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.llm.ordered import numbered
from heliogale.llm.store import stored

BUCKETS = 10_000  # at most 65,536, two bytes each
MIN_WORDS = 20
PERCENT = 5
SEED = 42

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_PLAIN = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_GAPS = regex.compile(rb"  +")
#: From the first letter of a word: the word, and the next two where there are any.
_RUNS = regex.compile(rb"(?<![^ ])([^ ]+)( [^ ]+)?( [^ ]+)?(?![^ ])")


def plain(text: bytes) -> bytes:
    """Words of ``text`` (UTF-8), lower-cased in ASCII, with one space between."""
    return _GAPS.sub(b" ", text.translate(_PLAIN)).strip(b" ")


def runs(words: bytes) -> tuple[int, array]:
    """Number of words and the CRC-32 of every run of 1 to 3 of them."""
    crc32, n, found = zlib.crc32, 0, array("I")
    add = found.append
    for match in _RUNS.finditer(words, overlapped=True):
        one, two, three = match.groups()
        n += 1
        crc = crc32(one)
        add(crc)
        if two is not None:
            crc = crc32(two, crc)
            add(crc)
            if three is not None:
                add(crc32(three, crc))
    return n, found


def _scan(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, held = [], []
            for text in batch.column("text"):
                n, found = runs(plain(text.as_buffer().to_pybytes())) if text.is_valid else (0, array("I"))
                words.append(n)
                held.append((np.frombuffer(found, dtype=np.uint32) % buckets).astype(np.uint16).tobytes())
            kept = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(
                kept | {"n_words": pa.array(words, pa.int64()), "buckets": pa.array(held, pa.binary())})

    return scan


def features(texts: DataFrame, kept: dict[str, Column], buckets: int = BUCKETS) -> DataFrame:
    """``kept`` columns, n_words and buckets (16-bit numbers) of every row of ``texts``, stored."""
    rows = texts.select(*[c.alias(k) for k, c in kept.items()], "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema]
    return stored(rows.mapInArrow(_scan(buckets), ", ".join([*fields, "n_words long", "buckets binary"])))


def _numbers(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a column of stored features, and where each row's begin (one more at the end)."""
    held = held.cast(pa.large_binary())
    bounds = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    data = held.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].tobytes() if data is not None else b""
    return np.frombuffer(values, dtype=np.uint16), (bounds - bounds[0]) // 2


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows of :func:`features`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column("buckets"))[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen), "n": pa.array(total[seen])})

    out = np.zeros(buckets, dtype=np.int64)
    per_task = scanned.select("buckets").mapInArrow(count, "bucket long, n long")
    for row in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of each bucket's smoothed share in the target and in the raw texts."""
    all_raw, all_target, n = int(raw.sum()), int(target.sum()), len(raw)
    ratio = lambda s, t: (t + 1) * (all_raw + n) / ((s + 1) * (all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(raw, target)], dtype=np.int64)


def _weigh(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = _numbers(batch.column("buckets"))
            total = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(gain[values], out=total[1:])
            kept = {c: batch.column(c) for c in batch.schema.names if c != "buckets"}
            yield pa.RecordBatch.from_pydict(
                kept | {"n_features": pa.array(np.diff(bounds)), "weight": pa.array(np.diff(total[bounds]))})

    return weigh


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that the id fixes."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(docs: DataFrame, target: DataFrame, kept: dict[str, Column], percent: int, min_words: int, buckets: int) -> DataFrame:
    own = {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64("text"), **kept}
    scanned = features(docs, own, buckets)
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(features(target, {}, buckets), buckets))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.drop("buckets").schema]
    weighed = scanned.mapInArrow(_weigh(gain), ", ".join([*fields, "n_features long", "weight long"]))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash")]
    places = numbered(scored.filter(F.col("n_words") >= min_words), [], order)
    drawn = F.floor(F.col("n") * percent / 100)
    ranked = places.withColumn("rank", F.when(F.col("pos") < drawn, F.col("pos") + 1)).drop("pos", "n")
    return ranked.unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
               buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (rank: null where not drawn).

    ``percent`` of the rows with at least ``min_words`` words are drawn, rounded down, the highest scores first.
    """
    return _ranked(docs, target, {}, percent, min_words, buckets).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns."""
    whole = {"row": F.struct(*docs.columns)}
    return _ranked(docs, target, whole, percent, min_words, buckets).filter(F.col("rank").isNotNull()).select("row.*")
