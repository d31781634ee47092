"""Quality by compression: a text is good if a dictionary of good text helps more than one of bad text.

Two zstandard dictionaries are built from good and from bad labelled text. A text is compressed with
either in pieces of ``PIECE`` bytes, so that the dictionaries count all through a long text and not only
at its start. The normalised difference of the two sizes and the plain compression ratio become a
probability by logistic regression on labelled texts that the dictionaries have not seen.

Training takes at most ``rows_per_class`` labelled texts of each class, none over ``MAX_TRAIN_BYTES``;
scoring takes every whole text. Defined results: null and empty texts get the score that calibration
gives to no evidence; if a class has under ``MIN_ROWS`` texts, every score is the share of good labels (0.5
without labels). Null labels are not used; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.llm.samples import drawn

PIECE = 2048
LEVEL = 3
DICTIONARY_BYTES = 112 << 10
ROWS_PER_CLASS = 3000
MAX_TRAIN_BYTES = 100_000
MIN_ROWS = 8


def _pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]


def _dictionary(texts: list[str]) -> bytes:
    """Trained by zstandard where there is enough text, else the text itself."""
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY_BYTES]


class Sizes:
    """Compressed sizes of texts under a good and a bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Per text: normalised size difference (positive for good) and mean compression ratio."""
        out = np.zeros((len(texts), 2))
        for k, text in enumerate(texts):
            pieces = _pieces(text)
            if pieces:
                good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.compressors)
                out[k] = (bad - good) / (bad + good), (bad + good) / (2 * sum(map(len, pieces)))
        return out


def _design(evidence: np.ndarray) -> np.ndarray:
    difference, ratio = evidence[:, 0], np.minimum(evidence[:, 1], 1.0)
    return np.column_stack([np.ones(len(evidence)), 10 * difference, ratio, ratio**2])


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    weights = np.zeros(features.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (labels - p) - ridge * weights
        curve = (features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    share: float  # of good labels; the score where nothing was learned

    def score(self, text: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            sizes = Sizes(model.good, model.bad) if len(model.weights) else None
            for texts in batches:
                if sizes is None:
                    yield pa.array(np.full(len(texts), model.share))
                    continue
                parts = [sizes.evidence(texts.slice(k, 256).to_pylist()) for k in range(0, len(texts), 256)]
                logits = _design(np.concatenate(parts)) @ model.weights if parts else np.zeros(0)
                yield pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

        return score(text)


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows_per_class: int = ROWS_PER_CLASS) -> QualityModel:
    """Learn from the labelled rows of ``docs`` whose id meets ``usable`` (a Column on ``doc_id``).

    Every other drawn text goes into a dictionary, the rest calibrates.
    """
    marked = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter(usable)
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    texts: dict[int, list[str]] = {}
    for quality in (0, 1):
        ids = drawn(marked.filter(F.col("quality") == quality).select("doc_id"), F.col("doc_id"), rows_per_class)
        fit = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, MAX_TRAIN_BYTES)).join(F.broadcast(ids), "doc_id")
        texts[quality] = [r["text"] for r in fit.sort("doc_id", "text").limit(rows_per_class).collect()]
    if min(map(len, texts.values())) < MIN_ROWS:
        return QualityModel(b"", b"", np.zeros(0), share)
    good, bad = _dictionary(texts[1][::2]), _dictionary(texts[0][::2])
    sizes = Sizes(good, bad)
    held = texts[1][1::2] + texts[0][1::2]
    truth = np.array([1.0] * len(texts[1][1::2]) + [0.0] * len(texts[0][1::2]))
    # Classes are drawn alike; weighing the prior back in makes the score a probability.
    weights = logistic(_design(sizes.evidence(held)), truth)
    odds = np.log(max(share, 1e-3) / max(1 - share, 1e-3)) - np.log(truth.sum() / (len(truth) - truth.sum()))
    weights[0] += odds
    return QualityModel(good, bad, weights, share)


def classify(docs: DataFrame, labels: DataFrame, threshold: float, usable: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    score = train(docs, labels, usable).score(F.col("text"))
    scored = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float, usable: Column) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    return docs.filter(train(docs, labels, usable).score(F.col("text")) >= threshold)
