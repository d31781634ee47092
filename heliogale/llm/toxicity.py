"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts carry a label; a sample of all texts is the unlabelled side, a mixture with a
known share ``prior`` of toxic ones. A linear classifier on the presence of words minimises the corrected
logistic risk ``prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])``; when the second term
falls below zero its gradient is followed upwards instead, so it cannot overfit the positives.

Training takes at most ``POSITIVES`` toxic and ``UNLABELLED`` other texts, none over ``MAX_TRAIN_BYTES``, and the
``FEATURES`` words that tell them apart best; scoring takes every whole text. Defined results: null and
empty texts get the score of no evidence; with under ``MIN_POSITIVES`` toxic texts every score is the prior (0
without labels). Null labels are not used; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.llm.samples import drawn
from heliogale.llm.wordhash import Hasher, text_words

POSITIVES = 3000
UNLABELLED = 6000
MAX_TRAIN_BYTES = 100_000
FEATURES = 1024
APART = 4.0  # standard errors between the samples that a word must show to count
MIN_POSITIVES = 5
STEPS = 400


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct token hashes of each text."""
    hasher = Hasher(tokens=True)
    for batch in batches:
        found = []
        for rows, first, (words,) in text_words(batch.column("text"), hasher):
            found += [np.unique(words[first[k] : first[k + 1]]).view(np.int64) for k in range(len(rows))]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "words": pa.array(found, pa.list_(pa.int64()))})


@dataclass
class ToxicityModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def logits(self, texts: pa.Array, hasher: Hasher) -> np.ndarray:
        """Bias plus the weights of the distinct known words of each text."""
        out = np.full(len(texts), self.bias)
        size = len(self.words)
        for rows, first, (words,) in text_words(texts, hasher) if size else ():
            place = np.minimum(np.searchsorted(self.words, words), size - 1)
            hit = np.flatnonzero(self.words[place] == words)
            row = np.searchsorted(first, hit, side="right") - 1
            pairs = np.unique(row * size + place[hit])
            out[rows[0] : rows[-1] + 1] += np.bincount(pairs // size, self.weights[pairs % size], len(rows))
        return out

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score of every row of ``docs``."""
        model = self

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(tokens=True)
            for batch in parts:
                score = 1 / (1 + np.exp(-np.clip(model.logits(batch.column("text"), hasher), -30, 30)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score)})

        return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, score double")


def _features(positive: list[np.ndarray], unlabelled: list[np.ndarray], limit: int) -> np.ndarray:
    """Sorted words whose share of texts differs most, in standard errors, between the two samples."""
    words, which = np.unique(np.concatenate(positive + unlabelled), return_inverse=True)
    split = sum(map(len, positive))
    in_p = np.bincount(which[:split], minlength=len(words)) / len(positive)
    in_u = np.bincount(which[split:], minlength=len(words)) / len(unlabelled)
    usual = (in_u * len(unlabelled) + 1) / (len(unlabelled) + 2)
    apart = np.abs(in_p - in_u) / np.sqrt(usual * (1 - usual) / len(positive))
    apart[in_p * len(positive) < 3] = 0
    best = np.argsort(-apart, kind="stable")[:limit]
    return words[np.sort(best[apart[best] > APART])]


def _matrix(texts: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    return np.array([np.isin(words, t, assume_unique=True) for t in texts], dtype=np.float32).reshape(len(texts), len(words))


def non_negative_pu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the corrected risk on presence matrices of positives and unlabelled."""
    p, u = (np.hstack([m, np.ones((len(m), 1), dtype=np.float32)]) for m in (p, u))
    w = np.zeros(p.shape[1], dtype=np.float32)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        of_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        towards = u.T @ (sigmoid(zu) / len(u)) - prior * (p.T @ (sigmoid(zp) / len(p)))
        slope = -prior * (p.T @ (sigmoid(-zp) / len(p))) + towards if of_negative >= 0 else -towards
        slope[:-1] += ridge * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1].astype(np.float64), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> ToxicityModel:
    """Learn from the rows whose id meets ``usable``; the prior is the toxic share of their labels."""
    marked = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(usable)
    seen = marked.agg(F.count("*").alias("n"), F.avg("toxic").alias("share")).first()
    prior = float(seen["share"] or 0.0)
    positives = marked.filter("toxic = 1").select("doc_id")
    key = F.col("doc_id")
    fitting = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, MAX_TRAIN_BYTES))
    ids = drawn(positives, key, POSITIVES), drawn(docs.select("doc_id").filter(usable), key, UNLABELLED)
    toxic, other = (fitting.join(F.broadcast(i), "doc_id", "left_semi") for i in ids)
    p, u = ([np.array(r["words"], dtype=np.int64).view(np.uint64) for r in rows.mapInArrow(_tokens, "doc_id long, words array<long>").sort("doc_id").collect()]
            for rows in (toxic, other))
    if len(p) < MIN_POSITIVES or not u:
        limited = min(max(prior, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(limited / (1 - limited))))
    words = _features(p, u, FEATURES)
    weights, bias = non_negative_pu(_matrix(p, words), _matrix(u, words), min(max(prior, 1e-3), 0.999))
    return ToxicityModel(words, weights, bias)


def classify(docs: DataFrame, labels: DataFrame, threshold: float, usable: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scored = train(docs, labels, usable).score(docs)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
