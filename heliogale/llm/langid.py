"""Language by string kernels: which n-grams two texts share.

The kernel of two texts is the number of n-grams of 1 to 3 bytes that both hold (presence, not counts), over
the geometric mean of their own numbers. ASCII letters are taken in lower case and all other ASCII bytes as
one gap. ``LANDMARKS`` training texts (one of each language at least) span the Nystroem approximation; n-grams outside all landmarks are
left out of the kernel. Kernel ridge regression, one language against the rest, gives a weight per landmark
and language. A task turns texts into presence rows and multiplies them, a batch at a time, with the
landmarks' rows and those weights.

Training takes at most ``TRAIN_ROWS`` texts or one of each language, none over ``MAX_TRAIN_BYTES``; every whole text is scored.
Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything if there is
nothing to learn from. Null langs are not used; extra columns are ignored; an empty table gives an empty
result. Equal scores go to the language that comes first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.llm.samples import drawn
from heliogale.llm.wordhash import blocks

LONGEST = 3
TRAIN_ROWS = 2000
LANDMARKS = 200
MAX_TRAIN_BYTES = 100_000
RIDGE = 1e-3
UNKNOWN = "und"
BATCH = 128

_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
# Bytes as 1..155: gap, a-z, then the bytes of other scripts.
_CLASS = np.ones(256, dtype=np.int32)
_CLASS[97:123] = _CLASS[65:91] = np.arange(2, 28)
_CLASS[128:] = np.arange(28, 156)


def _codes(raw: np.ndarray) -> list[np.ndarray]:
    """The n-grams of a text as numbers, for each length; lengths never share a number."""
    out = [_CLASS[raw]]
    for n in range(1, LONGEST):
        out.append((out[-1][:-1] << 8) | out[0][n:] if len(raw) > n else np.zeros(0, dtype=np.int32))
    return out


def _has_letter(raw: np.ndarray) -> bool:
    if _LETTER[raw].any():
        return True
    return bool((raw > 127).any()) and any(c.isalpha() for c in raw.tobytes().decode())


def _rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text, one after another."""
    for rows, bounds, raw in blocks(texts):
        for k in range(len(rows)):
            yield raw[bounds[k] : bounds[k + 1] - (len(rows) > 1)]


@dataclass
class LanguageModel:
    langs: list[str]
    grams: np.ndarray  # sorted numbers of the landmarks' n-grams
    landmarks: np.ndarray  # presence, one row per landmark, scaled to unit length
    weights: np.ndarray  # landmark x language

    def table(self) -> np.ndarray:
        out = np.full(1 << (8 * LONGEST), len(self.grams), dtype=np.int32)
        out[self.grams] = np.arange(len(self.grams), dtype=np.int32)
        return out

    def kernel(self, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Kernel of texts and landmarks, by one matrix product."""
        presence = np.zeros((len(texts), len(self.grams) + 1), dtype=np.float32)
        for k, raw in enumerate(texts):
            for codes in _codes(raw):
                presence[k, table[codes]] = 1
        presence = presence[:, :-1]
        own = np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
        return (presence @ self.landmarks.T) / own

    def predict(self, docs: DataFrame) -> DataFrame:
        """doc_id, lang_pred, score of every row of ``docs``."""
        model = self

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = model.table() if model.langs else None
            for batch in parts:
                lang: list[str] = []
                score: list[float] = []
                waiting: list[np.ndarray] = []
                known: list[bool] = []

                def flush():
                    values = model.kernel(waiting, table) @ model.weights
                    best = values.argmax(axis=1)
                    top = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)
                    lang.extend(model.langs[b] if k else UNKNOWN for b, k in zip(best, known))
                    score.extend(float(t) if k else 0.0 for t, k in zip(top, known))
                    waiting.clear()
                    known.clear()

                if table is None:
                    lang, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
                else:
                    for raw in _rows(batch.column("text")):
                        waiting.append(raw)
                        known.append(_has_letter(raw))
                        if len(waiting) == BATCH:
                            flush()
                    if waiting:
                        flush()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

        return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, lang_pred string, score double")


def fit(texts: list[str], truth: list[str], landmarks: int = LANDMARKS) -> LanguageModel:
    """Nystroem kernel ridge regression on a sample; landmarks are taken evenly from each language."""
    langs = sorted(set(truth))
    if not langs:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    raws = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts]
    per_lang = max(1, landmarks // len(langs))
    chosen = [k for lang in langs for k in [i for i, t in enumerate(truth) if t == lang][:per_lang]]
    sets = [np.unique(np.concatenate(_codes(raws[k]))) for k in chosen]
    grams = np.unique(np.concatenate(sets))
    rows = np.array([np.isin(grams, s, assume_unique=True) for s in sets], dtype=np.float32)
    rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    model = LanguageModel(langs, grams, rows, np.zeros((len(chosen), len(langs))))
    table = model.table()
    k_nm = np.concatenate([model.kernel(raws[i : i + BATCH], table) for i in range(0, len(raws), BATCH)]).astype(np.float64)
    k_mm = (rows @ rows.T).astype(np.float64)
    one_rest = np.where(np.array(truth)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    left = k_nm.T @ k_nm + RIDGE * len(raws) * k_mm + 1e-8 * len(raws) * np.eye(len(chosen))
    model.weights = np.linalg.solve(left, k_nm.T @ one_rest)
    return model


def train(docs: DataFrame, usable: Column) -> LanguageModel:
    """Learn from text and lang of the rows whose id meets ``usable``; each language gets an equal part."""
    fits = F.octet_length("text").between(1, MAX_TRAIN_BYTES)
    known = docs.select("doc_id", "lang", "text").filter(usable).filter(F.col("lang").isNotNull() & fits).select("doc_id", "lang")
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    fitting = docs.select("doc_id", "lang", "text").filter(usable).filter(fits)
    each = max(1, TRAIN_ROWS // max(1, len(langs)))
    texts: list[str] = []
    truth: list[str] = []
    for lang in langs:
        ids = drawn(known.filter(F.col("lang") == lang).select("doc_id"), F.col("doc_id"), each)
        # By id and language: a repeated id may stand for texts of several languages.
        for r in fitting.filter(F.col("lang") == lang).join(F.broadcast(ids), "doc_id", "left_semi").sort("doc_id", "text").limit(each).collect():
            texts.append(r["text"])
            truth.append(lang)
    return fit(texts, truth)


def identify(docs: DataFrame, usable: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    return train(docs, usable).predict(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
