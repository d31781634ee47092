"""Stupid-backoff scores of every document under the n-gram counts of all other documents.

A word scores ``c(its n-gram) / c(the n-gram's context)`` for the longest n-gram that occurs in another
document, times ``ALPHA`` for each order given up; a word seen nowhere else scores as half a count at the
lowest order. Counts are those of the whole table less the document's own, so no text vouches for itself.

The count tables are partitioned by ranges of the n-gram's hash: a block of texts sends its distinct n-grams, ascending,
and their counts, one row per bucket; a bucket adds up the counts of all blocks and joins the sums back, in the
order in which each block asked. Orders go from short to long, and an n-gram is only asked for if both n-grams one
word shorter occur in other texts, as it cannot occur there otherwise. N-grams are 64-bit hashes; keys travel as steps
and counts as compressed planes of bytes (``packed``).

Defined results: a null or empty text has no words, sum 0 and mean null; repeated rows are documents of
their own; null ids are carried along, and a block takes texts by id and text, so that rows without an id spread;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogale.llm.blocks import block_count
from heliogale.llm.packed import pack, pack_ascending, unpack, unpack_ascending
from heliogale.llm.wordhash import Hasher, mix, text_words

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 8 << 20  # a block's distinct n-grams are sent once, so larger blocks send less; about 30 bytes held per byte
TOTAL = np.uint64(0)  # the key of the empty n-gram: it counts all words
ASKED = "bucket int, block int, level int, keys binary, counts binary"
ANSWER = "bucket int, block int, level int, totals binary"
SCORES = "doc_id long, n_words long, n_unseen long, log_score double, mean_log_score double"


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """First place of each bucket in ascending ``keys``: buckets are ranges of hashes, so this order is theirs."""
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Counts:
    """The n-grams of a block: per order, the distinct hashes and their counts, and where they stand."""

    def __init__(self, texts: pa.Array, buckets: int):
        hasher = Hasher(1)
        words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, first, (found,) in text_words(texts, hasher):
            words.append(found)
            counts.append(np.diff(first))
        self.hasher, self.buckets = hasher, buckets
        self.words, self.counts = np.concatenate(words), np.concatenate(counts)
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.words)) - (np.cumsum(self.counts) - self.counts)[self.text_of]
        self.others = np.full(len(self.words), len(self.words), dtype=np.int64)  # order 0, set by ``answer``
        self.totals: list[np.ndarray] = []  # per order, the answer as it came
        self.seen: list[np.ndarray] = []  # per order, counts in other texts of the n-gram that ends at a word

    def ask(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words that end a useful n-gram of ``level`` words, its distinct hashes, counts and number in them."""
        ends = np.flatnonzero(self.place >= level - 1)
        if level > 1:
            # Both shorter n-grams, ending at this word and at the one before, occur in other texts.
            shorter = self.seen[level - 2]
            ends = ends[(shorter[ends] > 0) & (shorter[ends - 1] > 0)]
        hashes = self.hasher.windows(self.words, level)[ends - level + 1] | np.uint64(1) if len(ends) else np.zeros(0, np.uint64)
        keys, number, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        if level == 1:
            keys, counts = np.concatenate([[TOTAL], keys]), np.concatenate([[len(self.words)], counts])
            number = number + 1
        return ends, keys, counts, number

    def own(self, ends: np.ndarray, keys: np.ndarray, counts: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How often the n-gram that ends at each of ``ends`` occurs in its own text."""
        own = np.ones(len(ends), dtype=np.int64)
        several = np.flatnonzero(counts[number] > 1)
        in_text = mix(self.text_of[ends[several]].astype(np.uint64) + np.uint64(1)) + mix(keys[number[several]])
        _, which, times = np.unique(in_text, return_inverse=True, return_counts=True)
        own[several] = times[which]
        return own

    def answer(self, level: int, totals: np.ndarray) -> None:
        """Take the sums over all texts, in the order of the keys, and leave out each text's own counts."""
        ends, keys, counts, number = self.ask(level)
        seen = np.zeros(len(self.words), dtype=np.int64)
        seen[ends] = totals[number] - self.own(ends, keys, counts, number)
        if level == 1:
            self.others = totals[0] - self.counts[self.text_of]
        self.seen.append(seen)
        self.totals.append(totals)

    def carried(self, block: int) -> pa.Table:
        """The answers so far, addressed to the block itself, so that no order is asked for twice."""
        n = len(self.totals)
        return pa.table({"bucket": _fixed(-1 - block, n), "block": _fixed(block, n), "level": pa.array(np.arange(1, n + 1), pa.int32()),
                         "keys": pa.array([b""] * n, pa.binary()), "counts": pa.array([pack(t) for t in self.totals], pa.binary())})

    def sent(self, level: int, block: int) -> pa.Table:
        _, keys, counts, _ = self.ask(level)
        bound = _bounds(keys, self.buckets)
        used = np.flatnonzero(np.diff(bound))
        part = lambda packed, values: pa.array([packed(values[bound[b] : bound[b + 1]]) for b in used], pa.binary())
        return pa.table({"bucket": pa.array(used, pa.int32()), "block": _fixed(block, len(used)), "level": _fixed(level, len(used)),
                         "keys": part(pack_ascending, keys), "counts": part(pack, counts)})

    def scores(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Log score of every word, and whether it occurs in no other text."""
        out = np.log(alpha ** len(self.seen) * 0.5 / np.maximum(self.others, 1))
        for level, seen in enumerate(self.seen, 1):
            hit = np.flatnonzero(seen > 0)
            context = self.others[hit] if level == 1 else self.seen[level - 2][hit - 1]
            out[hit] = np.log(seen[hit] / context) + (len(self.seen) - level) * np.log(alpha)
        return out, self.seen[0] == 0 if self.seen else np.zeros(0, dtype=bool)


def _fixed(value: int, n: int) -> pa.Array:
    return pa.array(np.full(n, value), pa.int32())


def _answered(table: pa.Table, answers: pa.Table, buckets: int, upto: int) -> Counts:
    counts = Counts(_column(table, "text"), buckets)
    level, bucket = answers.column("level").to_numpy(), answers.column("bucket").to_numpy()
    totals = _column(answers, "totals")
    for k in range(1, upto + 1):
        rows = np.flatnonzero(level == k)
        rows = rows[np.argsort(bucket[rows])]
        parts = [unpack(totals[r].as_py()).astype(np.int64) for r in rows.tolist()]
        counts.answer(k, np.concatenate([np.zeros(0, np.int64), *parts]))
    return counts


def _first(buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return Counts(_column(table, "text"), buckets).sent(1, key[0].as_py())

    return send


def _longer(level: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        counts = _answered(table, answers, buckets, level - 1)
        return pa.concat_tables([counts.sent(level, key[0].as_py()), counts.carried(key[0].as_py())])

    return send


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of a bucket: the sums of all blocks, joined back to each block's keys. Carried answers pass as they are."""
    if key[0].as_py() < 0:
        return pa.table({"bucket": _column(table, "bucket"), "block": _column(table, "block"), "level": _column(table, "level"),
                         "totals": _column(table, "counts")})
    asked = [unpack_ascending(k.as_py()) for k in table.column("keys")]
    counts = np.concatenate([unpack(c.as_py()) for c in table.column("counts")])
    found, which = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(which, counts, len(found)).astype(np.uint64)[which]
    bound = np.concatenate([[0], np.cumsum([len(keys) for keys in asked])])
    return pa.table({"bucket": _column(table, "bucket"), "block": _column(table, "block"), "level": _column(table, "level"),
                     "totals": pa.array([pack(totals[bound[k] : bound[k + 1]]) for k in range(len(asked))], pa.binary())})


def _scored(order: int, alpha: float, buckets: int):
    def score(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        counts = _answered(table, answers, buckets, order)
        logs, unseen = counts.scores(alpha)
        texts = len(counts.counts)
        total = np.bincount(counts.text_of, logs, texts)
        mean = [float(t / n) if n else None for t, n in zip(total, counts.counts)]
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(counts.counts, pa.int64()),
            "n_unseen": pa.array(np.bincount(counts.text_of, unseen, texts).astype(np.int64)),
            "log_score": pa.array(total, pa.float64()), "mean_log_score": pa.array(mean, pa.float64())})

    return score


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_unseen, log_score, mean_log_score of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    blocks = block_count(docs, block_bytes)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    base = docs.select(block.alias("block"), "doc_id", "text").repartition("block")
    # One chain: each order is shuffled once, and what is known goes along with the next order's questions.
    asked = base.groupBy("block").applyInArrow(_first(blocks), ASKED)
    for level in range(2, order + 1):
        answers = asked.groupBy("bucket").applyInArrow(_summed, ANSWER)
        asked = base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_longer(level, blocks), ASKED)
    answers = asked.groupBy("bucket").applyInArrow(_summed, ANSWER)
    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(order, alpha, blocks), SCORES)
