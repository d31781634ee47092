"""Remove passages of ``WINDOW`` words that also start earlier, found by difference-cover anchors.

A difference cover D modulo v holds, for any two places i and j, a shift k < v with i+k and j+k both in D
modulo v. So two equal windows of ``WINDOW`` words share an equal run of ``WINDOW + 1 - v`` words that starts
at a cover place in both, the anchor. Only anchors (4 of 13 places) are compared across the corpus; windows
that hold an anchor seen twice are then extended to their full length and compared exactly by 96 bits of hash.

1. A block of texts sends its distinct anchors by bucket; buckets answer which occur twice.
2. The block sends the windows around those, each with its first place; buckets answer which of them start
   earlier in another block. Copies of an earlier equal text send nothing: all their windows start earlier.
3. The block marks windows that start earlier elsewhere or in itself, and removes the words they cover.

A place is (doc_id, start); null ids come first. Defined results: a null or empty text has no words;
repeated rows (same id and text) are the same document and get the same result; a text shorter than a
window keeps all words; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogale.llm.blocks import BLOCK_BYTES, block_count, block_of, blocked, by_bucket
from heliogale.llm.wordhash import Hasher, text_words

WINDOW = 20
PERIOD = 13
NO_ID = np.iinfo(np.int64).min


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set whose differences give every residue modulo ``period``."""
    for size in range(1, period + 1):
        for rest in itertools.combinations(range(1, period), size - 1):
            chosen = (0, *rest)
            if len({(a - b) % period for a in chosen for b in chosen}) == period:
                return chosen
    raise ValueError(period)


class Texts:
    """Word hashes of a block: the texts' ids in order, and two hashes of every word."""

    def __init__(self, table: pa.Table, copies: np.ndarray, second: bool = True):
        ids = table.column("doc_id").to_numpy() if not table.column("doc_id").null_count else (
            table.column("doc_id").fill_null(int(NO_ID)).to_numpy())
        order = np.lexsort((np.arange(len(ids)), ids))
        self.rows = order
        self.texts = table.column("text").take(pa.array(order)).combine_chunks()
        if isinstance(self.texts, pa.ChunkedArray):
            self.texts = pa.concat_arrays(self.texts.chunks) if self.texts.num_chunks else pa.array([], pa.string())
        self.ids = ids[order].astype(np.int64)
        hashers = (Hasher(1), Hasher(2)) if second else (Hasher(1),)
        self.hashers = hashers
        words: list[list[np.ndarray]] = [[] for _ in hashers]
        counts = []
        for _, first, found in text_words(self.texts, *hashers):
            counts.append(np.diff(first))
            for kept, w in zip(words, found):
                kept.append(w)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        self.words = [np.concatenate(w) if w else np.zeros(0, dtype=np.uint64) for w in words]
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.text_of = np.repeat(np.arange(len(self.ids)), self.counts)
        self.start = np.arange(len(self.text_of)) - self.first[self.text_of]
        self.is_copy = np.isin(self.ids, copies)
        # A repeated row (same id and text as one before it) is compared as its first one is.
        self.is_twin = np.zeros(len(self.ids), dtype=bool)
        again = np.flatnonzero(self.ids[1:] == self.ids[:-1]) + 1
        known: set[tuple[int, str | None]] = set()
        for k in np.union1d(again - 1, again):
            row = int(self.ids[k]), self.texts[int(k)].as_py()
            self.is_twin[k] = row in known
            known.add(row)
        self.shares_id = len(again) > 0

    def by_place(self, at: np.ndarray) -> np.ndarray:
        """Words in the order of their places; only texts that share an id are out of it."""
        return at[np.lexsort((self.start[at], self.ids[self.text_of[at]]))] if self.shares_id else at

    def windows(self, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window at every word, and whether it ends inside the same text."""
        found = self.hashers[which].windows(self.words[which], size)
        n = len(found)
        inside = self.text_of[:n] == self.text_of[size - 1 :] if n else np.zeros(0, dtype=bool)
        return found, inside


def _anchors(window: int, period: int, buckets: int):
    cover = np.zeros(period, dtype=bool)
    cover[list(difference_cover(period))] = True

    def at(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        found, inside = texts.windows(window + 1 - period)
        places = np.flatnonzero(inside & cover[texts.start[: len(found)] % period])
        return found[places], places

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, _ = at(Texts(table, np.zeros(0, dtype=np.int64), second=False))
        keys, times = np.unique(keys, return_counts=True)
        order, bound = by_bucket(keys, buckets)
        used = np.flatnonzero(np.diff(bound))
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), key[0].as_py()), pa.int32()),
            "keys": pa.array([keys[order[bound[b] : bound[b + 1]]].view(np.int64) for b in used], pa.list_(pa.int64())),
            "twice": pa.array([times[order[bound[b] : bound[b + 1]]] > 1 for b in used], pa.list_(pa.bool_())),
        })

    return at, send


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the row of each."""
    column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: per block, the anchors that occur twice or more in all."""
    keys, row = _flat(table.column("keys"))
    twice, _ = _flat(table.column("twice"))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    hit = twice.astype(bool).copy()
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    # A key that one block holds twice is held by that block alone or met above.
    return _answer(table.column("block").to_numpy(), keys[hit], row[hit])


def _answer(blocks: np.ndarray, keys: np.ndarray, row: np.ndarray) -> pa.Table:
    order = np.argsort(row, kind="stable")
    bound = np.searchsorted(row[order], np.arange(len(blocks) + 1))
    used = np.flatnonzero(np.diff(bound))
    return pa.table({
        "block": pa.array(blocks[used], pa.int32()),
        "keys": pa.array([keys[order[bound[k] : bound[k + 1]]] for k in used], pa.list_(pa.int64())),
        "copies": pa.array([[]] * len(used), pa.list_(pa.int64())),
    })


ANSWER = "block int, keys array<long>, copies array<long>"


def _told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and the copies' ids that buckets told a block."""
    keys = np.sort(_flat(answers.column("keys"))[0].astype(np.int64).view(np.uint64)) if len(answers) else np.zeros(0, np.uint64)
    copies = _flat(answers.column("copies"))[0].astype(np.int64) if len(answers) else np.zeros(0, np.int64)
    return keys, copies


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _candidates(anchors_at, window: int, period: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        seen, copies = _told(answers)
        texts = Texts(table, copies)
        keys, places = anchors_at(texts)
        places = places[_among(keys, seen)]
        found, inside = texts.windows(window)
        check, _ = texts.windows(window, 1)
        # The windows that hold an anchor start up to period - 1 words before it.
        held = np.zeros(len(texts.text_of) + 1, dtype=np.int64)
        np.add.at(held, np.maximum(places - period + 1, texts.first[texts.text_of[places]]), 1)
        np.add.at(held, places + 1, -1)
        text_of = texts.text_of[: len(found)]
        wanted = np.flatnonzero(inside & (np.cumsum(held)[: len(found)] > 0) & ~texts.is_copy[text_of] & ~texts.is_twin[text_of])
        wanted = texts.by_place(wanted)  # so the first of equal hashes is the first place
        keys, first = np.unique(found[wanted], return_index=True)
        wanted = wanted[first]
        order, bound = by_bucket(keys, buckets)
        used = np.flatnonzero(np.diff(bound))
        part = lambda values, kind: pa.array([values[order[bound[b] : bound[b + 1]]] for b in used], pa.list_(kind))
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), key[0].as_py()), pa.int32()),
            "keys": part(keys.view(np.int64), pa.int64()), "checks": part(check[wanted].astype(np.uint32).view(np.int32), pa.int32()),
            "docs": part(texts.ids[text_of[wanted]], pa.int64()), "starts": part(texts.start[wanted].astype(np.int32), pa.int32()),
        })

    return send


def _earlier(table: pa.Table) -> pa.Table:
    """Of one bucket: per block, the windows whose first place lies in another block."""
    keys, row = _flat(table.column("keys"))
    checks, docs, starts = (_flat(table.column(c))[0] for c in ("checks", "docs", "starts"))
    order = np.lexsort((starts, docs, checks, keys))
    leads = np.ones(len(order), dtype=bool)
    leads[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    late = order[~leads]
    return _answer(table.column("block").to_numpy(), keys[late], row[late])


def _remove(window: int):
    def texts_out(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        told, copies = _told(answers)
        texts = Texts(table, copies, second=False)
        found, inside = texts.windows(window)
        n = len(found)
        late = inside & (_among(found, told) | texts.is_copy[texts.text_of[:n]])
        # Inside the block all but the first of equal windows start later; a repeated row starts with its first one.
        at = texts.by_place(np.flatnonzero(inside & ~late))
        order = np.argsort(found[at], kind="stable")
        ranked = at[order]
        if len(ranked):
            new = np.concatenate([[True], found[ranked][1:] != found[ranked][:-1]])
            lead = ranked[np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))]
            place = lambda w: (texts.ids[texts.text_of[w]], texts.start[w])
            (a, b), (c, d) = place(lead), place(ranked)
            late[ranked[(a < c) | ((a == c) & (b < d))]] = True
        cover = np.zeros(len(texts.text_of) + 1, dtype=np.int64)
        hits = np.flatnonzero(late)
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[texts.first[1:]] - total[texts.first[:-1]]
        kept: list[str | None] = []
        for k, text in enumerate(texts.texts):
            words = (text.as_py() or "").encode().split()
            if removed[k]:
                words = [w for w, g in zip(words, gone[texts.first[k] : texts.first[k + 1]]) if not g]
            kept.append(b" ".join(words).decode())
        back = np.empty(len(texts.rows), dtype=np.int64)
        back[texts.rows] = np.arange(len(texts.rows))
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(texts.counts[back], pa.int64()),
            "n_removed": pa.array(removed[back].astype(np.int64)), "text": pa.array(kept, pa.string()).take(pa.array(back)),
        })

    return texts_out


def _digest(clean):
    """``clean`` with the text's SHA-256 in place of the text, so that texts do not leave the task."""

    def out(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        made = clean(key, table, answers)
        digests = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in made.column("text")]
        return made.drop(["text"]).append_column("kept_sha256", pa.array(digests, pa.string()))

    return out


def _cleaned(docs: DataFrame, finish, schema: str, window: int, period: int, block_bytes: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    blocks = block_count(docs, block_bytes)
    base = blocked(docs, blocks)
    anchors_at, send_anchors = _anchors(window, period, blocks)
    anchors = base.groupBy("block").applyInArrow(send_anchors, "bucket int, block int, keys array<long>, twice array<boolean>")
    twice = anchors.groupBy("bucket").applyInArrow(_repeated, ANSWER)

    # Copies of an earlier equal text, told to their blocks. Partial minima come before the shuffle.
    ids = docs.select("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("place"), F.sha2("text", 256).alias("same")).filter("same IS NOT NULL")
    lowest = ids.groupBy("same").agg(F.min("place").alias("lowest"))
    later = ids.join(lowest, "same").filter("place > lowest")
    copies = later.select(
        block_of(F.col("doc_id"), blocks).alias("block"), F.array().cast("array<long>").alias("keys"), F.array("place").alias("copies"))

    windows = base.groupBy("block").cogroup(twice.unionByName(copies).groupBy("block")).applyInArrow(
        _candidates(anchors_at, window, period, blocks),
        "bucket int, block int, keys array<long>, checks array<int>, docs array<long>, starts array<int>")
    late = windows.groupBy("bucket").applyInArrow(_earlier, ANSWER)
    return base.groupBy("block").cogroup(late.unionByName(copies).groupBy("block")).applyInArrow(finish(window), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (``text``) of every row of ``docs``."""
    return _cleaned(docs, _remove, "doc_id long, n_words long, n_removed long, text string", window, period, block_bytes)


def repeat_digest(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As :func:`remove_repeats`, with ``kept_sha256`` of the kept words in place of the text."""
    return _cleaned(docs, lambda w: _digest(_remove(w)), "doc_id long, n_words long, n_removed long, kept_sha256 string", window, period, block_bytes)
