"""Benchmark decontamination: find documents that hold an item, up to a few edited words.

An item is held by a text if some run of the text's tokens (letters and digits, ASCII letters in lower case) is
within ``share`` of the item's token number in edit distance. Candidates come from CGK embeddings: a random walk over a
window reads one token per step and moves on by a random bit of (step, token), which turns edit distance into
Hamming distance of the tokens read. Bit-sampling LSH keeps a few steps of the walk as a key. A repetition has its own walk and
steps; it starts at every token of the texts and at every token of an item, so every part of an item-sized
window is sampled. Repetitions are added until edited copies of the items of every length, at the largest allowed
distance, are met with at least ``recall``. Lengths that ``MOST_REPETITIONS`` leave below it are also found by pieces,
which miss nothing: of one piece more than the allowed edits, one is unedited. Candidates are confirmed by exact edit distance.

Items under ``SHORTEST`` tokens allow no edit and are looked up whole. The items are the stated query set; they
are taken ``ITEMS_AT_ONCE`` at a time against all texts. Defined results: null and empty texts hold nothing, null and empty
items are held by nothing; null or repeated ids are reported as they are; extra columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.llm.wordhash import Hasher, mix, text_words

SHARE = 0.2
RECALL = 0.99
STEPS, SAMPLED = 20, 7  # of a walk, for items from LONG tokens on
FEW_STEPS, FEW_SAMPLED = 6, 3  # for shorter ones
LONG = 12
SHORTEST = 5
MOST_REPETITIONS = 6
MEASURED = 200  # edited copies of the items of a length
LONGEST_ALONE = 64  # tokens from which lengths are measured together, up to the double
PIECE = 8  # tokens of a piece that are looked up at most
ITEMS_AT_ONCE = 20_000
TABLE = 1 << 20


@dataclass
class Walk:
    """One repetition: the seed of its walk and the steps it keeps."""

    seed: int
    kept: tuple[int, ...]

    @classmethod
    def drawn(cls, seed: int, steps: int, sampled: int) -> Walk:
        rng = np.random.default_rng(seed)
        return cls(seed, tuple(sorted(rng.choice(steps, sampled, replace=False).tolist())))

    def keys(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of the walk from every token, and the last token it read."""
        n = len(tokens)
        padded = np.concatenate([tokens, np.zeros(self.kept[-1] + 1, dtype=np.uint64)])
        bits = mix(padded + np.uint64(self.seed * 0x9E3779B97F4A7C15 % 2**64))
        at = np.arange(n)
        key = np.full(n, self.seed, dtype=np.uint64)
        for step in range(self.kept[-1] + 1):
            if step in self.kept:
                key = key * np.uint64(0xD6E8FEB86659FD93) + padded[at]
            if step < self.kept[-1]:
                at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        return mix(key), at


def distances(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Smallest edit distance of each item (row) to any run of its window (row)."""
    best = np.zeros((len(items), windows.shape[1] + 1), dtype=np.int32)
    along = np.arange(windows.shape[1] + 1, dtype=np.int32)
    for k in range(items.shape[1]):
        change = best[:, :-1] + (windows != items[:, k : k + 1])
        nxt = best + 1
        np.minimum(nxt[:, 1:], change, out=nxt[:, 1:])
        best = np.minimum.accumulate(nxt - along, axis=1) + along
    return best.min(axis=1)


def _table(keys: np.ndarray, items: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key, and a bit table of the keys."""
    order = np.argsort(keys, kind="stable")
    known = np.zeros(TABLE, dtype=bool)
    known[(keys % np.uint64(TABLE)).astype(np.int64)] = True
    return keys[order], items[order], starts[order], known


@dataclass
class Index:
    """Keys of the items for each repetition."""

    items: list[np.ndarray]
    share: float
    walks: list[Walk] = field(default_factory=list)
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    exact: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def allowed(self, n: int) -> int:
        return int(self.share * n + 1e-9) if n >= SHORTEST else 0

    @classmethod
    def build(cls, texts: list[str | None], share: float, recall: float) -> Index:
        hasher = Hasher(tokens=True)
        items: list[np.ndarray] = []
        for _, first, (words,) in text_words(pa.array(texts, pa.string()), hasher):
            items += [words[first[k] : first[k + 1]] for k in range(len(first) - 1)]
        index = cls(items, share)
        for n in range(1, SHORTEST):
            short = np.array([k for k, t in enumerate(items) if len(t) == n], dtype=np.int64)
            if len(short):
                keys = np.array([hasher.windows(items[k], n)[0] for k in short], dtype=np.uint64)
                order = np.argsort(keys, kind="stable")
                index.exact[n] = keys[order], short[order]
        few = [k for k, t in enumerate(items) if SHORTEST <= len(t) < LONG]
        many = [k for k, t in enumerate(items) if len(t) >= LONG]
        for group, steps, sampled, base in ((many, STEPS, SAMPLED, 1), (few, FEW_STEPS, FEW_SAMPLED, 101)):
            lengths = np.array([index._length(k) for k in group], dtype=np.int64)
            edited = index._edited(group, lengths)
            of, met, low = np.array([index._length(k) for k, _ in edited], dtype=np.int64), np.zeros(len(edited), dtype=bool), np.unique(lengths)
            for turn in range(MOST_REPETITIONS if group else 0):
                index._add(Walk.drawn(base + turn, steps, sampled), group)
                met |= [index._met(len(index.walks) - 1, text, item) for item, text in edited]
                low = np.array([n for n in low if met[of == n].mean() < recall], dtype=np.int64)
                if not len(low):
                    break
            index._cut([k for k, n in zip(group, lengths) if n in low], hasher)
        return index

    def _length(self, item: int) -> int:
        """The length whose recall stands for the item's."""
        n = len(self.items[item])
        return n if n < LONGEST_ALONE else 1 << (n.bit_length() - 1)

    def _cut(self, which: list[int], hasher: Hasher) -> None:
        """Look the items up by one piece more than the edits they allow."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k in which:
            n, parts = len(self.items[k]), self.allowed(len(self.items[k])) + 1
            for j in range(parts):
                start, end = j * n // parts, (j + 1) * n // parts
                size = min(end - start, PIECE)
                found.setdefault(size, []).append((int(hasher.windows(self.items[k][start : start + size], size)[0]), k, start))
        for size, rows in found.items():
            old = self.pieces.get(size)
            keys = np.array([r[0] for r in rows], dtype=np.uint64)
            items, starts = (np.array([r[c] for r in rows], dtype=np.int64) for c in (1, 2))
            self.pieces[size] = _table(*((keys, items, starts) if old is None else (np.concatenate(x) for x in zip(old[:3], (keys, items, starts)))))

    def _edited(self, group: list[int], lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Copies of items of every length with as many random edits, at different places, as are allowed."""
        rng = np.random.default_rng(5)
        which = [int(k) for n in np.unique(lengths) for k in np.resize(rng.permutation(np.array(group)[lengths == n]), MEASURED)]
        out = []
        for k in which:
            tokens = list(self.items[k])
            for at in sorted(rng.choice(len(tokens), self.allowed(len(tokens)), replace=False).tolist(), reverse=True):
                kind = int(rng.integers(3))
                fresh = [np.uint64(rng.integers(1 << 62))] if kind < 2 else []
                tokens[at : at + (kind != 1)] = fresh
            out.append((k, np.array(tokens, dtype=np.uint64)))
        return out

    def _met(self, walk: int, text: np.ndarray, item: int) -> bool:
        keys, items, _, _ = self.tables[walk]
        found = self.walks[walk].keys(text)[0]
        low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        return any((items[a:b] == item).any() for a, b in zip(low, high) if b > a)

    def _add(self, walk: Walk, group: list[int]) -> None:
        keys, items, starts = [], [], []
        for k in group:
            found, last = walk.keys(self.items[k])
            inside = np.flatnonzero(last < len(self.items[k]))
            keys.append(found[inside])
            items.append(np.full(len(inside), k))
            starts.append(inside)
        self.walks.append(walk)
        self.tables.append(_table(*(np.concatenate(x) for x in (keys, items, starts))))

    def candidates(self, tokens: np.ndarray, hasher: Hasher) -> np.ndarray:
        """Rows (item, place of the item's first token) that some repetition or piece meets."""
        met = [np.zeros((0, 2), dtype=np.int64)]
        looked = [(lambda walk=walk: walk.keys(tokens)[0], table) for walk, table in zip(self.walks, self.tables)]
        looked += [(lambda size=size: hasher.windows(tokens, size), table) for size, table in self.pieces.items()]
        for read, (keys, items, starts, known) in looked:
            found = read()
            at = np.flatnonzero(known[(found & np.uint64(TABLE - 1)).astype(np.int64)])
            low, high = np.searchsorted(keys, found[at], "left"), np.searchsorted(keys, found[at], "right")
            count = high - low
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            met.append(np.column_stack([items[which], np.repeat(at, count) - starts[which]]))
        return np.unique(np.concatenate(met), axis=0)

    def find(self, texts: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, int]]:
        """(row, item, smallest distance found) of every item held by a text."""
        for rows, first, (tokens,) in text_words(texts, hasher):
            best: dict[tuple[int, int], int] = {}
            for n, (keys, items) in self.exact.items():
                found = hasher.windows(tokens, n)
                low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                for at in np.flatnonzero(high > low):
                    row = int(np.searchsorted(first, at, side="right")) - 1
                    if at + n <= first[row + 1]:
                        best.update({(row, int(item)): 0 for item in items[low[at] : high[at]]})
            self._confirm(first, tokens, self.candidates(tokens, hasher), best)
            for (row, item), distance in sorted(best.items()):
                yield int(rows[row]), item, distance

    def _confirm(self, first: np.ndarray, tokens: np.ndarray, met: np.ndarray, best: dict[tuple[int, int], int]) -> None:
        lengths = np.array([len(t) for t in self.items])
        for n in np.unique(lengths[met[:, 0]]) if len(met) else ():
            mine = met[lengths[met[:, 0]] == n]
            k = self.allowed(int(n))
            # Any part of the window that some candidate points to: up to k tokens more at both ends.
            middle = np.clip(mine[:, 1] + n // 2, 0, len(tokens) - 1)
            row = np.searchsorted(first, middle, side="right") - 1
            for part in range(0, len(mine), 2000):
                here = slice(part, part + 2000)
                at = (mine[here, 1] - 2 * k)[:, None] + np.arange(n + 4 * k)
                inside = (at >= first[row[here]][:, None]) & (at < first[row[here] + 1][:, None])
                windows = np.where(inside, tokens[np.clip(at, 0, len(tokens) - 1)], np.uint64(0))
                found = distances(np.array([self.items[i] for i in mine[here, 0]]), windows)
                for r, item, d in zip(row[here], mine[here, 0], found):
                    if d <= k:
                        pair = (int(r), int(item))
                        best[pair] = min(best.get(pair, int(d)), int(d))


def _indexes(items: DataFrame, share: float, recall: float) -> Iterator[tuple[list[int | None], Index]]:
    """The stated items, ``ITEMS_AT_ONCE`` at a time."""
    ids: list[int | None] = []
    texts: list[str | None] = []
    for row in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        if len(ids) == ITEMS_AT_ONCE:
            yield ids, Index.build(texts, share, recall)
            ids, texts = [], []
    yield ids, Index.build(texts, share, recall)


def held_items(docs: DataFrame, items: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, distance, allowed: every item that a document holds."""
    schema = "doc_id long, item_id long, distance int, allowed int"
    out = None
    for ids, index in _indexes(items, share, recall):

        def search(batches: Iterator[pa.RecordBatch], ids=ids, index=index) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(tokens=True)
            for batch in batches:
                found = list(index.find(batch.column("text"), hasher))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
                    "item_id": pa.array([ids[f[1]] for f in found], pa.int64()),
                    "distance": pa.array([f[2] for f in found], pa.int32()),
                    "allowed": pa.array([index.allowed(len(index.items[f[1]])) for f in found], pa.int32())})

        part = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def holds_item(text: Column, items: DataFrame, share: float = SHARE, recall: float = RECALL) -> Column:
    """Does a text hold any item? For filters that keep all columns and rows of their input."""
    out = F.lit(False)
    for _, index in _indexes(items, share, recall):
        out = out | _holds(index)(text)
    return out


def _holds(index: Index):
    @F.arrow_udf("boolean")
    def held(texts: pa.Array) -> pa.Array:
        flags = np.zeros(len(texts), dtype=bool)
        flags[[row for row, _, _ in index.find(texts, Hasher(tokens=True))]] = True
        return pa.array(flags)

    return held
