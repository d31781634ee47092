"""Word hashes of whole texts, computed on Arrow buffers with numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Texts are taken as UTF-8 bytes, so nothing is decoded
and no Python object is made per word. Hashes are 64 bit; operators that compare texts across the
whole corpus confirm by a second, independent hash (``seed``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 17  # bytes of text worked on at once; longer texts are cut at separators
U64 = np.uint64

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_NO_TOKEN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _odd(seed: int) -> int:
    return (int(mix(np.array([seed * 2 + 1], dtype=U64))[0]) * 2 + 1) & (2**64 - 1)


class Hasher:
    """Hashes words and word windows; one object per task keeps its power tables.

    With ``lower`` ASCII letters count as lower case; with ``tokens`` it also takes runs of letters and
    digits in place of words.
    """

    def __init__(self, seed: int = 1, tokens: bool = False, lower: bool = False):
        self.separator = _NO_TOKEN if tokens else _SEPARATOR
        self.base = _odd(seed)
        self.inverse = pow(self.base, -1, 2**64)
        self.step = U64(_odd(seed + 1000))
        self.letters = mix(np.arange(1, 257, dtype=U64) + U64(seed << 32))
        if tokens or lower:
            self.letters[65:91] = self.letters[97:123]
        self.up = self.down = np.ones(1, dtype=U64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                table = np.full(n + 1, base, dtype=U64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        """Running sums from which :meth:`spans` hashes any span of the bytes ``raw``."""
        self._powers(len(raw))
        total = np.empty(len(raw) + 1, dtype=U64)
        total[0] = 0
        np.take(self.letters, raw, out=total[1:])
        total[1:] *= self.up[: len(raw)]
        np.cumsum(total[1:], out=total[1:])
        return total

    def spans(self, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(U64))

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every word in the bytes ``raw``."""
        start, end = word_spans(raw, self.separator)
        return start, end, self.spans(self.prefix(raw), start, end)

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hash of every run of ``size`` word hashes, by doubling."""
        if len(words) < size:
            return np.zeros(0, dtype=U64)
        done, length = words, 1
        out, taken = None, 0
        step = self.step
        while length <= size:
            if size & length:
                n = len(words) - taken - length + 1
                if out is None:
                    out = done[:n].copy()
                else:
                    out = out[:n] * _pow(step, length) + done[taken : taken + n]
                taken += length
            if length * 2 <= size:
                done = done[:-length] * _pow(step, length) + done[length:]
            length *= 2
        return mix(out[: len(words) - size + 1])


def _pow(step: np.uint64, n: int) -> np.uint64:
    return U64(pow(int(step), n, 2**64))


def word_spans(raw: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes ``raw``."""
    gap = np.empty(len(raw) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    np.take(separator, raw, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def pieces(raw: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """Cut bytes into pieces of about ``size`` that never split a word, with their offsets."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw):
            gaps = np.flatnonzero(_SEPARATOR[raw[end : end + size]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += size
        end = min(end, len(raw))
        yield at, raw[at:end]
        at = end


def text_words(texts: pa.Array, *hashers: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For groups of consecutive texts: row of each text, first word of each text (one more at the
    end), and one array of word hashes per hasher. Null counts as an empty text."""
    for rows, bounds, raw in blocks(texts):
        if len(rows) > 1 or bounds[-1] <= PIECE:
            found = [h.words(raw) for h in hashers]
            first = np.searchsorted(found[0][0], bounds)
            yield rows, first, [f[2] for f in found]
        else:
            parts = [[h.words(p)[2] for h in hashers] for _, p in pieces(raw)]
            joined = [np.concatenate(x) for x in zip(*parts)]
            yield rows, np.array([0, len(joined[0])]), joined


def blocks(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Consecutive rows, the bounds of their bytes and the bytes, about ``size`` bytes at a time.

    One newline is put after each text, so that words of neighbours never join. A text longer than
    ``size`` comes alone.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    length = np.diff(offsets)
    if texts.null_count:
        length = np.where(texts.is_valid().to_numpy(zero_copy_only=False), length, 0)
    at = 0
    while at < n:
        upto = at + 1
        total = int(length[at])
        while upto < n and total + length[upto] + 1 <= size:
            total += int(length[upto]) + 1
            upto += 1
        rows = np.arange(at, upto)
        if len(rows) == 1:
            yield rows, np.array([0, length[at]]), data[offsets[at] : offsets[at] + length[at]]
        else:
            bounds = np.concatenate([[0], np.cumsum(length[rows] + 1)])
            raw = np.full(int(bounds[-1]), 10, dtype=np.uint8)
            for k, r in enumerate(rows):
                raw[bounds[k] : bounds[k] + length[r]] = data[offsets[r] : offsets[r] + length[r]]
            yield rows, bounds, raw
        at = upto
