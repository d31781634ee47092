"""Line-first cleaning: judge every line, drop the failing ones, then reject texts that lost too much.

A line with a word fails when it is
* navigation: over ``NAV_SHARE`` of its words are separators standing alone,
* badly punctuated: over ``MARKS_PER_WORD`` punctuation bytes per word, or at most ``SHORT_LINE`` words
  and no closing mark of any script (``CLOSING``) at its end,
* boilerplate: it holds one of ``BOILERPLATE``, whatever the case.

Texts also have base counts (words, symbols, repeated lines and windows) and a base verdict. A text is
kept if the base verdict is good and at most ``MAX_LOSS`` of its words stood in failing lines.

Everything is counted on whole texts in numpy, some hundred kB of text at a time; one longer text is held
alone at about 40 bytes per byte. Defined results: a null or empty text has no words and is not kept;
ids may be null or repeated; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heliogale.llm.wordhash import Hasher, blocks, mix, word_spans

NAV_SHARE = 0.3
MARKS_PER_WORD = 1.0
SHORT_LINE = 8
MAX_LOSS = 0.5
# Phrases of page furniture and licence lines.
BOILERPLATE = (
    b"cookie", b"privacy policy", b"terms of use", b"terms of service", b"all rights reserved", b"javascript",
    b"lorem ipsum", b"subscribe to", b"sign in to", b"log in to", b"click here", b"licensed under", b"released under the",
)
# Marks that end a sentence, a quotation or a bracket, by script.
CLOSING = (
    ".!?:;\"')]}"  # ASCII
    "…»«›”“’‘"  # European quotations and the ellipsis
    "。！？：；」』）】》〉．｡｣"  # Chinese and Japanese
    "؟؛۔"  # Arabic and Urdu
    "।॥"  # Indic
    "·։՞״׃"  # Greek, Armenian, Hebrew
    "።፧፨៖។៕၊။"  # Ethiopic, Khmer, Burmese
)
WINDOW = 8
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lost_words long, n_lost_lines long"
)


def _table(marks: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(marks)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_ALONE = _table(b"|>/~\xc2\xbb\xb7")  # separators, with the UTF-8 bytes of two common ones
_CLOSING = np.array(sorted(map(ord, CLOSING)))
_MARK = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_SPACE = _table(b" \t\n\x0b\x0c\r")


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _repeated(keys: np.ndarray) -> np.ndarray:
    """For each key: does it occur twice or more?"""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def _code_points(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The characters whose last bytes stand at ``last``."""
    point, at, open_ = np.zeros(len(last), dtype=np.int64), last.copy(), np.ones(len(last), dtype=bool)
    for step in range(4):
        byte = raw[at].astype(np.int64)
        inner = (byte & 0xC0) == 0x80
        lead = np.select([byte < 0x80, byte < 0xE0, byte < 0xF0], [byte, byte & 0x1F, byte & 0x0F], byte & 0x07)
        point += np.where(open_, np.where(inner, byte & 0x3F, lead) << (6 * step), 0)
        open_ &= inner
        at = np.maximum(at - open_, 0)
    return point


class Lines:
    """Lines, words and verdicts of a block of texts."""

    def __init__(self, hasher: Hasher, bounds: np.ndarray, raw: np.ndarray):
        texts = len(bounds) - 1
        total = hasher.prefix(raw)
        start, end = word_spans(raw)
        first_word = np.searchsorted(start, bounds)
        text_of_word = np.repeat(np.arange(texts), np.diff(first_word))
        self.n_words = np.diff(first_word)

        in_word = _running(~_SPACE[raw] & ((raw & 0xC0) != 0x80))
        self.word_chars = np.diff(in_word[bounds])
        self.n_symbols = np.diff(_running(_SYMBOL[raw])[bounds])

        # Lines: cut at newlines and at the ends of texts.
        breaks = np.flatnonzero(raw == 10)
        line_start = np.union1d(breaks + 1, bounds[:-1])
        line_start = line_start[line_start < len(raw)]
        line_end = np.append(line_start[1:], len(raw))
        line_end = line_end - ((line_end > line_start) & (raw[np.maximum(line_end - 1, 0)] == 10))
        self.text_of_line = np.searchsorted(bounds, line_start, side="right") - 1
        first = np.searchsorted(start, line_start)
        self.line_words = np.searchsorted(start, line_end) - first
        wordy = self.line_words > 0
        line_key = hasher.spans(total, line_start, line_end) + mix(self.text_of_line.astype(np.uint64) + np.uint64(1))
        distinct = np.unique(line_key[wordy], return_index=True)[1]
        in_text = np.bincount(self.text_of_line[wordy], minlength=texts)
        self.n_dup_lines = in_text - np.bincount(self.text_of_line[wordy][distinct], minlength=texts)

        words = hasher.spans(total, start, end)
        windows = hasher.windows(words, WINDOW)
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        at = np.flatnonzero(text_of_word[: len(windows)] == text_of_word[WINDOW - 1 :]) if len(windows) else np.zeros(0, dtype=int)
        twice = at[_repeated(windows[at] + mix(text_of_word[at].astype(np.uint64) + np.uint64(1)))]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
        repeats = _running(np.cumsum(covered[:-1]) > 0)
        self.n_repeat_words = np.diff(repeats[first_word])

        alone = _running(_ALONE[raw[start]] & _ALONE[raw[end - 1]] & (end - start <= 2))
        separators = alone[first + self.line_words] - alone[first]
        marks = _running(_MARK[raw])
        n_marks = marks[line_end] - marks[line_start]
        last = np.zeros(len(first), dtype=np.int64)
        last[wordy] = end[first[wordy] + self.line_words[wordy] - 1] - 1
        unclosed = wordy & (self.line_words <= SHORT_LINE)
        unclosed[unclosed] = ~np.isin(_code_points(raw, last[unclosed]), _CLOSING)
        boiler = np.zeros(len(first), dtype=bool)
        low = raw.tobytes().lower()
        for phrase in BOILERPLATE:
            at = low.find(phrase)
            while at >= 0:
                boiler[np.searchsorted(line_start, at, side="right") - 1] = True
                at = low.find(phrase, at + 1)
        self.failed = wordy & (
            (separators > NAV_SHARE * self.line_words) | (n_marks > MARKS_PER_WORD * self.line_words) | unclosed | boiler)
        self.line_start, self.line_end = line_start, line_end
        self.n_lost_words = np.bincount(self.text_of_line, self.failed * self.line_words, texts).astype(np.int64)
        self.n_lost_lines = np.bincount(self.text_of_line, self.failed, texts).astype(np.int64)
        self.base_failed = (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)
        self.kept = ~self.base_failed & (self.n_lost_words <= MAX_LOSS * self.n_words)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        found: dict[str, list] = {}
        for _, bounds, raw in blocks(batch.column("text")):
            lines = Lines(hasher, bounds, raw)
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "n_lost_words", "n_lost_lines"):
                found.setdefault(name, []).append(getattr(lines, name))
        if found:
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")} | {k: pa.array(np.concatenate(v)) for k, v in found.items()})


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        texts: list[str] = []
        kept: list[bool] = []
        for _, bounds, raw in blocks(batch.column("text")):
            lines = Lines(hasher, bounds, raw)
            parts: list[list[bytes]] = [[] for _ in range(len(bounds) - 1)]
            for k in np.flatnonzero(~lines.failed):
                parts[lines.text_of_line[k]].append(raw[lines.line_start[k] : lines.line_end[k]].tobytes())
            texts += [b"\n".join(p).decode() for p in parts]
            kept += lines.kept.tolist()
        if texts:
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "kept": pa.array(kept)})


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(_judge, SCHEMA)


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows with the text of their passing lines: doc_id, text."""
    cleaned = docs.select("doc_id", "text").mapInArrow(_clean, "doc_id long, text string, kept boolean")
    return cleaned.filter("kept").drop("kept")
