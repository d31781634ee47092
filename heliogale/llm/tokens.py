"""Token counts, with huge texts encoded in overlapping chunks that are spliced where both agree.

A text of up to ``chunk`` characters is encoded as it is. A longer one is encoded from left to right: with the
exact encoding of its first ``e`` characters at hand, the next chunk starts some way before ``e``. Where both
encodings hold one token (same id, same characters) at a *stable* place, the left one is right up to it and the
chunk is right after it, so both together are the exact encoding of the text up to the chunk's end. If no such
token lies in the overlap, the overlap is doubled, if need be back to the start of the text.

Why a stable place is proven for a BPE whose words end in a suffix:

* A chunk begins and ends at a character that composes with nothing before it and not inside a special string, so
  normal forms and special tokens do not differ.
* If the token ends a word, both scans stand at a word's end; words after it do not depend on what came before.
  The three characters after it were known to the left encoding, and no rule looks further ahead.
* If it lies within a word, it and the three characters before it are of one class (letters, or neither letters,
  digits nor spaces), so both words go on to the same end. In BPE a sequence of tokens is the encoding of a word
  if each pair of neighbours is the encoding of its own symbols: the first merge across a border would take
  place in the pair alone as well. All pairs up to the token hold on the left, all after it in the chunk.

Tokenizers of another kind are used on whole texts. Nothing is trained, and the file is a parameter.

Defined results: a null text counts as empty and has no tokens; special strings inside a text count as the
library takes them; ids may be null or repeated; an empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16_384  # characters
OVERLAP = 256
LIMIT = 2048  # tokens
BATCH = 1 << 14  # characters of short texts that are encoded in one call; what they make should stay in the cache
AHEAD = 3  # characters that a rule of the word pattern looks at before it knows what it matches
# A normalizer's step that joins spaces, and the word pattern whose words the proof above is about.
SPACES = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def composes_with_none_before(char: str) -> bool:
    """False for marks and for Hangul vowels and finals, which may join the character before them."""
    return char < "̀" or not (unicodedata.category(char)[0] == "M" or "ᅠ" <= char <= "ᇿ")


def cut(text: str, at: int, low: int, special: tuple[str, ...] = ()) -> int:
    """The last place up to ``at``, but after ``low``, where a chunk may begin or end; else the first one after.

    No chunk begins or ends inside one of the ``special`` strings."""

    def allowed(k: int) -> bool:
        return k == len(text) or composes_with_none_before(text[k]) and all(
            text.find(s, max(0, k - len(s) + 1), k + len(s) - 1) < 0 for s in special)

    return next((k for way in (range(min(at, len(text)), low, -1), range(at + 1, len(text))) for k in way if allowed(k)), len(text))


def _one_class(some: str) -> bool:
    """All letters, or all neither letters, digits nor spaces, in lower case."""
    kinds = {"L" if (c := unicodedata.category(x)[0]) == "L" else "" if c == "N" or x.isspace() else "other"
             for y in some for x in y.lower()}
    return len(kinds) == 1 and "" not in kinds


class Encoded:
    """Tokens with the places of their characters."""

    def __init__(self, ids: list[int] = (), offsets: list[tuple[int, int]] = (), at: int = 0):
        self.ids = array("I", ids)
        self.start = array("Q", [at + s for s, _ in offsets])
        self.end = array("Q", [at + e for _, e in offsets])

    def apart(self, k: int) -> bool:
        """Does token ``k`` share no character with its neighbours?"""
        return (k == 0 or self.end[k - 1] <= self.start[k]) and (k + 1 == len(self.ids) or self.end[k] <= self.start[k + 1])

    def splice(self, mine: int, other: Encoded, theirs: int) -> None:
        """Keep the tokens through ``mine`` and go on with those of ``other`` after ``theirs``."""
        for name in ("ids", "start", "end"):
            held = getattr(self, name)
            del held[mine + 1 :]
            held.extend(getattr(other, name)[theirs + 1 :])


class Encoder:
    """Exact token ids of texts of any length, after the tokenizer file at ``path``."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, suffix = said["model"], said["model"].get("end_of_word_suffix")
        patterns = [p["pattern"].get("Regex") for p in (said.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        proven = model["type"] == "BPE" and suffix and not model.get("dropout") and not model.get("continuing_subword_prefix")
        self.chunk = chunk if proven and patterns == [WORDS] else None
        if self.chunk is not None and (said.get("normalizer") or {}).get("type") == "Sequence":
            # Spaces belong to no word, so a step that only replaces them changes no token.
            steps = said["normalizer"]["normalizers"]
            said["normalizer"]["normalizers"] = [s for s in steps if s != SPACES]
        self.tokenizer = Tokenizer.from_str(json.dumps(said))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.overlap = overlap
        self.special = tuple(token["content"] for token in said.get("added_tokens", []))
        self.word_end = {i for token, i in model["vocab"].items() if token.endswith(suffix)} if proven else set()
        self.widened = 0

    def encode(self, text: str, at: int = 0, end: int | None = None) -> Encoded:
        found = self.tokenizer.encode(text[at:end], add_special_tokens=False)
        return Encoded(found.ids, found.offsets, at)

    def _common(self, text: str, left: Encoded, end: int, right: Encoded, start: int) -> tuple[int, int] | None:
        """A token of both at a stable place, as its number in each."""
        first = bisect_left(left.start, start)
        places = {(left.start[k], left.end[k], left.ids[k]): k for k in range(first, len(left.ids))}
        for theirs in range(len(right.ids)):
            s, e = right.start[theirs], right.end[theirs]
            if e + AHEAD > end:
                return None
            mine = places.get((s, e, right.ids[theirs]))
            if mine is None or not (left.apart(mine) and right.apart(theirs)):
                continue
            if right.ids[theirs] in self.word_end or (s - AHEAD >= start and _one_class(text[s - AHEAD : e])):
                return mine, theirs
        return None

    def whole(self, text: str) -> Encoded:
        """The encoding of all of ``text``, from chunks."""
        if self.chunk is None or len(text) <= self.chunk:
            return self.encode(text)
        end = cut(text, self.chunk, 0, self.special)
        done = self.encode(text, 0, end)
        while end < len(text):
            upto, overlap = cut(text, end + self.chunk, end, self.special), self.overlap
            while True:
                start = cut(text, end - overlap, 0, self.special) if end > overlap else 0
                right = self.encode(text, start, upto)
                if start == 0 or start >= end:
                    done = right if start == 0 else self.encode(text, 0, upto)
                    break
                common = self._common(text, done, end, right, start)
                if common:
                    done.splice(common[0], right, common[1])
                    break
                overlap *= 2
                self.widened += 1
            end = upto
        return done

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text; short texts go to the library together."""
        out = [0] * len(texts)
        some: list[int] = []
        length = 0

        def flush() -> None:
            nonlocal length
            for k, found in zip(some, self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)):
                out[k] = len(found)
            some.clear()
            length = 0

        for k, text in enumerate(texts):
            if not text:
                continue
            if self.chunk is not None and len(text) > self.chunk:
                out[k] = len(self.whole(text).ids)
                continue
            some.append(k)
            length += len(text)
            if length >= BATCH:
                flush()
        if some:
            flush()
        return out


@lru_cache(maxsize=2)
def encoder(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path, chunk, overlap)


def _mapped(column: str, kind: pa.DataType, make: Callable[[Encoder, list], list], path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.array(make(encoder(path, chunk, overlap), part.column("text").to_pylist()), kind)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names if c != "text"} | {column: made})

    return run


def token_ids(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids of every row of ``docs``."""
    ids = lambda own, texts: [list(own.whole(t or "").ids) for t in texts]
    run = _mapped("ids", pa.list_(pa.int32()), ids, path, chunk, overlap)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    run = _mapped("n_tokens", pa.int64(), lambda own, texts: own.counts(texts), path, chunk, overlap)
    counted = docs.select("doc_id", size.alias("n_bytes"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
