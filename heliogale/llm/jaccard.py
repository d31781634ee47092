"""Exact Jaccard join of word-shingle sets: which documents are linked, and in which component they are.

Jaccard distance is a metric, but nearly all texts are at distance 1 from each other, where the triangle
inequality separates nothing: with documents as the only pivots every text would be copied to every
region. So the far space is first cut by single-shingle pivots:

1. A set of size n can only be within ``1 - t`` of sets that share one of its first ``n - ceil(t n) + 1``
   shingles, in any order common to all. Each such shingle is a pivot, its region the texts near it in that
   sense; a boundary text is replicated to all of its regions. Shingles that very many texts hold come last
   in the order, so a passage that many documents share makes no region, unless a text is made of little else.
2. Regions of at most ``SMALL`` sets are joined directly.
3. Larger regions (thousands of near copies) get documents as pivots. Sets within ``1 - t`` of a pivot are
   linked to it. Whatever is left apart joins recursively: new pivots are taken from the parts not yet
   connected (32 times as many each turn) and meet the region's sets of other parts that the triangle
   inequality lets near them, until every region is connected or all its sets have been pivots. Sets known to be connected need no test.
   Every set also has a sketch of ``SKETCH`` bits, the parities of its shingles. Sketches differ in at most as many bits as
   the sets in shingles, so this map into Hamming space contracts the distance: pairs it keeps apart are apart.

Equal sets are one class, compared once. Candidate pairs are verified on whole sets; to do so a text is
sent at most once to a block of texts, whatever the number of its partners there. Sets hold 64-bit hashes.

Defined results: a null or empty text has an empty set and is alone; repeated rows are equal sets (an id names one
text); a null id counts as the smallest, so its component has a null id; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.llm.blocks import BLOCK_BYTES, block_count, block_of, blocked, by_bucket
from heliogale.llm.store import stored
from heliogale.llm.wordhash import Hasher, mix, text_words

SHINGLE = 5
PERCENT = 80
SMALL = 32  # sets of a region that are compared pair by pair
COMMON = 32  # texts above which a shingle comes last in the order
MOST_COMMON = 1 << 18  # shingles that come last at most, as all tasks know them; others keep their place
PIVOTS = 4  # pivots that a large region takes at once
BOUNDS = ("size", "last", "cap", "loose")  # of a set in a region: what its links are bounded by
SKETCH = 512  # bits of a set's sketch: for each, whether an odd number of its shingles falls there
FIRST_SHARED = 32  # regions of a set in which is looked for the first one that a pair shares
NO_ID = -(1 << 62)  # ids below stand for null ids, one for each text


class Sets:
    """Distinct shingle hashes of texts, sorted inside each text."""

    def __init__(self, texts: pa.Array, shingle: int):
        hasher = Hasher(1, lower=True)
        values, sizes = [], []
        for _, first, (words,) in text_words(texts, hasher):
            count = np.diff(first)
            text_of = np.repeat(np.arange(len(count)), count)
            found = hasher.windows(words, shingle)
            at = np.flatnonzero(text_of[: len(found)] == text_of[shingle - 1 :]) if len(found) else np.zeros(0, dtype=np.int64)
            hashes, owner = [found[at]], [text_of[at]]
            for short in np.flatnonzero((count > 0) & (count < shingle)):
                whole = hasher.windows(words[first[short] : first[short + 1]], int(count[short]))
                hashes.append(mix(whole + np.uint64(count[short])))
                owner.append(np.array([short]))
            hashes, owner = np.concatenate(hashes), np.concatenate(owner)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            values.append(hashes[new])
            sizes.append(np.bincount(owner[new], minlength=len(count)))
        self.values = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.text_of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def of(self, k: int) -> np.ndarray:
        return self.values[self.first[k] : self.first[k + 1]]

    def heads(self, percent: int, last: np.ndarray | None = None) -> np.ndarray:
        """Places of each text's leading shingles: by hash, those marked ``last`` after all others."""
        length = self.sizes - (percent * self.sizes + 99) // 100 + 1
        order = np.arange(len(self.values)) if last is None else np.lexsort((self.values, last, self.text_of))
        rank = np.arange(len(self.values)) - self.first[self.text_of]
        return order[rank < length[self.text_of]]


    def sketches(self, rows: np.ndarray) -> pa.Array:
        """Sketch of each text in ``rows``. Two sketches differ in at most as many bits as the sets in shingles."""
        wanted = np.zeros(len(self.sizes), dtype=bool)
        wanted[rows] = True
        of = wanted[self.text_of]
        place = (np.cumsum(wanted) - 1)[self.text_of[of]] * SKETCH + (mix(self.values[of]) % np.uint64(SKETCH)).astype(np.int64)
        odd = (np.bincount(place, minlength=len(rows) * SKETCH) & 1).astype(bool).reshape(len(rows), SKETCH)
        words = np.packbits(odd, axis=1).view(np.int64)
        return pa.FixedSizeListArray.from_arrays(pa.array(words.ravel()), SKETCH // 64).cast(pa.list_(pa.int64()))


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _ids(table: pa.Table) -> np.ndarray:
    return _column(table, "doc_id").to_numpy().astype(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def _lists(values: np.ndarray, bound: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([values[bound[k] : bound[k + 1]] for k in rows], pa.list_(kind))


FIRST = "bucket int, block int, keys array<long>, times array<int>, docs array<long>, sizes array<long>, low array<long>, high array<long>"


def _first(shingle: int, percent: int, buckets: int):
    """Of a block: its leading shingles by bucket, and (bucket -1) size and fingerprint of each text's set."""

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, sets = _ids(table), Sets(_column(table, "text"), shingle)
        keys, times = np.unique(sets.values[sets.heads(percent)], return_counts=True)
        order, bound = by_bucket(keys, buckets)
        used = np.flatnonzero(np.diff(bound))
        n = len(used)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(v)]) for v in (sets.values, mix(sets.values + np.uint64(0x9E3779B97F4A7C15)))]
        low, high = ((s[sets.first[1:]] - s[sets.first[:-1]]).view(np.int64) for s in sums)
        none = [None] * n
        lists = pa.list_(pa.int64())
        return pa.table({
            "bucket": pa.array(np.append(used, -1), pa.int32()), "block": pa.array(np.full(n + 1, key[0].as_py()), pa.int32()),
            "keys": pa.concat_arrays([_lists(keys[order].view(np.int64), bound, used, pa.int64()), pa.array([None], lists)]),
            "times": pa.concat_arrays([_lists(times[order].astype(np.int32), bound, used, pa.int32()), pa.array([None], pa.list_(pa.int32()))]),
            "docs": pa.array([*none, ids], lists), "sizes": pa.array([*none, sets.sizes], lists),
            "low": pa.array([*none, low], lists), "high": pa.array([*none, high], lists),
        })

    return send


def _common(common: int):
    """Of a bucket: its shingles that lead more than ``common`` texts, and how many they lead."""

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, which = np.unique(_flat(_column(table, "keys"))[0], return_inverse=True)
        total = np.bincount(which, _flat(_column(table, "times"))[0], len(found)).astype(np.int64)
        return pa.table({"key": pa.array(found[total > common], pa.int64()), "n": pa.array(total[total > common])})

    return count


def _later(shingle: int, percent: int, buckets: int, common: np.ndarray):
    """Of a block: by bucket, the shingles that lead a text only because ``common`` ones come last."""

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = Sets(_column(table, "text"), shingle)
        new = np.setdiff1d(sets.heads(percent, _among(sets.values, common)), sets.heads(percent))
        keys, times = np.unique(sets.values[new], return_counts=True)
        order, bound = by_bucket(keys, buckets)
        used = np.flatnonzero(np.diff(bound))
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), key[0].as_py()), pa.int32()),
            "keys": _lists(keys[order].view(np.int64), bound, used, pa.int64()),
            "times": _lists(times[order].astype(np.int32), bound, used, pa.int32())})

    return send


TOLD = "block int, shared array<long>, copies array<long>"


def _counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of a bucket: per block, its shingles that lead two texts or more in all, in one order or the other."""
    keys, row = _flat(_column(table, "keys"))
    found, which = np.unique(keys, return_inverse=True)
    hit = np.bincount(which, _flat(_column(table, "times"))[0], len(found))[which] > 1
    rows = np.arange(table.num_rows)
    shared = _lists(keys[hit], np.searchsorted(row[hit], np.arange(len(rows) + 1)), rows, pa.int64())
    return pa.table({"block": _column(table, "block"), "shared": shared, "copies": pa.array([[]] * len(rows), pa.list_(pa.int64()))})


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _regions(shingle: int, percent: int, common: np.ndarray):
    """Of a block: per class representative, the shingles whose regions it enters."""

    def send(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        ids, sets = _ids(table), Sets(_column(table, "text"), shingle)
        shared, copies = (_flat(_column(told, c))[0].astype(np.int64) for c in ("shared", "copies"))
        shared = np.sort(shared.view(np.uint64))
        heads = sets.heads(percent, _among(sets.values, common))
        value, owner = sets.values[heads], sets.text_of[heads]
        rank = (np.arange(len(owner)) - np.searchsorted(owner, owner)).astype(np.int32)
        # Places in the common order, as signed numbers.
        place = ((value >> np.uint64(1)) ^ np.where(_among(value, common), np.uint64(0), np.uint64(1 << 63))).view(np.int64)
        last = np.zeros(len(ids), dtype=np.int64)
        last[owner] = place  # the last head of each text stays
        useful = _among(value, shared)  # any other leads this text alone, and a region needs two
        first_row = np.zeros(len(ids), dtype=bool)
        first_row[np.unique(ids, return_index=True)[1]] = True
        useful &= (~np.isin(ids, copies) & first_row)[owner]
        value, owner, rank = value[useful], owner[useful], rank[useful]
        order = np.argsort(owner, kind="stable")
        bound = np.searchsorted(owner[order], np.arange(len(ids) + 1))
        used = np.flatnonzero(np.diff(bound))
        return pa.table({
            "doc": pa.array(ids[used], pa.int64()), "size": pa.array(sets.sizes[used], pa.int64()), "last": pa.array(last[used], pa.int64()),
            "sketch": sets.sketches(used), "keys": _lists(value[order].view(np.int64), bound, used, pa.int64()), "ranks": _lists(rank[order], bound, used, pa.int32())})

    return send


def _sent(key: tuple[pa.Scalar, ...], table: pa.Table, wanted: pa.Table) -> pa.Table:
    """Of a block: the texts that other blocks ask for."""
    ids = _ids(table)
    where = {int(d): k for k, d in reversed(list(enumerate(ids)))}
    docs, to = _flat(_column(wanted, "docs"))[0], _flat(_column(wanted, "to"))[0]
    rows = np.array([where[int(d)] for d in docs], dtype=np.int64)
    return pa.table({"block": pa.array(to.astype(np.int32), pa.int32()), "doc": pa.array(docs.astype(np.int64), pa.int64()),
                     "text": _column(table, "text").take(pa.array(rows))})


def _verified(shingle: int, percent: int):
    """Of a block: sizes of intersection and union of its pairs that reach ``percent``, one text of which lies in the block."""

    def verify(key: tuple[pa.Scalar, ...], table: pa.Table, asked: pa.Table) -> pa.Table:
        here = {int(d): k for k, d in reversed(list(enumerate(_ids(table))))}
        pairs = asked.filter(pa.compute.is_valid(asked.column("b")))
        texts = asked.filter(pa.compute.is_null(asked.column("b")))
        there = {int(d): k for k, d in enumerate(_column(texts, "a").to_numpy())}
        a, b = _column(pairs, "a").to_numpy(), _column(pairs, "b").to_numpy()
        rows = np.array(sorted({here[int(x)] for x in a}), dtype=np.int64)
        place = {int(r): k for k, r in enumerate(rows)}
        own = Sets(_column(table, "text").take(pa.array(rows)), shingle)
        other = Sets(_column(texts, "text"), shingle)
        both = np.array([
            len(np.intersect1d(own.of(place[here[int(x)]]), other.of(there[int(y)]), assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
        size = np.array([own.sizes[place[here[int(x)]]] + other.sizes[there[int(y)]] for x, y in zip(a, b)], dtype=np.int64)
        found = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "both": pa.array(both), "either": pa.array(size - both)})
        return found.filter(pa.array(both * 100 >= (size - both) * percent))

    return verify


def _named(docs: DataFrame) -> Column:
    """The id of a row; of a null id, one of its text."""
    return F.coalesce(docs["doc_id"], F.lit(2 * NO_ID) + F.pmod(F.xxhash64(docs["text"]), F.lit(-NO_ID)))


class Join:
    """One join; the steps share the shuffle of the texts and the parameters."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int, small: int, common: int, pivots: int, block_bytes: int):
        self.docs = docs.select(_named(docs).alias("doc_id"), "text")
        self.shingle, self.percent, self.small, self.common, self.pivots = shingle, percent, small, common, pivots
        self.blocks = block_count(self.docs, block_bytes)
        self.base = blocked(self.docs, self.blocks)

    def verify(self, pairs: DataFrame, percent: int) -> DataFrame:
        """a, b, both, either of the distinct pairs a, b that reach ``percent``."""
        pairs = pairs.select("a", "b", block_of(F.col("a"), self.blocks).alias("to"), block_of(F.col("b"), self.blocks).alias("block"))
        wanted = pairs.select("block", "b", "to").distinct().groupBy("block").agg(
            F.collect_list("b").alias("docs"), F.collect_list("to").alias("to"))
        sent = self.base.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_sent, "block int, doc long, text string")
        asked = pairs.select(F.col("to").alias("block"), "a", "b", F.lit(None).cast("string").alias("text")).unionByName(
            sent.select("block", F.col("doc").alias("a"), F.lit(None).cast("long").alias("b"), "text"))
        return self.base.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
            _verified(self.shingle, percent), "a long, b long, both long, either long")

    def near(self, pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.col("both") * 100 >= F.col("either") * self.percent)

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Members (doc, size, rep) of all classes, and the component (id, component) of linked representatives."""
        first = stored(self.base.groupBy("block").applyInArrow(_first(self.shingle, self.percent, self.blocks), FIRST))
        zipped = F.explode(F.arrays_zip("docs", "sizes", "low", "high")).alias("z")
        sets = first.filter("bucket = -1").select(zipped).select(
            F.col("z.docs").alias("doc"), F.col("z.sizes").alias("size"), F.col("z.low").alias("low"), F.col("z.high").alias("high"))
        same = ["size", "low", "high"]
        reps = sets.filter("size > 0").groupBy(*same).agg(F.min("doc").alias("rep"))
        members = stored(sets.join(reps, same, "left").select("doc", "size", F.coalesce("rep", "doc").alias("rep")))

        heads = first.filter("bucket >= 0").select("bucket", "block", "keys", "times")
        common = self._common(heads)
        if len(common):
            heads = heads.unionByName(self.base.groupBy("block").applyInArrow(
                _later(self.shingle, self.percent, self.blocks, common), heads.schema))
        told = heads.groupBy("bucket").applyInArrow(_counted, TOLD)
        empty = F.array().cast("array<long>")
        copies = members.filter("doc <> rep").select(
            block_of(F.col("doc"), self.blocks).alias("block"), empty.alias("shared"), F.array("doc").alias("copies"))
        regions = stored(self.base.groupBy("block").cogroup(told.unionByName(copies).groupBy("block")).applyInArrow(
            _regions(self.shingle, self.percent, common), "doc long, size long, last long, sketch array<long>, keys array<long>, ranks array<int>"))

        rows = regions.select("doc", "size", "last", F.explode(F.arrays_zip("keys", "ranks")).alias("z")).select(
            "doc", "size", "last", F.col("z.keys").alias("key"), F.col("z.ranks").alias("rank"))
        held = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        met = rows.join(held, "key").groupBy("doc", "size", "last").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "n"))).alias("met"))
        # A pair need only be met in the region of its first shared shingle, where both share nothing that comes before:
        # ``loose`` is what is left of a set from there on. Of two sets, the one whose last head comes first shares
        # only heads that the other leads with too; without its heads that no other text leads with, ``cap`` is left of it.
        heads = F.col("size") - F.floor((self.percent * F.col("size") + 99) / 100) + 1
        kept = stored(met.select("doc", "size", "last", (heads - F.size("met")).alias("own"), (F.col("size") - heads + F.size("met")).alias("most"), F.posexplode("met").alias("pos", "m")).select(
            "doc", "size", "last", "own", (F.col("most") - F.col("pos")).alias("cap"), (F.col("size") - F.col("m.rank")).alias("loose"), "m.key", "m.n"))
        pairs = self._small(kept.filter(F.col("n") <= self.small)).distinct()
        large = kept.filter(F.col("n") > self.small).drop("n")
        self.sketches = regions.select("doc", "sketch")
        return members, self._connect(large, pairs)

    def _common(self, heads: DataFrame) -> np.ndarray:
        """The shingles that come last, for all texts alike: those that lead the most texts. Which ones these are
        decides about the size of regions, not about links."""
        counts = heads.groupBy("bucket").applyInArrow(_common(self.common), "key long, n long")
        keys = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toArrow()
        return np.sort(_column(keys, "key").to_numpy().view(np.uint64))

    def _fits(self, x, y) -> Column:
        """Can two sets, given by what names their columns, be linked by their first shared shingle in this region?"""
        rest = lambda one, two: F.when(one("last") <= two("last"), one("cap")).otherwise(one("loose"))
        both = F.least(rest(x, y), rest(y, x))
        return both * 100 >= (x("size") + y("size") - both) * self.percent

    def _small(self, rows: DataFrame) -> DataFrame:
        """All pairs of sets that can be linked, inside regions of at most ``small`` sets."""
        sets = F.array_sort(F.collect_list(F.struct("doc", "size", "last", "cap", "loose")))
        fits = lambda x, y: (x["doc"] < y["doc"]) & self._fits(x.getField, y.getField)
        inside = lambda x: F.transform(F.filter("sets", lambda y: fits(x, y)), lambda y: F.struct(y["doc"].alias("a"), x["doc"].alias("b")))
        pairs = F.explode(F.flatten(F.transform("sets", inside))).alias("p")
        return rows.groupBy("key").agg(sets.alias("sets")).select(pairs).select("p.a", "p.b")

    def _pivots(self, rows: DataFrame) -> DataFrame:
        """key, pivot and its columns: of each region the most central sets, those with the smallest
        share of shingles of their own; equal shares are told apart by ``pivots`` hash orders.

        The orders are the same for all regions, so regions of one group of texts choose the same sets.
        """
        own = F.floor(F.col("own") * 64 / F.col("size"))
        rank = lambda j: F.struct(own, F.xxhash64("doc", F.lit(j)), "doc", *BOUNDS)
        chosen = rows.groupBy("key").agg(*[F.min(rank(j)).alias(f"p{j}") for j in range(self.pivots)])
        listed = chosen.select("key", F.explode(F.array_distinct(F.array(*[
            F.struct(F.col(f"p{j}.doc").alias("pivot"), *[F.col(f"p{j}.{c}").alias(f"pivot_{c}") for c in BOUNDS])
            for j in range(self.pivots)]))).alias("p"))
        return listed.select("key", "p.*")

    def _more_pivots(self, waiting: DataFrame, turn: int) -> DataFrame:
        """As above, from the sets outside each region's largest component; 32 times as many each turn."""
        share = F.pmod(F.xxhash64("doc", F.lit(-turn)), F.lit(1 << 30)) / (1 << 30)
        largest = waiting.groupBy("key").agg(F.max(F.struct("weight", "component"))["component"].alias("largest"))
        small = waiting.join(largest, "key").filter("component <> largest").withColumn("share", share)
        first = small.groupBy("key").agg(F.count("*").alias("n"), F.min("share").alias("lowest"))
        chosen = small.join(first, "key").filter((F.col("share") <= F.col("lowest")) | (F.col("share") * F.col("n") < self.pivots * 32**turn))
        return chosen.select("key", *[F.col(c).alias("pivot" if c == "doc" else f"pivot_{c}") for c in ("doc", *BOUNDS, "home", "height", "component")])

    def _able(self, rows: DataFrame) -> DataFrame:
        """Without the sets of a region that can be linked to none of its sets.

        Of two linked sets the one whose last head comes first is ``good``: its ``cap`` allows a link to a set as
        large as the region's smallest one. The other is good too, or comes later and is of a size near a good one's.
        """
        size, least = F.col("size"), rows.groupBy("key").agg(F.min("size").alias("least"))
        reach = lambda c: F.col(c) * 100 >= (size + F.greatest(c, "least") - F.col(c)) * self.percent
        rows = rows.join(least, "key").filter(reach("loose")).withColumn("good", reach("cap")).drop("least")
        good = rows.filter("good").groupBy("key").agg(F.min("last").alias("from"), F.min("size").alias("low"), F.max("size").alias("high"))
        near = (size * 100 >= F.col("low") * self.percent) & (F.col("high") * 100 >= size * self.percent)
        return rows.join(good, "key").filter(F.col("good") | (F.col("last") > F.col("from")) & near).drop("good", "from", "low", "high")

    def _met(self, rows: DataFrame, pivots: DataFrame) -> DataFrame:
        """The sets of every region beside its pivots, where their bounds and sketches let them be linked.

        Sketches are long, so they are only looked up here and not kept with the rows of every region.

        Near copies share most of their regions. A pair meets only in the first one, in the common order, of those where one
        is a pivot of the other: bounds fall from region to region, so a pair they let meet at all meets there. Each side
        knows the first ``FIRST_SHARED`` of its regions. If both know a shared one, the first of these is the pair's first;
        if not, the pair meets wherever the bounds let it.
        """
        bounds = self._fits(F.col, lambda c: F.col(f"pivot_{c}"))
        # ``cap`` falls by one from each region of a set to its next one.
        first = lambda cap: F.slice(F.sort_array(F.collect_list(F.struct((-F.col(cap)).alias("at"), "key"))), 1, FIRST_SHARED)["key"]
        of_sets = self.sketches.join(rows.groupBy("doc").agg(first("cap").alias("first")), "doc")
        of_pivots = self.sketches.select(F.col("doc").alias("pivot"), F.col("sketch").alias("pivot_sketch")).join(
            pivots.groupBy("pivot").agg(first("pivot_cap").alias("pivot_first")), "pivot")
        shared = F.array_intersect("first", "pivot_first")
        once = (F.size(shared) == 0) | (F.get(shared, F.lit(0)) == F.col("key"))
        return rows.join(of_sets, "doc").join(pivots.join(of_pivots, "pivot"), "key").filter(bounds & self._alike() & once)

    def _alike(self) -> Column:
        """Do the sketches of a set and a pivot differ in no more bits than linked sets of their sizes may in shingles?"""
        differ = F.aggregate(F.zip_with("sketch", "pivot_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        return differ * (100 + self.percent) <= (F.col("size") + F.col("pivot_size")) * (100 - self.percent)

    def _connect(self, large: DataFrame, pairs: DataFrame) -> DataFrame:
        # Tables used several times are stored first: one plan of all these steps would hold each of them as often as it is
        # used, and plans, their many broadcast tables and their states take the driver's memory.
        large = stored(self._able(large))
        pivots = stored(self._pivots(large))
        met = self._met(large, pivots).filter(F.col("doc") != F.col("pivot"))
        pairs = stored(pairs.unionByName(met.select(F.col("doc").alias("a"), F.col("pivot").alias("b"))).distinct())
        tested = stored(self.verify(pairs, 0))
        links = stored(self.near(tested).select("a", "b"))
        labels = components(links)
        if large.isEmpty():
            return labels
        first = pivots.select(F.col("pivot").alias("b")).distinct()
        distance = 1 - F.col("both") / F.col("either")
        homes = tested.join(first, "b", "left_semi").groupBy(F.col("a").alias("doc")).agg(
            F.min(distance).alias("height"), F.min_by("b", F.struct(distance, "b")).alias("home"))
        large = stored(large.join(homes, "doc", "left"))
        done = pivots.select("key", F.col("pivot").alias("doc"))
        turn = 1
        while True:
            weights = labels.groupBy("component").agg(F.count("*").alias("weight"))
            weighed = labels.join(weights, "component")
            marked = stored(large.join(weighed, F.col("doc") == F.col("id"), "left").select(
                "key", "doc", *BOUNDS, "home", "height", F.coalesce("component", "doc").alias("component"), F.coalesce("weight", F.lit(1)).alias("weight")))
            # Sets that have been pivots have met the whole region; the others must not be all connected.
            waiting = marked.join(done, ["key", "doc"], "left_anti")
            apart = waiting.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("key")
            waiting = stored(waiting.join(apart, "key"))
            if waiting.isEmpty():
                return labels
            pivots = stored(self._more_pivots(waiting, turn))
            # A set that has been a pivot has met all others, so only waiting sets meet the new pivots.
            met = stored(
                self._met(waiting, pivots).filter((F.col("component") != F.col("pivot_component")) & self._window())
                .select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
            )
            links = links.unionByName(stored(self.verify(met, self.percent)).select("a", "b"))
            done = done.unionByName(pivots.select("key", F.col("pivot").alias("doc")))
            labels = components(links)
            turn += 1

    def _window(self) -> Column:
        """Does the triangle inequality let a set near a pivot? In one Voronoi region (the closest first pivot is
        the same) their distances to its centre must not differ by more than the limit."""
        gap = (100 - self.percent) / 100 + 1e-9
        apart = (F.col("home") == F.col("pivot_home")) & (F.abs(F.col("height") - F.col("pivot_height")) > gap)
        return ~F.coalesce(apart, F.lit(False))


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in ``links`` (a, b).

    Each round takes the smallest label among the neighbours and then the label of that label, so long
    chains shorten by half. Hubs are harmless: labels are joined to edges and reduced by partial minima.
    Every id is its own neighbour, so a round looks labels up only once before the second step.
    """
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in "ab" for y in "ab"])).alias("e")
    edges = stored(links.select(ends).select("e.x", "e.y").distinct())
    labels = stored(edges.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("component")))
    while True:
        lower = edges.join(labels.select(F.col("id").alias("y"), "component"), "y").groupBy("x").agg(
            F.max(F.when(F.col("x") == F.col("y"), F.col("component"))).alias("component"), F.min("component").alias("lower"))
        jump = lower.select(F.col("x").alias("lower"), F.col("lower").alias("jump"))
        moved = stored(lower.join(jump, "lower").select(
            F.col("x").alias("id"), F.col("jump").alias("component"), (F.col("jump") < F.col("component")).alias("moved")))
        labels = moved.select("id", "component")
        if moved.filter("moved").isEmpty():
            return labels


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, small: int = SMALL, common: int = COMMON,
         pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    real = lambda c: F.when(F.col(c) >= NO_ID, F.col(c))
    return _joined(docs, shingle, percent, small, common, pivots, block_bytes).select(
        real("doc").alias("doc_id"), F.col("size").alias("n_shingles"), real("lead").alias("component_id"))


def _joined(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, small: int = SMALL, common: int = COMMON,
            pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc, size, lead (smallest id of the component), by ids that tell texts with a null id apart."""
    members, labels = Join(docs, shingle, percent, small, common, pivots, block_bytes).run()
    return members.join(labels, F.col("rep") == F.col("id"), "left").select("doc", "size", F.coalesce("component", "rep").alias("lead"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each component; a repeated row stays once."""
    leads = stored(_joined(docs, **parameters).groupBy(F.col("doc").alias("_lead")).agg(
        F.max(F.col("doc") == F.col("lead")).alias("_leads"), F.count("*").alias("_rows")).filter("_leads").drop("_leads"))
    # Only rows whose id is repeated are compared by their text; all others are sent to no other task for it.
    kept = lambda some: docs.join(leads.filter(some), _named(docs) == leads["_lead"], "left_semi")
    return kept(F.col("_rows") == 1).unionByName(kept(F.col("_rows") > 1).dropDuplicates(["doc_id", "text"]))
