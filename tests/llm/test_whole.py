"""Cases that once lost a part of the job, against plain versions."""

import random

import brute
import pyarrow as pa
import pytest
from conftest import prose

from pyspark.sql import functions as F

from heliogale.llm import decontam, jaccard, langid
from heliogale.llm.wordhash import Hasher

order = lambda rows: sorted(rows, key=str)


def joined(docs, **parameters):
    return order((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, **parameters).collect())


def uneven_rows(seed, n=90):
    """Texts of 8 to 500 words, some with a common passage, each with copies that lost, got or ended in 1 to 25% of words."""
    rng = random.Random(seed)
    passages = [prose(rng, k).split() for k in (8, 30, 80)]
    rows = []
    for _ in range(n):
        base = prose(rng, rng.choice((8, 9, 10, 12, 16, 24, 40, 80, 200, 500))).split()
        if rng.random() < 0.4:
            at = rng.randrange(len(base))
            base[at:at] = rng.choice(passages)
        rows.append(base)
        for _ in range(rng.randrange(1, 4)):
            some = max(1, int(len(base) * rng.uniform(0.01, 0.25)))
            kind = rng.randrange(4)
            if kind == 0:
                rows.append(base[:-some])
            elif kind == 1:
                rows.append(base[some:])
            elif kind == 2:
                rows.append(base + prose(rng, some).split())
            else:
                at = rng.randrange(len(base))
                rows.append(base[:at] + prose(rng, some).split() + base[at:])
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("parameters", [{}, {"small": 2, "pivots": 1, "block_bytes": 20_000}])
def test_jaccard_of_unequal_sizes(frame, parameters):
    rows = uneven_rows(21)
    assert joined(frame(rows), common=10**6, **parameters) == order(brute.jaccard_components(rows))


def short_rows(seed):
    """Short texts that share leading parts, so that shingles lie around the limit of common ones."""
    rng = random.Random(seed)
    parts = [prose(rng, 6, 60).split() for _ in range(12)]
    rows = []
    for _ in range(220):
        words = sum(rng.sample(parts, rng.randrange(1, 4)), [])[: rng.randrange(5, 18)]
        for _ in range(rng.randrange(3)):
            words.insert(rng.choice((0, len(words))), f"n{rng.randrange(400)}")
        rows.append(" ".join(words))
    return list(enumerate(rows))


@pytest.mark.parametrize("parameters", [{"common": 1}, {"common": 4, "block_bytes": 1000, "small": 4}, {}])
def test_jaccard_around_the_common_limit(frame, parameters):
    rows = short_rows(5)
    assert joined(frame(rows), **parameters) == order(brute.jaccard_components(rows))


def test_recall_at_every_length():
    rng = random.Random(12)
    # Many long items first: they must not stand for the short ones.
    items = [prose(rng, 60, 10**6) for _ in range(60)] + [prose(rng, n, 10**6) for n in range(5, 61) for _ in range(4)]
    index = decontam.Index.build(items, decontam.SHARE, decontam.RECALL)
    texts, held = [], []
    for k in range(60, len(items)):
        for _ in range(25):
            tokens = items[k].split()
            for at in sorted(rng.sample(range(len(tokens)), len(tokens) // 5), reverse=True):
                kind = rng.randrange(3)
                tokens[at : at + (kind != 1)] = [f"n{rng.randrange(10**9)}"] if kind < 2 else []
            texts.append(" ".join([prose(rng, 15), *tokens, prose(rng, 15)]))
            held.append(k)
    found = {(row, item) for row, item, _ in index.find(pa.array(texts), Hasher(tokens=True))}
    for n in range(5, 61):
        rows = [row for row, k in enumerate(held) if len(items[k].split()) == n]
        assert sum((row, held[row]) in found for row in rows) >= 0.97 * len(rows), n


def test_keep_one_of_near_copies_with_null_ids(frame):
    text = prose(random.Random(2), 80)
    rows = [(None, text), (None, text + " more"), (None, "another text"), (5, text + " end")]
    kept = {r["text"] for r in jaccard.keep_one(frame(rows, True)).collect()}
    assert len(kept) == 2 and "another text" in kept


def test_every_language_is_learned(frame, monkeypatch):
    for name, value in (("LANDMARKS", 2), ("TRAIN_ROWS", 8), ("MAX_TRAIN_BYTES", 200)):
        monkeypatch.setattr(langid, name, value)
    # Language 0 has many texts that are too long to learn from, and one that is not.
    rows = [(k, f"l{k % 4} " * (100 if k % 4 == 0 and k else 9)) for k in range(200)]
    docs = frame(rows).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 4))
    assert langid.train(docs, F.lit(True)).langs == ["l0", "l1", "l2", "l3"]


def test_near_copies_meet_once(frame, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(words))] + [(k, " ".join([*words[:k], "other", *words[k + 1 :]])) for k in range(1, 40)]
    met, keep = [], jaccard.Join._met

    def counted(self, *arguments):
        out = keep(self, *arguments)
        met.append((out.count(), out.select("doc", "pivot").distinct().count()))
        return out

    monkeypatch.setattr(jaccard.Join, "_met", counted)
    out = {r["doc_id"]: r["component_id"] for r in jaccard.join(frame(rows), small=4).collect()}
    assert set(out.values()) == {0}
    assert met[0][1] >= 39 and all(n == different for n, different in met)


def test_keep_one_keeps_the_texts_of_a_repeated_id(frame):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (3, None), (3, None), (4, "m n")]
    kept = sorted((r["doc_id"], r["text"] or "") for r in jaccard.keep_one(frame(rows)).collect())
    assert kept == [(1, "a b c d e f"), (1, "g h i j k l"), (3, ""), (4, "m n")]


def test_no_plan_of_the_join_repeats_its_steps(frame, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(words))] + [(k, " ".join([*words[:k], "other", *words[k + 1 :]])) for k in range(1, 40)]
    exchanges, keep = [], jaccard.stored

    def counted(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges.append(plan.count("Exchange"))
        return keep(df)

    monkeypatch.setattr(jaccard, "stored", counted)
    out = {r["doc_id"]: r["component_id"] for r in jaccard.join(frame(rows), small=4).collect()}
    assert set(out.values()) == {0}
    assert max(exchanges) <= 30, exchanges


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(200, 260)] + [(7, 5)]
    out = {r["id"]: r["component"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {k: 100 for k in range(100, 141)} | {k: 200 for k in [500, *range(200, 260)]} | {5: 5, 7: 5}
