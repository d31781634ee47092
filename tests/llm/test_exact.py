"""Operators with one right answer, against plain versions."""

import math
import random

import brute
import pytest
from conftest import SF, prose

from checks.compare import difference, sql_rows
from heliogale.llm import decontam, jaccard, linerules, lm, mixing, sharding, substrings
from heliogale.llm.queries import ORACLES, QUERIES

order = lambda rows: sorted(rows, key=str)


def collect(df, *names):
    return order(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("extra", [False, True])
def test_substrings(hard_rows, frame, extra):
    got = collect(substrings.repeat_digest(frame(hard_rows, extra), block_bytes=20_000), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == order(brute.substring_dedup(hard_rows))


def test_substring_text_and_small_cover(frame):
    rows = [(1, "a b c d e f g h"), (2, "x b c d e y"), (3, "b c d e b c d e")]
    out = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(frame(rows), window=4, period=3).collect()}
    assert out == {1: "a b c d e f g h", 2: "x y", 3: ""}
    assert substrings.difference_cover(13) == (0, 1, 3, 9)


@pytest.mark.parametrize("parameters", [{}, {"small": 3, "common": 2, "pivots": 1, "block_bytes": 20_000}])
def test_jaccard(hard_rows, frame, parameters):
    got = collect(jaccard.join(frame(hard_rows, True), **parameters), "doc_id", "n_shingles", "component_id")
    assert got == order(brute.jaccard_components(hard_rows))


def test_keep_one(hard_rows, frame):
    docs = frame(hard_rows, True)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    leads = {(i, c) for i, _, c in brute.jaccard_components(hard_rows) if i == c}
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in leads}


def test_backoff(hard_rows, frame):
    got = collect(lm.score(frame(hard_rows, True), block_bytes=20_000), "doc_id", "n_words", "n_unseen", "log_score")
    want = order(brute.backoff(hard_rows))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))


def test_line_rules(hard_rows, frame):
    rows = hard_rows + [(80, "a b c d e.\na b c d e.\n\n \n a b c d e."), (81, "home | news | about | help\n" * 5), (82, "#*$%&|<> x")]
    got = {(r[0], *r[1:6]) for r in linerules.judge(frame(rows, True)).collect()}
    assert got == {(i, *brute.line_counts(t)) for i, t in rows}


def test_line_verdicts(frame):
    text = " ".join(f"word{k}" for k in range(30)) + "."
    menu = " | ".join(f"m{k}" for k in range(40))
    rows = [(1, text), (2, text + "\n" + menu), (3, text + "\nWe use cookies here."), (4, "short.")]
    out = {r["doc_id"]: r for r in linerules.judge(frame(rows)).collect()}
    assert [out[k]["kept"] for k in (1, 2, 3, 4)] == [True, False, True, False]
    assert out[4]["base_failed"] and not out[2]["base_failed"]
    assert {r["doc_id"]: r["text"] for r in linerules.clean(frame(rows)).collect()} == {1: text, 3: text}


@pytest.mark.parametrize("line, lost", [
    ("stój ę", 2), ("стой мой", 2), ("стой л", 2), ("Стой!", 0), ("这是一句话。", 0), ("这是一句话", 1), ("ما هذا؟", 0), ("ما هذا", 2),
    ("यह एक वाक्य है।", 0), ("यह एक वाक्य है", 4), ("« Oui, bien sûr »", 0), ("он сказал…", 0), ("日本語」", 0), ("an end \U0001f600", 3), ("é", 1), ("\n\n", 0)])
def test_closing_marks_of_scripts(frame, line, lost):
    out = linerules.judge(frame([(1, line), (2, "plain words.\n" + line)])).collect()
    assert [r["n_lost_words"] for r in out] == [lost, lost]


def test_edit_distance():
    import numpy as np

    rng = random.Random(1)
    for _ in range(50):
        item, text = [[rng.randrange(4) for _ in range(n)] for n in (7, 15)]
        got = decontam.distances(np.array([item]), np.array([text]))[0]
        assert got == brute.edit_distance_to_run(item, text)


def test_decontamination(hard_rows, frame, spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randrange(14, 60), 10**6)) for k in range(60)] + [(100, "rare pair"), (101, None), (102, "")]
    rows, want, clean = list(hard_rows), set(), set()
    for k, (item, text) in enumerate(items[:60]):
        tokens = text.split()
        for _ in range(k % 4 if len(tokens) > 20 else 0):
            tokens[rng.randrange(len(tokens))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 + k, (prose(rng, 50) + " " + " ".join(tokens).upper() + ", " + prose(rng, 20))))
        want.add((1000 + k, item))
        rows.append((2000 + k, prose(rng, 20) + " " + " ".join(text.split()[: len(text.split()) // 2]) + " " + prose(rng, 20)))
        clean.add(2000 + k)
    rows.append((3000, "a Rare, pair!"))
    want.add((3000, 100))
    docs, bench = frame(rows, True), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.held_items(docs, bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert want <= got and not {i for i, _ in got} & clean
    texts, tokens = dict(rows), lambda t: __import__("re").findall(r"\w+", (t or "").lower())
    for r in found.collect():
        assert brute.edit_distance_to_run(tokens(dict(items)[r["item_id"]]), tokens(texts[r["doc_id"]])) == r["distance"] <= r["allowed"]
    import pyspark.sql.functions as F

    kept = docs.filter(~decontam.holds_item(F.col("text"), bench))
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({i for i, _ in got})


def test_mix(frame):
    rng = random.Random(3)
    rows = [(k if k % 50 else None, prose(rng, rng.randrange(0, 60))) for k in range(600)] + [(7, None), (7, None), (8, "")]
    docs = frame(rows, True)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and mixing.take(docs).columns == docs.columns
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    by_source = {}
    for r in out:
        entry = by_source.setdefault((r["source_size"], r["target"]), [0])
        entry[0] += r["taken"]
    assert all(abs(taken[0] - target) <= 60 and target <= 3 * size + 1e-6 for (size, target), taken in by_source.items())
    assert math.isclose(sum(t for _, t in by_source), sum(r["size"] for r in out), rel_tol=1e-6)
    assert mixing.take(docs).count() == sum(r["copies"] for r in out)
    assert order(map(tuple, mixing.mix(docs).collect())) == order(map(tuple, out))


@pytest.mark.parametrize("limit", [1, 10])
def test_mix_ranks_in_parts_like_its_twin(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "ROWS_PER_RANK", limit)
    df = QUERIES["op3_entropy_mix"](spark, SF)
    names, want = sql_rows(SF, ORACLES["op3_entropy_mix"].replace("50000", str(limit)))
    assert difference(df.columns, [tuple(r) for r in df.collect()], names, want) is None


def test_mix_draws_the_same_texts_for_equal_ids(frame):
    rows = [(7 if k % 2 else None, f"word{k} and two") for k in range(300)] + [(k, "a b") for k in range(50)]
    drawn = [order((r["doc_id"], r["text"]) for r in mixing.take(frame(data, True).repartition(n)).select("doc_id", "text").collect())
             for data, n in ((rows, 3), (rows, 7))]
    assert drawn[0] == drawn[1]


def test_shards(hard_rows, frame):
    import zlib

    rng = random.Random(6)
    rows = hard_rows + [(5000 + k, prose(rng, 20)) for k in range(1500)] + [(9000 + k, "the same text again") for k in range(800)]
    out = sharding.shard(frame(rows, True)).collect()
    raw = lambda t: len((t or "").encode()) + 1
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert order((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == order((i, raw(t), crc(t)) for i, t in rows)
    slots, loads = {}, dict.fromkeys(range(16), 0)
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(raw(t) for _, t in rows)
    assert max(loads.values()) <= sum(loads.values()) / 16 * 1.001 + longest


@pytest.mark.parametrize("same_id", [None, 5])
def test_shards_of_equal_rows(frame, same_id, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CHUNK", 100)
    rng = random.Random(9)
    rows = [(same_id, "thirty bytes of an equal text")] * 1000 + [(k, prose(rng, 5)) for k in range(1000)] + [(None, None)] * 7
    out = sharding.shard(frame(rows, True)).collect()
    assert order((r["doc_id"], r["size"]) for r in out) == order((i, len(t or "") + 1) for i, t in rows)
    slots, loads = {}, dict.fromkeys(range(16), 0)
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(loads.values()) / 16
    assert max(loads.values()) <= mean * (1.001 + 2 / sharding.PARTS) + 31


def test_ring_walk_by_hand(spark):
    """The walk of :func:`sharding.place`, item by item along a list of nodes."""
    rng = random.Random(10)
    items = [(rng.randrange(sharding.CELLS), 0, rng.randrange(1, 50)) for _ in range(300)] + [(77, p, 400) for p in range(5)]
    items = list({i[:2]: i for i in items}.values())
    got = {(r["cell"], r["part"]): r["shard"] for r in sharding.place(
        spark.createDataFrame(items, "cell int, part int, load long"), 5, 20, 0.01).collect()}
    nodes = sorted((r["cell"], r["shard"]) for r in sharding.ring(spark, 5, 20).collect())
    limit, loads, want, left = sum(i[2] for i in items) / 5 * 1.01, dict.fromkeys(range(5), 0), {}, items
    while left:
        is_open = {s for s in loads if loads[s] < limit}
        waiting = {}
        for cell, part, load in left:
            on = [s for at, s in nodes if at >= cell and s in is_open] or [s for _, s in nodes if s in is_open]
            waiting.setdefault(on[0], []).append((-load, cell, part))
        left = []
        for s, queue in waiting.items():
            ahead = loads[s]
            for load, cell, part in sorted(queue):
                if ahead < limit:
                    want[cell, part] = s
                    loads[s] -= load
                else:
                    left.append((cell, part, -load))
                ahead -= load
    assert got == want


def test_shard_movement(frame):
    rng = random.Random(7)
    docs = frame([(k, prose(rng, 10)) for k in range(4000)])
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.shard(docs, n).collect()} for n in (8, 9))
    moved = sum(before[k] != after[k] for k in before)
    assert moved < 2.5 * len(before) / 9


def test_empty_tables(frame, spark):
    docs = frame([])
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (substrings.repeat_digest(docs), jaccard.join(docs), lm.score(docs), linerules.judge(docs), decontam.held_items(docs, bench),
                mixing.mix(docs), mixing.take(docs), sharding.shard(docs)):
        assert out.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    df = QUERIES[name](spark, SF)
    names, want = sql_rows(SF, ORACLES[name])
    assert difference(df.columns, [tuple(r) for r in df.collect()], names, want) is None
