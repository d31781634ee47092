"""Merkle manifest, importance resampling and token counts against plain versions."""

import random

import brute
import public_tokenizers
import pytest
from conftest import SCHEMA, prose

from pyspark.sql import functions as F

from heliogale.llm import merkle, resample, tokens
from heliogale.llm.ordered import numbered

order = lambda rows: sorted(rows, key=str)
PATH = public_tokenizers.path("word_bpe_49k.json")


def tuples(df):
    return order(map(tuple, df.collect()))


# ---- numbers along an order -------------------------------------------------------
def test_numbers_in_groups_of_any_size(spark):
    rows = [(g, k) for g, n in ((None, 1), ("a", 700), ("b", 3)) for k in range(n)] + [("c", 5)] * 4
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    out = numbered(df, ["g"], [F.col("k").desc()])
    assert tuples(out.filter("g != 'c' or g is null")) == order(
        [(None, 0, 0, 1)] + [("a", k, 699 - k, 700) for k in range(700)] + [("b", k, 2 - k, 3) for k in range(3)])
    assert sorted(r["pos"] for r in out.filter("g = 'c'").collect()) == [0, 1, 2, 3]
    assert numbered(df.limit(0), [], [F.col("k")]).count() == 0


def test_a_large_group_lies_in_many_ranges(spark):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")  # so few rows would be read by one task
    try:
        out = numbered(spark.range(40_000).withColumn("g", F.lit(None).cast("string")), ["g"], [F.col("id")])
        assert out.filter("pos != id or n != 40000").isEmpty()
        assert len({f.rsplit("/", 1)[0] + f.rsplit("part-", 1)[1][:5] for f in out.inputFiles()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set(coalesce, before)


# ---- manifest ------------------------------------------------------------------------
def manifest_rows(n):
    rng = random.Random(n)
    rows = [(k, prose(rng, 5).replace(" ", "\n") if k % 3 else "été one", "en" if k % 4 else None,
             None if k % 7 == 0 else "Ä" if k % 5 == 0 else "s" if k % 2 else "only 1" if k == 2 else "t", k if k % 6 else None) for k in range(n)]
    return [(i, t, lang, s, c) for i, t, lang, s, c in rows] + [(None, None, None, None, None)] * 2 + [(1, "a\nb", "x", "s", 3)] * 2 + [(1, None, "x", "s", 3)]


@pytest.mark.parametrize("n", [0, 1, 2, 30, 400])
def test_manifest(spark, n):
    rows = manifest_rows(n)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "pos", "n", "digest", "steps", "members", "up0")})
    assert tuples(merkle.tamper_check(docs)) == order(brute.merkle_tamper([(i, s, lang, c, t) for i, t, lang, s, c in rows]))


def test_one_leaf_is_its_own_root(spark):
    row = merkle.tamper_check(spark.createDataFrame([(3, "a\nb", "en", "s", 3)], SCHEMA)).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"].startswith("e3b0c442")


@pytest.mark.parametrize("fan,kept", [(3, 1), (2, 3), (5, 2)])
def test_proofs_of_other_shapes_fold_to_the_root(spark, fan, kept):
    docs = spark.createDataFrame(manifest_rows(120), SCHEMA)
    out = merkle.manifest(docs, fan=fan, kept=kept)
    assert out.filter(merkle.folded(F.col("leaf"), F.col("steps")) != F.col("root")).isEmpty() and out.count() == docs.count()


def test_empty_manifest(frame):
    assert merkle.tamper_check(frame([])).count() == 0


# ---- importance resampling ---------------------------------------------------------
TARGETS = ["v1 v2 v3 Été v5", None, "", "VOID v2 v3 -- v4"]


@pytest.mark.parametrize("extra", [False, True])
def test_importance(hard_rows, frame, spark, extra):
    rows = hard_rows + [(200, "A-b_c, d\x00e été ÉTÉ 12x"), (201, "--- !!")] + [(300 + k, prose(random.Random(k), 21)) for k in range(50)]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGETS)], "item_id long, text string")
    got = tuples(resample.importance(frame(rows, extra), target, percent=40))
    assert got == order(brute.resample(rows, TARGETS, percent=40))


def test_draw_returns_whole_rows(hard_rows, frame, spark):
    target = spark.createDataFrame([(1, TARGETS[0])], "item_id long, text string")
    docs = frame(hard_rows, True)
    out = resample.draw(docs, target, percent=50)
    want = [r for r in brute.resample(hard_rows, TARGETS[:1], percent=50) if r[-1]]
    assert out.columns == docs.columns and order(r["doc_id"] for r in out.collect()) == order(r[0] for r in want)


def test_importance_of_empty_tables(frame, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.importance(frame([]), none).count() == 0
    assert tuples(resample.importance(frame([(1, "a b")]), none)) == brute.resample([(1, "a b")], [])


def test_a_long_text_is_scanned_whole():
    n, found = resample.runs(resample.plain(b"Ab,  cd\n" * 300_000))
    assert (n, len(found)) == (600_000, 3 * 600_000 - 3)


# ---- token counts ------------------------------------------------------------------
PARTS = ["a", "\u00a0", "\x85", "\u2003", "'", "'s", "'ll", "re", "  ", "\n", "é", "é", "́", "İ", "ß", "<|startoftext|>", "<|endoftext|>", "<|start", "1", "…", "--",
         "日本", "한", "한", "😀", "‍", "the", "ing", "Ω", "ﬁ"]


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 16), (50, 3)])
def test_spliced_chunks_are_the_whole_encoding(chunk, overlap):
    rng = random.Random(chunk)
    from tokenizers import Tokenizer

    own, library = tokens.Encoder(PATH, chunk, overlap), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice(some) for _ in range(rng.choice((100, 400)))) for some in (rng.sample(PARTS, rng.choice((2, 4, 27))) for _ in range(300))]
    texts += ["a" * 900, "'" * 900, "日" * 700, "lorem" * 300, "́" * 400, "".join(rng.choice("abcdefgh") for _ in range(3000)), prose(rng, 500)]
    for text in texts:
        assert list(own.whole(text).ids) == library.encode(text, add_special_tokens=False).ids
    assert own.widened  # the overlap was too short at times


def test_token_counts(hard_rows, frame):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = hard_rows + [(90, "x <|endoftext|> Y"), (91, "long " * 6000), (92, "z" * 50_000)]
    size = lambda t: len((t or "").encode())
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = order((i, size(t), n(t), n(t) > 2048) for i, t in rows)
    assert tuples(tokens.token_counts(frame(rows, True), PATH)) == want
    assert tuples(tokens.token_counts(frame(rows, True), PATH, chunk=500, overlap=20)) == want
    ids = {(r["doc_id"], tuple(r["ids"])) for r in tokens.token_ids(frame(rows), PATH, chunk=500, overlap=20).collect()}
    assert ids == {(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert tokens.token_counts(frame([]), PATH).count() == 0


def test_other_tokenizers_take_whole_texts():
    own = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), chunk=50)
    text = prose(random.Random(1), 300)
    assert own.chunk is None and own.counts([text]) == [len(own.tokenizer.encode(text, add_special_tokens=False).ids)]
