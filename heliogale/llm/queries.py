"""The registered queries of these operators and, where SQL can say them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogale.llm import decontam, jaccard, langid, linerules, lm, merkle, mixing, quality, resample, sharding, substrings, tokens, toxicity
from heliogale.llm.samples import fold
from heliogale.llm.twins import MERKLE_SQL, RESAMPLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
WITH counted_words AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce('t' || text, '')), 1, 15))::BIGINT AS mark
  FROM documents),
sizes AS (
  SELECT *, mark % CAST(ceil(count(*) OVER (PARTITION BY source, size) / 50000.0) AS BIGINT) AS part FROM counted_words),
per_source AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sizes GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM per_source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS ceil3 FROM ordered),
roomy AS (SELECT *, ceil3 / weight AS room FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(ceil3) OVER before, 0)) /
            (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS candidate
  FROM roomy WINDOW before AS (ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(candidate, (room, place)) AS level FROM levels WHERE candidate <= room),
rates AS (
  SELECT source, source_size, least(ceil3, weight * level) AS target,
         CASE WHEN source_size > 0 THEN round(least(ceil3, weight * level) / source_size, 9) ELSE 0.0 END AS rate
  FROM levels, level),
groups AS (
  SELECT s.source, s.size, s.part, count(*) AS n, any_value(source_size) AS source_size, any_value(target) AS target, any_value(rate) AS rate
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source GROUP BY s.source, s.size, s.part),
counted AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS frac,
         coalesce(sum(n) OVER (PARTITION BY source ORDER BY size, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM groups),
evened AS (SELECT *, floor(frac * (before + n) + 0.5) - floor(frac * before + 0.5) AS even FROM counted),
lacking AS (SELECT *, target - sum(size * (n * whole + even)) OVER (PARTITION BY source) AS lacks FROM evened),
rooms AS (
  SELECT *, CASE WHEN lacks < 0 THEN even WHEN rate > whole THEN n - even ELSE 0 END AS free FROM lacking),
used AS (
  SELECT *, coalesce(sum(free * size) OVER (PARTITION BY source ORDER BY size, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM rooms),
changes AS (
  SELECT *, greatest(0, least(CASE WHEN size > 0 THEN floor((abs(lacks) - used) / size) ELSE 0 END, free)) AS change FROM used),
plan AS (SELECT *, even + CASE WHEN lacks < 0 THEN -change ELSE change END AS extra FROM changes),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, size, part ORDER BY doc_id NULLS FIRST, mark) AS k FROM sizes)
SELECT d.doc_id, d.size, CAST(p.source_size AS BIGINT) AS source_size, round(p.target, 6) AS target,
       CAST(p.whole + floor(p.extra * k / p.n) - floor(p.extra * (k - 1) / p.n) AS BIGINT) * d.size AS taken,
       CAST(p.whole + floor(p.extra * k / p.n) - floor(p.extra * (k - 1) / p.n) AS BIGINT) AS copies, p.rate
FROM numbered d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.size = p.size AND d.part = p.part
"""


@query("op3_entropy_mix", MIX_SQL)
def entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op9_ring_shards")
def ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def _fold(folds: int):
    return fold(F.col("doc_id"), folds)


@query("op1_compression_quality")
def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, 0.3, _fold(5) != 0, _fold(5) == 0)


@query("op2_kernel_language")
def kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), _fold(3) != 1, _fold(3) == 1)


@query("op6_line_rules")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judge(table(spark, sf_dir, "documents"))


@query("op7_pu_toxicity")
def pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels, 0.5, _fold(5) != 0, _fold(5) == 0)


@query("op10_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digest(table(spark, sf_dir, "documents"))


@query("op8_metric_join")
def metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op4_cgk_decontamination")
def cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.held_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_backoff_scores")
def backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


@query("op12_importance_resampling", RESAMPLE_SQL)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
