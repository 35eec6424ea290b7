"""Findings of the third round, each on a few rows."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.llm import language_id
from quillspark.operators import entities, guards, jobs, scoring, vectors
from quillspark.plans.registry import QUERIES
from quillspark.sources import tables

WORDS = ("banana", "band", "nab", "bandana", "an", "and", "dab")


def test_dimension_scores_round_as_sql_does(spark):
    """100 * 0.6045 is 60.449999999999996 in binary, and 60.5 in the SQL."""
    rows = spark.createDataFrame([(1, "content", s, 1.5, "info") for s in (0.5, 0.709)], "doc_id long, dimension string, score double, weight double, severity string")
    assert 100 * ((0.5 * 1.5 + 0.709 * 1.5) / 3.0) < 60.45
    assert [r.score for r in scoring.dimension_scores(rows, ["doc_id"]).collect()] == [60.5]
    assert spark.range(1).select(T.round_binary(F.lit(-0.25), 1)).first()[0] == -0.3


def test_acronyms_end_before_letters_that_are_not_ascii(spark):
    """The SQL's word boundaries are those of ASCII."""
    rows = spark.createDataFrame([(1, "ensttz. SSö tzu", "", "")], "job_id long, required string, responsibilities string, text string")
    assert [(r.phrase, r.score) for r in jobs.keyword_scores(rows).collect() if r.phrase == "ss"] == [("ss", 3.0)]


def test_streets_end_before_letters_that_are_not_ascii(spark):
    """as in the SQL."""
    rows = spark.createDataFrame([("at 12 Long stß, or 7643 Ling st.",)], "text string")
    assert rows.select(guards.redact(F.col("text"))).first()[0] == "at [ADDRESS]ß, or [ADDRESS]"


def test_keys_without_a_whole_stretch_have_null_months(spark):
    """customers whose orders have no date keep their row, the null customer too."""
    rows = spark.createDataFrame([(1, 5, 6), (1, None, None), (2, None, None), (None, 7, 7), (3, 9, None)], "k long, s int, e int")
    assert {tuple(r) for r in entities.tenure_months(rows, "k", "s", "e").collect()} == {(1, 2), (2, None), (None, 1), (3, None)}


def test_terms_are_counted_in_small_frames(spark):
    """Neither the session's batches nor a batch's terms grow with the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts = spark.createDataFrame([(i, f"word{i} thing") for i in range(50)], "doc_id long, text string")
    assert vectors.term_table(texts, "doc_id").count() == 50 * 4
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
    long = "u" + "some words " * (vectors.PIECE // 22)
    frames = list(vectors._pieces(iter([(pd.Series([long, None, long, long, "ua b"]), pd.Series([True] * 5))]), False))
    assert sum(map(len, frames)) == 5 and len(frames) == 2


def test_composed_texts_are_not_broadcast_by_estimate(spark, tmp_path):
    """the estimate of texts composed of keys is below the threshold at any size of theirs."""
    estimated, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.unset(estimated), spark.conf.unset(measured)
    spark.range(60_000).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(60_000).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    plan = QUERIES["narrative_prompts"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashedRelationBroadcastMode") == 0 and plan.count("SortMergeJoin") == 2
    assert spark.conf.get(measured) == "10485760b" and [tables._bytes(x) for x in ("10485760b", "256k", "10MB", "-1")] == [10485760, 262144, 10485760, -1]


def test_best_postings_have_a_short_plan(spark, sf_dir):
    """it was a million characters, as the parsing stood in it 36 times."""
    assert len(QUERIES["profile_best_postings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()) < 200_000


def test_limits_of_languages_come_from_all_texts(spark):
    """they came from 2,000 texts a language of one half."""
    rows = [(i, " ".join(WORDS[(i * k + k) % 7] for k in range(1, 3 + i % 5)) + (" zq" * 40 if i % 997 == 0 else ""), "en") for i in range(4_600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, halves = language_id.count_grams(df), df.withColumn("half", language_id._half(F.col("doc_id"))).collect()
    h, n = [], []
    for half in (0, 1):
        other = language_id._fit(counts.filter(F.col("half") == 1 - half).withColumn("model", F.lit(0)).drop("half"))[0]
        bits, letters = language_id.Scorer(other).entropies([r.text for r in halves if r.half == half])
        assert len(letters) > 2_000
        h, n = np.concatenate((h, bits[:, 0])), np.concatenate((n, letters))
    mean = np.average(h, weights=n)
    spread = np.average((h - mean) ** 2, weights=n) + 1e-4, np.median((h - mean) ** 2 * n) * 2.2
    models = language_id.fit_models(df)
    assert abs(models.mean[0] - mean) < 1e-6 and np.allclose(models.spread[0], spread, rtol=2e-3)
    assert abs(models.top[0] - np.quantile((h - mean) / np.sqrt(spread[0] + spread[1] / n), 0.99)) < 0.02


def test_words_are_those_of_the_pattern():
    every = "".join(map(chr, range(0x110000)))
    assert language_id.letters_of(every) == re.findall(r"[^\W\d_]+", every.lower()) and language_id.letters_of(None) == []


def test_scores_are_aggregated_without_sorting_and_dealt_once(spark):
    """rows were sorted before the partial aggregate, and dealt twice for recommendations."""
    rows = spark.createDataFrame([(1, "ats", "a", "A", s, 1.0, v, "do", []) for s, v in ((0.2, "critical"), (0.5, "warning"), (1.0, "ok"))],
                                 "doc_id long, dimension string, signal_id string, label string, score double, weight double, severity string, recommendation string, evidence array<string>")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = scoring.dimension_scores(rows, ["doc_id"])
    assert "SortAggregate" not in plan(found) and [r.severity for r in found.collect()] == ["critical"]
    best = scoring.recommendations(rows, ["doc_id"])
    assert plan(best).count("Exchange hashpartitioning") == 1 and [(r.rank, r.severity) for r in best.collect()] == [(1, "critical"), (2, "warning")]
