"""Findings of the third round that its first changes left open, each on a few rows."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.functions import text as T
from quillspark.operators import entities, vectors
from quillspark.operators.sections import with_buckets
from quillspark.plans.registry import QUERIES


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pipeline_learns_from_all_labelled_rows(spark):
    """rows of op10's held-out third were left out, so a language that only they have was unknown."""
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "qorvu zixem qorvu wexim" if i in held else "the band and the banana", "xx" if i in held else "en", "web", 23) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert held and kept == set(range(120))


def test_quoted_signals_need_no_sections(spark, sf_dir):
    """sections were cut, and 9 scores and all quotes gathered, for the quotes of four signals that read lines and bullets."""
    assert "map_from_arrays" not in _plan(QUERIES["profile_evidence"](spark, sf_dir))


def test_posting_skills_read_a_posting_once(spark, sf_dir):
    """F32: whole postings were parsed and cached, scanned, and joined with themselves."""
    assert " Join " not in _plan(QUERIES["posting_skills"](spark, sf_dir)) and "seniority" not in _plan(QUERIES["posting_skills"](spark, sf_dir))


def test_values_of_a_line_are_made_once(spark):
    """Lambdas made a heading's text at each of its uses, and a date range's match at each of its parts."""
    rows = spark.createDataFrame([(1, "x")], "job_id long, clean string")
    assert _plan(with_buckets(rows, "clean")).count("regexp_replace") <= 1
    texts = spark.createDataFrame([(["Mar 2019 - 04/2021, Oslo", "since 2018", "2015 to present", None, "", "2015 2016"],)], "t array<string>")
    out = texts.select(entities.date_ranges(F.col("t")).alias("d"))
    assert [r and tuple(r) for r in out.first().d] == [
        (2019, 3, 2021, 4, False, "Mar 2019 - 04/2021"), (2018, None, 2018, None, False, "2018"), (2015, None, None, None, True, "2015 to present"), None, None, None]
    assert _plan(texts.select(F.transform("t", entities.date_range))).count("(?i)\\b(") <= 6
    assert [r[0] for r in spark.createDataFrame([(" \t\x0b a b\n\f\r",), ("",), (None,)], "t string").select(T.strip(F.col("t"))).collect()] == ["a b", "", None]


def test_terms_of_the_first_side_alone_are_not_dealt(spark):
    """all terms of both sides met by pair, for weights of the second side."""
    left = spark.createDataFrame([(1, "alpha beta gamma delta epsilon" * 3), (2, None), (3, "zeta")], "doc_id long, text string")
    right = spark.createDataFrame([(7, "beta omega sigma\n- beta theta, again and again"), (8, "")], "job_id long, text string")
    pairs = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "doc_id long, job_id long")
    key = lambda r: (r.doc_id, r.job_id, r.term)
    whole = {key(r): (r.wa is not None, round(r.wb, 9)) for r in vectors.pair_terms(left, right, pairs, "doc_id", "job_id").filter("wb is not null").collect()}
    made = vectors.second_terms(left, right, pairs, "doc_id", "job_id")
    assert whole == {key(r): (r.met, round(r.wb, 9)) for r in made.collect()} and len(whole) > 10
    assert "LeftSemi" in _plan(made)
