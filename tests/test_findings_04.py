"""Findings of the fourth round, each on a few rows."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import matching, packed_tfidf
from quillspark.plans import profiles as P
from quillspark.plans.engine import Analysis, fields_match, from_text
from quillspark.plans.registry import ORACLE_SQL, QUERIES


def test_tenure_counts_stretches_that_end_before_they_start_as_sql_does(spark, tmp_path):
    """orders of negative keys end up to three months before they start; their rows were left out."""
    day = lambda m: dt.datetime(1996, m, 5)
    rows = [(-3, 1, day(5)), (2, 1, day(9)), (-1, 2, day(4)), (-7, 3, day(4)), (5, 3, None), (None, 4, day(2)), (-6, None, day(7)), (-5, None, day(7)), (3, 5, day(1)), (-2, 5, day(3))]
    path = str(tmp_path / "orders.parquet")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{path}/*.parquet'")
    want = set(db.execute(ORACLE_SQL["tenure_months"]).fetchall())
    got = {tuple(r) for r in QUERIES["tenure_months"](spark, str(tmp_path)).collect()}
    assert got == want and (1, 1) in got and (3, -2) in got


ODD = ("one two three four five six\none two", "", "  ", "the of", "short", "seven\neight nine", "one two three four five six seven\n" * 3, "x" * 40 + " yy", "c++ node.js ci/cd a-b",
       "zz yy xx ww vv uu tt ss rr qq", "zz yy xx ww vv uu tt ss rr qq", "é ü ñ ab", None, "only punctuation !!! ???\n\n\n- bullet of some length here")


def _documents(spark, path, n=120):
    rows = [(i, ODD[i % len(ODD)] if i % 3 else " ".join(f"w{(i * k) % 23}" for k in range(2, 3 + i % 17)), (None, "en", "de", "fr")[i % 4]) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(path / "documents.parquet"))


@pytest.mark.parametrize("name", ["tfidf_topk", "lang_centroids"])
def test_packed_terms_give_the_rows_of_the_sql(spark, tmp_path, monkeypatch, name):
    """with pieces of a text or two and several buckets, texts without words or units, and a null group."""
    _documents(spark, tmp_path)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sizes = packed_tfidf.PIECE, packed_tfidf.BUCKET
    for piece, bucket in (sizes, (60, 50)):
        monkeypatch.setattr(packed_tfidf, "BUCKET", bucket)
        monkeypatch.setattr(packed_tfidf, "PIECE", piece)
        df = QUERIES[name](spark, str(tmp_path))
        want = db.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert Counter(map(tuple, df.collect())) == Counter(want) and want


def test_terms_are_not_shuffled_a_row_each(spark, tmp_path):
    """rows of terms took the disk 17 times the input; now texts' terms stay in their pieces."""
    _documents(spark, tmp_path)
    for name in ("tfidf_topk", "lang_centroids"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan


def test_flat_groups_are_ranked_whole(spark, monkeypatch):
    """where many terms of a group weigh the same, none is left out of the ranking."""
    texts = spark.createDataFrame([(i, " ".join(f"q{i}x{k}" for k in range(60)), "en") for i in range(30)], "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(packed_tfidf, "BUCKET", 200)
    got = [(r.rank, r.term) for r in packed_tfidf.best_group_terms(texts, "doc_id", "lang", 5).orderBy("rank").collect()]
    assert got == list(enumerate(sorted(f"q{i}x{k}" for i in range(30) for k in range(60))[:5], 1))
    coarse = packed_tfidf.best_group_terms(texts, "doc_id", "lang", 5, digits=1).orderBy("rank").collect()  # all weights round to 0.0
    every = [t for i in range(30) for k in range(60) for t in (f"q{i}x{k}", f"q{i}x{k}_q{i}x{k + 1}")[: 2 if k < 59 else 1]]
    assert [r.term for r in coarse] == sorted(every)[:5]


def test_field_signals_read_no_keywords_and_no_similarity(spark, sf_dir):
    """all terms of all pairs were weighed, and keywords scored, for four signals that need neither."""
    plan = QUERIES["profile_match_signals"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "counted_terms" not in plan and "row_number" not in plan and "InMemoryRelation" not in plan


def test_field_signals_are_those_of_the_analysis(spark, sf_dir):
    """the narrow way gives what the whole analysis gives."""
    wanted = ("match.required_skills", "match.preferred_skills", "match.seniority", "match.experience")
    docs, postings, pairs = (f(spark, sf_dir).limit(40).persist() for f in (P.resumes, P.postings, P.pairs))
    got = fields_match(spark, from_text(docs), postings, pairs, wanted).select("doc_id", "job_id", "signal_id", "score", "severity", "recommendation")
    whole = Analysis(spark, from_text(docs), postings, pairs)
    want = whole.match_signals.filter(F.col("signal_id").isin(*wanted)).select(*got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and not got.isEmpty()
    whole.close()


def test_coverage_of_arrays_is_that_of_rows(spark):
    """the same counts and shares without a row a skill; nothing asked, nothing owned, a skill owned twice."""
    asked = [("a", True, 0.7), ("b", True, 1.0), ("c", False, 0.85), ("d", False, 0.7)]
    owned = [("a", False), ("b", True), ("c", False), ("x", True), ("b", False)]
    rows = spark.createDataFrame([(1, asked, owned), (2, asked, None), (3, None, owned), (4, asked[2:], owned)],
                                 "k int, a array<struct<skill:string,required:boolean,weight:double>>, o array<struct<name:string,is_demonstrated:boolean>>")
    got = {r.k: (r.n_required, r.n_preferred, r.preferred_hits, round(r.required_share, 9)) for r in matching.with_coverage(rows, F.col("a"), F.col("o")).collect()}
    assert got == {1: (2, 2, 1, round((0.7 * 0.75 + 1.0) / 1.7, 9)), 2: (2, 2, 0, 0.0), 3: (0, 0, 0, 0.0), 4: (0, 2, 1, 0.0)}
