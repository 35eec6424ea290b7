"""Answers: form, rules, and calls that are not repeated."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators.answers import FIELDS, RECORDS, Narrator, answer_problems, narratives, parse_answer, validate_answer

GOOD = {x: "" if x in ("headline", "summary_rewrite") else [] for x in FIELDS} | {"headline": "Fine."}
RECORD = {f: "x" for f in RECORDS["priority_fixes"]}


@pytest.mark.parametrize("answer, want", [
    (GOOD, []), ("no object", ["not_json"]), ("[1]", ["not_json"]), (None, ["not_json"]), ("{broken", ["not_json"]), ({}, [f"missing:{x}" for x in FIELDS]),
    *[({k: v for k, v in GOOD.items() if k != x}, [f"missing:{x}"]) for x in FIELDS], *[(GOOD | {x: 7}, [f"type:{x}"]) for x in FIELDS], *[(GOOD | {x: None}, [f"type:{x}"]) for x in FIELDS],
    (GOOD | {"strengths": ["a", 1]}, ["type:strengths"]), (GOOD | {"priority_fixes": [RECORD, {"target": "x"}]}, ["type:priority_fixes"]),
    (GOOD | {"priority_fixes": [RECORD | {"more": "x"}]}, ["type:priority_fixes"]), (GOOD | {"priority_fixes": [RECORD | {"fix": 1}]}, ["type:priority_fixes"]),
    (GOOD | {"priority_fixes": [RECORD]}, []), (GOOD | {"priority_fixes": [RECORD | {"target": "x" * 201}]}, ["too_long:priority_fixes"]),
    (GOOD | {"headline": "x" * 401, "b": 1, "a": 2}, ["too_long:headline", "extra:a", "extra:b"]),
], ids=str)
def test_strict_form(spark, answer, want):
    text = answer if answer is None or isinstance(answer, str) else f"Here it is: {json.dumps(answer)} Bye."
    row = spark.createDataFrame([(text,)], "a string").select(answer_problems(F.col("a")).alias("p")).select("p", parse_answer(F.lit(text), F.col("p")).alias("f")).first()
    assert row.p == want and (row.f is None) == bool(want)


def test_rules_beyond_the_form(spark):
    rewrite = lambda text: {"original": "o", "improved": text, "rationale": "r"}
    answer = GOOD | {"headline": " [CANDIDATE_NAME] is fine ", "strengths": ["a", " a ", "", *"bcdefghij"], "summary_rewrite": "Led 77 people",
                     "bullet_rewrites": [rewrite("Cut cost by 40%"), rewrite("Cut cost by 90%"), rewrite("Mail [EMAIL]"), *[rewrite("x")] * 4]}
    contact = F.struct(*[F.lit(v).alias(c) for c, v in (("name", "Ann Lee"), ("email", "ann@example.com"), ("phone", None), ("linkedin", None), ("github", None), ("website", None), ("location", None))])
    v = spark.range(1).select(validate_answer(parse_answer(F.lit(json.dumps(answer)), answer_problems(F.lit(json.dumps(answer)))), F.lit("cost fell 40%"), contact).alias("v")).first().v
    assert v.headline == "Ann Lee is fine" and v.strengths == ["a", "b", "c", "d", "e", "f"] and v.summary_rewrite == ""
    assert [r.improved for r in v.bullet_rewrites] == ["Cut cost by 40%", "Mail ann@example.com", "x", "x"] and len(v.dropped) == 2


def test_calls_are_not_repeated(spark, tmp_path):
    calls = str(tmp_path / "calls")
    Path(calls).mkdir()

    def call(prompt):
        import uuid

        (Path(calls) / f"{prompt}-{uuid.uuid4().hex}").touch()
        if prompt == "fails" and sum(p.name.startswith("fails-") for p in Path(calls).iterdir()) < 2:
            raise TimeoutError
        return {"refused": True} if prompt == "bad" else {"text": json.dumps(GOOD), "input_tokens": 5, "model": "m-1"}

    schema, prompts = "doc_id long, prompt string, source string, contact struct<name:string,email:string,phone:string,linkedin:string,github:string,website:string,location:string>", str(tmp_path / "prompts")
    rows = [(1, "a", "s", None), (2, "a", "s", None), (3, "bad", "s", None), (4, "fails", "s", None), (5, "later", "s", None)]
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.mode("append").parquet(prompts)
    spark.createDataFrame(rows[3:4], schema).coalesce(1).write.mode("append").parquet(prompts)
    narrator = Narrator(spark, str(tmp_path / "store"), "m", call)
    told = lambda: {r.doc_id: (r.skipped_reason, r.usage.input_tokens if r.usage else None) for r in narratives(spark.createDataFrame(rows, schema), narrator.answers(), "m").collect()}
    narrator.narrate_all(prompts, schema, str(tmp_path / "ck"), 1)
    assert told() == {1: (None, 5), 2: (None, 5), 3: ("refused", None), 4: ("TimeoutError", None), 5: ("not_called", None)}
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.mode("append").parquet(prompts)
    narrator.narrate_all(prompts, schema, str(tmp_path / "ck"), 1)
    narrator.narrate(spark.createDataFrame(rows, schema))
    assert told()[4] == (None, 5) and told()[5] == (None, 5)
    assert sorted(p.name.split("-")[0] for p in Path(calls).iterdir()) == ["a", "bad", "fails", "fails", "later"]
    off = narratives(spark.createDataFrame(rows, schema), narrator.answers(), "m", has_key=False)
    assert {r.skipped_reason for r in off.collect()} == {"no_api_key"}


def test_breaker_spares_calls(spark, tmp_path):
    def call(prompt):
        raise ConnectionError

    narrator = Narrator(spark, str(tmp_path / "store"), "m", call, most_failures=2)
    narrator.narrate(spark.createDataFrame([(f"p{i}",) for i in range(6)], "prompt string").coalesce(1))
    assert sorted(r.status for r in narrator.answers().collect()).count("circuit_open") >= 1
