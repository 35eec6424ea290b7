"""A narrative model's answers: strict JSON form, rules a form cannot state, and calls that a later run doesn't repeat.

An answer is parsed once as a VARIANT, so that unknown keys, wrong types and records that lack a field are seen, which
a plain struct would read as nulls. Answers are kept by the digest of model and prompt, a micro-batch at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.guards import any_of, fabricated_numbers, restore, strip_placeholders
from quillspark.streaming.stateful import Breaker

# An answer's fields with the longest text, and most items of lists; fields of records.
TEXTS = {"headline": 400, "summary_rewrite": 1200}
LISTS = {"strengths": 8, "keyword_guidance": 15, "interview_risks": 8, "integrity_notes": 8}
RECORDS = {"priority_fixes": {"target": 200, "problem": 1200, "fix": 1200, "why_it_matters": 1200},
           "bullet_rewrites": {"original": 1200, "improved": 1200, "rationale": 1200}}
MOST_RECORDS, MOST_CHARS = 5, 1200
FIELDS = (*TEXTS, *LISTS, *RECORDS)

_RECORD = {name: f"struct<{','.join(f'{f}:string' for f in fields)}>" for name, fields in RECORDS.items()}
_ANSWER = "struct<" + ",".join([*[f"{x}:string" for x in TEXTS], *[f"{x}:array<string>" for x in LISTS], *[f"{x}:array<{r}>" for x, r in _RECORD.items()]]) + ">"


def _json(answer: Column) -> Column:
    """The object within an answer, whatever stands around it, as a VARIANT; null if that is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")))


def answer_problems(answer: Column) -> Column:
    """What keeps an answer from the form, in the order of FIELDS: not_json, missing:x, type:x, too_long:x, extra:x. Empty if nothing does."""
    value = _json(answer)
    held = F.try_variant_get(value, "$", "map<string,variant>")
    found = []
    for x in FIELDS:
        mine = F.element_at(held, F.lit(x))
        kind = F.schema_of_variant(mine)
        if x in TEXTS:
            wrong, long = kind != "STRING", F.length(F.try_variant_get(value, f"$.{x}", "string")) > TEXTS[x]
        elif x in LISTS:
            wrong, long = ~kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)
        else:
            whole = "OBJECT<" + ", ".join(f"{f}: STRING" for f in sorted(RECORDS[x])) + ">"
            items = F.try_variant_get(value, f"$.{x}", "array<variant>")
            wrong = items.isNull() | F.exists(items, _differs(whole))
            long = F.exists(F.try_variant_get(value, f"$.{x}", f"array<{_RECORD[x]}>"), _too_long(RECORDS[x]))
        found.append(F.when(~F.map_contains_key(held, F.lit(x)), f"missing:{x}").when(wrong, f"type:{x}").when(long, f"too_long:{x}"))
    extra = F.transform(F.array_sort(F.filter(F.map_keys(held), lambda k: ~k.isin(*FIELDS))), lambda k: F.concat(F.lit("extra:"), k))
    return F.when(value.isNull() | held.isNull(), F.array(F.lit("not_json"))).otherwise(F.concat(F.array_compact(F.array(*found)), extra))


def _differs(kind: str) -> Callable[[Column], Column]:
    return lambda item: F.schema_of_variant(item) != kind


def _too_long(most: dict[str, int]) -> Callable[[Column], Column]:
    return lambda record: any_of([F.length(record[f]) > n for f, n in most.items()])


def parse_answer(answer: Column, problems: Column) -> Column:
    """The answer as a struct of FIELDS; null if it has problems."""
    return F.when(F.size(problems) == 0, F.try_variant_get(_json(answer), "$", _ANSWER))


def validate_answer(parsed: Column, source: Column, contact: Column) -> Column:
    """The answer with contact values back in place, at most so many items, and without figures that the source lacks; `dropped` says what went."""
    back = lambda x: restore(x, contact)

    def cleaned(items: Column, most: int) -> Column:
        kept = F.filter(F.transform(F.slice(items, 1, most), lambda i: T.strip(back(i))), lambda i: i != "")
        return F.array_distinct(F.transform(kept, lambda i: F.substring(i, 1, MOST_CHARS)))

    rewrites = F.transform(F.slice(parsed["bullet_rewrites"], 1, MOST_RECORDS), lambda r: F.struct(r.alias("r"), fabricated_numbers(r["improved"], source).alias("new")))
    records = lambda name, rows, take: F.transform(rows, lambda r: F.struct(*[back(take(r)[f]).alias(f) for f in RECORDS[name]]))
    summary = T.strip(back(parsed["summary_rewrite"]))
    bold = F.size(fabricated_numbers(summary, source)) > 0
    lost = F.transform(F.filter(rewrites, lambda x: F.size(x["new"]) > 0), lambda x: F.concat(
        F.lit("rewrite with figures not in the document ("), F.array_join(x["new"], ", "), F.lit("): "), F.substring(x["r"]["improved"], 1, 120)))
    return F.when(parsed.isNotNull(), F.struct(
        T.strip(back(parsed["headline"])).alias("headline"), F.when(bold, "").when(F.contains(summary, F.lit("[")), strip_placeholders(summary)).otherwise(summary).alias("summary_rewrite"),
        *[cleaned(parsed[x], n).alias(x) for x, n in LISTS.items()],
        records("priority_fixes", F.slice(parsed["priority_fixes"], 1, MOST_RECORDS), lambda r: r).alias("priority_fixes"),
        records("bullet_rewrites", F.filter(rewrites, lambda x: F.size(x["new"]) == 0), lambda x: x["r"]).alias("bullet_rewrites"),
        F.concat(lost, F.when(bold, F.array(F.lit("summary with figures not in the document"))).otherwise(F.array().cast("array<string>"))).alias("dropped")))


# ---------------------------------------------------------------- calls

USAGE = "model string, input_tokens long, output_tokens long, cache_read_tokens long, latency_ms double, request_id string"
STORED = f"digest string, answer string, status string, {USAGE}, answered_at timestamp"


def prompt_digest(prompt: Column, model: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(model), prompt), 256)


class Narrator:
    """Answers to prompts through an injected callable, kept in a store.

    call(prompt) gives a dict with `text`, or `refused`, and what it knows of USAGE; it may raise. Statuses: answered, refused, circuit_open (not called,
    as too many calls before it in its task had failed), or the name of what was raised. Only answered and refused prompts are not called again.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, call: Callable[[str], dict], most_failures: int = 4, cooldown_s: float = 60.0):
        self.spark, self.path, self.model, self.call = spark, path, model, call
        self.most_failures, self.cooldown_s = most_failures, cooldown_s

    def answers(self) -> DataFrame:
        """STORED of each prompt called; the last status of those called again."""
        try:
            rows = self.spark.read.schema(STORED).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], STORED)
        last = F.max_by(F.struct(*rows.columns), F.struct(F.col("status").isin("answered", "refused"), "answered_at"))
        return rows.groupBy("digest").agg(last.alias("r")).select("r.*")

    def narrate(self, prompts: DataFrame, batch_id: int | None = None) -> None:
        """Calls for the prompts that have no answer, equal ones once. For `foreachBatch` too: a replayed batch finds its answers."""
        call, model, most, cooldown = self.call, self.model, self.most_failures, self.cooldown_s

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            breaker = Breaker(most, cooldown)
            for pdf in batches:
                rows = []
                for digest, prompt in zip(pdf["digest"], pdf["prompt"]):
                    began, got, status = time.monotonic(), {}, "circuit_open"
                    if not breaker.is_open(began):
                        try:
                            got = call(prompt)
                            status = "refused" if got.get("refused") else "answered"
                        except Exception as e:  # the reason is the result here
                            status = type(e).__name__
                        breaker.record(status in ("answered", "refused"), time.monotonic())
                    usage = [got.get(k) for k in ("input_tokens", "output_tokens", "cache_read_tokens")]
                    rows.append((digest, got.get("text"), status, got.get("model", model), *usage, got.get("latency_ms", (time.monotonic() - began) * 1e3), got.get("request_id"), pd.Timestamp.now("UTC")))
                out = pd.DataFrame(rows, columns=[f.split()[0] for f in STORED.split(", ")])
                yield out.astype({c: "Int64" for c in ("input_tokens", "output_tokens", "cache_read_tokens")})

        wanted = prompts.select(prompt_digest(F.col("prompt"), model).alias("digest"), "prompt").dropDuplicates(["digest"])
        done = self.answers().filter(F.col("status").isin("answered", "refused")).select("digest")
        wanted.join(done, "digest", "left_anti").mapInPandas(run, STORED).write.mode("append").parquet(self.path)

    def narrate_all(self, prompts: str, schema: str, checkpoint: str, files_a_batch: int = 10) -> None:
        """All prompts of a Parquet folder, some files at a time: an interrupted run goes on behind the last batch it finished."""
        rows = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(prompts)
        rows.writeStream.foreachBatch(self.narrate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def narratives(prompts: DataFrame, answers: DataFrame, model: str, enabled: bool = True, has_key: bool = True) -> DataFrame:
    """prompts (prompt, source, contact and other columns) with feedback, problems, skipped_reason (null if there is feedback), and usage. Never an exception."""
    if not (enabled and has_key):
        none = F.lit(None)
        return prompts.select("*", none.cast(_ANSWER).alias("feedback"), F.array().cast("array<string>").alias("problems"), F.lit("no_api_key" if enabled else "disabled").alias("skipped_reason"))
    usage = F.struct(*[f.split()[0] for f in USAGE.split(", ")]).alias("usage")
    held = answers.select("digest", "answer", "status", usage)
    rows = prompts.withColumn("digest", prompt_digest(F.col("prompt"), model)).join(held, "digest", "left")
    answered = F.col("status") == "answered"
    rows = rows.withColumn("problems", F.when(answered, answer_problems(F.col("answer"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("feedback", validate_answer(F.when(answered, parse_answer(F.col("answer"), F.col("problems"))), F.col("source"), F.col("contact")))
    reason = F.when(F.col("status").isNull(), "not_called").when(~answered, F.col("status")).when(F.size("problems") > 0, "invalid_schema")
    return rows.withColumn("skipped_reason", reason).drop("digest", "answer", "status")
