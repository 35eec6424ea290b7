"""A batch job: files and postings in, JSON results, report, errors and counts out.

    spark-submit analyse.py RESUMES OUT [--job POSTINGS] [--best N] [--as-of DAY]

RESUMES is a file or folder of any store that Spark reads; so is POSTINGS. One posting is scored for every document, of
several each document's N best (by shared skills). OUT gets the folders files (what was read, a row a file), results (a JSON object a
line), report (text), errors and counts (JSON). Exit code 1 if no file could be read.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark import share_code
from quillspark.operators import scoring
from quillspark.plans.engine import Analysis, EngineConfig
from quillspark.sources.history import write_json
from quillspark.sources.readers import extract, extract_all, read_files, split_errors
from quillspark.streaming.metrics import Tracker

#: Recommendations that a report shows.
SHOWN = 6


def report(analysis: Analysis) -> DataFrame:
    """keys, text: headline, a bar a dimension, the first recommendations."""
    keys = analysis.keys
    bars = scoring.report_lines(analysis.dimensions, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("bars"))
    first = analysis.recommendations.filter(F.col("rank") <= SHOWN).withColumn("line", F.format_string("%d. [%s] %s: %s", "rank", "severity", "title", "action"))
    advice = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("advice"))
    rows = analysis.overall.join(bars, keys).join(advice, keys, "left")
    none = F.array().cast("array<string>")
    lines = F.concat(F.array(F.format_string("Overall %.1f (%s)", "overall", "band")), F.transform("bars", lambda x: x["line"]), F.coalesce(F.transform("advice", lambda x: x["line"]), none))
    return rows.select(*keys, F.array_join(lines, "\n").alias("text"))


def _observed(rows: DataFrame, path: str, columns: dict[str, Column]) -> tuple[DataFrame, dict]:
    """The rows as a table of this path, and counts taken while it was written."""
    seen = Observation()
    rows.observe(seen, *[c.alias(name) for name, c in columns.items()]).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path), seen.get


def run(spark: SparkSession, source: str, out: str, postings: str | None = None, config: EngineConfig = EngineConfig()) -> dict:
    """Counts: files, documents, errors, characters, postings, scored; and seconds by step."""
    tracker, counts = Tracker(), {}
    with tracker.track("read") as step:
        rows, counts["read"] = _observed(extract_all(read_files(spark, source), config), f"{out}/files", {
            "files": F.count("*"), "documents": F.count_if(F.col("code").isNull()), "errors": F.count_if(F.col("code").isNotNull()),
            "truncated": F.count_if(F.array_contains("warnings", "truncated")), "chars": F.sum(F.when(F.col("code").isNull(), F.length("text")).otherwise(0))})
    seconds = {"read": step["seconds"]}
    documents, errors = split_errors(rows)
    documents = documents.withColumn("doc_id", F.xxhash64("path"))
    jobs = pairs = None
    if postings is not None:
        read, _ = extract(read_files(spark, postings), config=replace(config, max_chars=config.max_posting_chars))
        jobs = read.select(F.xxhash64("path").alias("job_id"), F.col("path").alias("posting"), "text").persist()
        counts["postings"] = jobs.count()
        if not counts["postings"]:
            raise ValueError(f"no posting could be read from {postings}")
        if counts["postings"] == 1:
            pairs = documents.select("doc_id").crossJoin(F.broadcast(jobs.select("job_id")))  # one posting
    analysis = Analysis(spark, documents, None if jobs is None else jobs.select("job_id", "text"), pairs, config=config)
    try:
        with tracker.track("score") as step:
            found = analysis.results().join(analysis.documents.select("doc_id", "path", "source_format", "warnings"), "doc_id")
            found = found if jobs is None else found.join(jobs.select("job_id", "posting"), "job_id")
            seen = Observation()
            write_json(found.observe(seen, F.count("*").alias("results"), F.avg("overall").alias("mean_overall")), f"{out}/results")
            counts["score"] = seen.get
        seconds["score"] = step["seconds"]
        with tracker.track("report") as step:
            lines = report(analysis).join(analysis.documents.select("doc_id", "path"), "doc_id").orderBy("path", *analysis.keys)
            lines.select(F.concat_ws("\n", "path", "text").alias("value")).write.mode("overwrite").text(f"{out}/report")
            write_json(errors, f"{out}/errors")
        seconds["report"] = step["seconds"]
        counts["seconds"] = seconds
        write_json(spark.createDataFrame([(json.dumps(counts, sort_keys=True),)], "counts string"), f"{out}/counts")
        return counts
    finally:
        analysis.close()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Analyse documents, alone or against postings.")
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--job")
    parser.add_argument("--best", type=int, default=EngineConfig.postings_a_document)
    parser.add_argument("--as-of", default=EngineConfig.as_of)
    given = parser.parse_args(arguments)
    counts = run(share_code(SparkSession.builder.getOrCreate()), given.source, given.out, given.job, EngineConfig(as_of=given.as_of, postings_a_document=given.best))
    print(json.dumps(counts, sort_keys=True))
    return 0 if counts["read"]["documents"] else 1
