"""Counters and histograms of operations: samples, tumbling windows, and a store that a replayed micro-batch doesn't change.

A sample is a row (ts, name, labels, value): a counter's increment, or a duration. Sums and bucket counts merge, so each
micro-batch adds its own partial windows and late samples need no watermark: they add to their window whenever they come.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillspark.functions.lexicon import HISTOGRAM_BOUNDS

SAMPLES = "ts timestamp, name string, labels map<string,string>, value double, timed boolean"
_BUCKETS = [f"b{i}" for i in range(len(HISTOGRAM_BOUNDS) + 1)]
_STORED = "start timestamp, name string, labels string, timed boolean, total decimal(38,9), n long, " + ", ".join(f"{b} long" for b in _BUCKETS)


def canonical(labels: Column) -> Column:
    """JSON of a map, by name."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))))))


def windows(samples: DataFrame, length: str = "1 minute") -> DataFrame:
    """start, name, labels, timed, total (decimal, so that no order of adding matters), n and bucket counts: partial sums of each tumbling window."""
    below = [F.lit(False), *[F.col("value") <= b for b in HISTOGRAM_BOUNDS], F.lit(True)]
    counts = [F.count_if(F.col("timed") & below[i + 1] & ~below[i]).alias(b) for i, b in enumerate(_BUCKETS)]
    return samples.groupBy(F.window("ts", length)["start"].alias("start"), "name", canonical(F.col("labels")).alias("labels"), "timed").agg(
        F.sum(F.col("value").cast("decimal(28,9)")).alias("total"), F.count("*").alias("n"), *counts)


class MetricsStore:
    """Partial windows as Parquet: a folder a micro-batch, which a replay overwrites, and bases that hold all batches up to one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def upsert(self, samples: DataFrame, batch_id: int) -> None:
        """For `foreachBatch`: the same batch again changes nothing, nor does one that a base already holds."""
        if batch_id > self._base():
            windows(samples).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")

    def write(self, samples: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A stream of samples into the store; to be started."""
        return samples.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint)

    def _read(self, kind: str, key: str) -> DataFrame:
        schema = f"{_STORED}, {key} long"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _base(self) -> int:
        """The last batch of the newest base; -1 if there is none."""
        return self._read("bases", "upto").agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def rows(self) -> DataFrame:
        """All partial windows: the newest base and the batches behind it."""
        upto = self._base()
        return self._read("bases", "upto").filter(F.col("upto") == upto).drop("upto").unionByName(self._read("batches", "batch").filter(F.col("batch") > upto).drop("batch"))

    def compact(self, upto: int) -> None:
        """One base of all batches up to one that has been written; older folders are no longer read."""
        if upto > self._base():
            before = self._base()
            rows = self._read("bases", "upto").filter(F.col("upto") == before).drop("upto").unionByName(
                self._read("batches", "batch").filter(F.col("batch").between(before + 1, upto)).drop("batch"))
            self._merged(rows, "start").write.mode("overwrite").parquet(f"{self.path}/bases/upto={upto}")

    @staticmethod
    def _merged(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys, "name", "labels", "timed").agg(*[F.sum(c).alias(c) for c in ("total", "n", *_BUCKETS)])

    def totals(self, since: datetime | None = None) -> DataFrame:
        """name, labels, timed, total, n and bucket counts over all windows, or those that start at a time or later."""
        rows = self.rows()
        return self._merged(rows if since is None else rows.filter(F.col("start") >= F.lit(since))).withColumn("total", F.col("total").cast("double"))

    def exposition(self) -> DataFrame:
        """line: the totals in the text format that scrapers read, in order."""
        totals = self.totals()
        kind = F.when(F.col("timed"), "histogram").otherwise("counter")
        pairs = F.transform(F.map_entries(F.from_json("labels", "map<string,string>")), lambda e: F.format_string('%s="%s"', e["key"], e["value"]))
        named = lambda suffix, *more: F.concat(F.col("name"), F.lit(suffix), braces(F.concat(pairs, F.array(*more).cast("array<string>"))))
        braces = lambda x: F.when(F.size(x) > 0, F.concat(F.lit("{"), F.array_join(x, ","), F.lit("}"))).otherwise("")
        line = lambda name, value: F.concat_ws(" ", name, value.cast("string"))
        bounds, upto = [*map(str, HISTOGRAM_BOUNDS), "+Inf"], F.lit(0)
        buckets = []
        for bound, b in zip(bounds, _BUCKETS):
            upto = upto + F.col(b)
            buckets.append(line(named("_bucket", F.lit(f'le="{bound}"')), upto))
        sampled = F.array(*buckets, line(named("_count"), F.col("n")), F.concat_ws(" ", named("_sum"), F.format_string("%.6f", "total")))
        rows = totals.select("name", kind.alias("kind"), "labels", F.posexplode(F.when(F.col("timed"), sampled).otherwise(F.array(line(named(""), F.col("total"))))).alias("at", "line"))
        heads = totals.select("name", kind.alias("kind"), F.lit("").alias("labels"), F.lit(-1).alias("at"), F.concat_ws(" ", F.lit("# TYPE"), "name", kind).alias("line")).distinct()
        return heads.unionByName(rows).orderBy("kind", "name", "labels", "at").select("line")


class Tracker:
    """Samples of a driver's own operations, to be written where the stream of samples reads."""

    def __init__(self, prefix: str = "quillspark"):
        self.prefix, self.samples = prefix, []

    def increment(self, name: str, value: float = 1.0, **labels: str) -> None:
        self.samples.append((datetime.now(UTC), name, labels, float(value), False))

    def observe(self, name: str, seconds: float, **labels: str) -> None:
        self.samples.append((datetime.now(UTC), name, labels, float(seconds), True))

    @contextmanager
    def track(self, operation: str, **labels: str) -> Iterator[dict]:
        """Times a block: a duration and a count by outcome. What the block puts into the dict comes back with its duration and outcome."""
        began, facts, outcome = time.perf_counter(), {}, "ok"
        try:
            yield facts
        except Exception as e:
            outcome = "error"
            facts["exception"] = type(e).__name__
            raise
        finally:
            facts |= {"seconds": time.perf_counter() - began, "outcome": outcome}
            self.observe(f"{self.prefix}_operation_seconds", facts["seconds"], operation=operation, **labels)
            self.increment(f"{self.prefix}_operation_total", operation=operation, outcome=outcome, **labels)

    def flush(self, spark: SparkSession, path: str) -> int:
        """Appends what was sampled since the last call; how many rows."""
        rows, self.samples = self.samples, []
        if rows:
            spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(path)
        return len(rows)
