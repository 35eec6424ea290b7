"""Metrics: windows, replays, compaction, tracked blocks."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.streaming.metrics import SAMPLES, MetricsStore, Tracker

BASE = datetime(2024, 1, 1)


def samples(spark, n, first=0):
    rows = [(BASE + timedelta(seconds=10 * i), "jobs_total", {"b": "2", "a": str(i % 2)}, 1.0, False) for i in range(first, first + n)]
    return spark.createDataFrame(rows + [(BASE + timedelta(seconds=10 * i), "took", None, 0.02 * i, True) for i in range(first, first + n)], SAMPLES)


def totals(store):
    return {(r.name, r.labels): (r.total, r.n) for r in store.totals().collect()}


def test_replays_and_compaction_change_nothing(spark, tmp_path):
    store = MetricsStore(spark, str(tmp_path / "m"))
    assert store.totals().count() == 0
    for batch in (0, 1, 1, 0):
        store.upsert(samples(spark, 30, 30 * batch), batch)
    want = totals(store)
    assert want["jobs_total", '{"a":"0","b":"2"}'] == (30.0, 30) and want["took", "{}"][1] == 60
    store.compact(1)
    store.upsert(samples(spark, 30), 1)  # a replay of what the base holds
    assert totals(store) == want
    store.upsert(samples(spark, 10), 2)
    store.compact(2)
    store.compact(2)
    assert totals(store)["took", "{}"][1] == 70 and store.rows().filter("name = 'took'").agg(F.sum("n")).first()[0] == 70
    assert store.totals(since=BASE + timedelta(minutes=5)).filter("name = 'took'").first().n == 30


def test_stream_into_the_store(spark, tmp_path):
    for i in range(3):
        samples(spark, 20, 20 * i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = MetricsStore(spark, str(tmp_path / "m"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        store.write(stream, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert totals(store)["took", "{}"][1] == 60


def test_tracked_blocks(spark, tmp_path):
    tracker = Tracker()
    with tracker.track("analyse", kind="batch") as facts:
        facts["pages"] = 3
    with pytest.raises(ValueError), tracker.track("analyse", kind="batch"):
        raise ValueError("x")
    assert facts["outcome"] == "ok" and facts["pages"] == 3 and facts["seconds"] >= 0
    assert tracker.flush(spark, str(tmp_path / "s")) == 4 and tracker.flush(spark, str(tmp_path / "s")) == 0
    store = MetricsStore(spark, str(tmp_path / "m"))
    store.upsert(spark.read.parquet(str(tmp_path / "s")), 0)
    assert totals(store)["quillspark_operation_total", '{"kind":"batch","operation":"analyse","outcome":"error"}'] == (1.0, 1)
    lines = [r.line for r in store.exposition().collect()]
    assert "# TYPE quillspark_operation_seconds histogram" in lines and 'quillspark_operation_total{kind="batch",operation="analyse",outcome="ok"} 1.0' in lines
    assert 'quillspark_operation_seconds_bucket{kind="batch",operation="analyse",le="+Inf"} 2' in lines and 'quillspark_operation_seconds_count{kind="batch",operation="analyse"} 2' in lines
