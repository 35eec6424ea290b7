"""Readers, history, limiter, breaker: small files and plain loops."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.sources.history import History
from quillspark.sources.readers import detect_format, documents_from_pages, extract, read_files
from quillspark.streaming import stateful

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def paragraph(text: str, listed: bool = False) -> str:
    return f"<w:p>{'<w:pPr><w:numPr/></w:pPr>' if listed else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_reads_files_and_reports_errors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("caf\xe9 notes".encode("cp1252"))
    (tmp_path / "sub" / "b.docx").write_bytes(docx(paragraph("Head") + paragraph("point", True) + f"<w:tbl><w:tr><w:tc>{paragraph('x')}</w:tc><w:tc>{paragraph('x')}</w:tc><w:tc>{paragraph('y')}</w:tc></w:tr></w:tbl>"))
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04 broken word/document.xml")
    (tmp_path / "d.txt").write_bytes(b"   ")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "f.png").write_bytes(b"x")
    docs, errors = extract(read_files(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: r for r in docs.collect()}
    assert got["a.txt"].text == "café notes" and got["b.docx"].text == "Head\n- point\nx | y" and got["b.docx"].table_count == 1
    assert {r.path.rsplit("/", 1)[1]: r.code for r in errors.collect()} == {"c.docx": "extraction_failed", "d.txt": "empty_document", "e.pdf": "extraction_failed"}


def test_detects_formats(spark):
    rows = [(b"%PDF-1", "x"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "x.doc"), (b"{\\rtf1", "x.rtf"), (b"PK\x03\x04zzz", "x.zip"), (b"hello", "x.bin"), (b"\0\1", "x.bin")]
    df = spark.createDataFrame(rows, "content binary, path string")
    assert [r[0] for r in df.select(detect_format(F.col("content"), F.col("path"))).collect()] == ["pdf", None, None, None, "txt", None]


def test_pages_to_documents(spark):
    pages = spark.createDataFrame([("p", 1, "ﬁrst page " * 40), ("p", 0, "short\nlines\n" * 60), ("p", 2, "")], "path string, index int, text string")
    r = documents_from_pages(pages).first()
    assert r.page_count == 3 and r.warnings == ["1 page(s) without text"] and r.text.startswith("short") and "first page" in r.text


def analyses(spark, store, ids, base=datetime(2024, 5, 1)):
    rows = [(x, base + timedelta(days=i), "f", "txt", "h", 50.0, 1.0, 1.0, 1.0, None, None, None, 10, 1, False, "{}", "me@example.com") for i, x in enumerate(ids)]
    return spark.createDataFrame(rows, store.rows().schema)


def test_history(spark, tmp_path):
    store = History(spark, str(tmp_path / "h"), buckets=4)
    assert store.list()[0] == 0 and not store.delete("id0")
    store.save(analyses(spark, store, [f"id{i}" for i in range(3)]))
    total, page = store.list(limit=2)
    assert total == 3 and [r.id for r in page.collect()] == ["id2", "id1"]
    assert store.get("id1").first().resume_text == "[EMAIL]"
    assert store.delete("id1") and not store.delete("id1") and store.list()[0] == 2
    assert store.repeats().first().n == 2


def test_history_saved_again_and_compacted(spark, tmp_path):
    store = History(spark, str(tmp_path / "h"), buckets=4)
    store.save(analyses(spark, store, [f"id{i}" for i in range(20)]))
    for i in (1, 2, 3):
        assert store.delete(f"id{i}")
    store.save(analyses(spark, store, ["id1"]))  # an older created_at, saved later
    assert store.get("id1").count() == 1 and store.get("id2").isEmpty()
    before = sorted(r.id for r in store.rows().collect())
    store.compact()
    assert sorted(r.id for r in store.rows().collect()) == before and len(before) == 18
    files = list((tmp_path / "h" / "analyses").glob("bucket=*/*.parquet"))
    assert len(files) <= 4 and store._read("deleted", "id string, deleted_at timestamp, bucket int").isEmpty()
    assert store.delete("id1") and store.get("id1").isEmpty() and store.list()[0] == 17


def test_history_lookup_opens_one_bucket(spark, tmp_path):
    store = History(spark, str(tmp_path / "h"), buckets=8)
    store.save(analyses(spark, store, [f"id{i}" for i in range(60)]))
    found = store.get("id7")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and len(list((tmp_path / "h" / "analyses").glob("bucket=*"))) == 8
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d\)\]", plan) and "EqualTo(id,id7)" in plan


def test_history_does_not_hide_faults(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    (tmp_path / "h" / "analyses").mkdir(parents=True)
    (tmp_path / "h" / "analyses" / "bucket=0").write_text("no table")
    with pytest.raises(Exception) as e:  # noqa: PT011  whatever Spark makes of it
        History(spark, str(tmp_path / "h")).rows().collect()
    assert not isinstance(e.value, AnalysisException) or e.value.getCondition() != "PATH_NOT_FOUND"


def test_json_arrays(spark, tmp_path):
    import json

    from quillspark.sources.history import write_json_arrays

    df = spark.createDataFrame([(f"f{i}.txt", i * 1.5, ["a", "b"]) for i in range(30)] + [("f1.txt", 0.0, None)] * 2, "file string, overall double, skills array<string>")
    write_json_arrays(df, str(tmp_path / "out"), "file", 4)
    found = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("bucket=*/part-*")]
    assert len(found) == 4 and sum(map(len, found)) == 32 and all([r["file"] for r in x] == sorted(r["file"] for r in x) for x in found)


def events(spark, n=300):
    base = datetime(2024, 1, 1)
    rows = [(i, i % 3, base + timedelta(seconds=(i * 7) % 500), i % 4 != 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, key long, ts timestamp, ok boolean")


def test_limiter_and_breaker_against_loops(spark):
    rows, df = events(spark)
    got = {r.event_id: r.allowed for r in stateful.rate_limited(df, 5, 60.0).collect()}
    trace = {r.event_id: r.blocked for r in stateful.breaker_trace(df, 2, 30.0).collect()}
    want, blocked = {}, {}
    for k in range(3):
        taken, fails, opened = [], 0, None
        for i, _, ts, ok in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            at = ts.timestamp()
            live = [t for t in taken if t >= at - 60]
            want[i] = len(live) < 5
            if want[i]:
                taken.append(at)
            if opened is not None and at - opened >= 30:
                opened, fails = None, 1
            blocked[i] = opened is not None
            if not blocked[i]:
                fails = 0 if ok else fails + 1
                if fails >= 2:
                    opened = at
    assert got == want and trace == blocked and not all(want.values()) and any(blocked.values())


def test_null_key_is_one_key(spark):
    """Whatever the Arrow batches: 200 events of a null key, of which 5 may pass, and the same for a large number."""
    base, big = datetime(2024, 1, 1), 2**62 + 1
    rows = [(i, None if i % 2 else big, base + timedelta(milliseconds=i), False) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, key long, ts timestamp, ok boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        allowed = [r.key for r in stateful.rate_limited(df, 5, 60.0).filter("allowed").collect()]
        passed = [r.key for r in stateful.breaker_trace(df, 3, 60.0).filter("not blocked").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert allowed.count(None) == allowed.count(big) == 5 and passed.count(None) == passed.count(big) == 3


def test_batch_job(spark, tmp_path):
    import json
    from pathlib import Path

    from quillspark.plans import batch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Mira Solano\nmira@example.com\n\nEXPERIENCE\nEngineer | Pine Labs | Jan 2016 - Apr 2020\n- Rebuilt the ledger in Go for 24 teams of the firm\n\nSKILLS\nGo, SQL")
    (tmp_path / "in" / "b.txt").write_text("  ")
    (tmp_path / "job.txt").write_text("Backend Engineer\n\nRequirements\n- 3+ years of experience\n- Go and Kafka")
    out = tmp_path / "out"
    counts = batch.run(spark, str(tmp_path / "in"), str(out), str(tmp_path / "job.txt"))
    assert counts["read"] == {"files": 2, "documents": 1, "errors": 1, "truncated": 0, "chars": 151} and counts["score"]["results"] == 1 and counts["postings"] == 1
    lines = lambda name: [x for p in sorted(Path(out, name).glob("part-*")) for x in p.read_text().splitlines()]
    found = [json.loads(x) for x in lines("results")]
    assert len(found) == 1 and found[0]["path"].endswith("a.txt") and set(found[0]["dimensions"]) == {"match", "ats", "content", "structure"}
    assert any(r["signal_id"] == "match.required_skills" and r["evidence"] == ["Kafka"] for r in found[0]["recommendations"])
    text = lines("report")
    assert text[1].startswith("Overall ") and sum(x.startswith(tuple(f"{i}. [" for i in range(1, 9))) for x in text) == 6
    assert [json.loads(x)["code"] for x in lines("errors")] == ["empty_document"]


def test_documented_command(tmp_path):
    """The command line of the README, with a folder of postings."""
    import json
    import os
    import subprocess
    import sys
    from pathlib import Path

    import pyspark

    root = Path(__file__).resolve().parent.parent
    (tmp_path / "in").mkdir()
    (tmp_path / "jobs").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Mira Solano\nmira@example.com\n\nEXPERIENCE\nEngineer | Pine Labs | Jan 2016 - Apr 2020\n- Rebuilt the ledger in Go for 24 teams of the firm\n\nSKILLS\nGo/SQL")
    for name, asked in (("x", "Go and Kafka"), ("y", "Go and SQL"), ("z", "Rust")):
        (tmp_path / "jobs" / f"{name}.txt").write_text(f"Backend Engineer\n\nRequirements\n- {asked}")
    run = subprocess.run([f"{os.path.dirname(pyspark.__file__)}/bin/spark-submit", "--master", "local[2]", "--conf", "spark.ui.enabled=false", "--conf", "spark.sql.shuffle.partitions=2",
                          str(root / "analyse.py"), str(tmp_path / "in"), str(tmp_path / "out"), "--job", str(tmp_path / "jobs"), "--best", "2"],
                         capture_output=True, text=True, timeout=280, env=os.environ | {"PYSPARK_PYTHON": sys.executable}, cwd=tmp_path)
    assert run.returncode == 0, run.stderr[-2_000:]
    counts = json.loads(run.stdout.strip().splitlines()[-1])
    assert counts["read"]["documents"] == 1 and counts["postings"] == 3 and counts["score"]["results"] == 2
    found = [json.loads(x) for p in (tmp_path / "out" / "results").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(Path(r["posting"]).name for r in found) == ["x.txt", "y.txt"]


def test_save_if_possible(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    store = History(spark, str(tmp_path / "file" / "h"))
    empty = spark.createDataFrame([], History(spark, str(tmp_path / "none")).rows().schema)
    assert "Exception" in store.save_if_possible(empty.unionByName(spark.createDataFrame([("i", datetime(2024, 1, 1), *[None] * 15)], empty.schema)))


def streamed(spark, tmp_path, name, df, made, batches=4):
    """The answers to the events of a table that comes in shuffled micro-batches, then late markers; and the state rows left at the end."""
    src, rows = str(tmp_path / "in"), sorted(df.collect(), key=lambda r: hash((r.event_id * 7919) % 101))
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], df.schema).coalesce(1).write.mode("append").parquet(src)
    for i in range(3):  # the watermark passes all events, then all that their keys remember
        spark.createDataFrame([(10**6 + i, -1, datetime(2024, 2, 1 + i), True)], df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = made(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.table(name).filter("key >= 0").collect(), left


def test_limiter_stream_equals_table(spark, tmp_path):
    _, df = events(spark, 120)
    got, left = streamed(spark, tmp_path, "limited", df, lambda s: stateful.rate_limited_stream(s, 5, 60.0, late_s=600))
    assert {r.event_id: (r.allowed, r.retry_after_s) for r in got} == {r.event_id: (r.allowed, r.retry_after_s) for r in stateful.rate_limited(df, 5, 60.0).collect()}
    assert max(left) >= 3 and left[-1] <= 1  # what is left is the marker's


def test_breaker_stream_equals_table(spark, tmp_path):
    _, df = events(spark, 120)
    got, left = streamed(spark, tmp_path, "broken", df, lambda s: stateful.breaker_stream(s, 2, 30.0, late_s=600, forget_s=3_600))
    want = {r.event_id: (r.blocked, r.failures) for r in stateful.breaker_trace(df, 2, 30.0).collect()}
    assert {r.event_id: (r.blocked, r.failures) for r in got} == want and any(b for b, _ in want.values())
    assert max(left) >= 3 and left[-1] <= 1


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.005), ("a", 0.05), ("a", 99.0)], "k string, v double")
    got = {r.le: r.n for r in stateful.histogram(df, ["k"], "v").collect()}
    assert got["0.01"] == 1 and got["0.05"] == 2 and got["30.0"] == 2 and got["+Inf"] == 3


def test_streamed_files_are_read_once(spark, tmp_path):
    """Documents and errors in one pass; a second run takes new files only."""
    from quillspark.sources.readers import extract_all, split_errors, stream_files

    src, out = tmp_path / "in", str(tmp_path / "out")
    (src / "sub").mkdir(parents=True)

    def run():
        done = extract_all(stream_files(spark, str(src))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
        done.trigger(availableNow=True).start().awaitTermination(120)
        return {r.path.rsplit("/", 1)[1]: (r.code, r.text) for r in spark.read.parquet(out).collect()}

    (src / "a.txt").write_bytes(b"notes of a day")
    (src / "sub" / "b.DOCX").write_bytes(docx(paragraph("Head")))
    (src / "skipped.png").write_bytes(b"x")
    assert run() == {"a.txt": (None, "notes of a day"), "b.DOCX": (None, "Head")}
    (src / "a.txt").write_bytes(b"changed later")  # the same file
    (src / "c.docx").write_bytes(b"PK\x03\x04 broken word/document.xml")
    (src / "d.pdf").write_bytes(b"%PDF-1.4")
    got = run()
    assert got["a.txt"][1] == "notes of a day" or len(got) == 5  # a rewritten file may count as new
    assert got["c.docx"][0] == "extraction_failed" and got["d.pdf"][0] == "extraction_failed" and got["b.DOCX"][1] == "Head"
    documents, errors = split_errors(spark.read.parquet(out))
    assert errors.count() == 2 and set(errors.columns) == {"path", "code", "message"} and "code" not in documents.columns
