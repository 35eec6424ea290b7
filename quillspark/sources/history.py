"""Analyses kept as Parquet in buckets of their id: append, page, look up, delete by tombstones, compact, spot repeats."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import materialized

SCHEMA = """id string, created_at timestamp, filename string, source_format string, content_hash string, overall_score double,
    ats_score double, structure_score double, content_score double, match_score double, job_title string, company string,
    word_count int, skill_count int, llm_used boolean, payload string, resume_text string"""


def content_hash(content: Column) -> Column:
    """Hex SHA-256 of bytes or of a text's UTF-8."""
    return F.sha2(content, 256)


def page(rows: DataFrame, created: str, key: str, limit: int = 25, offset: int = 0) -> DataFrame:
    """Newest first, the key as tie-break; 1 to 100 rows."""
    return rows.orderBy(F.desc(created), F.asc(key)).offset(max(0, offset)).limit(min(100, max(1, limit)))


class History:
    """Analyses in buckets of a hash of their id: a look-up opens one bucket's files, whose bloom filters on the id skip what doesn't have it.

    A deletion is a tombstone, which hides what was saved before it; an id saved again afterwards shows. `compact` takes both out of the files. Saves and
    deletions only append and may meet; compaction has to run alone.
    """

    def __init__(self, spark: SparkSession, path: str, redacted: bool = True, buckets: int = 64):
        self.spark, self.path, self.redacted, self.buckets = spark, path, redacted, buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self, bucket: Column | None = None) -> DataFrame:
        """All analyses but those deleted since they were saved; or those of one bucket."""
        kept, gone = self._read("analyses", f"{SCHEMA}, saved_at timestamp, bucket int"), self._read("deleted", "id string, deleted_at timestamp, bucket int")
        if bucket is not None:
            kept, gone = kept.filter(F.col("bucket") == bucket), gone.filter(F.col("bucket") == bucket)
        last = gone.groupBy(F.col("id").alias("__id")).agg(F.max("deleted_at").alias("__gone"))
        live = kept.join(last, (F.col("id") == F.col("__id")) & (F.col("saved_at") <= F.col("__gone")), "left_anti")
        return live.drop("bucket", "saved_at")

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the store; empty only if it is not there."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, mode: str = "append", dynamic: bool = False) -> None:
        writer = rows.write.mode(mode).partitionBy("bucket").option("parquet.bloom.filter.enabled#id", "true")
        (writer.option("partitionOverwriteMode", "dynamic") if dynamic else writer).parquet(f"{self.path}/{name}")

    def save(self, analyses: DataFrame) -> None:
        """Appends; resume_text is redacted unless the store was opened otherwise."""
        from quillspark.operators.guards import redact

        if self.redacted:
            analyses = analyses.withColumn("resume_text", redact(F.col("resume_text")))
        ordered = analyses.select(*[f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ")])
        self._write(ordered.withColumn("saved_at", F.current_timestamp()).withColumn("bucket", self._bucket(F.col("id"))), "analyses")

    def list(self, limit: int = 25, offset: int = 0) -> tuple[int, DataFrame]:
        return self.rows().count(), page(self.rows(), "created_at", "id", limit, offset)

    def get(self, analysis_id: str) -> DataFrame:
        """The row of an id, from one bucket."""
        return self.rows(self._bucket(F.lit(analysis_id))).filter(F.col("id") == analysis_id)

    def save_if_possible(self, analyses: DataFrame) -> str | None:
        """`save`, for callers whose results matter more than their record: what went wrong, or null."""
        try:
            self.save(analyses)
        except (AnalysisException, SparkRuntimeException, Py4JJavaError) as e:
            return f"{type(e).__name__}: {e}"[:300]
        return None

    def delete(self, analysis_id: str) -> bool:
        """False if there is no such row. Appends a tombstone; no file is rewritten, so callers don't meet."""
        if self.get(analysis_id).isEmpty():
            return False
        mark = self.spark.range(1).select(F.lit(analysis_id).alias("id"), F.current_timestamp().alias("deleted_at"))
        self._write(mark.withColumn("bucket", self._bucket(F.col("id"))), "deleted")
        return True

    def compact(self) -> None:
        """Each bucket's files as one, without what is deleted; buckets that nothing is left of, and the tombstones used, go."""
        live = materialized(self._read("analyses", f"{SCHEMA}, saved_at timestamp, bucket int").join(
            self.rows().select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left_semi"), "history-live")
        gone = self._read("deleted", "id string, deleted_at timestamp, bucket int").groupBy("id").agg(F.max("deleted_at").alias("__gone"))
        live = live.join(gone, "id", "left").filter(F.col("__gone").isNull() | (F.col("saved_at") > F.col("__gone"))).select(*live.columns)
        staged = materialized(live, "history-staged")
        self._write(staged.repartition("bucket"), "analyses", "overwrite")
        self._write(self.spark.createDataFrame([], "id string, deleted_at timestamp, bucket int"), "deleted", "overwrite")

    def repeats(self) -> DataFrame:
        return self.rows().groupBy("content_hash").agg(F.count("*").alias("n")).filter("n > 1")


def write_json(results: DataFrame, path: str) -> None:
    """One JSON object a line, one file a partition."""
    results.select(F.to_json(F.struct(*results.columns)).alias("value")).write.mode("overwrite").text(path)


def write_json_arrays(results: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A JSON array a file: {"file": ..., ...} of each row by `key`, in a bucket of its hash; a file has a line an element, so no array is held whole."""
    rows = results.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.col(key).alias("__key"), F.to_json(F.struct(*results.columns)).alias("value"))
    w = Window.partitionBy("bucket").orderBy("__key", "value")
    opens, closes = F.row_number().over(w) == 1, F.lead("value").over(w).isNull()
    lines = rows.select("bucket", F.concat(F.when(opens, "[\n").otherwise(""), "value", F.when(closes, "\n]").otherwise(",")).alias("value"))
    lines.write.mode("overwrite").partitionBy("bucket").text(path)
