"""What the operators of this subpackage share: shared storage, word splitting, samples."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from typing import BinaryIO

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import ROWS_A_BATCH, materialized, shared_dir, small_batches, spread

#: Bytes that are neither digits, letters nor part of a non-ASCII character, for benchmark words.
_NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER_TO_SPACE = bytes(
    0x20 if b in _NOT_WORD else b for b in bytes(range(256)).lower()
)


@functools.lru_cache(maxsize=1)
def _staging() -> str:
    """The driver's own folder, from which executors fetch files; it goes when the driver ends."""
    folder = tempfile.mkdtemp(prefix="quillspark-files-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def staged(name: str) -> BinaryIO:
    """A new file of the driver, to be filled and then given to `share_file`."""
    return open(os.path.join(_staging(), f"{name}-{uuid.uuid4().hex}"), "wb")


def share_file(spark: SparkSession, path: str) -> str:
    """Sends a driver's file to each executor, once; its name for `SparkFiles.get` there. Its workers can map it into memory."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def labelled_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def bounded_sample(rows: DataFrame, key: str, most: int, stratum: str) -> DataFrame:
    """key, stratum of at most `most` rows of each stratum: those with the smallest hash of the key, the same at every run.

    The strata have to be few (labels, languages): they are counted first, and the hash that about
    three times `most` rows stay below thins each of them before the rows are ranked.
    """
    keys = rows.select(key, stratum)
    share = [x for r in keys.groupBy(stratum).count().collect() for x in (F.lit(r[0]), F.lit(min(1.0, 3 * most / r["count"]))) if r[0] is not None]
    if not share:
        return keys.limit(0)
    order = F.xxhash64(F.col(key)).bitwiseAND(F.lit(2**63 - 1))
    thin = keys.filter(order < F.element_at(F.create_map(*share), F.col(stratum)) * float(2**63))
    w = Window.partitionBy(stratum).orderBy(order, F.col(key))
    return thin.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= most).drop("__rank")


def ascii_words(data: bytes) -> list[bytes]:
    """Words between ASCII white space: [^\\x20\\x09-\\x0D]+ of UTF-8 text."""
    return data.split()


def literal_rows(spark: SparkSession, rows: Sequence[tuple], names: str) -> DataFrame:
    """A few rows known beforehand, as literals of the plan."""
    made = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names.split(), row)]) for row in rows])
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables; `documents`, if it has too few files for all cores, dealt out to them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


__all__ = [
    "LOWER_TO_SPACE", "ROWS_A_BATCH", "StorageLevel", "ascii_words", "bounded_sample", "labelled_fold",
    "literal_rows", "materialized", "share_file", "shared_dir", "small_batches", "staged", "table",
]
