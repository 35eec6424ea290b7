"""Tables that are dealt out where too few files would leave cores idle, and tables kept in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Texts of an Arrow batch at most.
ROWS_A_BATCH = 1_000
#: Bytes of an estimated size up to which a join's side is broadcast.
ESTIMATED = 256 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine (master local), a new one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialized(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: short lineage, survives lost executors. The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"quillspark-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(rows: DataFrame) -> DataFrame:
    """`rows`, in a session whose Arrow batches have ROWS_A_BATCH rows at most, and whose Python workers give memory back.

    Rows hold whole texts here, and a batch is in memory several times, in the JVM and in Python; the
    default of 10,000 rows is meant for short ones. A smaller setting of the caller's stays. Workers live on from task to
    task: with a fixed threshold the C library unmaps arrays of a megabyte when they are freed, instead of keeping them.
    """
    rows.sparkSession.sparkContext.environment.setdefault("MALLOC_MMAP_THRESHOLD_", str(1 << 20))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(setting, "0")) <= ROWS_A_BATCH:
        conf.set(setting, str(ROWS_A_BATCH))
    return rows


def measured_broadcasts(rows: DataFrame) -> DataFrame:
    """`rows`, in a session that broadcasts a join's side of over ESTIMATED bytes only if its measured size, not an estimate, is below the threshold.

    Spark estimates from the size of compressed files and the types of columns: texts composed of keys, arrays and repetitive columns are ten times larger and
    more, and would meet in the driver. Sides that have been shuffled are measured. Explicit broadcasts stay.
    """
    conf = rows.sparkSession.conf
    estimated, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if conf.get(measured, None) is None:
        conf.set(measured, conf.get(estimated))
        conf.set(estimated, str(min(ESTIMATED, _bytes(conf.get(estimated)))))
    return rows


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) * 1024 ** " kmgtp".index((unit or " ")[0].replace("b", " "))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` of fewer files than there are cores in as many partitions; others as they are.

    A small file is one row group, so one task would parse all its texts. Tables of many files are not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores)
