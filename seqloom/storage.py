"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir. Where the setting is absent only local mode may go on: it gets a temporary folder."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes df and reads it back: lineage ends here and survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes a core from which a scan's rows are read where they lie, if its splits reach a quarter of the cores.
ENOUGH = 32 << 20


def dealt(scan: DataFrame) -> DataFrame:
    """A bare scan's rows over all cores where its files have fewer splits than there are cores and little in each; a larger table is left as it is.

    A small file has few row groups, and what follows a scan (tokens, scores) costs far more than moving its rows once. Where a
    core has ENOUGH to read, moving them is dear and some idle cores are not; with fewer splits than a quarter of the
    cores they are moved all the same.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    if splits >= cores:
        return scan
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan if 4 * splits > cores and size > ENOUGH * cores else scan.repartition(cores)


#: Bytes of an Arrow batch to a Python worker. The JVM holds a batch outside its heap and the worker once or twice more, on every core.
BATCH = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session gives Python workers batches of about BATCH bytes at most (Spark's own limit is 64 MB); a lower limit stays."""
    now = re.fullmatch(r"(\d+)([kmg]?)b?", (spark.conf.get(_LIMIT, None) or "").lower())
    if not now or not 0 < int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= BATCH:
        spark.conf.set(_LIMIT, f"{BATCH}b")
