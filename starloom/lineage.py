"""Cutting lineage with reliable checkpoints and written tables.

Both live in the folder that the cluster names in `spark.checkpoint.dir`, which every executor shares, so a lost executor costs only its
running tasks. A folder of our own is made only where the session names none and runs on one machine (local tests). Checkpoints are
deleted with their DataFrames where `spark.cleaner.referenceTracking.cleanCheckpoints` is on, as in our sessions; written tables and a
folder of our own are deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Of rows of megabytes: of a row group (read whole) and of a batch for Python (held by the JVM, up to twice its bytes, and by Python).
WIDE_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives Python batches of `WIDE_BYTES` or one row; Spark's own bound is 64 MB for each task."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, WIDE_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="starloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """`df`, written to the checkpoint folder and read from there from now on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, wide: bool = False) -> DataFrame:
    """`df` as a parquet table in the checkpoint folder: a fraction of a checkpoint's bytes where rows are wide, and read by columns.

    `wide` rows are of megabytes: Parquet looks at a row group's size only every hundred rows, so that a task would read hundreds of megabytes at once; here it looks after each.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    options = {"parquet.block.size": WIDE_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "compression": "zstd"} if wide else {}
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: the session may have ended before."""
    try:
        if spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001, S110 - nothing to do for a session that is gone
        pass
