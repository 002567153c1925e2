"""Where jobs cut lineage, and how data of a checked size is shared."""

from __future__ import annotations

import ctypes
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, one machine) a local folder is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of an Arrow batch, where the session names none: workers hold several copies of a batch at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the memory of Python workers on long texts; a setting of the session's own is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumora-{name}-{uuid.uuid4().hex}"


_released = [0.0]


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files that nothing refers to any more, every few seconds at most.

    It does so when the driver collects garbage, which a driver with little to do may put off for long, while
    the files of all steps so far fill the executors' disks.
    """
    if time.monotonic() - _released[0] > 3:
        spark.sparkContext._jvm.java.lang.System.gc()
        _released[0] = time.monotonic()


_trimmed = [0.0]


def trim() -> None:
    """Gives the system the memory that this process has freed and holds for later, once a second at most.

    Python workers outlive their tasks; without it each holds what the greediest step so far has left in pieces.
    """
    if time.monotonic() - _trimmed[0] > 1:
        pa.default_memory_pool().release_unused()
        give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if give:
            give(0)
        _trimmed[0] = time.monotonic()


def trimmed(run):
    """``run`` for mapInArrow, with ``trim`` after a partition."""
    def with_trim(batches):
        yield from run(batches)
        trim()
    return with_trim


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage that outlives executors.

    What was shuffled for it is of no use from here on and may go.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that further columns of the input cannot clash with an operator's own."""
    small_batches(df.sparkSession)
    return df.select(*[df[f"`{n}`"] for n in names])
