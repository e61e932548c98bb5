"""Written intermediate tables and Arrow batch limits, shared by the operators."""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from massloom.session import shared_dir

#: Text bytes an operator looks at in one go.
BLOCK_BYTES = 2 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about two megabytes whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))


def block_ids():
    """Numbers for the blocks of the running task, unique over the job."""
    base = TaskContext.get().partitionId() << 32
    n = 0
    while True:
        yield base + n
        n += 1


def bucket_count(spark: SparkSession, total_bytes: float, each: int = 24 << 20) -> int:
    """Buckets of at most about ``each`` bytes, and enough of them for every core."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(max(2 * parts, 32, total_bytes // each + 1))


def hand_back() -> None:
    """Gives free memory of this worker back to the machine: workers wait for later stages and keep what they once took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def modest(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a partition's batches, with free memory handed back at its end."""
    def over(batches):
        yield from run(batches)
        hand_back()

    return over
