"""Incremental forms: every job runs with an availableNow trigger and resumes from its checkpoint."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, schema, path: str, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as a stream; a backlog is worked off in batches of bounded size."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _finish(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, reason: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Stores every judged row under its batch and verdict; rows and counters are read back from there.

    Each batch writes one folder named by its id, so a replayed batch replaces
    its own output instead of adding to it, and the batch is evaluated once.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        judged = reason(df).withColumn("reason", F.coalesce("reason", F.lit("accepted")))
        judged.write.mode("overwrite").partitionBy("reason").parquet(f"{out}/epoch={epoch}")

    _finish(stream.writeStream.foreachBatch(batch), checkpoint)


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """Admitted rows; the verdict is a folder level, so refused rows are not read."""
    return spark.read.parquet(out).filter("reason = 'accepted'").drop("reason", "epoch")


def ingest_counters(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def sliding_counts(stream: DataFrame, time: str, by: list[str], out: str, checkpoint: str) -> None:
    """Events per hour, one partial count per batch; ``sliding_windows`` combines them.

    An event is counted once, in its hour, however late it comes.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        hour = F.floor(F.unix_seconds(time) / 3600).alias("hour")
        df.groupBy(*by, hour).agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _finish(stream.writeStream.foreachBatch(batch), checkpoint)


def sliding_windows(spark: SparkSession, out: str, by: list[str], hours: int = 24) -> DataFrame:
    """(by, start_s, count) for every window of ``hours`` that holds an event, moving by one hour."""
    hourly = spark.read.parquet(out).groupBy(*by, "hour").agg(F.sum("count").alias("count"))
    starts = F.explode(F.sequence(F.col("hour") - (hours - 1), F.col("hour"))).alias("start")
    return hourly.select(*by, starts, "count").groupBy(*by, (F.col("start") * 3600).alias("start_s")).agg(F.sum("count").alias("count"))


def match_stream(stream: DataFrame, rank: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Query micro-batches against the static catalogue; ``rank`` turns a batch into its top lists."""
    def batch(df: DataFrame, epoch: int) -> None:
        rank(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _finish(stream.writeStream.foreachBatch(batch), checkpoint)
