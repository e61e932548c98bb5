"""Exact global order without a single-task window.

Rows are range-partitioned on the full sort key, each partition is scanned on
its own, and only one summary row per partition is combined. The range
partitions are checkpointed so that both passes see the same split.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.session import durable

BUCKET = "__bucket"


def order_buckets(df: DataFrame, order: list[Column | str], buckets: int | None = None) -> DataFrame:
    """Adds ``__bucket``: ascending range partitions of the sort key.

    Include enough columns to tell tied rows apart; ties on the whole key share
    a bucket. Without ``buckets`` adaptive execution sizes the partitions, which
    stay contiguous and in order when it merges small ones.
    """
    ranged = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)
    return durable(ranged.withColumn(BUCKET, F.spark_partition_id()))


def exclusive_prefix(summary: DataFrame, agg: Column, out: str) -> DataFrame:
    """Prefix aggregate over the preceding buckets (one row per bucket)."""
    w = W.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    return summary.select(BUCKET, agg.over(w).alias(out))


def global_running_sum(df: DataFrame, order: list[Column | str], value: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` over the global order."""
    b = order_buckets(df.withColumn("__v", value), order, buckets)
    start = exclusive_prefix(b.groupBy(BUCKET).agg(F.sum("__v").alias("s")), F.sum("s"), "__start")
    local = F.sum("__v").over(W.partitionBy(BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (b.withColumn("__local", local).join(F.broadcast(start), BUCKET)
            .withColumn(out, F.col("__local") + F.coalesce("__start", F.lit(0))).drop("__local", "__start", "__v", BUCKET))


def global_rank(df: DataFrame, order: list[Column | str], out: str = "pos", buckets: int | None = None) -> DataFrame:
    """0-based position of every row in the global order."""
    return global_running_sum(df, order, F.lit(1), out, buckets).withColumn(out, F.col(out) - 1)


def grouped_rank(df: DataFrame, group: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """0-based position within each group, for groups too large for one task."""
    ranked = global_rank(df, [*group, *order], "__g")
    first = ranked.groupBy(*group).agg(F.min("__g").alias("__first"))
    return ranked.join(first, group).withColumn(out, F.col("__g") - F.col("__first")).drop("__g", "__first")


def hash_rank(df: DataFrame, digest: str, out: str = "pos", by: list[str] | None = None) -> DataFrame:
    """0-based position in digest order, within ``by`` when given.

    Digests are uniform, so their first hex digits split the rows into even
    buckets (65,536 in all, 256 per group) whose counts are the only thing
    combined.
    """
    by = by or []
    b = df.withColumn(BUCKET, F.substring(digest, 1, 2 if by else 4))
    before = W.partitionBy(*by).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    start = b.groupBy(*by, BUCKET).count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = F.row_number().over(W.partitionBy(*by, BUCKET).orderBy(digest)) - 1
    placed = b.withColumn("__local", local).join(start if by else F.broadcast(start), [*by, BUCKET])
    return placed.withColumn(out, F.col("__local").cast("bigint") + F.col("__start")).drop("__local", "__start", BUCKET)


def merge_intervals(df: DataFrame, lo: str, hi: str, buckets: int | None = None) -> DataFrame:
    """Union of closed intervals as disjoint (lo, hi) rows."""
    d = df.select(F.col(lo).alias("lo"), F.col(hi).alias("hi")).distinct()
    b = order_buckets(d, ["lo", "hi"], buckets)
    before = exclusive_prefix(b.groupBy(BUCKET).agg(F.max("hi").alias("m")), F.max("m"), "__reach")
    w = W.partitionBy(BUCKET).orderBy("lo", "hi")
    reach = F.greatest(F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("__reach"))
    flagged = b.join(F.broadcast(before), BUCKET).withColumn(
        "__new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    starts = exclusive_prefix(flagged.groupBy(BUCKET).agg(F.sum("__new").alias("s")), F.sum("s"), "__base")
    island = F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("__base", F.lit(0))
    return (flagged.join(F.broadcast(starts), BUCKET).withColumn("island", island)
            .groupBy("island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi"))
