"""Exact quantiles by position in the order of counted values."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.operators.ordering import global_running_sum


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], prefix: str = "q") -> DataFrame:
    """Linear-interpolation quantiles per group: columns prefix0, prefix1, ... and ``n``.

    One plan for groups of every size: equal values are counted, the counts are
    summed along the global order of (group, value), and the values at the two
    ranks around each quantile are picked by partial aggregates. Null values
    don't count; null groups do.
    """
    key = by or ["__all"]
    keyed = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    keyed = keyed if by else keyed.withColumn("__all", F.lit(1))
    run = global_running_sum(keyed, [*key, value], F.col("__c"), "__end").withColumn("__start", F.col("__end") - F.col("__c"))
    size = run.groupBy(*key).agg(F.min("__start").alias("__base"), F.sum("__c").alias("n")).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], "__base", "n")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    placed = run.join(size, same).drop(*[f"__k{i}" for i in range(len(key))])
    start, end = F.col("__start") - F.col("__base"), F.col("__end") - F.col("__base")

    def at(rank):
        return F.min(F.when((start <= rank) & (rank < end), F.col(value)))

    out = []
    for i, p in enumerate(probs):
        rank = F.lit(p) * (F.col("n") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        out.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(f"{prefix}{i}"))
    return placed.groupBy(*key).agg(*out, F.first("n").alias("n")).select(*by, *[f"{prefix}{i}" for i in range(len(probs))], "n")


def group_median(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, by, value, [0.5]).select(*by, F.col("q0").alias(out))
