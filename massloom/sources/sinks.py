"""Ranked-list, report and subset sinks."""
from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators.ranking import ranked_list


def write_ranked_lists(ranked: DataFrame, query: str, guess: str, path: str, order: DataFrame | None = None) -> None:
    """CSV of ``;``-joined guesses, one row per query, in the order of ``order`` (query, row) when given."""
    rows = ranked_list(ranked, query, guess)
    if order is not None:
        rows = order.join(rows, query, "left").repartitionByRange("row").sortWithinPartitions("row")
    rows.select(query, "guesses").write.mode("overwrite").option("header", True).csv(path)


def write_report(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_subset(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def output_order(spark: SparkSession, template: DataFrame | None, groups: DataFrame, key: str) -> DataFrame:
    """(key, row, source): template order when its ids equal the current ids, else the current ids sorted."""
    from massloom.operators.ordering import global_rank

    current = groups.select(key).distinct()
    if template is not None:
        repeated = template.groupBy(key).count().filter("count > 1").limit(1).count()
        differs = template.select(key).join(current.withColumn("__c", F.lit(1)), key, "full_outer") \
            .join(template.select(key, F.lit(1).alias("__t")), key, "left") \
            .filter(F.col("__c").isNull() | F.col("__t").isNull()).limit(1).count()
        if not repeated and not differs:
            return template.select(key, "row").withColumn("source", F.lit("matching_template_ids"))
    return global_rank(current, [key], "row").withColumn("source", F.lit("current_test_ids"))


def materialise(df_builder, signature: str, spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Reuses a table only when it was completed under the same signature.

    Every signature has its own folder, and its mark is written after the data,
    so neither a half-written table nor another version is ever read.
    """
    folder = f"{path}/{hashlib.sha256(signature.encode()).hexdigest()[:32]}"
    try:
        done = spark.read.schema("signature string").json(f"{folder}/mark").first()
    except AnalysisException:  # no such folder yet
        done = None
    if done is not None and done["signature"] == signature:
        return spark.read.parquet(f"{folder}/data"), True
    df_builder().write.mode("overwrite").parquet(f"{folder}/data")
    spark.range(1).select(F.lit(signature).alias("signature")).coalesce(1).write.mode("overwrite").json(f"{folder}/mark")
    return spark.read.parquet(f"{folder}/data"), False
