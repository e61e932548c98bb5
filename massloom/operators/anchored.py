"""Anchored grouping of ordered values: a group is bounded by its first member, not by its last."""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions.numeric import tolerance


class Break(NamedTuple):
    """When a value opens a group: gap > max(da, anchor * ppm * 1e-6), or >= when ``closed``."""

    da: float
    ppm: float = 0.0
    closed: bool = False

    def column(self, gap: Column, anchor: Column) -> Column:
        tol = tolerance(anchor, self.ppm, self.da)
        return gap >= tol if self.closed else gap > tol

    def value(self, gap: float, anchor: float) -> bool:
        tol = max(self.da, anchor * self.ppm * 1e-6)
        return gap >= tol if self.closed else gap > tol


def anchored_groups(df: DataFrame, keys: list[str], value: str, rule: Break, carry: list[str],
                    split_at_gaps: bool = False) -> DataFrame:
    """Adds ``run`` and ``sub`` (group number within the run) to the distinct values of each key.

    Membership depends on earlier decisions, so ordered values are scanned once
    with a single remembered anchor: rows stream through in Arrow batches and
    nothing is gathered. With ``split_at_gaps`` a key is first cut wherever the
    gap to the previous value already breaks (such a value opens a group
    whatever came before), so a key with many values spreads over many tasks.
    """
    by = [*keys, "run"]
    runs = _runs(df, keys, value, rule) if split_at_gaps else df.withColumn("run", F.lit(0).cast("bigint"))
    ordered = runs.select(*by, value, *carry).repartition(*by).sortWithinPartitions(*by, value)
    schema = T.StructType([*ordered.schema.fields, T.StructField("sub", T.LongType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, anchor, sub = None, 0.0, 0
        for b in batches:
            out = []
            for group, v in zip(zip(*[b[c] for c in by]), b[value]):
                if group != current:
                    current, anchor, sub = group, v, 1
                elif rule.value(v - anchor, anchor):
                    anchor, sub = v, sub + 1
                out.append(sub)
            yield b.assign(sub=out)

    return ordered.mapInPandas(scan, schema)


def _runs(df: DataFrame, keys: list[str], value: str, rule: Break) -> DataFrame:
    """Run number per row, from windows over unit cells and one row per occupied cell."""
    cells = df.withColumn("__cell", F.floor(F.col(value)))
    w = W.partitionBy(*keys, "__cell").orderBy(value)
    by_key = W.partitionBy(*keys).orderBy("__cell")
    edge = cells.groupBy(*keys, "__cell").agg(F.max(value).alias("__last")) \
        .withColumn("__before", F.lag("__last").over(by_key)).drop("__last")
    prev = F.coalesce(F.lag(value).over(w), F.col("__before"))
    marked = cells.join(edge, [*keys, "__cell"]).withColumn("__prev", prev).withColumn(
        "__new", F.when(F.col("__prev").isNull() | rule.column(F.col(value) - F.col("__prev"), F.col("__prev")), 1).otherwise(0))
    base = marked.groupBy(*keys, "__cell").agg(F.sum("__new").alias("__s")).withColumn(
        "__base", F.coalesce(F.sum("__s").over(by_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    return marked.join(base, [*keys, "__cell"]).withColumn(
        "run", F.col("__base") + F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))


def merge_peak_rows(df: DataFrame, keys: list[str], mz: str, intensity: str, tolerance_da: float = 0.005) -> DataFrame:
    """One survivor per anchored cluster of a key's peaks: most intense, lower m/z on ties."""
    d = df.groupBy(*keys, mz).agg(F.max(intensity).alias(intensity))
    g = anchored_groups(d, keys, mz, Break(tolerance_da, closed=True), [intensity])
    return g.groupBy(*keys, "run", "sub").agg(
        F.min_by(F.struct(mz, intensity), F.struct(-F.col(intensity), F.col(mz))).alias("s")).select(
        *keys, F.col(f"s.{mz}").alias(mz), F.col(f"s.{intensity}").alias(intensity))
