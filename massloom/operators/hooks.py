"""User-supplied scoring and preparation functions, with their contracts checked."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom import fixed
from massloom.operators.ranking import top_k


def rank_with_adapter(df: DataFrame, query: list[str], inputs: list[str], adapter: Callable[..., pd.Series], pos: str,
                      k: int = fixed.TOP_K) -> DataFrame:
    """Final top k by a user scoring function over candidate columns.

    The function maps column batches to scores; Spark orders them and validates
    that each query got exactly min(k, n) distinct rows of its own.
    """
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = adapter(*[b[c] for c in inputs])
            if len(s) != len(b) or not np.isfinite(s.to_numpy(dtype=float)).all():
                raise ValueError("adapter must return one finite score per candidate")
            yield b[[*query, pos]].assign(adapter_score=s.to_numpy(dtype=float))

    narrow = df.select(*query, pos, *inputs)
    schema = T.StructType([*narrow.select(*query, pos).schema.fields, T.StructField("adapter_score", T.DoubleType())])
    return top_k(narrow.mapInPandas(score, schema), query, [F.col("adapter_score").desc(), F.col(pos)], k)


def adapter_violations(ranked: DataFrame, candidates: DataFrame, query: list[str], pos: str, k: int = fixed.TOP_K) -> DataFrame:
    """Queries whose returned rows are not min(k, n) distinct rows."""
    got = ranked.groupBy(*query).agg(F.count(F.lit(1)).alias("got"), F.count_distinct(pos).alias("unique"))
    want = candidates.groupBy(*query).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("want"))
    return want.join(got, query, "left").filter(
        ~F.col("want").eqNullSafe(F.col("got")) | (F.col("got") != F.col("unique")))


def evidence_udf(fn: Callable[..., pd.Series]):
    """Vectorised evidence in [0, 1] or null, for ``certified_rerank``."""
    return F.pandas_udf(fn, "double")


def prepare_peaks(df: DataFrame, fn: Callable[[pd.Series, pd.Series], pd.Series], peaks: str = "peaks",
                  precursor: str = "precursor_mz") -> DataFrame:
    """Applies a peak pre-processor beside the row it came from; rows left without peaks are flagged, not dropped.

    ``fn`` maps (peak lists, precursors) to lists of {mz, i}.
    """
    udf = F.pandas_udf(fn, "array<struct<mz:double,i:double>>")
    return df.withColumn("prepared", udf(peaks, precursor)).withColumn("rejected", F.size("prepared") == 0)
