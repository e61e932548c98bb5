"""Batch inference from numeric weights and training-table preparation."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom import fixed
from massloom.functions.hashing import salted
from massloom.functions.numeric import logit, sigmoid


def check_weights(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> None:
    """Raises with the names of all requirements that the arrays break."""
    required = {
        "w1 is hidden x inputs": w1.ndim == 2 and b1.shape == w1.shape[:1],
        "w2 is outputs x hidden": w2.ndim == 2 and b2.shape == w2.shape[:1] and w2.shape[1:] == b1.shape,
        "all values are finite": bool(np.isfinite(np.concatenate([np.ravel(a) for a in (w1, b1, w2, b2)])).all()),
    }
    broken = [text for text, holds in required.items() if not holds]
    if broken:
        raise ValueError("weights: not so: " + "; ".join(broken))


def two_layer(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, batch_size: int = 1024) -> Callable[..., Column]:
    """relu(x W1' + b1) W2' + b2 over an array column, Arrow batch by Arrow batch.

    The weights ride in the function's closure: a model is a few MB, loaded once
    per Python worker.
    """
    check_weights(w1, b1, w2, b2)

    def load():
        def predict(x: np.ndarray) -> np.ndarray:
            x = np.asarray(x, dtype=np.float64)
            if not np.isfinite(x).all():
                raise ValueError("a feature vector holds a value that is no number")
            return np.maximum(x @ w1.T + b1, 0) @ w2.T + b2
        return predict

    return predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                             input_tensor_shapes=[[w1.shape[1]]])


def mean_array(df: DataFrame, by: list[str], column: str, weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean of an array column: vectors are summed where they lie, one partial row per group and task is exchanged."""
    vector = array_to_vector(F.col(column))
    mean = Summarizer.mean(vector, F.col(weight).cast("double")) if weight else Summarizer.mean(vector)
    return df.groupBy(*by).agg(vector_to_array(mean).alias(column))


def early_fusion(df: DataFrame, by: list[str], features: str, model: Callable[..., Column]) -> DataFrame:
    """Mean features, then score."""
    return mean_array(df, by, features).withColumn("logits", model(features))


def late_fusion(df: DataFrame, by: list[str], features: str, model: Callable[..., Column]) -> DataFrame:
    """Score each view, mean probability, back to logits (clipped at 1e-7)."""
    p = df.withColumn("__z", model(features)).withColumn("p", F.transform("__z", lambda z: sigmoid(z)))
    return mean_array(p.select(*by, "p"), by, "p").withColumn("logits", F.transform("p", lambda v: logit(v)))


def training_examples(features: Callable[[DataFrame], DataFrame], spectra: DataFrame, key: str, neutral: str, n_keys: int,
                      spectrum: str = "spectrum_id") -> tuple[DataFrame, DataFrame]:
    """Sampled keys (lowest digests) with mean features, and their counts and mean observed mass.

    ``features`` makes the feature rows of the spectra it is given, which are
    those of the sampled keys only.
    """
    from massloom.operators.features import corpus_totals

    picked = spectra.select(key).distinct().orderBy(salted(fixed.SALT_SAMPLE, key)).limit(n_keys)
    chosen = spectra.join(picked, key, "left_semi")
    return corpus_totals(features(chosen.select(spectrum)), chosen, key, neutral, spectrum)


def enrich_distinct(df: DataFrame, column: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs a user function once per distinct string; rows it cannot parse come back null and are the rejects."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.select(column).filter(F.trim(column) != "").distinct().mapInPandas(run, schema)


def mass_sorted(catalog: DataFrame, mass: str = "mass", tie: list[str] = ()) -> DataFrame:
    """Catalogue in (mass, ties) order across and within partitions."""
    return catalog.repartitionByRange(mass, *tie).sortWithinPartitions(mass, *tie)
