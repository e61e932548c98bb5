"""Small models on bounded samples: logistic regression and its calibration."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def labelled_sample(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """Up to ``per_class`` ids of each class, lowest id hashes first: the bound on what a fit sees."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))
    picked = [rows.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return picked[0].unionByName(picked[1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 300, rate: float = 0.1,
             start: np.ndarray | None = None, pull=None):
    """(weights, bias) by full-batch Adam, from ``start``; ``pull`` adds a gradient of its own at weights with the bias behind them."""
    w, b = (np.zeros(x.shape[1]), 0.0) if start is None else (start[:-1].copy(), float(start[-1]))
    g = np.ones(len(y)) if weight is None else weight
    g = g / g.sum()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        r = (sigmoid(x @ w + b) - y) * g
        grad = np.append(r @ x + l2 * w, r.sum())
        if pull is not None:
            grad = grad + pull(np.append(w, b))
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset that make scores probabilities on held-out rows."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    scale = max(1e-9, float(np.std(score)))
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, b = logistic((score / scale)[:, None], target, l2=1e-4, steps=500, rate=0.05)
    return max(float(w[0]), 0.0) / scale, float(b)
