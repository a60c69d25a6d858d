"""Ridge-penalised logistic regression on a bounded sample, and how that sample is drawn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], most: int) -> pd.DataFrame:
    """text and labels of at most ``most`` labelled documents, those with the smallest hashed ids.

    The ids are drawn first, so the documents are joined with a table of ``most`` rows.
    Rows with a null id, text or label teach nothing.
    """
    known = labels.select("doc_id", *label_cols).dropna().dropDuplicates(["doc_id"])
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    return found.dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
