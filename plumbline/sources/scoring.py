"""Scoring a table with a user's model: batches go through Arrow, results come back as prediction rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PREDICTIONS = "sample_id bigint, model string, score double, pred int"


def score_batches(df: DataFrame, id_col: str, features: str, model: str, scorer: Callable[[np.ndarray], np.ndarray], threshold: float = 0.5) -> DataFrame:
    """Apply ``scorer`` (matrix of features -> probabilities) batch by batch on the executors. Row order and
    batch size do not matter; nothing is gathered."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            p = np.asarray(scorer(np.stack(batch[features].to_numpy()).astype("float64")), dtype="float64")
            yield pd.DataFrame({"sample_id": batch[id_col].astype("int64"), "model": model, "score": p, "pred": (p >= threshold).astype("int32")})
    return df.select(id_col, features).mapInPandas(run, PREDICTIONS)


def linear_scorer(weights: list[float], bias: float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
    w = np.asarray(weights, dtype="float64")
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ w + bias)))
