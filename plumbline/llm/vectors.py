"""Vectors of a table as matrices, equal vectors taken together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stage


def has_direction(vector: Column) -> Column:
    """True for a vector that is not null, has no null or non-finite component and is not zero; never null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0.0), F.lit(False))


def usable_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, node, vec) of the rows whose vector has a direction: not null, without null or non-finite components, not zero.
    node hashes the vector: equal vectors are one node (64 bits)."""
    vec = F.col(vector_col).cast("array<double>")
    return table.where(has_direction(vec)).select(F.col(id_col).alias("id"), F.xxhash64(vec).alias("node"), vec.alias("vec"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(node, n, vec) for each different vector: a third of all rows with one vector are one row here, combined before the shuffle."""
    return stage(rows.groupBy("node").agg(F.count("*").alias("n"), F.first("vec").alias("vec")), "vectors")


def matrix(vectors: Sequence[Sequence[float]], dim: int) -> np.ndarray:
    """Rows of ``dim`` doubles; shorter vectors are followed by zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; each is first scaled by its largest component, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True).clip(np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
