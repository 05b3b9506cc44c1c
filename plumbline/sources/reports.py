"""Nested metric reports (model -> condition -> metrics) as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRIC_FIELDS = ("accuracy", "precision", "recall", "f1")
COUNT_FIELDS = ("true_positive", "true_negative", "false_positive", "false_negative", "total")


def flatten_report(df: DataFrame, text: str, models_field: str = "models") -> DataFrame:
    """Rows (model, condition, metrics, counts) from a JSON report column."""
    leaf = ", ".join([f"{m}: double" for m in METRIC_FIELDS] + [f"{c}: bigint" for c in COUNT_FIELDS])
    schema = f"{models_field} map<string, map<string, struct<{leaf}>>>"
    parsed = df.select(F.from_json(text, schema).alias("r"))
    models = parsed.select(F.explode(f"r.{models_field}").alias("model", "conditions"))
    rows = models.select("model", F.explode("conditions").alias("condition", "m"))
    return rows.select("model", "condition", *[f"m.{f}" for f in (*METRIC_FIELDS, *COUNT_FIELDS)])
