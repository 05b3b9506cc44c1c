"""Dataset checks. Every status is computed from the data; nothing is assumed to have passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationFailed(AssertionError):
    """A gate did not hold; the message lists the failing checks."""


def checks_from_aggregates(df: DataFrame, checks: Mapping[str, tuple[Column, Column | float | int]]) -> DataFrame:
    """One row per check: (check_name, observed, expected, passed). All aggregates run in one scan."""
    agg, rows = [], []
    for i, (name, (observed, expected)) in enumerate(checks.items()):
        exp = expected if isinstance(expected, Column) else F.lit(expected)
        agg += [observed.cast("double").alias(f"o{i}"), exp.cast("double").alias(f"e{i}")]
        rows.append(F.struct(F.lit(name).alias("check_name"), F.col(f"o{i}").alias("observed"), F.col(f"e{i}").alias("expected"),
                             F.coalesce(F.col(f"o{i}") == F.col(f"e{i}"), F.lit(False)).alias("passed")))
    return df.agg(*agg).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def gate(checks: DataFrame) -> DataFrame:
    """Raise when a check failed. Only the failing rows (one per check at most) reach the driver."""
    bad = checks.where(~F.col("passed")).select("check_name", "observed", "expected").collect()
    if bad:
        raise ExpectationFailed("; ".join(f"{r.check_name}: observed {r.observed}, expected {r.expected}" for r in bad))
    return checks


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ExpectationFailed(f"missing columns: {missing}")


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check_name, violations, passed) for row-level rules; a rule that is NULL on a row counts as violated."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"v{i}") for i, rule in enumerate(rules.values())])
    rows = [F.struct(F.lit(n).alias("check_name"), F.col(f"v{i}").alias("violations"), (F.col(f"v{i}") == 0).alias("passed"))
            for i, n in enumerate(rules)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pair_checks(df: DataFrame, pair: str, truth: str, split: str) -> DataFrame:
    """Per pair: is there exactly one original (0) and one variant (1), all in one split?

    Counts and min/max only, so a pair id shared by very many rows costs nothing extra.
    """
    return df.groupBy(pair).agg(
        F.count_if(F.col(truth) == 0).alias("n_original"), F.count_if(F.col(truth) == 1).alias("n_variant"),
        (F.min(split) == F.max(split)).alias("one_split"),
    ).withColumn("valid", (F.col("n_original") == 1) & (F.col("n_variant") == 1) & F.col("one_split"))


def status_summary(audit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return audit.groupBy(*keys).agg(
        F.count("*").alias("n_checks"), F.count_if(F.col("status") == "PASS").alias("n_pass"),
        F.count_if(F.col("status") != "PASS").alias("n_fail"))


def ledger_check(ledger: DataFrame, actual: DataFrame, path: str = "path") -> DataFrame:
    """Expected against actual SHA-256 by path: MATCH, MISMATCH, MISSING (no file) or UNLISTED (no entry)."""
    j = ledger.select(path, F.col("sha256").alias("expected")).join(actual.select(path, F.col("sha256").alias("actual")), path, "full_outer")
    status = (F.when(F.col("actual").isNull(), "MISSING").when(F.col("expected").isNull(), "UNLISTED")
               .when(F.lower("actual") == F.lower("expected"), "MATCH").otherwise("MISMATCH"))
    return j.withColumn("status", status)
