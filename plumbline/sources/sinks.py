"""Writing results and reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write a result table; by default an existing result is never overwritten."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(format).save(path)


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; built by ``build()`` and written first when it is not there yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Rows that a report in one text may have.
MAX_REPORT_ROWS = 100_000


def nested_report(df: DataFrame, outer: str, inner: str, values: Sequence[str]) -> DataFrame:
    """One JSON text: outer key -> inner key -> values. For result tables; keys are written in order.
    More than MAX_REPORT_ROWS rows are an error: the whole report is one row."""
    few = df.limit(MAX_REPORT_ROWS + 1).agg(F.assert_true(F.count("*") <= MAX_REPORT_ROWS, F.lit(f"a report of more than {MAX_REPORT_ROWS} rows")).alias("x")).scalar()
    df = df.where(few.isNull())
    entry = F.struct(F.col(inner).cast("string").alias("k"), F.struct(*values).alias("v"))
    per_outer = df.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    whole = per_outer.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(outer).cast("string").alias("k"), F.to_json("m").alias("j"))))).alias("all"))
    body = F.array_join(F.transform(F.map_entries("all"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return whole.select(F.concat(F.lit("{"), body, F.lit("}")).alias("report"))


def percent(c: str | Column, digits: int = 2) -> Column:
    """A share as a percentage, rounded half-even like the reports print it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.bround(c * 100.0, digits)
