"""A reference index on disk that is built once, follows its input files, and is read by the buckets a search needs.

Layout below one folder: ``keys/batch=.../bucket=...`` holds the index rows, ``done`` which input file was indexed in which batch. An input file is
known by its path, length and time of change, so a changed file is another file. A batch counts only once ``done`` names it: what a lost job
left behind is never read, and rows of files that are gone or have changed are left out. Nothing is rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def key_bucket(key: Column) -> Column:
    """The folder of a key."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def input_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_id, path) of the Parquet files at ``paths``; only the listing is read, not the files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(list(paths))
    return found.select(F.xxhash64("path", "length", "modificationTime").alias("file_id"), "path")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class ReferenceIndex:
    """``rows`` turns a frame read from input files into one with a column ``key`` and whatever the index carries beside it."""

    def __init__(self, spark: SparkSession, folder: str, paths: Sequence[str], rows: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.folder, self.paths, self.rows = spark, folder, list(paths), rows

    def _done(self) -> DataFrame:
        if _exists(self.spark, f"{self.folder}/done"):
            return self.spark.read.schema("file_id long, batch string").parquet(f"{self.folder}/done")
        return self.spark.createDataFrame([], "file_id long, batch string")

    def refresh(self) -> int:
        """Index the input files that are not yet; the number of them. With none nothing is written."""
        missing = input_files(self.spark, self.paths).join(self._done(), "file_id", "left_anti").collect()  # file names, as every read has them
        if not missing:
            return 0
        batch = uuid.uuid4().hex
        ids = self.spark.createDataFrame([(m.file_id, m.path) for m in missing], "file_id long, path string")
        read = self.spark.read.parquet(*[m.path for m in missing]).select("*", F.col("_metadata.file_path").alias("_path"))
        # The listing and the reader spell the scheme differently (file:/ and file:///).
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        keyed = self.rows(read.join(ids.select("file_id", plain("path").alias("_at")), plain("_path") == F.col("_at")).drop("_path", "_at"))
        keyed.withColumns({"batch": F.lit(batch), "bucket": key_bucket(F.col("key"))}).repartition("bucket").write.mode("append").partitionBy("batch", "bucket").parquet(f"{self.folder}/keys")
        ids.select("file_id", F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
        return len(missing)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of all present input files, of some buckets alone if given."""
        current = input_files(self.spark, self.paths).join(self._done(), "file_id").select(F.col("file_id").alias("_f"), F.col("batch").alias("_b"))
        batches = [r[0] for r in current.select("_b").distinct().collect()]
        kept = self.spark.read.parquet(f"{self.folder}/keys").where(F.col("batch").isin(*batches))
        if buckets is not None:
            kept = kept.where(F.col("bucket").isin(*buckets))
        return kept.join(current, (F.col("file_id") == F.col("_f")) & (F.col("batch") == F.col("_b"))).drop("_f", "_b", "batch", "bucket", "file_id")

    def search(self, candidates: DataFrame, key: str) -> DataFrame:
        """Candidates joined with the index rows of an equal key. Only the folders of their keys are read: at most BUCKETS numbers are gathered for that."""
        wanted = [r[0] for r in candidates.where(F.col(key).isNotNull()).select(key_bucket(F.col(key))).distinct().collect()]
        found = self.read(wanted or [-1]).withColumnRenamed("key", "_key")
        return candidates.join(found, F.col(key) == F.col("_key")).drop("_key")
