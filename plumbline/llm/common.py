"""What several operators here share: staged tables, text columns, connected components, output files."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ensure_checkpoint_dir

#: White space and words as the contracts of this package define them: six ASCII characters and everything else.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read on from there.

    Unlike ``checkpoint`` the plan runs once, the table is columnar and Spark knows its true size, so a small one
    is broadcast by Spark's own size check and a large one is not. It survives the loss of executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, unless their path has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_plumbline_sent", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(f"{root}/plumbline", f"{folder}/zip/plumbline", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/plumbline", "zip", f"{folder}/zip"))
    sc._plumbline_sent = True


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Before a Python step: bound the rows of an Arrow batch, since one row may be a text of megabytes (a smaller setting
    is kept), and see that the workers have this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (node, root) for every node that has an edge to
    another, root being the component's smallest node.

    Rounds of large-star and small-star steps: each is an aggregation (a minimum, combined before the shuffle) and an
    equi-join that Spark may split where a node has very many edges. Every round is staged; rows never outnumber the
    edges. Self-loops and repeated edges change nothing; no edges give no rows.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = mark
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lowest)
        now = stage(small.distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
