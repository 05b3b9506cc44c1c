"""Near-duplicate vectors by tile products of int8-quantised vectors with rigorous error bounds.

A unit vector x is held as q (int8) times a scale, with the length e of what that misses. For two of them
|x.y - s_x s_y q_x.q_y| <= e_x + e_y + e_x e_y, so a tile product of small whole numbers shows which pairs may reach the threshold, and
only those are computed again in double precision. No pair at or above it is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, small_batches, stage
from plumbline.llm.vectors import distinct_vectors, has_direction, matrix, unit, usable_rows

TILE = 4096
_STRIP, _PAIRS = 1024, 200_000
_TILE_ROW = "nodes binary, counts binary, q binary, scales binary, errors binary, full binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, lengths of the errors) of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-12


def _tile(row: dict) -> dict[str, np.ndarray]:
    nodes = np.frombuffer(row["nodes"], np.int64)
    n = nodes.size
    return {"nodes": nodes, "counts": np.frombuffer(row["counts"], np.int64), "q": np.frombuffer(row["q"], np.int8).reshape(n, -1), "scales": np.frombuffer(row["scales"]),
            "errors": np.frombuffer(row["errors"]), "full": np.frombuffer(row["full"]).reshape(n, -1)}


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of all links one label, the smallest, in place."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if (labels[a] == low).all() and (labels[b] == low).all():
            return
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while not (labels[labels] == labels).all():
            labels[:] = labels[labels]


def tile_links(x: dict[str, np.ndarray], y: dict[str, np.ndarray], same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, their numbers of linked rows, smallest local node reachable) of the pairs between two tiles, or within one."""
    n = x["nodes"].size
    nodes = x["nodes"] if same else np.concatenate([x["nodes"], y["nodes"]])
    counts = x["counts"] if same else np.concatenate([x["counts"], y["counts"]])
    found, labels, shift = np.zeros(nodes.size, dtype=np.int64), np.arange(nodes.size), 0 if same else n
    exact = np.float32 if x["q"].shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of whole numbers are exact in it
    right = y["q"].astype(exact).T
    worst = x["errors"].max() * y["errors"].max() + 1e-5  # also covers the rounding of the bound itself
    for i in range(0, n, _STRIP):
        part = slice(i, i + _STRIP)
        bound = (x["q"][part].astype(exact) @ right) * x["scales"][part, None].astype(exact) * y["scales"][None, :].astype(exact)
        bound += (x["errors"][part, None] + worst).astype(exact)
        bound += y["errors"][None, :].astype(exact)
        a, b = np.nonzero(bound >= threshold)
        a += i
        if same:
            a, b = a[b > a], b[b > a]
        for k in range(0, a.size, _PAIRS):
            p, r = a[k : k + _PAIRS], b[k : k + _PAIRS]
            linked = np.einsum("ij,ij->i", x["full"][p], y["full"][r]) >= threshold
            p, r = p[linked], r[linked] + shift
            np.add.at(found, p, counts[r])
            np.add.at(found, r, counts[p])
            _join(labels, p, r)
    at = np.flatnonzero(found)
    low = pd.Series(nodes).groupby(labels).min()
    return nodes[at], found[at], low.loc[labels[at]].to_numpy()


def near_duplicate_vectors(table: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding; other columns ignored): two rows are linked if the cosine of
    their vectors, in double precision, is at least ``threshold``; a component takes its smallest vec_id.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Shorter vectors are
    read as if followed by zeros. Equal vectors are one node that counts as often as it occurs; rows that repeat an id are counted apart. A row
    without id belongs to its component and is kept only if nothing there has an id. An empty table gives no rows.

    Different vectors are dealt by hash to tiles of about ``TILE``; every pair of tiles is one row of work, whose result is at most one
    row per vector of the two tiles (a number of links and a local root), however dense the group. This computes all products,
    as an exact answer for arbitrary vectors must; the work is spread evenly and memory does not grow.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = usable_rows(table)
    vectors = distinct_vectors(rows)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    dim, tiles = int(size.dim or 1), max(1, -(-size.n // TILE))

    def pack(group: pa.Table) -> pa.Table:
        full = unit(matrix(group.column("vec").to_pylist(), dim))
        q, scales, errors = quantise(full)
        parts = [group.column("tile")[0].as_py(), group.column("node").to_numpy().tobytes(), group.column("n").to_numpy().tobytes(), q.tobytes(), scales.tobytes(), errors.tobytes(), full.tobytes()]
        return pa.table({k: [v] for k, v in zip(("tile", "nodes", "counts", "q", "scales", "errors", "full"), parts, strict=True)})

    dealt = vectors.withColumn("tile", F.pmod("node", F.lit(tiles)).cast("bigint"))
    packed = stage(dealt.groupBy("tile").applyInArrow(pack, f"tile long, {_TILE_ROW}"), "tiles")
    pairs = packed.select(F.col("tile").alias("i"), F.explode(F.sequence(F.col("tile"), F.lit(tiles - 1).cast("bigint"))).alias("j"))
    cell = F.struct("nodes", "counts", "q", "scales", "errors", "full")
    work = pairs.join(packed.select(F.col("tile").alias("i"), cell.alias("x")), "i").join(packed.select(F.col("tile").alias("j"), cell.alias("y")), "j")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                node, links, root = tile_links(_tile(row["x"]), _tile(row["y"]), row["i"] == row["j"], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")  # a row here is two tiles
    try:
        found = stage(work.mapInArrow(product, "node long, links long, root long"), "links")
    finally:
        spark.conf.set(key, before)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = vectors.select("node", "n").join(links, "node", "left").join(roots, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    full = rows.select("id", "node").join(placed, "node")
    lowest = full.groupBy("root").agg(F.min("id").alias("component_id"))
    done = full.join(lowest, "root").select("id", "n_links", "component_id")
    lost = ~has_direction(F.col("embedding").cast("array<double>"))
    alone = table.where(lost).select(F.col("vec_id").alias("id"), F.lit(0).cast("bigint"), F.col("vec_id"))
    return done.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
