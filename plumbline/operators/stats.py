"""Resampling intervals and paired tests.

Bootstrap, always on counted cells, so its cost is cells x replicates whatever the number of rows. ``poisson``: a cell of n rows gets a
Poisson(n) count per replicate, which is what n independent Poisson(1) weights add up to; it is drawn by inversion from a hash of (seed,
replicate, cell), by one rule for every n, so any engine can repeat it. ``multinomial``: each replicate redraws all cell counts together, which is resampling rows with
replacement exactly. All models share the cells, hence one resample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from hashlib import md5
from itertools import groupby
from math import factorial, log, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.digest import md5_heads, message_words, text_bytes
from plumbline.functions.scalars import chi2_1df_p, ratio, snapped, two_sided_p
from plumbline.operators.metrics import cell_counts, with_rates
from plumbline.operators.prefix import running_totals, value_totals
from plumbline.session import cut_lineage

#: A Poisson number of mean n lies within n +- (SPREAD sqrt(n) + MARGIN) but for less than 1e-17; numbers of the table that stand in one running total.
SPREAD, MARGIN, STEP = 9.0, 30, 1024
#: Parts of (0, 1) by which a draw meets the rows of the table.
SLICES = 256


def poisson_table(means: DataFrame, mean: str = "n") -> DataFrame:
    """(n, slice, k, low, high): a uniform number u in [low, high) gives the count k of the Poisson distribution of mean n, exactly
    but for the rounding of doubles, by one rule for every n; ``slice`` is floor(u * SLICES).

    ``means`` holds distinct whole numbers above 0; each gets 18 sqrt(n) + 60 rows. Probabilities are computed for each k by itself and
    added up in blocks of STEP, so no mean is on one task however large it is.
    """
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    reach = F.floor(F.lit(SPREAD) * F.sqrt(n)).cast("bigint") + MARGIN
    first = F.greatest(F.lit(0), F.col("n") - reach).cast("bigint")
    rows = means.select(F.col(mean).alias("n")).select("n", first.alias("_from"), F.explode(F.sequence(first, F.col("n") + reach)).alias("k"))
    # ln p = k ln n - n - ln k!; beyond 20! with Stirling's series, and differences taken before the logarithm.
    small = k * F.log(n) - n - F.log(F.factorial(F.least("k", F.lit(20)).cast("int")).cast("double"))
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / (k * k)) / (k * k)) / (k * k)) / k
    large = (k - n) - (k + 0.5) * F.log(k / n) - F.log(n * (2.0 * pi)) * 0.5 - series
    rows = rows.withColumn("_p", F.exp(F.when(F.col("k") <= 20, small).otherwise(large))).withColumn("_block", F.floor((F.col("k") - F.col("_from")) / STEP))
    inside = Window.partitionBy("n", "_block").orderBy("k")
    rows = rows.withColumn("_upto", F.sum("_p").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_over", F.sum("_p").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = rows.groupBy("n", "_block").agg(F.max("_over").alias("_all"))
    order = Window.partitionBy("n").orderBy("_block")
    before = ends.select("n", "_block", F.coalesce(F.sum("_all").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"), F.lead("_block").over(order).isNull().alias("_final"))
    rows = rows.join(before, ["n", "_block"]).withColumn("high", F.col("_before") + F.col("_upto"))
    rows = rows.withColumn("low", F.coalesce(F.lag("high").over(inside), F.when(F.col("_block") == 0, F.lit(0.0)).otherwise(F.col("_before"))))
    last = F.col("k") == F.col("n") + reach
    rows = rows.withColumn("high", F.when(last, F.lit(1.0)).otherwise(F.least("high", F.lit(1.0)))).where("high > low")
    slices = F.sequence(F.floor(F.col("low") * SLICES), F.least(F.ceil(F.col("high") * SLICES) - 1, F.lit(SLICES - 1)).cast("bigint"))
    return rows.select("n", F.explode(slices).alias("slice"), "k", "low", "high")


def uniform(digest: Column) -> Column:
    """52 bits of a hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def poisson_cells(cells: DataFrame, keys: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """(replicate, keys..., n) with n > 0: the counts ``n`` of the cells drawn again for each replicate, by inversion of the exact distribution.
    Cells of one count share their table, which is staged: the join to it is a broadcast where its size allows."""
    name = F.concat_ws(":", F.lit(seed), F.col("replicate").cast("string"), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    cells = cut_lineage(cells.where("n > 0"))
    table = cut_lineage(poisson_table(cells.select(F.col("n").alias("n")).distinct()))
    # Cells are few and each becomes a thousand rows, so they are dealt out first; a stated number is not coalesced again.
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each step is its own projection, so the digest is computed once.
    drawn = cells.repartition(tasks, *keys).select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select("replicate", *keys, "n", F.md5(name).alias("_d"))
    drawn = drawn.select("replicate", *keys, F.col("n").alias("_n"), uniform(F.col("_d")).alias("_u"))
    drawn = drawn.select("*", F.floor(F.col("_u") * SLICES).alias("_slice"))
    steps = table.toDF(*[f"_t_{c}" for c in table.columns])
    found = drawn.join(steps, (F.col("_n") == F.col("_t_n")) & (F.col("_slice") == F.col("_t_slice")) & (F.col("_u") >= F.col("_t_low")) & (F.col("_u") < F.col("_t_high")))
    return found.select("replicate", *keys, F.col("_t_k").alias("n")).where("n > 0")


def bootstrap_cells(wide: DataFrame, y: str, preds: Sequence[str], replicates: int, seed: str, mode: str = "poisson") -> DataFrame:
    """(replicate, y, preds..., n): resampled counts of every prediction pattern. Binary columns only."""
    cells = [y, *preds]
    draw = {"poisson": poisson_cells, "multinomial": multinomial_replicates}.get(mode)
    if draw is None:
        raise ValueError(f"unknown bootstrap mode {mode!r}")
    return draw(wide.groupBy(*cells).agg(F.count("*").alias("n")), cells, replicates, seed)


def bootstrap_scores(df: DataFrame, keys: Sequence[str], y: str, score: str, replicates: int, seed: str) -> DataFrame:
    """(replicate, keys..., score, pos, neg): score histograms resampled cell by cell, for curves of every replicate."""
    cells = [*keys, F.col(y).cast("int").alias("y"), F.col(score).alias("score")]
    drawn = poisson_cells(df.groupBy(*cells).agg(F.count("*").alias("n")), [*keys, "y", "score"], replicates, seed)
    return drawn.groupBy("replicate", *keys, "score").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))


#: Tries of one binomial draw; each is accepted with a probability above one fifth, so that all fail about once in 10**12 draws.
TRIES = 128


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: bound as the variable of a one-element transform."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _stirling_rest(k: Column) -> Column:
    """ln k! - ((k + 1/2) ln k - k + ln(2 pi) / 2) for whole k >= 1."""
    exact = F.log(F.factorial(F.least(k, F.lit(20.0)).cast("int")).cast("double")) - (k + 0.5) * F.log(k) + k - 0.5 * log(2 * pi)
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / (k * k)) / (k * k)) / (k * k)) / k
    return F.when(k <= 20, exact).otherwise(series)


def _deviance(x: Column, m: Column) -> Column:
    """x ln(x / m) + m - x, without cancellation where x is near m."""
    def near(v: Column) -> Column:
        total = F.lit(1 / 17)
        for j in range(15, 1, -2):
            total = total * v * v + 1 / j
        return (x - m) * v + x * 2.0 * v * v * v * total
    return _let((x - m) / (x + m), lambda v: F.when(F.abs(v) < 0.1, near(v)).otherwise(x * F.log(x / m) + m - x))


def binomial_log_p(k: Column, n: Column, p: Column, q: Column) -> Column:
    """ln of the binomial probability of k out of n, p + q = 1, both positive; all columns doubles."""
    inner = (_stirling_rest(n) - _stirling_rest(F.greatest(k, F.lit(1.0))) - _stirling_rest(F.greatest(n - k, F.lit(1.0))) - _deviance(F.greatest(k, F.lit(1.0)), n * p) - _deviance(F.greatest(n - k, F.lit(1.0)), n * q)
             + 0.5 * F.log(n / (F.greatest(k * (n - k), F.lit(1.0)) * (2 * pi))))
    return F.when(k <= 0, n * F.log(q)).when(k >= n, n * F.log(p)).otherwise(inner)


def binomial_draw(n: Column, p: Column, q: Column, seeds: Sequence[Column]) -> Column:
    """A binomial number of trials ``n`` (whole) with probability p, q = 1 - p, from hashes of ``seeds``.

    Rejection from a hat of a flat middle and exponential tails around the mode, which covers every log-concave distribution and
    takes about five tries whatever n is: exact but for the rounding of doubles and the 2**-53 steps of the uniform numbers.
    """
    size = n.cast("double")
    uniform_of = lambda i, j: F.shiftrightunsigned(F.xxhash64(*seeds, i, F.lit(j)), 11).cast("double") / float(2**53)

    def draw(b: Column) -> Column:
        mode, top = b["mode"], F.exp(b["log_top"])
        width = top * 0.5 + 1.0

        def attempt(i: Column) -> Column:
            u, v, level = uniform_of(i, 1), uniform_of(i, 2), uniform_of(i, 3)
            y = F.when(u <= width / (width + 1.0), v * width / top).otherwise((width - F.log(F.lit(1.0) - v)) / top)

            def judged(far: Column) -> Column:
                x = F.when(uniform_of(i, 4) < 0.5, -F.floor(far + 0.5)).otherwise(F.floor(far + 0.5)).cast("double") + mode
                return _let(x, lambda at: F.struct(
                    ((at >= 0) & (at <= size) & (F.log(level + 1e-300) + F.least(F.lit(0.0), width - top * far) <= binomial_log_p(F.greatest(F.lit(0.0), F.least(at, size)), size, p, q) - b["log_top"])).alias("done"), at.cast("bigint").alias("k")))
            return _let(F.least(y, size + 1.0), judged)
        start = F.struct(F.lit(False).alias("done"), F.lit(-1).cast("bigint").alias("k"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), start, lambda acc, i: F.when(acc["done"], acc).otherwise(attempt(i)))["k"]

    mode = F.least(F.floor((size + 1.0) * p).cast("double"), size)
    one = _let(mode, lambda m: F.struct(m.alias("mode"), binomial_log_p(m, size, p, q).alias("log_top")))
    return F.when(n <= 0, F.lit(0).cast("bigint")).when(q <= 0, n).when(p <= 0, F.lit(0).cast("bigint")).otherwise(_let(one, draw))


def multinomial_replicates(cells: DataFrame, keys: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """Redraw cell counts ``n`` for each replicate from Multinomial(sum n, n / sum n), for any number of cells.

    The cells, in the order of a hash, are the leaves of a binary tree. From the root down the count of every node is split between its two
    children by a binomial draw with their shares, level by level: an equi-join with the table of the level's nodes and a draw
    from hashes of (seed, replicate, node), so the result does not depend on partitioning and no task holds all cells.
    """
    cells = cells.where("n > 0").withColumn("_place", F.struct(F.xxhash64(F.lit(seed), *keys).alias("h"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    ranked = running_totals(cells.withColumn("_one", F.lit(1).cast("bigint")), [], ["_place"], F.shiftright(F.col("_place.h"), 52), {"_leaf": "_one"})
    ranked = cut_lineage(ranked.select(*keys, "n", (F.col("_leaf") - 1).alias("_leaf")))
    total = ranked.agg(F.count("*").alias("m"), F.sum("n").alias("n")).first()
    depth = max(0, (total.m - 1).bit_length()) if total.m else 0
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = cells.sparkSession.range(0, replicates if total.m else 0, 1, tasks).select(F.col("id").cast("int").alias("replicate"), F.lit(0).cast("bigint").alias("_node"), F.lit(total.n or 0).cast("bigint").alias("_n"))
    for level in range(1, depth + 1):
        nodes = ranked.groupBy(F.shiftright("_leaf", depth - level + 1).alias("_node")).agg(
            F.sum(F.when(F.shiftright("_leaf", depth - level) % 2 == 0, F.col("n")).otherwise(0)).cast("double").alias("_left"), F.sum("n").cast("double").alias("_all"))
        split = drawn.join(cut_lineage(nodes), "_node")
        left = binomial_draw(F.col("_n"), F.col("_left") / F.col("_all"), (F.col("_all") - F.col("_left")) / F.col("_all"), [F.lit(seed), F.col("replicate"), F.lit(level), F.col("_node")])
        split = split.select("replicate", "_node", "_n", left.alias("_l"))
        drawn = split.select("replicate", F.explode(F.array(F.struct((F.col("_node") * 2).alias("_node"), F.col("_l").alias("_n")), F.struct((F.col("_node") * 2 + 1).alias("_node"), (F.col("_n") - F.col("_l")).alias("_n")))).alias("_c")).select("replicate", "_c.*").where("_n > 0")
    return drawn.join(ranked.select(*keys, F.col("_leaf").alias("_node")), "_node").select("replicate", *keys, F.col("_n").alias("n"))


#: Cells that a task holds and counts at a time, and blocks of replicates at most.
LOT, MOST_BLOCKS = 2**19, 40
#: Replicates and draws that are hashed together, which stay near a core's cache; counted rows that leave together.
AT_ONCE, DRAWS, ROWS_OUT = 8, 2**16, 2**16
#: Leading bits of a draw that look up its count.
HEAD_BITS = 12


@lru_cache(maxsize=4096)
def poisson_bounds(mean: int) -> tuple[int, np.ndarray]:
    """The first count k and the upper ends of the intervals of u for it and those after it: the rule of ``poisson_table`` for one mean."""
    reach = int(SPREAD * mean**0.5) + MARGIN
    first = max(0, mean - reach)
    k, n = np.arange(first, mean + reach + 1, dtype="float64"), float(mean)
    small = k[k <= 20]
    k = k[len(small):]
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (k * k)) / (k * k)) / (k * k)) / k
    logs = [small * log(n) - n - np.log(np.array([float(factorial(int(x))) for x in small])), (k - n) - (k + 0.5) * np.log(k / n) - log(n * (2 * pi)) * 0.5 - series]
    high = np.minimum(np.cumsum(np.exp(np.concatenate(logs))), 1.0)
    high[-1] = 1.0
    return first, high


@lru_cache(maxsize=256)
def poisson_heads(mean: int) -> np.ndarray:
    """The count for each value of a draw's first HEAD_BITS bits; -1 where they leave it open."""
    first, high = poisson_bounds(mean)
    low = np.arange(2**HEAD_BITS) / 2.0**HEAD_BITS
    least, most = (np.searchsorted(high, u, side="right") for u in (low, low + (2.0**-HEAD_BITS - 2.0**-52)))
    return np.where(least == most, first + least, -1).astype("float64")


def poisson_counts(heads: np.ndarray, mean: int, draw: Callable[[int], float]) -> np.ndarray:
    """Counts of the Poisson distribution from the first 32 bits of each draw; ``draw`` gives one in full, for the few that these leave open."""
    flat = heads.reshape(-1)
    first, high = poisson_bounds(mean)
    k = poisson_heads(mean)[flat >> np.array(32 - HEAD_BITS, "u4")] if flat.size >= 2**HEAD_BITS else np.full(flat.size, -1.0)
    rest = np.flatnonzero(k < 0)
    low = flat[rest] / 2.0**32
    least, most = (np.searchsorted(high, u, side="right") for u in (low, low + (2.0**-32 - 2.0**-52)))
    k[rest] = first + least
    for i in rest[least != most].tolist():
        k[i] = first + np.searchsorted(high, draw(i), side="right")
    return k.reshape(heads.shape)


def _tile_histograms(models: Sequence[str], seed: str, replicates: int, blocks: int):
    """Rows (block, cells), whose cells are an Arrow batch of (name, n, y, a score of each model), to (replicate, model, score, pos, neg); at most LOT cells and a batch are held."""
    def batch_of(rows: list[tuple[int, str, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(total) for _, _, _, total in rows]
        total = np.concatenate([total for _, _, _, total in rows])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([r for r, _, _, _ in rows], "int32"), sizes)), pa.array(np.repeat(np.array([m for _, m, _, _ in rows], object), sizes), pa.string()),
                                           pa.concat_arrays([scores for _, _, scores, _ in rows]), pa.array(total[:, 1]), pa.array(total[:, 0])], names=["replicate", "model", "score", "pos", "neg"])

    def count(block: int, cells: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, sizes = text_bytes(cells["name"].combine_chunks())
        # Cells of one count lie together, and of these the names of one length.
        order = np.lexsort((sizes, cells["n"].to_numpy()))
        texts, sizes, n, y = texts[order], sizes[order], *(cells[c].to_numpy()[order] for c in ("n", "y"))
        coded = [cells[f"s{i}"].combine_chunks().dictionary_encode(null_encoding="encode") for i in range(len(models))]
        both = [(c.indices.to_numpy()[order] * np.int64(2) + y, c.dictionary) for c in coded]
        ends = [*(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)]
        ours = range(replicates * block // blocks, replicates * (block + 1) // blocks)
        rows: list[tuple[int, str, pa.Array, np.ndarray]] = []
        out, held = 0, np.empty((min(AT_ONCE, len(ours)), len(n)))
        for _, alike in groupby(ours, key=lambda r: len(str(r))):
            members = list(alike)
            leads = [f"{seed}:{r}:".encode() for r in members]
            words, lengths = message_words(texts, sizes, len(leads[0]))
            parts = -(-len(members) // AT_ONCE)
            for part in range(parts):
                some = slice(len(members) * part // parts, len(members) * (part + 1) // parts)
                starts = leads[some]
                k = held[:len(starts)]
                step, mean_at = max(1, DRAWS // len(starts)), 0
                for at in range(0, len(n), step):
                    to = min(len(n), at + step)
                    heads = md5_heads(starts, {w: x[at:to] for w, x in words.items()}, lengths[at:to])
                    low = at
                    while low < to:
                        high = min(to, ends[mean_at])
                        # The first 52 bits of a digest are the draw, as ``uniform`` takes them.
                        full = lambda i, low=low, wide=high - low: (int.from_bytes(md5(starts[i // wide] + texts[low + i % wide, :sizes[low + i % wide]].tobytes()).digest()[:7]) >> 4) / 2.0**52
                        k[:, low:high] = poisson_counts(heads[:, low - at:high - at], int(n[low]), full)
                        mean_at += high == ends[mean_at]
                        low = high
                for replicate, drawn in zip(members[some], k, strict=True):
                    for model, (code, scores) in zip(models, both, strict=True):
                        total = np.bincount(code, weights=drawn, minlength=2 * len(scores)).astype("int64").reshape(-1, 2)
                        seen = total.any(axis=1)
                        rows.append((replicate, model, scores.filter(pa.array(seen)), total[seen]))
                        out += len(rows[-1][3])
                        if out >= ROWS_OUT:
                            yield batch_of(rows)
                            rows, out = [], 0
        if rows:
            yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        rows = 0
        for batch in batches:
            for block, part in zip(batch["block"].to_pylist(), batch["cells"], strict=True):
                with pa.ipc.open_stream(part.as_buffer()) as stream:
                    held.setdefault(block, []).extend(stream)
                rows += held[block][-1].num_rows
                if rows >= LOT:
                    for block, parts in held.items():
                        yield from count(block, pa.Table.from_batches(parts))
                    held, rows = {}, 0
        for block, parts in held.items():
            yield from count(block, pa.Table.from_batches(parts))
    return run


def _packed(lots: int):
    """Arrow batches of cells to (lot, cells), a batch a row: the batches of each task go to one lot after the other."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches, TaskContext.get().partitionId()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([i % lots], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["lot", "cells"])
    return pack


def bootstrap_joint_curves(wide: DataFrame, y: str, scores: Mapping[str, str], replicates: int, seed: str) -> DataFrame:
    """(replicate, model, score, pos, neg) for curves of several models on one resample: the cells of all their scores together
    are drawn once, then counted for each model's own scores. ``scores`` maps model to column; cells are the distinct tuples of scores, so for very many
    rows two models at a time have far fewer.

    The draws are those of ``poisson_cells``, but no row is made of a draw: lots of cells meet blocks of replicates, and a task draws the counts
    of its cells, hashed together in arrays, and adds them up by score at once. Shuffled are the cells, packed, once for each block, and the counted scores of each task.
    """
    columns = [y, *scores.values()]
    name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in columns])
    cells = cut_lineage(wide.where(F.col(y).isin(0, 1)).groupBy(*columns).agg(F.count("*").alias("n")).select(
        name.alias("name"), "n", F.col(y).cast("int").alias("y"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(scores.values())]))
    # An eighth of a lot is left free, since batches are dealt out whole.
    lots = max(1, -(-cells.count() * 8 // (LOT * 7)))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(MOST_BLOCKS, replicates, -(-tasks // lots)))
    packed = cells.mapInArrow(_packed(lots), "lot int, cells binary")
    tiles = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*")
    dealt = tiles.repartitionById(blocks * lots, F.col("block") * lots + F.col("lot")).select("block", "cells")
    kind = cells.schema["s0"].dataType.simpleString()
    drawn = dealt.mapInArrow(_tile_histograms(list(scores), seed, replicates, blocks), f"replicate int, model string, score {kind}, pos bigint, neg bigint")
    # A task has counted each score once, so its rows are dealt out as they are.
    return drawn.repartition("replicate", "model", "score").groupBy("replicate", "model", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def model_histograms(cells: DataFrame, y: str, scores: Mapping[str, str]) -> DataFrame:
    """(replicate, model, score, pos, neg) from cells (replicate, y, score columns, n)."""
    per = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in scores.items()]))
    long = cells.select("replicate", F.col(y).alias("y"), "n", per.alias("_m"))
    return long.groupBy("replicate", F.col("_m.model").alias("model"), F.col("_m.score").alias("score")).agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))


def replicate_metrics(cells: DataFrame, y: str, models: dict[str, str], names: Sequence[str]) -> DataFrame:
    """(replicate, model, metrics...) from resampled cells; ``models`` maps model name to prediction column."""
    per = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in models.items()]))
    long = cells.select("replicate", y, "n", per.alias("_m")).select("replicate", F.col(y).alias("y"), "n", "_m.model", "_m.pred")
    counts = long.groupBy("replicate", "model").agg(*cell_counts("y", "pred", F.col("n")))
    return with_rates(counts, names).select("replicate", "model", *names)


def interval(replicates: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, standard error (n-1) and the 2.5 and 97.5 percentiles over replicates. A group holds one row per
    replicate, a number chosen by the caller, so the exact percentile is bounded."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(*keys).agg(F.avg(value).alias("boot_mean"), F.stddev_samp(value).alias("std_error"), q.alias("_q")).select(
        *keys, "boot_mean", "std_error", F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"))


def paired_interval(long: DataFrame, pairs: Sequence[tuple[str, str]], replicates: int) -> DataFrame:
    """Differences of (replicate, model, metric, value) rows between two models of one replicate, with an
    interval, whether it excludes zero, and the two-sided p (at least 1/replicates)."""
    models = sorted({m for p in pairs for m in p})
    wide = long.groupBy("replicate", "metric").agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(f"v_{m}") for m in models])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("model_1"), F.lit(b).alias("model_2"), (F.col(f"v_{a}") - F.col(f"v_{b}")).alias("value")) for a, b in pairs]))
    d = wide.select("replicate", "metric", rows.alias("_p")).select("replicate", "metric", "_p.model_1", "_p.model_2", "_p.value")
    keys = ["model_1", "model_2", "metric"]
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    out = d.groupBy(*keys).agg(
        F.avg("value").alias("boot_mean"), F.stddev_samp("value").alias("std_error"), q.alias("_q"),
        F.avg((F.col("value") <= 0).cast("double")).alias("_le"), F.avg((F.col("value") >= 0).cast("double")).alias("_ge"))
    low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return out.select(*keys, "boot_mean", "std_error", low.alias("ci_low"), high.alias("ci_high"),
                      (~((low <= 0) & (high >= 0))).alias("significant"),
                      F.greatest(F.least("_le", "_ge") * 2.0, F.lit(1.0 / replicates)).alias("p_value"))


# --------------------------------------------------------------------------- paired tests

def signed_rank(df: DataFrame, keys: Sequence[str], delta: str, digits: int = 9, cells: bool = False) -> DataFrame:
    """Wilcoxon signed-rank test of paired differences per group: zeros dropped, mid-ranks, normal p with tie
    correction and no continuity correction. ``cells`` keeps what ``with_p_method`` needs for other p-values.

    Differences are rounded to ``digits`` so that equal differences of decimal scores tie. They are
    counted by size before ranking; only distinct sizes are ordered.
    """
    keys = list(keys)
    cells_ = df.select(*keys, snapped(delta, digits).alias("_d")).groupBy(*keys, "_d").agg(F.count("*").alias("_n"))
    return signed_rank_counted(cells_, keys, "_d", "_n", cells)


def signed_rank_counted(counted: DataFrame, keys: Sequence[str], delta: str, count: str, cells: bool = False) -> DataFrame:
    """``signed_rank`` from rows that stand for ``count`` equal differences each. Groups without any difference other than zero have no row."""
    d = F.col(delta)
    sizes = (counted.where((d != 0) & d.isNotNull() & (F.col(count) > 0)).groupBy(*keys, F.abs(d).alias("_size"))
             .agg(F.sum(count).alias("_t"), F.sum(F.when(d > 0, F.col(count)).otherwise(0)).alias("_up")))
    run = value_totals(sizes, keys, "_size", {"_upto": "_t"})
    t = F.col("_t").cast("double")
    mid = F.col("_upto").cast("double") - (t - 1.0) / 2.0
    # Twice the mid-rank is a whole number, and with the number of ties below it one number of both. Cells are kept for groups alone that are small enough for an exact p.
    cell = F.when(F.col("_upto_all") <= MOST_EXACT_PAIRS, ((F.col("_upto") * 2 - F.col("_t") + 1) * CELL_BASE + F.col("_t")).cast("int"))
    s = run.groupBy(*keys).agg(
        F.max("_upto_all").alias("n"), F.sum(mid * F.col("_up")).alias("w_plus"),
        F.sum(mid * (F.col("_t") - F.col("_up"))).alias("w_minus"), F.sum(t * t * t - t).alias("_ties"), F.max("_t").alias("_most"),
        F.sum(t * F.pow(mid, F.lit(4.0))).alias("_r4"), F.sum(t * F.pow(mid, F.lit(6.0))).alias("_r6"), F.array_sort(F.collect_list(cell)).alias("rank_cells"))
    n = F.col("n").cast("double")
    var = n * (n + 1.0) * (n * 2.0 + 1.0) / 24.0 - F.col("_ties") / 48.0
    z = ratio(F.col("w_plus") - n * (n + 1.0) / 4.0, F.sqrt(var))
    out = s.select(*keys, "n", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("statistic"), z.alias("z"),
                   two_sided_p(z).alias("p_value"), (F.col("_most") > 1).alias("has_ties"), (F.col("_r4") / (var * var)).alias("_k4"), (F.col("_r6") / (var * var * var)).alias("_k6"), F.sqrt(var).alias("_sd"), "rank_cells")
    return out if cells else out.drop("_k4", "_k6", "_sd", "rank_cells")


#: Largest number of pairs of a group for which exact p-values are made: the table of sums grows with its square; what doubled ranks of cells are multiplied by.
MOST_EXACT_PAIRS = 1000
CELL_BASE = 2048


def with_p_method(tests: DataFrame, method: str) -> DataFrame:
    """Replace the normal p of ``signed_rank(..., cells=True)`` by another one; adds ``p_method`` and ``p_error``, and drops the cells.

    ``exact``: from the distribution of the sum of doubled mid-ranks, ties included, made by multiplying its generating function cell by cell; a group of more than
    MOST_EXACT_PAIRS pairs is an error. ``series``: the normal p at the statistic moved by half a step, with two further terms by the fourth and sixth cumulants (the odd
    ones are zero), for any size; p_error is the size of the last term and of the first one left out for the steps. ``exact_or_series``: exact as far as MOST_EXACT_PAIRS, series beyond; p_method tells which.
    ``normal`` needs no cells. No group has a NULL p.
    """
    if method == "normal":
        return tests.withColumn("p_method", F.lit(method))
    if method not in ("exact", "series", "exact_or_series"):
        raise ValueError(f"unknown p method {method!r}")

    @F.pandas_udf(T.DoubleType())
    def exact(cells: pd.Series, w: pd.Series) -> pd.Series:
        # A group's cells come as one array of whole numbers, not as an object a cell.
        def p_value(group: np.ndarray, stat: float) -> float:
            ranks, times = np.divmod(group.astype("int64"), CELL_BASE)
            chance = np.zeros(int(ranks @ times) + 1)
            chance[0], top = 1.0, 0
            for r in np.repeat(ranks, times).tolist():
                chance[: top + r + 1] *= 0.5
                chance[r : top + r + 1] += chance[: top + 1].copy()
                top += r
            return min(1.0, 2.0 * float(chance[: int(round(2 * stat)) + 1].sum()))
        return pd.Series([p_value(g, x) if len(g) else 0.0 for g, x in zip(cells, w, strict=True)], dtype="float64")

    z = F.greatest(F.lit(0.0), F.abs("z") - F.lit(0.5) / F.col("_sd"))
    density = F.exp(z * z / -2.0) * (1.0 / (2 * pi) ** 0.5)
    # Cumulants of a sum of +-r/2: kappa4 = -sum r^4 / 8, kappa6 = sum r^6 / 4, over powers of the variance. Terms of the upper tail, doubled.
    k4, k6 = F.col("_k4") * -0.125, F.col("_k6") * 0.25
    he3, he5 = z * z * z - z * 3.0, F.pow(z, F.lit(5.0)) - z * z * z * 10.0 + z * 15.0
    he7 = F.pow(z, F.lit(7.0)) - F.pow(z, F.lit(5.0)) * 21.0 + z * z * z * 105.0 - z * 105.0
    second, third = density * he3 * k4 / 12.0, density * (he5 * k6 / 360.0 + he7 * k4 * k4 / 576.0)
    series = F.least(F.lit(1.0), F.greatest(F.lit(0.0), two_sided_p(z) + second + third))
    third = F.abs(third) + density * z / (F.col("_sd") * F.col("_sd") * 12.0)
    small = F.col("n") <= MOST_EXACT_PAIRS
    if method == "exact":
        tests = tests.where(F.assert_true(small, F.lit(f"a group of more than {MOST_EXACT_PAIRS} pairs has no exact p-value")).isNull())
    by_table = exact(F.when(small, F.col("rank_cells")).otherwise(F.slice("rank_cells", 1, 0)), F.col("statistic"))
    p, error, name = {"exact": (by_table, F.lit(0.0), F.lit("exact")), "series": (series, third, F.lit("series")),
                      "exact_or_series": (F.when(small, by_table).otherwise(series), F.when(small, F.lit(0.0)).otherwise(third), F.when(small, "exact").otherwise("series"))}[method]
    kept = [c for c in tests.columns if c not in ("_k4", "_k6", "_sd", "rank_cells")]
    out = tests.withColumns({"_p": p, "p_error": error, "p_method": name}).select(*[c for c in kept if c != "p_value"], F.col("_p").alias("p_value"), "p_error", "p_method")
    return out


def mcnemar(gained: Column, lost: Column) -> dict[str, Column]:
    """Continuity-corrected statistic of two discordant counts and its chi-square p; 0 and 1 without any."""
    b, c = gained.cast("double"), lost.cast("double")
    stat = ratio((F.abs(b - c) - 1.0) * (F.abs(b - c) - 1.0), b + c)
    return {"statistic": stat, "p_value": F.when(b + c == 0, F.lit(1.0)).otherwise(chi2_1df_p(stat))}


def correct_multiple(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, keys: Sequence[str] = (), order: Sequence[str] = (),
                     mode: str = "step_down", strict: bool = True) -> DataFrame:
    """Bonferroni and Holm decisions over a family of tests (a result table, so a window per family is small).

    ``step_down`` stops at the first test that fails; ``per_row`` compares each test with its own level.
    """
    family = Window.partitionBy(*keys)
    ranked = family.orderBy(p, *order)
    i = F.row_number().over(ranked)
    m = F.count("*").over(family)
    level = F.lit(alpha) / (m - i + 1)
    t = tests.withColumn("holm_rank", i.cast("bigint")).withColumn("holm_level", level).withColumn("bonferroni_level", F.lit(alpha) / m)
    under = (lambda c: F.col(p) < F.col(c)) if strict else (lambda c: F.col(p) <= F.col(c))
    t = t.withColumn("_ok", under("holm_level"))
    holm = F.col("_ok")
    if mode == "step_down":
        holm = F.min("_ok").over(Window.partitionBy(*keys).orderBy("holm_rank").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("holm_significant", holm).withColumn("bonferroni_significant", under("bonferroni_level")).drop("_ok")


def effect_size(delta: Column) -> Column:
    """Mean over population standard deviation of paired differences (Cohen's d_z)."""
    return ratio(F.avg(delta), F.stddev_pop(delta))
