"""Near-duplicate documents by MinHash with tensored banding, every candidate verified on its full shingle set.

A band key is not made of hashes of its own. Two small collections of keys are computed, ``LEFT`` and ``RIGHT``, each
key from two or three min-hashes, and every pair (left key, right key) is a table: 8 x 12 = 96 tables of five
hashes each, from 52 min-hashes instead of 480. At similarity 0.8 a pair shares a left key with probability
1 - 0.36^8 and a right key with 1 - 0.488^12, hence a table with 0.9995.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles as sh
from plumbline.llm.common import components, small_batches, stage

#: (keys, min-hashes in each) of the two collections.
LEFT, RIGHT = (8, 2), (12, 3)
_N = LEFT[0] * LEFT[1] + RIGHT[0] * RIGHT[1]
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(0, 2**63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 2**63, _N, dtype=np.uint64)
#: Hashes, and bytes of texts, worked on at once: what is computed from them stays in the processor's cache.
_BLOCK, _BYTES = 1 << 13, 1 << 17
#: Nodes on one side of a comparison inside a task.
_TILE = 512


def _keys_of_sets(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left and the right keys, a row a set, of sets that stand end to end and begin at ``starts``; none is empty."""
    lows = np.full((_N, starts.size), np.iinfo(np.uint64).max)
    for i in range(0, hashes.size, _BLOCK):
        part = hashes[i : i + _BLOCK]
        a, b = np.searchsorted(starts, i, "right") - 1, np.searchsorted(starts, i + part.size)
        at, buffer = np.maximum(starts[a:b] - i, 0), np.empty_like(part)
        for k in range(_N):
            np.bitwise_xor(part, _FLIP[k], out=buffer)
            np.multiply(buffer, _MULTIPLY[k], out=buffer)
            np.minimum(lows[k, a:b], np.minimum.reduceat(buffer, at), out=lows[k, a:b])
    keys, at = [], 0
    for n, width in (LEFT, RIGHT):
        part = lows[at : at + n * width].reshape(n, width, -1)
        at += n * width
        key = np.arange(1, n + 1, dtype=np.uint64)[:, None]
        for j in range(width):
            key = sh.mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
        keys.append(np.ascontiguousarray(key.T).astype(np.int64))
    return keys[0], keys[1]


def _band_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = _keys_of_sets(hashes, np.array([0]))
    return left[0], right[0]


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of some hundred thousand characters of consecutive texts at a time, and where each begins and the last ends; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _BYTES, "right")) - 1)
        yield raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def _summaries(raw: np.ndarray, bounds: np.ndarray, width: int) -> pa.StructArray:
    members, sizes, words = sh.sets_of_texts(raw, bounds, width)
    node = np.zeros(sizes.size, dtype=np.int64)
    node[sizes > 0] = sh.set_hashes(members, sizes[sizes > 0])
    large = sizes >= 4  # two different sets with fewer members are never 80 % alike
    members, of_large = members[np.repeat(large, sizes)], sizes[large]
    left, right = _keys_of_sets(members, np.cumsum(of_large) - of_large)
    histograms = iter(sh.histograms(members, of_large))

    def lists(values: np.ndarray) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum(large) * values.shape[1]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=pa.array(~large))

    columns = [pa.array(node, mask=sizes == 0), pa.array(sizes), pa.array(words), lists(left), lists(right), pa.array([next(histograms) if x else None for x in large], pa.binary())]
    return pa.StructArray.from_arrays(columns, ["node", "n", "words", "left", "right", "histogram"])


def shingle_table(docs: DataFrame, width: int, carry: Sequence[str] = ()) -> DataFrame:
    """(id, t, node, n, words, left, right, histogram) per row of ``docs``: t hashes the text, node the shingle set (null if empty), n is its
    size, words the number of the text's words. Columns named in ``carry`` come along, in a struct of that name.

    Sets of equal content have one node: 64 bits, so two different sets of a billion meet with a chance of 3 in 100.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("node bigint, n bigint, words bigint, left array<bigint>, right array<bigint>, histogram binary")
    def summarise(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [_summaries(raw, bounds, width) for raw, bounds in _blocks(batch)]
            yield pa.concat_arrays(parts) if parts else _summaries(np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64), width)

    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), summarise("text").alias("s"), *more).select("id", "t", "s.*", *(["carry"] if carry else []))


def _texts(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): one document's text for each of ``nodes``."""
    needed = nodes.join(reps.select("node", "id", "t"), "node")
    source = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text").alias("d")
    return stage(source.join(needed.alias("k"), F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.t") == F.col("k.t"))).select("k.node", "d.text"), "texts")


def linked_sets(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``x`` its place and those of the sets of ``y`` that are alike: members are looked up in the sorted members of all y."""
    sizes = np.array([a.size for a in y], dtype=np.int64)
    members, owner = np.concatenate(y), np.repeat(np.arange(len(y)), sizes)
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    for i, a in enumerate(x):
        left, right = np.searchsorted(members, a, "left"), np.searchsorted(members, a, "right")
        n = right - left
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(y))
        found = np.flatnonzero(100 * both >= percent * (a.size + sizes - both))
        if found.size:
            yield i, found


def _across(buckets: DataFrame, roots: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between nodes that share a bucket but are not yet in one component.

    In a bucket the component that is largest overall is the main one, the nodes of others are strays. Each stray is compared once with all
    members of each main component it meets, and strays of the buckets with one smallest member with each other. Both kinds of
    work are cut into tiles of ``_TILE`` nodes, compared inside a task; only links leave it, one for each
    stray and tile, since a link to any member joins the component.
    """
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    placed = buckets.join(roots.join(sizes, "root"), "node", "left").select("key", "low", "node", F.coalesce("root", "node").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    placed = stage(placed, "placed")
    # A bucket of two was tested whole by its star. The few that are mixed are found by one combined aggregation and met again by a join, which is split where a bucket is large.
    unlike = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.struct("size", "root"))["root"].alias("main"), F.count("*").alias("m")).where("r0 <> r1 and m > 2")
    mixed = stage(placed.join(stage(unlike.select("key", "main"), "unlike"), "key").select("low", "node", "root", "main"), "mixed")
    texts = _texts(mixed.select("node").distinct(), reps, docs)
    members = mixed.where("root = main").select("main", "node").distinct()
    strays = mixed.where("root <> main").select("main", "node").distinct()
    among = mixed.where("root <> main").select("low", "node", "root").distinct()

    def tiles(df: DataFrame, by: str, name: str, *more: Column) -> DataFrame:
        return df.groupBy(by).agg(F.count("*").alias(f"{name}_rows"), F.ceil(F.count("*") / _TILE).cast("int").alias(name), *more)

    def tile_of(count: str):
        return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def pool(by: str, rows: int | None):
        return F.pmod(F.xxhash64(by), F.lit(-(-(rows or 1) // _TILE)))

    counts = stage(tiles(members, "main", "tm").join(tiles(strays, "main", "ts"), "main"), "counts")
    of_main = members.join(counts, "main").select("main", "node", tile_of("tm").alias("i"), every("ts").alias("j"), F.lit(False).alias("stray"))
    of_strays = strays.join(counts, "main").select("main", "node", every("tm").alias("i"), tile_of("ts").alias("j"), F.lit(True).alias("stray"))

    def to_main(t: pa.Table) -> pa.Table:
        found, sets, node, stray = [], _sets_of_nodes(t, width), t["node"].to_numpy(), t["stray"].to_numpy()
        for rows in _rows_by(t["main"].to_numpy()):
            m, s = rows[~stray[rows]], rows[stray[rows]]
            if m.size and s.size:
                found += [(node[s[i]], node[m[at[0]]]) for i, at in linked_sets([sets[n] for n in node[s]], [sets[n] for n in node[m]], percent)]
        return _edges(found)

    def to_each_other(t: pa.Table) -> pa.Table:
        found, sets, node, root = [], _sets_of_nodes(t, width), t["node"].to_numpy(), t["root"].to_numpy()
        mine, others = (t["tile"].to_numpy() == t[k][0].as_py() for k in ("i", "j"))
        for rows in _rows_by(t["low"].to_numpy()):
            x, y = rows[mine[rows]], rows[others[rows]]
            if not x.size or not y.size:
                continue
            for i, at in linked_sets([sets[n] for n in node[x]], [sets[n] for n in node[y]], percent):
                at = y[at]
                _, first = np.unique(root[at], return_index=True)  # one link to each component
                found += [(node[x[i]], node[k]) for k in at[first] if root[k] != root[x[i]]]
        return _edges(found)

    # Small groups are handed to Python together, about a tile of rows at a time.
    rows = counts.agg(F.sum(F.col("tm_rows") * F.col("ts") + F.col("ts_rows") * F.col("tm"))).first()[0]
    a = of_main.union(of_strays).join(texts, "node").withColumn("pool", pool("main", rows)).groupBy("pool", "i", "j").applyInArrow(to_main, "a long, b long")
    # Staged, so that Spark knows its size: the join to it is broadcast, or split where one group is large.
    per = stage(tiles(among, "low", "tn", F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("low", "tn", "tn_rows"), "groups")
    own = among.join(per, "low").select("low", "node", "root", tile_of("tn").alias("tile"), every("tn").alias("k"))
    own = own.select("low", "node", "root", "tile", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j")).join(texts, "node")
    rows = per.agg(F.sum(F.col("tn_rows") * F.col("tn"))).first()[0]
    b = own.withColumn("pool", pool("low", rows)).groupBy("pool", "i", "j").applyInArrow(to_each_other, "a long, b long")
    return stage(a.union(b), "links")


def _rows_by(key: np.ndarray) -> list[np.ndarray]:
    """Places of each value of ``key``."""
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if key.size else []


def _sets_of_texts(texts: pa.Array, width: int) -> list[np.ndarray]:
    found = []
    for raw, bounds in _blocks(texts):
        members, sizes, _ = sh.sets_of_texts(raw, bounds, width)
        found += np.split(members, np.cumsum(sizes)[:-1])
    return found


def _sets_of_nodes(t: pa.Table, width: int) -> dict[int, np.ndarray]:
    """The set of each node of a table of nodes and texts."""
    nodes, first = np.unique(t["node"].to_numpy(), return_index=True)
    texts = t["text"].cast(pa.large_string()).take(pa.array(first)).combine_chunks()
    return dict(zip(nodes.tolist(), _sets_of_texts(texts, width), strict=True))


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({k: pa.array([int(e[i]) for e in found], pa.int64()) for i, k in enumerate("ab")})


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the node pairs (a, b) whose full sets are alike.

    First a rigorous bound from the two histograms, a thirtieth of a set each, drops nearly all false candidates; only
    texts of the rest travel.
    """
    @F.pandas_udf("boolean")
    def possible(na: pd.Series, ha: pd.Series, nb: pd.Series, hb: pd.Series) -> pd.Series:
        return pd.Series([100 * (most := min(sh.most_shared(x, y), m, n)) >= percent * (m + n - most) for m, x, n, y in zip(na, ha, nb, hb, strict=True)], dtype=bool)

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        texts = pa.chunked_array([x.cast(pa.large_string()) for x in (a, b)]).combine_chunks().dictionary_encode()  # a text is cut once a batch
        sets, at = _sets_of_texts(texts.dictionary, width), texts.indices.to_numpy().reshape(2, -1)
        return pa.array([100 * (both := sh.shared(x := sets[i], y := sets[j])) >= percent * (x.size + y.size - both) for i, j in at.T], pa.bool_())

    side = reps.select("node", "n", "histogram")
    sized = pairs.join(side.toDF("a", "na", "ha"), "a").join(side.toDF("b", "nb", "hb"), "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    close = stage(sized.where(possible("na", "ha", "nb", "hb")).select("a", "b"), "candidates")
    texts = _texts(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), reps, docs)
    joined = close.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return stage(joined.where(alike("ta", "tb")).select("a", "b").distinct(), "links")


def _grouped(docs: DataFrame, width: int, percent: int, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The shingle table of ``docs``, and (id, t, n, words, root) for its rows that have words, with the columns it carries: rows of one component have one root."""
    if not 80 <= percent <= 100:
        raise ValueError("the tables are made for similarities of 80 per cent or more")
    rows = stage(shingle_table(docs, width, carry), "shingles")
    reps = stage(rows.where("left is not null").groupBy("node").agg(F.first(F.struct("id", "t", "n", "left", "right", "histogram")).alias("r")).select("node", "r.*"), "sets")
    # A table's key is shared only if its right key is: only with right keys that two nodes have are tables made.
    # The smallest and largest member are combined before the shuffle, and members meet them by a join: no task holds a bucket, however many members it has.
    sides = reps.select(F.explode("right").alias("r"), "node")
    common = stage(sides.groupBy("r").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("r"), "common")
    met = stage(sides.join(common, "r", "left_semi"), "met")
    keyed = met.join(reps.select("node", "left"), "node").select(F.explode("left").alias("l"), "r", "node").select(F.xxhash64("l", "r").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    buckets = stage(keyed.join(stage(shared.select("key", "low"), "lows"), "key").select("key", "node", "low"), "buckets")
    stars = buckets.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    links = _verified(stars, reps, docs, width, percent)
    more = _across(buckets, components(links), reps, docs, width, percent)
    roots = components(links.union(more))
    return rows, rows.where("node is not null").join(roots, "node", "left").select("id", "t", "n", "words", F.coalesce("root", "node").alias("root"), *(["carry"] if carry else []))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: documents are linked if their sets of ``width``-word
    shingles satisfy 100 x intersection >= ``percent`` x union, and a component takes its smallest doc_id.

    With fewer words than ``width`` the whole sequence is one shingle. Texts that are null, empty or blank have an empty set and
    are linked with nothing. Rows with equal sets are one node, so exact copies cost no pairs. A row without id belongs to the
    component of its text and is kept only if nothing there has an id; rows that repeat an id get a row each. An empty table
    gives no rows. Other columns are ignored.

    In each bucket of each table all members are first paired with the smallest one. What then shares a bucket but no component is
    compared in tiles (see ``_across``), so no link that the tables offer is lost, and a dense group costs rows in proportion to its size.
    """
    rows, full = _grouped(docs, width, percent)
    lowest = stage(full.groupBy("root").agg(F.min("id").alias("component_id")), "components")
    done = full.join(lowest, "root").select("id", "n", "component_id")
    alone = rows.where("node is null").select("id", "n", F.col("id").alias("component_id"))
    return done.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def clusters(docs: DataFrame, width: int = 5, percent: int = 80, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, words, cluster) for every row of ``docs``, and its columns named in ``carry``: the number of the text's words, and
    one cluster for the members of one component of ``near_duplicates``, null for texts without words."""
    rows, full = _grouped(docs, width, percent, carry)
    named = full.withColumnRenamed("root", "cluster").unionByName(rows.where("node is null"), allowMissingColumns=True)
    return named.select(F.col("id").alias("doc_id"), "words", "cluster", *[F.col(f"carry.`{c}`") for c in carry])


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are one of each component of ``near_duplicates``, and every row whose text has no words.

    The row kept is the one with the smallest (doc_id, hash of the text), rows without id last; of rows equal in both the one whose
    columns come first as JSON, whatever their types. The decision goes by (doc_id, hash of the text), so rows that share an id, or have none, are told apart.
    """
    rows, full = _grouped(docs, width, percent)
    counted = full.groupBy("root", "id", "t").agg(F.count("*").alias("rows"))
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "t", "rows")).alias("f")).select("f.id", "f.t", "f.rows")
    empty = rows.where("node is null").select("id", "t").distinct().select("id", "t", F.lit(1).cast("long").alias("rows"))
    kept = stage(first.union(empty), "kept").alias("k")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.t") == F.col("k.t"))
    single = source.join(kept.where("rows = 1"), same, "left_semi").select("row.*")
    repeated = source.join(kept.where("rows > 1"), same, "left_semi").groupBy("id", "t").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return single.union(repeated)
