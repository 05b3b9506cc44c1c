"""Nearest vectors by a forest of random-projection trees, searched through one priority queue, and exact reranking.

Each tree halves the vectors again and again at the median of their products with a random direction, one direction for each level of a tree. A query goes down all
trees; the side of each split that it does not take enters a queue shared by all trees, at its distance from the query
(the largest distance to any split passed on the way). Sides are taken from the queue, nearest first, as long as
that distance is below ``slack`` x r / sqrt(dimensions), r being the distance of the k-th best vector in the query's own leaves: how far the
neighbours at distance r lie from the query along a random direction. So queries in dense regions look at a few leaves and queries far from everything at many.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, stage
from plumbline.llm.vectors import distinct_vectors, matrix, unit, usable_rows


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors (those with the smallest hashes) that the splits are fitted on; every vector is indexed. Leaves are split while they hold more than
    ``leaf`` vectors by estimate and ``least`` of the sample, so leaves keep their size up to sample x leaf / least vectors (``sample`` is to grow with
    the table beyond that). ``block`` bounds the vectors, and the queries, of neighbouring leaves that a task compares at once."""

    trees: int = 16
    sample: int = 20_000
    leaf: int = 64
    least: int = 4
    block: int = 2048
    slack: float = 0.5
    seed: int = 11


@dataclass
class Tree:
    """Arrays by node; a leaf has below = -1 and its number in ``above``. ``directions`` has a row for each level."""

    directions: np.ndarray
    level: np.ndarray
    at: np.ndarray
    below: np.ndarray
    above: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        products = x @ self.directions.T
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.below[node] >= 0)
            if not inner.size:
                return self.above[node]
            k = node[inner]
            side = products[inner, self.level[k]] > self.at[k]
            node[inner] = np.where(side, self.above[k], self.below[k])

    @property
    def n_leaves(self) -> int:
        return int(self.above[self.below < 0].max()) + 1


def grow(sample: np.ndarray, size: int, rng: np.random.Generator) -> Tree:
    """One tree over ``sample``; a leaf holds at most ``size`` of it, unless its vectors cannot be told apart by the tree's directions. Leaves are numbered
    from one side to the other, so that neighbours in number lie close together."""
    depth = max(1, int(np.ceil(np.log2(max(2, len(sample)) / size))) + 4)
    directions = rng.normal(size=(depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    products = sample @ directions.T
    level, at, below, above, leaf = [], [], [], [], 0
    todo = [(np.arange(len(sample)), -1, False, 0)]
    while todo:
        rows, parent, up, deep = todo.pop()
        me = len(at)
        if parent >= 0:
            (above if up else below)[parent] = me
        p = products[rows, min(deep, depth - 1)]
        cut = float(np.median(p)) if rows.size else 0.0
        level.append(min(deep, depth - 1))
        at.append(cut)
        if rows.size <= size or deep >= depth or not (p > cut).any():
            below.append(-1)
            above.append(leaf)
            leaf += 1
        else:
            below.append(0)
            above.append(0)
            todo += [(rows[p > cut], me, True, deep + 1), (rows[p <= cut], me, False, deep + 1)]
    return Tree(directions, *(np.array(a) for a in (level, at, below, above)))


def lists(trees: list[Tree]) -> list[tuple[list, ...]]:
    """Level, cut, below and above of each tree's nodes as lists, which a walk reads faster."""
    return [tuple(a.tolist() for a in (t.level, t.at, t.below, t.above)) for t in trees]


def probes(trees: list[Tree], x: np.ndarray, reach: float, t_links: list[tuple[list, ...]] | None = None) -> list[tuple[int, int]]:
    """(tree, leaf) that a query visits: its own leaves, and those within ``reach``, nearest first. ``t_links`` may hold ``lists`` of the trees."""
    t_links = t_links or lists(trees)
    products = [(t.directions @ x).tolist() for t in trees]
    queue, found = [(0.0, k, 0) for k in range(len(trees))], []
    while queue:
        far, k, node = heapq.heappop(queue)
        if far > reach:
            break
        level, at, below, above = t_links[k]
        while below[node] >= 0:
            m = products[k][level[node]] - at[node]
            near, other = (above[node], below[node]) if m > 0 else (below[node], above[node])
            heapq.heappush(queue, (max(far, abs(m)), k, other))
            node = near
        found.append((k, above[node]))
    return found


def nearest(table: DataFrame, every: int = 50, k: int = 5, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``table`` (vec_id, embedding; other columns ignored) whose vec_id is divisible by
    ``every``, the k rows found with the largest cosine to it, itself left out, ties to the smaller vec_id; score is the cosine in double precision.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or candidate, nor do rows without id. Shorter
    vectors are read as if followed by zeros. Equal vectors are indexed once with their k + 1 smallest ids, which is all that any
    answer can hold, so copies cost nothing. Rows that repeat an id are candidates of their own, but for the query's own id. Fewer than k candidates
    give fewer rows; an empty table gives none.

    Every vector is indexed in every tree. Queries and the vectors of neighbouring leaves meet in a task, about ``block`` vectors and as many queries at once, and only
    the k + 1 best of a query and its leaves there leave it.
    """
    spark = table.sparkSession
    small_batches(spark, 2048)
    rows = usable_rows(table).where("id is not null")
    vectors = distinct_vectors(rows)
    smallest = Window.partitionBy("node").orderBy("id")
    ids = stage(rows.select("id", "node").withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ids")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = size.n, int(size.dim or 1)
    drawn = vectors.orderBy(F.xxhash64("node"), "node").limit(s.sample).select("vec").toPandas()["vec"]
    sample = unit(matrix(list(drawn), dim)) if len(drawn) else np.zeros((0, dim))
    rng = np.random.default_rng(s.seed)
    trees = [grow(sample, max(s.least, len(sample) * s.leaf // max(n, 1)), rng) for _ in range(s.trees)]
    # Neighbouring leaves go together to a task; a leaf of more vectors than a block, or with more queries, is cut by hashes instead.
    fewest = min(t.n_leaves for t in trees)
    together = max(1, s.block * fewest // max(n, 1))
    blocks = max(1, -(-2 * n // (fewest * s.block)))

    @F.pandas_udf("array<int>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vec in batches:
            x = unit(matrix(list(vec), dim))
            yield pd.Series(np.stack([t.leaves(x) for t in trees], axis=1).astype(np.int32).tolist())

    @F.pandas_udf("array<struct<tree: int, leaf: int>>")
    def search(vec: pd.Series, worst: pd.Series) -> pd.Series:
        x = unit(matrix(list(vec), dim))
        reach = s.slack * np.sqrt(np.maximum(0, 2 - 2 * worst.fillna(-1).to_numpy()) / dim)
        t_links = lists(trees)
        return pd.Series([[{"tree": t, "leaf": leaf} for t, leaf in probes(trees, q, r, t_links)] for q, r in zip(x, reach, strict=True)])

    placed = stage(vectors.select("node", "vec", place("vec").alias("leaves")).join(ids, "node"), "index")
    own = F.explode(F.transform("leaves", lambda leaf, i: F.struct(i.alias("tree"), leaf.alias("leaf"))))
    index = placed.select("node", "vec", F.col("ids")[0].alias("first"), own.alias("p")).select("node", "vec", "first", "p.tree", "p.leaf", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "node").distinct()
    queries = placed.join(asked.select("node").distinct(), "node", "left_semi")

    def best(found: DataFrame) -> DataFrame:
        """The k + 1 best different vectors of each query."""
        order = Window.partitionBy("query").orderBy(F.desc("score"), "first", "node")
        return found.dropDuplicates(["query", "node"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        """Each query against the vectors of the leaves that it visits here: rows that ask hold their leaves."""
        asks, has = g[g["asks"]], g[~g["asks"]].sort_values(["leaf", "first"], kind="stable")
        out = []
        if len(asks) and len(has):
            x, node, first = unit(matrix(list(has["vec"]), dim)), has["node"].to_numpy(), has["first"].to_numpy()
            leaves, starts = np.unique(has["leaf"].to_numpy(), return_index=True)
            spans = list(zip(leaves.tolist(), starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True))
            for i in range(0, len(asks), 256):
                part = asks.iloc[i : i + 256]
                q, visited = unit(matrix(list(part["vec"]), dim)), np.concatenate(part["visits"].to_list())
                owner = np.repeat(np.arange(len(q)), [len(v) for v in part["visits"]])
                score = np.full((len(q), len(x)), -np.inf)
                for leaf, start, stop in spans:  # a query is compared with the leaves that it visits alone
                    here = owner[visited == leaf]
                    if here.size:
                        score[here, start:stop] = q[here] @ x[start:stop].T
                # Ties: the smallest first id, as everywhere.
                top = np.lexsort((np.broadcast_to(first, score.shape), -score), axis=1)[:, : k + 1]
                flat = pd.DataFrame({"query": np.repeat(part["node"].to_numpy(), top.shape[1]), "node": node[top].ravel(), "first": first[top].ravel(), "score": np.take_along_axis(score, top, axis=1).ravel()})
                out.append(flat[flat["score"] > -np.inf])
        return pd.concat(out) if out else pd.DataFrame({"query": [], "node": [], "first": [], "score": []}).astype({"query": "int64", "node": "int64", "first": "int64", "score": "float64"})

    def meet(visits: DataFrame) -> DataFrame:
        """visits: node, vec, tree, leaf. A query comes once to a group of leaves, with those that it visits there; queries are dealt to ``lots`` of about a block each."""
        met = visits.groupBy("node", "tree", F.floor(F.col("leaf") / together).alias("area")).agg(F.first("vec").alias("vec"), F.collect_list("leaf").alias("visits"))
        met = stage(met, "visits")
        many = met.groupBy("tree", "area").agg(F.ceil(F.count("*") / s.block).cast("int").alias("lots"))
        many = stage(many, "areas")
        lot = F.pmod(F.xxhash64("node", F.lit(s.seed)), F.col("lots")).cast("int").alias("lot")
        spread = met.join(many, ["tree", "area"]).select("node", "vec", F.lit(None).cast("bigint").alias("first"), "tree", "area", F.lit(None).cast("int").alias("leaf"), "visits", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), lot, F.lit(True).alias("asks"))
        held = index.withColumn("area", F.floor(F.col("leaf") / together)).join(many, ["tree", "area"])
        wanted = held.select("node", "vec", "first", "tree", "area", "leaf", F.lit(None).cast("array<int>").alias("visits"), "block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "asks")
        return wanted.union(spread).groupBy("tree", "area", "block", "lot").applyInPandas(compare, "query long, node long, first long, score double")

    home = queries.select("node", "vec", own.alias("p")).select("node", "vec", "p.*")
    near = best(meet(home)).where(F.col("query") != F.col("node")).groupBy("query").agg(F.count("*").alias("c"), F.min("score").alias("low"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    reach = near.select(F.col("query").alias("node"), F.get("s", F.lit(k - 1)).alias("worst"))
    visits = queries.select("node", "vec").join(reach, "node", "left").select("node", "vec", F.explode(search("vec", "worst")).alias("p")).select("node", "vec", "p.*")
    found = stage(best(meet(visits)).select("query", "node", "score"), "found")
    answers = asked.withColumnRenamed("node", "query").join(found, "query").join(ids, "node").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
