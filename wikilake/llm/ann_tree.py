"""Approximate nearest neighbours: a hierarchical k-means tree searched best-bin-first.

1. Tree: fitted on at most ``SAMPLE`` vectors (the first by a hash of the id), ``BRANCH``
   ways per node, until a node has fewer than ``2 * LEAF_SAMPLE`` sample rows or
   ``MAX_LEAVES`` leaves are reached; so the tree's size is bounded.
2. Index: every vector goes down to its nearest leaf. The vectors of a child of the root
   form a search unit, a large one cut by hash into several of ``ROWS_PER_UNIT`` rows.
3. Traversal: a query walks the tree with a priority queue of nodes, the largest inner
   product with the node's centre first, and takes leaves in that order.
4. Calibration: for ``PROBES`` queries the true neighbours are found by brute force over
   all rows; leaf visits are widened until the share of true neighbours whose leaf was
   visited reaches ``RECALL``. Every query then makes that many visits.
5. Search: each query meets, unit by unit, the rows of the leaves it visits; the k best
   per unit are merged by a window over the query. Scores are double-precision inner
   products of the original vectors.

Broadcast data: the tree and the probes, both bounded. Units and query blocks are bounded
in rows, so a hot leaf (many equal vectors) is many tasks.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or
have another length than most take no part; rows without an id neither; a query's own id
is never its candidate; among rows with the query's id the smallest vector is the query;
repeated candidate rows count each; fewer than k found: those; ties to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best, exact_best, matrix, merged, valid_vectors

SAMPLE = 20_000
BRANCH = 12
LEAF_SAMPLE = 32
MAX_LEAVES = 144
PROBES = 256
RECALL = 0.95
ROWS_PER_UNIT = 8192
QUERIES_PER_BLOCK = 1024
SEED = 5
FOUND = "query_id bigint, ids array<bigint>, scores array<double>"


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of the clusters that are not empty."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        label = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        sizes = np.bincount(label, minlength=len(centres))
        centres = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


class Tree:
    """children[node]: node numbers (empty for a leaf); centre[node]; leaf[node]: its
    number or -1; unit[leaf]: the root's child above it."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_sample: int = LEAF_SAMPLE,
                 max_leaves: int = MAX_LEAVES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.centres = [sample.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        top = [0]
        open_nodes = [(-len(sample), 0, sample)]  # the largest is split first
        leaves = 1
        while open_nodes:
            size, node, rows = heapq.heappop(open_nodes)
            if -size < 2 * leaf_sample or leaves + branch - 1 > max_leaves:
                continue
            centres = k_means(rows, min(branch, -size // leaf_sample), rng)
            if len(centres) < 2:
                continue
            label = nearest(rows, centres)
            for c in range(len(centres)):
                child = len(self.children)
                self.children.append([])
                self.children[node].append(child)
                self.centres.append(centres[c])
                top.append(child if node == 0 else top[node])
                mine = rows[label == c]
                heapq.heappush(open_nodes, (-len(mine), child, mine))
            leaves += len(centres) - 1
        self.centres = np.array(self.centres)
        nodes = [n for n, c in enumerate(self.children) if not c]
        self.leaf = np.full(len(self.children), -1)
        self.leaf[nodes] = np.arange(len(nodes))
        units = {t: i for i, t in enumerate(dict.fromkeys(top[n] for n in nodes))}
        self.unit = np.array([units[top[n]] for n in nodes])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.arange(len(x)) if self.children[0] else np.empty(0, dtype=np.int64)
        while len(moving):
            for node in np.unique(at[moving]):
                mine = moving[at[moving] == node]
                kids = np.array(self.children[node])
                at[mine] = kids[nearest(x[mine], self.centres[kids])]
            moving = moving[[bool(self.children[n]) for n in at[moving]]]
        return self.leaf[at]

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order."""
        product = self.centres @ query
        queue, out = [(-product[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
            for child in self.children[node]:
                heapq.heappush(queue, (-product[child], child))
        return out


def fit_tree(rows: DataFrame, sample: int = SAMPLE) -> Tree | None:
    chosen = rows.select("id", "v", F.xxhash64("id", "v").alias("h")).orderBy("h", "id").limit(sample).toArrow()
    return Tree(matrix(chosen.column("v"))) if len(chosen) else None


def probe_truth(rows: DataFrame, probes: pa.Table, k: int) -> DataFrame:
    """The true neighbours of a bounded number of queries: k best of each Arrow batch,
    merged by a window."""
    ids, q = probes.column("id").to_numpy(), matrix(probes.column("v"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v, own = matrix(pa.chunked_array([batch.column("v")])), batch.column("id").to_numpy()
            leaf = batch.column("leaf").to_numpy()
            scores = q @ v.T
            scores[ids[:, None] == own[None, :]] = -np.inf
            at = [best(s, own, k) for s in scores]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(ids, [len(a) for a in at])), pa.array(own[np.concatenate(at)]),
                pa.array(leaf[np.concatenate(at)]), pa.array(np.concatenate([s[a] for s, a in zip(scores, at)]))],
                ["query_id", "vec_id", "leaf", "score"])

    from pyspark.sql.window import Window

    found = rows.mapInArrow(scan, "query_id bigint, vec_id bigint, leaf int, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.filter(F.col("score") > float("-inf")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated_visits(tree: Tree, placed: DataFrame, queries: DataFrame, k: int, recall: float, probes: int) -> int:
    """Leaf visits at which the probes' true neighbours are found at rate ``recall``."""
    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(probes).toArrow()
    if not len(chosen):
        return 1
    n = len(tree.unit)
    place = {}
    for own, v in zip(chosen.column("id").to_pylist(), matrix(chosen.column("v"))):
        for i, leaf in enumerate(tree.visits(v, n)):
            place[own, leaf] = i
    truth = probe_truth(placed, chosen, k).select("query_id", "leaf").collect()  # at most probes * k rows
    hits = np.bincount([place[r["query_id"], r["leaf"]] for r in truth], minlength=n) if truth else np.ones(n)
    return int(np.searchsorted(np.cumsum(hits) / hits.sum(), recall) + 1)


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL, sample: int = SAMPLE,
                       probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = written(valid_vectors(vectors, id_col, vec_col, allow_zero=False))
    tree = fit_tree(rows, sample)
    if tree is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    @F.arrow_udf("int")
    def leaf_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            yield pa.array(tree.leaf_of(matrix(pa.chunked_array([v]))) if len(v) else [], pa.int32())

    placed = written(rows.withColumn("leaf", leaf_of("v")))
    queries = written(placed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    visits = calibrated_visits(tree, placed, queries, k, recall, probes)

    unit_of = F.array(*[F.lit(int(u)) for u in tree.unit])
    units = placed.withColumn("unit", F.element_at(unit_of, F.col("leaf") + 1))
    sizes = {r["unit"]: r["count"] for r in units.groupBy("unit").count().collect()}  # one row per child of the root
    n_units = int(tree.unit.max()) + 1
    cuts = [max(1, -(-sizes.get(u, 0) // ROWS_PER_UNIT)) for u in range(n_units)]
    n_q = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    cut_of = F.element_at(F.array(*map(F.lit, cuts)), F.col("unit") + 1)
    left = units.select("unit", F.pmod(F.xxhash64("id", "v"), cut_of).cast("int").alias("part"), "id", "v", "leaf",
                        F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))

    @F.arrow_udf("array<int>")
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            yield pa.array([tree.visits(x, visits) for x in matrix(pa.chunked_array([v]))] if len(v) else [], pa.list_(pa.int32()))

    asked = queries.select("id", "v", F.explode(walk("v")).alias("leaf"),
                           F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int").alias("qb"))
    asked = asked.withColumn("unit", F.element_at(unit_of, F.col("leaf") + 1)).groupBy("unit", "qb", "id").agg(
        F.first("v").alias("v"), F.collect_set("leaf").alias("leaves"))  # at most MAX_LEAVES numbers
    right = asked.select("unit", "qb", "id", "v", "leaves", F.explode(F.sequence(F.lit(0), cut_of - 1)).alias("part"))

    def search(unit: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(unit) and len(asking):
            ids, v, leaf = unit.column("id").to_numpy(), matrix(unit.column("v")), unit.column("leaf").to_numpy()
            q_ids, q = asking.column("id").to_numpy(), matrix(asking.column("v"))
            for lo in range(0, len(q), 128):  # bounds the score matrix
                scores = q[lo:lo + 128] @ v.T
                for i, leaves in enumerate(asking.column("leaves")[lo:lo + 128].to_pylist()):
                    rough = np.where(np.isin(leaf, leaves) & (ids != q_ids[lo + i]), scores[i], -np.inf)
                    found, exact = exact_best(q[lo + i], v, ids, rough, k)
                    out.append((int(q_ids[lo + i]), found.tolist(), exact.tolist()))
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()),
                         "ids": pa.array([r[1] for r in out], pa.list_(pa.int64())),
                         "scores": pa.array([r[2] for r in out], pa.list_(pa.float64()))})

    keys = ("unit", "part", "qb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)
    return merged(found, k, "double")
