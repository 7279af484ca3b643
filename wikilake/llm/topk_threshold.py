"""Exact top-k search: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are cut by hash into blocks, queries into blocks; every query block meets every
vector block in a task of its own (the stated query set against all rows, in blocks). A
vector block sorts one list per dimension. A query reads its lists from the favourable
end (highest first where its component is positive, lowest first where it is negative),
a stretch of all lists at a time; every vector seen is scored in full by random access.
The bound of the vectors not yet seen is the product of the query with the list values
just reached; reading stops once the k-th result is above that bound. The k best per
block are merged by a window over the query. Scores are exact 64-bit integers (vectors
with components too large for that are scored with Python integers, which saturate).

Defined results: vectors that are null, empty, hold null or non-finite components, or have
another length than most take no part, as query or candidate; rows without an id neither;
a query's own id is never its candidate; among rows with the query's id the smallest
vector is the query; repeated candidate rows count each; fewer than k candidates: all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best, matrix, merged, valid_vectors

SCALE = 1024
VECTORS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024
FIRST_STRETCH = 16
FOUND = "query_id bigint, ids array<bigint>, scores array<bigint>"


def scaled(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where a score could
    leave 64 bits."""
    y = np.floor(scale * v)
    if not len(y) or np.abs(y).max() ** 2 * y.shape[1] < 2.0**62:
        return y.astype(np.int64)
    return np.array([[int(x) for x in row] for row in y], dtype=object)


class SortedLists:
    """The per-dimension lists of one vector block."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T  # dimension by position, ascending
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)

    def top(self, query: np.ndarray, ids: np.ndarray, own: int, k: int, stretch: int = FIRST_STRETCH):
        """(positions, scores) of the k best by (score descending, id), without ``own``."""
        n = len(ids)
        up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        q_up, q_down = query[up], query[down]
        seen = ids == own
        rows = np.empty(0, dtype=np.int64)
        scores = np.empty(0, dtype=self.vectors.dtype)
        at = 0
        while at < n:
            to = min(n, at + stretch)
            met = np.concatenate([self.order[up, at:to].ravel(), self.order[down, n - to:n - at].ravel()])
            if not len(met):  # a zero query: every score is 0
                met = np.arange(n)
                to = n
            new = np.unique(met[~seen[met]])
            if len(new):
                seen[new] = True
                rows = np.concatenate([rows, new])
                scores = np.concatenate([scores, self.vectors[new] @ query])
                keep = best(scores, ids[rows], k)
                rows, scores = rows[keep], scores[keep]
            at, stretch = to, 2 * stretch
            if at < n and len(rows) == k:
                bound = (q_up * self.values[up, at - 1]).sum() + (q_down * self.values[down, n - at]).sum()
                if scores[-1] > bound:  # an equal score could still have a smaller id
                    break
        return rows, scores


def exact_top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = SCALE, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    rows = written(valid_vectors(vectors, id_col, vec_col))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n_v = max(1, -(-rows.count() // VECTORS_PER_BLOCK))
    n_q = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    cut = F.pmod(F.xxhash64("id", "v"), F.lit(n_v)).cast("int")
    cut_q = F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int")
    every_q = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb")
    every_v = F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb")
    left = rows.select("id", "v", cut.alias("vb"), every_q)
    right = queries.select("id", "v", cut_q.alias("qb"), every_v)

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(block) and len(asked):
            ids = block.column("id").to_numpy()
            both = scaled(np.concatenate([matrix(block.column("v")), matrix(asked.column("v"))]), scale)
            lists, q = SortedLists(both[:len(ids)]), both[len(ids):]
            for i, own in enumerate(asked.column("id").to_numpy()):
                at, scores = lists.top(q[i], ids, own, k)
                out.append((int(own), ids[at].tolist(), [min(max(int(s), -2**63), 2**63 - 1) for s in scores]))
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()),
                         "ids": pa.array([r[1] for r in out], pa.list_(pa.int64())),
                         "scores": pa.array([r[2] for r in out], pa.list_(pa.int64()))})

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(search, FOUND)
    return merged(found, k, "bigint")
