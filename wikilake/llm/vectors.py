"""Helpers for vector tables: valid rows, block numbers, exact scores inside a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", allow_zero: bool = True) -> DataFrame:
    """(id, v) of the rows that take part: id not null; v not null, without null, NaN or
    infinite components (and not zero, unless allowed), of the table's most common length
    (the smaller of equally common ones)."""
    v = column(vectors, vec_col).cast("array<double>")
    rows = vectors.select(column(vectors, id_col).cast("bigint").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if not allow_zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    return rows.filter(F.size("v") == (common[0]["d"] if common else 0))


def matrix(column_: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional array."""
    lists = column_.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def exact_best(query: np.ndarray, v: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int, slack: float = 1e-9):
    """(ids, scores) of the k nearest. ``rough`` scores come from a matrix product, whose
    rounding may differ between equal vectors; all within ``slack`` of the k-th are
    computed anew, one fixed sum per row."""
    if len(rough) > k:
        kth = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= kth - slack * (1.0 + abs(kth)))
    else:
        near = np.flatnonzero(rough > -np.inf)
    near = near[rough[near] > -np.inf]
    scores = (v[near] * query).sum(axis=1)
    order = best(scores, ids[near], k)
    return ids[near][order], scores[order]


def merged(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score from per-block rows (query_id, ids, scores)."""
    from pyspark.sql.window import Window

    flat = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").cast(score_type).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return flat.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
