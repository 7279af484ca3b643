"""Helpers shared by the operators: clash-free column names, written tables, digests."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikilake.session import checkpoint_dir

#: Fixed value: what counts as a word (anything but the six ASCII blanks).
WORD = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def column(df: DataFrame, name: str):
    """The column of that exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared scratch folder and read again.

    Cuts the lineage (a lost executor costs a read, not a recomputation) and gives the
    optimizer the true size of the result, so that it broadcasts only what is small.
    """
    spark = spark or df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def library_on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this library where it is not installed but lies on a path
    that they share with the driver (on a cluster it comes as a package or by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = spark.sparkContext.environment
    if root not in found.get("PYTHONPATH", "").split(os.pathsep):
        found["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [found.get("PYTHONPATH")])])


#: What tasks may keep in a worker for their own length: each entry empties one memo.
MEMOS: list[Callable[[], object]] = []


def release() -> None:
    """Gives back what a finished task leaves in its Python worker, which Spark keeps for
    later tasks of other operators: memos, Arrow's unused pages, freed heap."""
    for forget in MEMOS:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can trim
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator, rows: int = 512, most_bytes: int = 4 << 20) -> Iterator:
    """The Arrow arrays of ``batches`` in slices of at most ``rows`` and about ``most_bytes``
    (one row at least), so that a function's working memory does not follow the size of
    Spark's batches; memory is given back after the last one. Batches of several arrays
    (tuples) are sliced alike."""
    try:
        for batch in batches:
            parts = batch if isinstance(batch, tuple) else (batch,)
            at, n = 0, len(parts[0])
            while at < n:
                step = min(rows, n - at)
                while step > 1 and sum(p.slice(at, step).nbytes for p in parts) > most_bytes:
                    step //= 2
                cut = tuple(p.slice(at, step) for p in parts)
                yield cut if isinstance(batch, tuple) else cut[0]
                at += step
    finally:
        release()


def shuffle_width(spark: SparkSession, n_units: int, per_task: int) -> int:
    """Partitions so that each holds about ``per_task`` of ``n_units``; never fewer than
    the session's own shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-n_units // per_task))
