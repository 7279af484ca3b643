"""A table that keeps one row per key, merged batch by batch in hash buckets.

A batch is merged into the buckets it touches: their stored rows and its own give the newest row
per key, and the merged buckets are written under the batch's own folder (``v=<batch>``). A small
manifest per batch says for every bucket which folder holds it. Reading costs one row per key,
however many batches or captures came in; a batch costs the buckets it touches.

A batch that runs again starts from the manifest before it and rewrites its own folder and
manifest, so a replay changes nothing. Readers follow the newest manifest, which is written
last. Folders that neither the newest nor the manifest before it names are removed after it.

The number of buckets is fixed when a table is begun; a bucket is the table's rows / buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

BUCKETS = 64


class MergedTable:
    """``path``: the table's folder; ``key``: its columns; ``newest``: the columns by which the
    latest row of a key is told (ties: any, so they should tell rows apart)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], newest: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.newest, self.buckets = spark, path.rstrip("/"), key, newest, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in self.key]
        kept = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.newest)).alias("r"))  # combined map-side
        return kept.select(*self.key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*self.columns)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    # --- manifests: one row per bucket, a folder per batch -----------------------------------
    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self, path: str, prefix: str) -> list[int]:
        fs, at = self._folder(path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """bucket → batch whose folder holds it, as of the newest ended batch (before one)."""
        ended = [n for n in self._numbers(f"{self.path}/_manifest", "batch=")
                 if (before is None or n < before) and self._folder(f"{self.path}/_manifest/batch={n}/_SUCCESS")[0].exists(
                     self._folder(f"{self.path}/_manifest/batch={n}/_SUCCESS")[1])]
        if not ended:
            return {}
        rows = self.spark.read.schema("bucket int, v long").json(f"{self.path}/_manifest/batch={ended[-1]}")
        return {r["bucket"]: r["v"] for r in rows.collect()}  # at most ``buckets`` rows

    def _read(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # --- use -------------------------------------------------------------------------------------
    def read(self, before: int | None = None) -> DataFrame:
        """The table, as of its newest batch or of the newest one before ``before``."""
        return self._read(self._manifest(before))

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        mine = staged(self.latest(rows).withColumn("bucket", self.bucket()))
        touched = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # at most ``buckets``
        held = self._manifest(before=batch_id)
        if touched:
            old = self._read({b: v for b, v in held.items() if b in touched})
            merged = self.latest(old.unionByName(mine.select(*self.columns))).withColumn("bucket", self.bucket())
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={batch_id}")
        now = {**held, **{b: batch_id for b in touched}}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, v long").coalesce(1).write.mode("overwrite").json(
            f"{self.path}/_manifest/batch={batch_id}")
        self._clean(batch_id, now, held)

    def _clean(self, batch_id: int, now: dict[int, int], held: dict[int, int]) -> None:
        used = set(now.items()) | set(held.items())
        for v in self._numbers(self.path, "v="):
            if v < batch_id:
                for b in self._numbers(f"{self.path}/v={v}", "bucket="):
                    if (b, v) not in used:
                        fs, at = self._folder(f"{self.path}/v={v}/bucket={b}")
                        fs.delete(at, True)
                if v not in {x for _, x in used}:
                    fs, at = self._folder(f"{self.path}/v={v}")
                    fs.delete(at, True)
        for n in self._numbers(f"{self.path}/_manifest", "batch=")[:-2]:
            fs, at = self._folder(f"{self.path}/_manifest/batch={n}")
            fs.delete(at, True)
