"""Spark session helpers.

The library never creates a session behind the caller's back except through
``get_session``, which is what tests, ``bench.py`` and the entry point use.
On a cluster the session is built by the platform; ``checkpoint_dir`` then reads
the shared folder from ``spark.checkpoint.dir`` and never invents a local one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults tuned for a single local JVM; on a cluster the platform's settings win
# because ``getOrCreate`` returns the running session unchanged.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    "spark.sql.maxMetadataStringLength": "2000",  # plans are shown with all of a scan's filters
}


def get_session(master: str | None = None, app: str = "wikilake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that value is used
    as given. Only a local test session without the setting gets a fresh scratch
    folder (``mktemp``-style, never reused).
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="wikilake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # some deployments refuse runtime edits of core settings
        pass
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def library_on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this library where it is not installed but lies on a path
    that they share with the driver (on a cluster it comes as a package or by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = spark.sparkContext.environment
    if root not in found.get("PYTHONPATH", "").split(os.pathsep):
        found["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [found.get("PYTHONPATH")])])


def staged(df):
    """``df`` written as Parquet into the shared scratch folder and read again.

    Used where a plan would compute the same rows several times: the source is then read
    once, a lost executor costs a read of the file, and the optimizer knows the true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def partitions_for(df, bytes_per_partition: int = 8 * 1024 * 1024, max_partitions: int = 200_000) -> int:
    """Shuffle width for a per-document job: the stored size of what ``df`` reads divided by
    ``bytes_per_partition``, at least twice the cluster's parallelism.

    A document expands about tenfold when cut into tokens or lines, and its window steps hold
    a task's rows, so the share of a task is small and does not grow with the input: the
    memory of a task follows it. The size is that of the relations below ``df``, for the
    optimizer takes every column for equally wide and the texts are nearly all of a table. An
    explicit count keeps AQE from merging the partitions.
    """
    spark = df.sparkSession
    floor_n = 2 * spark.sparkContext.defaultParallelism
    unknown = min(2**60, int(spark.conf.get("spark.sql.defaultSizeInBytes", str(2**63 - 1))))
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Exception:  # estimate unavailable (e.g. a remote session): fall back to the floor
        sizes = []
    size = sum(n for n in sizes if n < unknown)  # an unknown size is not read as huge
    return int(max(floor_n, min(max_partitions, size // bytes_per_partition + 1)))
