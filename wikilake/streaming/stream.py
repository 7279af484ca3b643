"""Streaming forms.

Listings arrive response by response and pages gain versions; both ingest paths are
Structured Streaming file sources feeding ``foreachBatch`` sinks:

* T1 ``stream_listing``: new listing-response files → listing rows (S1, stateless), each
  micro-batch merged into the hash buckets it touches (``merged.py``); the table holds one row
  per ``(instance, page_id)``: latest capture, then highest ordinal, whatever batches the files
  fell into, and reading it does not depend on the number of captures.
* T2 ``stream_convert``: new page rows → markdown. Row-based windows are not allowed on a
  streaming DataFrame, so the token job runs on each micro-batch inside ``foreachBatch``. The
  table keeps, per page, the digest of the body it was made from: a row whose body the table
  has already is not converted again, whatever file or run it comes from.

Sinks and checkpoints live in the shared folder named by ``spark.checkpoint.dir``; a
re-run of a batch after a lost executor rewrites the same ``batch_id`` folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.html2md import html_to_markdown
from ..session import checkpoint_dir, staged
from ..sources.listing import page_listing
from .merged import MergedTable

LISTING_SCHEMA = "instance STRING, page_id STRING, title STRING, space_key STRING, space_name STRING, ordinal BIGINT, capture BIGINT"
LISTING_NEWEST = ["capture", "ordinal", "title", "space_key", "space_name"]
RAW_SCHEMA = "instance STRING, kind STRING, space_key STRING, start INT, body STRING, capture BIGINT"


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def stream_listing(spark: SparkSession, source_dir: str, work_dir: str | None = None, max_files: int = 64) -> DataFrame:
    """Ingest every response file now in ``source_dir`` (JSON lines of ``RAW_SCHEMA``)
    and return the listing table with the latest row per page. ``max_files`` per micro-batch
    bounds a batch; it does not change the result."""
    work = work_dir or _run_dir(spark, "listing")
    out_dir, ckpt = f"{work}/table", f"{work}/_checkpoint"
    src = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").json(source_dir)

    def to_rows(batch: DataFrame) -> DataFrame:
        raw = batch.withColumn("kind", F.coalesce("kind", F.lit("page")))
        return page_listing(raw, "capture").withColumn("capture", F.coalesce("capture", F.lit(0).cast("long")))

    table = MergedTable(spark, out_dir, LISTING_SCHEMA, ["instance", "page_id"], LISTING_NEWEST)
    q = (src.writeStream.foreachBatch(lambda batch, batch_id: table.merge(to_rows(batch), batch_id))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return table.read().select("instance", "page_id", "title", "space_key", "space_name", "ordinal")


def write_listing_source(raw: DataFrame, source_dir: str, capture: int = 0) -> None:
    """Capture listing responses as JSON-lines files, the form a fetcher drops them in."""
    raw.withColumn("capture", F.lit(capture).cast("long")).write.mode("append").json(source_dir)


def stream_convert(spark: SparkSession, pages_path: str, work_dir: str | None = None, id_col: str = "page_id", html_col: str = "html",
                   version_col: str | None = None, converted: list | None = None) -> DataFrame:
    """Convert the page rows now at ``pages_path`` (a folder of parquet files, or one file)
    that the table does not hold yet, micro-batch by micro-batch, and return ``(page_id,
    markdown)``, one row per page: of several versions of a page the one with the largest
    ``version_col`` of the latest batch that had one. ``converted`` collects, per batch, the
    number of pages converted."""
    work = work_dir or _run_dir(spark, "convert")
    out_dir, ckpt = f"{work}/table", f"{work}/_checkpoint"
    columns = [id_col, html_col, *([version_col] if version_col else [])]
    schema = spark.read.parquet(pages_path).select(*columns).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    at = spark._jvm.org.apache.hadoop.fs.Path(pages_path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # stream its folder, filtered to that name
        reader, pages_path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    table = MergedTable(spark, out_dir, "page_id STRING, markdown STRING, digest STRING, version BIGINT, batch BIGINT", ["page_id"],
                        ["batch", "version", "digest"])

    def convert(batch: DataFrame, batch_id: int) -> None:
        version = F.col(version_col).cast("long") if version_col else F.lit(None).cast("long")
        rows = batch.select(F.col(id_col).cast("string").alias("page_id"), F.col(html_col).alias("html"), version.alias("version"))
        rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
        last = rows.groupBy("page_id").agg(F.max_by(F.struct("html", "version", "digest"), F.struct("version", "digest")).alias("r")).select("page_id", "r.*")
        known = table.read(before=batch_id).select("page_id", "digest")
        new = staged(last.join(known, ["page_id", "digest"], "left_anti"))
        if converted is not None:
            converted.append(new.count())
        done = html_to_markdown(new.select("page_id", "html")).join(new.select("page_id", "digest", "version"), "page_id")
        table.merge(done.withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    q = (reader.parquet(pages_path).select(*columns).writeStream.foreachBatch(convert)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return table.read().select("page_id", "markdown")
