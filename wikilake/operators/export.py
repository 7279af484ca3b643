"""Page read / export / edit-buffer operators.

They all sit on top of the HTML → markdown job: one token job per page table, whose
result meets the page metadata on a key made of ``instance`` and ``page_id``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .html2md import html_to_markdown
from .requests import with_base_url

_KEY = "_doc_key"


def _key() -> Column:
    return F.concat_ws("\u0000", "instance", "page_id")


def _markdown(pages: DataFrame) -> DataFrame:
    """(key, markdown) of every page: the one shuffle that carries bodies."""
    keyed = pages.select(_key().alias(_KEY), "storage_html")
    return html_to_markdown(keyed, id_col=_KEY, html_col="storage_html").withColumnRenamed("page_id", _KEY)


def with_markdown(pages: DataFrame) -> DataFrame:
    """pages (without their body) + ``markdown`` (the converted storage HTML)."""
    return pages.drop("storage_html").withColumn(_KEY, _key()).join(_markdown(pages), _KEY, "left").drop(_KEY)


def read_pages(pages: DataFrame, instances: DataFrame) -> DataFrame:
    """The read result: id, title, space, space_key, version, html, markdown, url. The URL
    is put to the page row before the bodies meet, by the page key."""
    meta = with_base_url(pages, instances).withColumn(_KEY, _key())
    return meta.join(_markdown(pages), _KEY, "left").select(
        "instance", F.col("page_id").alias("id"), "title", F.col("space_name").alias("space"), "space_key", "version",
        F.col("storage_html").alias("html_content"), F.col("markdown").alias("markdown_content"),
        T.page_url("base_url", "page_id").alias("url"),
    )


def export_documents(pages: DataFrame, instances: DataFrame) -> DataFrame:
    """K1: one markdown document per page: metadata header + converted body, with the
    file name the list tool gives it and how many pages of the instance share that name
    (files of one name overwrite each other when written one by one).

    File names, their counts and URLs are made from metadata alone; the converted bodies
    join last, by the page key, and are not shuffled again."""
    meta = pages.drop("storage_html").withColumn("file_name", T.slug("title"))
    same = meta.groupBy("instance", "file_name").agg(F.count(F.lit(1)).alias("n_same_slug"))
    meta = with_base_url(meta.join(same, ["instance", "file_name"], "left"), instances).withColumn(_KEY, _key())
    header = T.metadata_header("title", "space_name", "page_id", "version", T.page_url("base_url", "page_id"))
    return meta.withColumn("_header", header).join(_markdown(pages), _KEY, "left").select(
        "instance", "file_name", "page_id", F.concat("_header", F.coalesce(F.col("markdown"), F.lit(""))).alias("content"), "n_same_slug")


def edit_buffers(pages: DataFrame) -> DataFrame:
    """The edit buffer of each page, the text the clean step gives back, and
    whether an untouched buffer round-trips to the same markdown (so it is not uploaded)."""
    md = with_markdown(pages)
    buf = T.edit_buffer("title", "page_id", "version", F.coalesce(F.col("markdown"), F.lit("")))
    out = md.select("instance", "page_id", "markdown", buf.alias("buffer"))
    out = out.withColumn("cleaned", T.clean_edit("buffer"))
    return out.select("instance", "page_id", "buffer", "cleaned",
                      (F.col("cleaned") == T.strip_ws(F.coalesce(F.col("markdown"), F.lit("")))).alias("unchanged"))


def write_markdown(docs: DataFrame, out_dir: str) -> None:
    """Write each document to ``out_dir/<instance>/<file_name>``.

    ``out_dir`` must be a folder every executor sees (a shared mount). Each task writes
    its own rows; pages sharing a file name are written in page-id order, so the last one
    wins as it does when exporting one by one.
    """
    rows = docs.select("instance", "page_id", "file_name", "content") \
        .repartition("instance", "file_name").sortWithinPartitions("instance", "file_name", "page_id")

    def write_part(it):
        for r in it:
            d = os.path.join(out_dir, r["instance"])
            os.makedirs(d, exist_ok=True)
            with open(os.path.join(d, r["file_name"]), "w", encoding="utf-8") as f:
                f.write(r["content"])

    rows.foreachPartition(write_part)
