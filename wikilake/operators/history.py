"""Page history and restore (R4) on an append-only version table.

The table holds whole bodies, one row per stored version: (instance, page_id, version, title,
storage_html, change). Batches are appended as folders of their own and replaced as a whole
when a batch is run again, so a repeated batch adds nothing. If two batches hold the same
version of a page, the later batch's row counts.

Lookups work on narrow rows (page, version); bodies are joined once, at the end, by page and
version. A page may own any share of the versions or of the lookups: the order inside a page
comes from ranges (``ranges.py``), never from a window over a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from .ranges import last_before, numbered

KEY = ["instance", "page_id"]
VERSION_COLUMNS = [*KEY, "version", "title", "storage_html", "change"]
NEWEST = 2**31 - 1


def stored_versions(pages: DataFrame, change: str = "stored") -> DataFrame:
    return pages.select(*KEY, F.col("version").cast("int").alias("version"), "title", "storage_html", F.lit(change).alias("change"))


def update_versions(applied: DataFrame) -> DataFrame:
    """The versions a batch of requests writes (the result of ``updates.apply_requests``)."""
    return applied.select(*KEY, F.col("new_version").alias("version"), "title", F.col("new_body").alias("storage_html"),
                          F.lit("update").alias("change"))


def append_versions(versions: DataFrame, path: str, batch: int) -> None:
    versions.select(*VERSION_COLUMNS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """One row per (page, version): the row of the latest batch that holds it."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(*KEY, "version").agg(F.max("batch").alias("batch"))
    return rows.join(last, [*KEY, "version", "batch"]).select(*VERSION_COLUMNS)


def page_history(versions: DataFrame) -> DataFrame:
    """Every version with its place in the page's history (0 is the oldest), the version
    before it, the change of the body's length and whether the body changed at all."""
    meta = staged(versions.select(*KEY, "version", "title", "change", F.length("storage_html").alias("n_chars"),
                                  F.sha2("storage_html", 256).alias("body_sha256")))
    placed = staged(numbered(meta, KEY, ["version"], meta.count()))
    before = placed.select(*KEY, (F.col("pos") + 1).alias("pos"), F.col("version").alias("previous_version"),
                           F.col("n_chars").alias("_n"), F.col("body_sha256").alias("_sha"))
    after = placed.select(*KEY, (F.col("pos") - 1).alias("pos"), F.lit(False).alias("_latest"))
    j = placed.join(before, [*KEY, "pos"], "left").join(after, [*KEY, "pos"], "left")
    return j.select(*KEY, "version", F.col("pos").alias("position"), "title", "change", "previous_version",
                    F.col("n_chars").cast("long").alias("n_chars"), (F.col("n_chars") - F.col("_n")).cast("long").alias("chars_added"),
                    (~F.col("body_sha256").eqNullSafe(F.col("_sha"))).alias("body_changed"), F.coalesce("_latest", F.lit(True)).alias("is_latest"))


def found_versions(versions: DataFrame, asked: DataFrame, as_of: str = "as_of") -> DataFrame:
    """``asked`` with ``found_version``: the page's latest version at or before ``as_of``
    (null asks for the newest); null where the page has none."""
    ask = F.struct(*asked.columns)
    have = versions.select(*KEY, F.col("version").alias("at"), F.lit(0).alias("kind"), F.col("version").alias("have"),
                           F.lit(None).cast(asked.select(ask.alias("a")).schema["a"].dataType).alias("ask"))
    want = asked.select(*KEY, F.coalesce(as_of, F.lit(NEWEST)).cast("int").alias("at"), F.lit(1).alias("kind"),
                        F.lit(None).cast("int").alias("have"), ask.alias("ask"))
    both = staged(have.unionByName(want))
    found = last_before(both, KEY, ["at", "kind", "have"], "have", both.count(), "found_version")
    return found.filter("kind = 1").select("ask.*", "found_version")


def page_as_of(versions: DataFrame, asked: DataFrame, as_of: str = "as_of") -> DataFrame:
    """``found_versions`` with the title and the body of that version."""
    bodies = versions.select(*KEY, F.col("version").alias("found_version"), "title", "storage_html")
    return staged(found_versions(versions, asked, as_of)).join(bodies, [*KEY, "found_version"], "left").select(
        *asked.columns, "found_version", "title", "storage_html")


def restore(versions: DataFrame, asked: DataFrame, seq: str = "request_seq", as_of: str = "as_of") -> DataFrame:
    """The new versions that restores write, in the order of ``seq`` per page: each re-reads the
    page and, if the state asked for is not the current one, writes it as the next version.
    ``restored_from`` names the version it came from.

    ``as_of`` is looked up in the table as it was before the batch; restores of unknown pages or
    of times before the first version write nothing. Restores of equal ``seq`` go by ``as_of``."""
    newest = versions.groupBy(*KEY).agg(F.max("version").alias("newest"))
    asks = staged(found_versions(versions, asked.select(*KEY, seq, as_of), as_of).filter("found_version IS NOT NULL"))
    placed = staged(numbered(asks, KEY, [seq, as_of], asks.count()))
    before = placed.select(*KEY, (F.col("pos") + 1).alias("pos"), F.col("found_version").alias("_state"))
    moves = placed.join(before, [*KEY, "pos"], "left").join(newest, KEY)
    moves = staged(moves.filter(F.col("found_version") != F.coalesce("_state", "newest")).select(
        *KEY, "newest", F.col("found_version").alias("restored_from"), F.col("pos").alias("turn")))
    steps = numbered(moves, KEY, ["turn"], moves.count())
    bodies = versions.select(*KEY, F.col("version").alias("restored_from"), "title", "storage_html")
    return steps.join(bodies, [*KEY, "restored_from"]).select(
        *KEY, (F.col("newest") + F.col("pos") + 1).cast("int").alias("version"), "title", "storage_html", F.lit("restore").alias("change"), "restored_from")


def current_pages(versions: DataFrame) -> DataFrame:
    """The newest version of every page."""
    newest = versions.groupBy(*KEY).agg(F.max("version").alias("version"))
    return versions.join(newest, [*KEY, "version"])
