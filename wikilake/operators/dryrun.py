"""Dry run of a batch of requests (R6): what it would write, as ordered line hunks, and the
backup of what it would overwrite. Nothing is written but scratch tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .linediff import apply_hunks, line_hunks
from .updates import KEY, apply_requests


class DryRun(NamedTuple):
    """changes: per touched page its versions, ``old_body`` and ``new_body``; hunks: the ordered
    line differences (``linediff.line_hunks``); backup: the stored rows that would go."""

    changes: DataFrame
    hunks: DataFrame
    backup: DataFrame


def dry_run(pages: DataFrame, reqs: DataFrame, check_version: bool = False) -> DryRun:
    applied = apply_requests(pages, reqs, check_version)
    old = pages.select(*KEY, F.col("storage_html").alias("old_body"))
    changes = staged(applied.join(old, KEY))
    hunks = staged(line_hunks(changes, KEY, "old_body", "new_body"))
    backup = changes.select(*KEY, F.col("old_version").alias("version"), "title", F.col("old_body").alias("storage_html"),
                            F.sha2("old_body", 256).alias("body_sha256"))
    return DryRun(changes, hunks, backup)


def change_report(run: DryRun) -> DataFrame:
    """Per touched page: versions, hunks, lines added and removed, whether the hunks make
    exactly the new body of the old one, and the hash of the backed-up body."""
    counts = run.hunks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hunks"), F.sum(F.size("added")).alias("n_added"),
                                         F.sum(F.size("removed")).alias("n_removed"))
    made = apply_hunks(run.changes, run.hunks, KEY, "old_body").join(counts, KEY, "left")
    return made.select(*KEY, "old_version", "new_version", "lost_macros",
                       *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hunks", "n_added", "n_removed")],
                       F.sha2("rebuilt", 256).alias("rebuilt_sha256"), F.col("rebuilt").eqNullSafe(F.col("new_body")).alias("exact"),
                       F.sha2("old_body", 256).alias("backup_sha256"))


def write_backup(run: DryRun, path: str) -> None:
    """The backup as a table; a second run of the same batch replaces it by the same rows."""
    run.backup.write.mode("overwrite").option("compression", "zstd").parquet(path)


def roll_back(pages: DataFrame, backup: DataFrame) -> DataFrame:
    """``pages`` with the backed-up titles and bodies in place again."""
    kept = backup.select(*KEY, F.lit(True).alias("_saved"), F.col("title").alias("_title"), F.col("storage_html").alias("_html"),
                         F.col("version").alias("_version"))
    j = pages.join(kept, KEY, "left")
    put = {c: F.when(F.col("_saved"), F.col(f"_{s}")).otherwise(F.col(c)) for c, s in (("title", "title"), ("storage_html", "html"), ("version", "version"))}
    return j.select(*[put[c].alias(c) if c in put else F.col(c) for c in pages.columns])
