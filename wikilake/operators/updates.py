"""Versioned page changes (U1-U4) and REST payloads (K2, K3).

A batch of requests is applied the way the client applies them one call after another:
each call re-reads the page, adds one to its version and writes the whole body back.
For a page that receives several requests, in ``request_seq`` order, this gives

    body    = [prepends after the last replace, newest first] + [base] + [appends after it, in order]
    base    = the last replace's body, or the stored body when there is none
    version = stored version + number of requests applied to the page

A run of requests is summed up by its last replace, the prepends and the appends after it, and
counts. Two neighbouring runs sum up to such a summary again, so the requests of a page are
merged in rounds: every round groups at most ``SEGMENT_ROWS`` neighbours by (page, position div
SEGMENT_ROWS). No group is larger, however many requests one page gets. Positions come from
``ranges.numbered`` and only where a page has more requests than one segment.

Requests with the same ``request_seq`` are separate requests, taken in the order of ``ORDER``.

The requests are read once: the accepted ones, with their texts cleaned and hashed, are
staged. Each distinct text is converted once and joined back by its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_edit, strip_ws
from ..functions.urls import page_id_from_url
from ..session import partitions_for, staged
from .md2html import markdown_to_html
from .ranges import numbered
from .requests import first_by_title, reject_reasons, resolved_parent

SEGMENT_ROWS = 128  # requests, or summaries of requests, merged by one group
KEY = ["instance", "page_id"]
ORDER = ["request_seq", "action", "append", "content_type", "src_key"]


def with_source(reqs: DataFrame) -> DataFrame:
    """``is_md``, ``src`` (the text to store or to convert: edits are cleaned, P13; html is
    taken as it is, G11) and ``src_key``, its hash."""
    is_edit = F.col("action") == "edit"
    is_md = is_edit | (F.coalesce(F.col("content_type"), F.lit("markdown")) == "markdown")
    src = F.when(is_edit, clean_edit("content")).otherwise(F.col("content"))
    return reqs.select("*", is_md.alias("is_md"), src.alias("src")).withColumn("src_key", F.sha2("src", 256))


def with_html(rows: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``rows`` of ``with_source`` with ``html``. Every distinct markdown text of ``source``
    (the staged table behind ``rows``) is converted once."""
    source = rows if source is None else source
    width = partitions_for(source)
    texts = source.filter("is_md AND src IS NOT NULL").select("src_key", "src")
    texts = texts.repartition(width, "src_key").dropDuplicates(["src_key"])
    html = markdown_to_html(texts, id_col="src_key", md_col="src", partitioned=True).select(
        F.col("doc_id").alias("src_key"), F.col("html").alias("_html"))
    j = rows.join(html, "src_key", "left")
    return j.withColumn("html", F.when(F.col("is_md"), F.coalesce("_html", F.lit(""))).otherwise(F.col("src"))).drop("_html")


def checked_requests(reqs: DataFrame, pages: DataFrame, check_version: bool = False) -> DataFrame:
    """Requests other than creates with ``page_id``, ``stored_version`` and ``reasons``.

    ``check_version``: refuse an edit whose ``base_version`` is not the stored version
    (the server-side check of an edit started from an older snapshot)."""
    r = reqs.filter(F.col("action") != "create").withColumn("page_id", page_id_from_url("url"))
    r = r.withColumn("reasons", reject_reasons(reqs, "page_id"))  # the URL is taken apart once
    j = r.join(pages.select(*KEY, F.lit(True).alias("_hit"), F.col("version").alias("stored_version")), KEY, "left")
    conflict = (F.lit(check_version) & (F.col("action") == "edit") & F.col("base_version").isNotNull()
                & (F.col("base_version") != F.col("stored_version")))
    reasons = (F.when((F.size("reasons") == 0) & F.col("_hit").isNull(), F.array(F.lit("page not found")))
               .when((F.size("reasons") == 0) & conflict, F.array(F.lit("version conflict")))
               .otherwise(F.col("reasons")))
    return j.withColumn("reasons", reasons).drop("_hit")


def accepted_requests(reqs: DataFrame, pages: DataFrame, check_version: bool = False) -> DataFrame:
    """The accepted requests with their source texts, staged: all later steps read this."""
    ok = checked_requests(reqs, pages, check_version).filter(F.size("reasons") == 0)
    ok = ok.withColumn("append", F.coalesce("append", F.lit(True)))
    return staged(with_source(ok).select(*KEY, *ORDER, "base_version", "stored_version", "is_md", "src"))


def drop_unchanged(ok: DataFrame, pages: DataFrame) -> DataFrame:
    """Accepted requests without the edits whose cleaned text is the page's own
    markdown; the client does not upload those, so they step no version and keep macros.

    In a batch the text is compared with the state the edit was made from, the stored page:
    an edit started from another version (``base_version``) is never taken for unchanged, and
    earlier requests of the batch do not make an untouched buffer a change. Only pages with
    such an edit are converted, and texts are compared by their hashes.
    """
    from .export import with_markdown

    fresh = (F.col("action") == "edit") & (F.coalesce("base_version", "stored_version") == F.col("stored_version"))
    edited = ok.filter(fresh).select(*KEY).distinct()
    current = with_markdown(pages.select(*KEY, "storage_html").join(edited, KEY, "left_semi"))
    own = staged(current.select(*KEY, F.sha2(strip_ws(F.coalesce("markdown", F.lit(""))), 256).alias("_probe")))
    return ok.withColumn("_probe", F.when(fresh, F.col("src_key"))).join(own, [*KEY, "_probe"], "left_anti").drop("_probe")


def request_summaries(rows: DataFrame, at: Column) -> DataFrame:
    """Each converted request as the summary of itself, at its place ``at``."""
    is_edit = F.col("action") == "edit"
    return rows.select(
        *KEY, at.alias("at"), is_edit.alias("replaced"), F.when(is_edit, F.col("html")).alias("base"),
        F.when(~is_edit & ~F.col("append"), F.col("html")).alias("prepends"), F.when(~is_edit & F.col("append"), F.col("html")).alias("appends"),
        F.lit(1).cast("long").alias("n"), is_edit.cast("long").alias("n_edits"))


def merged_summaries(parts: DataFrame, group: list[Column]) -> DataFrame:
    """The summaries of neighbouring runs, by group and in the order of ``at``, as one each:
    what stands before the last replace is overwritten by it."""
    run = parts.groupBy(*KEY, *group).agg(
        F.array_sort(F.collect_list(F.struct("at", "replaced", "base", "prepends", "appends"))).alias("run"),  # at most SEGMENT_ROWS
        F.sum("n").alias("n"), F.sum("n_edits").alias("n_edits"))
    last = F.array_max(F.transform("run", lambda s, i: F.when(s["replaced"], i)))
    run = run.withColumn("last", last).withColumn("live", F.filter("run", lambda s, i: i >= F.coalesce("last", F.lit(0))))

    def text(part: str, newest_first: bool) -> Column:
        found = F.filter(F.transform("live", lambda s: s[part]), lambda x: x.isNotNull())
        found = F.reverse(found) if newest_first else found
        return F.when(F.size(found) > 0, F.array_join(found, "\n")).alias(part)

    names = [c for c in run.columns if c not in KEY + ["run", "n", "n_edits", "last", "live"]]
    return run.select(*KEY, *names, F.col("last").isNotNull().alias("replaced"), F.get("run", F.col("last"))["base"].alias("base"),
                      text("prepends", True), text("appends", False), "n", "n_edits")


def summed_up(ok: DataFrame, source: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One summary per page of the requests ``ok`` (rows of the staged table ``source``)."""
    per_page = source.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    most, total = per_page.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if most <= segment_rows:
        return merged_summaries(request_summaries(with_html(ok, source), F.struct(*ORDER)), [])
    placed = numbered(ok, KEY, ORDER, total)
    parts = request_summaries(with_html(placed, source), F.col("pos"))
    while most > segment_rows:
        parts = merged_summaries(parts, [F.floor(F.col("at") / segment_rows).alias("next")]).withColumnRenamed("next", "at")
        most = -(-most // segment_rows)
    return merged_summaries(parts, [])


def apply_requests(pages: DataFrame, reqs: DataFrame, check_version: bool = False, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """U4 (and U1/U2 as special cases): new body, version and title per touched page. Edits
    that change nothing are left out (P14, ``drop_unchanged``)."""
    source = accepted_requests(reqs, pages, check_version)
    ok = source
    if not source.filter("action = 'edit'").isEmpty():
        ok = staged(drop_unchanged(source, pages))
    whole = summed_up(ok, ok, segment_rows)  # texts that go are not converted
    pg = pages.select(*KEY, "title", F.col("version").alias("old_version"), F.col("storage_html"))
    out = whole.join(pg, KEY, "inner")
    body = F.concat_ws("\n", F.col("prepends"), F.coalesce(F.col("base"), F.col("storage_html")), F.col("appends"))
    return out.select(
        *KEY, "title", "old_version",
        (F.col("old_version") + F.col("n")).cast("int").alias("new_version"),
        F.col("n").alias("n_applied"), "n_edits",
        body.alias("new_body"),
        # a replace round-trips the page through markdown, so macros of the old body are lost
        F.when(F.col("n_edits") > 0, F.size(F.split(F.col("storage_html"), "<ac:", -1)) - 1)
        .otherwise(F.lit(0)).cast("long").alias("lost_macros"),
    )


def update_payloads(updated: DataFrame) -> DataFrame:
    """K2: the PUT body per updated page."""
    payload = F.to_json(F.struct(
        F.struct(F.col("new_version").alias("number")).alias("version"),
        F.col("title"), F.lit("page").alias("type"),
        F.struct(F.struct(F.col("new_body").alias("value"), F.lit("storage").alias("representation")).alias("storage")).alias("body"),
    ))
    return updated.select("instance", "page_id", payload.alias("payload"))


def apply_creates(reqs: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Accepted create requests with converted body, parent and line count. With a page
    ``listing`` the parent is looked up by its title (J2)."""
    c = reqs.filter(F.col("action") == "create").withColumn("reasons", reject_reasons(reqs))
    c = c.filter(F.size("reasons") == 0).drop("reasons")
    if listing is not None:
        titles = first_by_title(listing).withColumnRenamed("title", "parent_title")
        c = c.join(titles, ["instance", "space_key", "parent_title"], "left").withColumn("parent_id", resolved_parent())
    n_lines = F.size(F.split(F.regexp_replace(F.col("content"), "\n+$", ""), "\n", -1))
    c = staged(with_source(c).select("request_seq", "instance", "space_key", "title", "parent_id", "is_md", "src", "src_key",
                                     n_lines.cast("long").alias("n_lines")))
    return with_html(c).select("request_seq", "instance", "space_key", "title", "parent_id", F.col("html").alias("body"), "n_lines")


def create_payloads(creates: DataFrame) -> DataFrame:
    """K3: the POST body; ``ancestors`` only when a parent id is given."""
    anc = F.when(F.coalesce(F.col("parent_id"), F.lit("")) != "", F.array(F.struct(F.col("parent_id").alias("id"))))
    payload = F.to_json(F.struct(
        F.lit("page").alias("type"), F.col("title"),
        F.struct(F.col("space_key").alias("key")).alias("space"),
        F.struct(F.struct(F.col("body").alias("value"), F.lit("storage").alias("representation")).alias("storage")).alias("body"),
        anc.alias("ancestors"),
    ))
    return creates.select("request_seq", payload.alias("payload"))


def request_rejects(reqs: DataFrame, pages: DataFrame) -> DataFrame:
    """Rejected requests of a batch with their reasons (argument checks and missing pages)."""
    bad = checked_requests(reqs, pages).filter(F.size("reasons") > 0).select(
        "request_seq", "action", F.array_join("reasons", "; ").alias("reject_reason"))
    c = reqs.filter(F.col("action") == "create").withColumn("reasons", reject_reasons(reqs)) \
        .filter(F.size("reasons") > 0).select("request_seq", "action", F.array_join("reasons", "; ").alias("reject_reason"))
    return bad.unionByName(c)


def edit_changes(pages: DataFrame, reqs: DataFrame) -> DataFrame:
    """For each edit request, whether its cleaned text differs from the page's current
    markdown (an unchanged buffer is not uploaded). Only edited pages are converted."""
    from .export import with_markdown

    edits = reqs.filter(F.col("action") == "edit").withColumn("page_id", page_id_from_url("url"))
    targets = pages.join(edits.select("instance", "page_id").distinct(), ["instance", "page_id"], "left_semi")
    md = with_markdown(targets.select("instance", "page_id", "storage_html"))
    j = edits.join(md, ["instance", "page_id"], "left")
    cleaned = clean_edit("content")
    current = strip_ws(F.coalesce("markdown", F.lit("")))
    return j.select("request_seq", "instance", "page_id", F.col("markdown").isNotNull().alias("page_found"),
                    (cleaned != current).alias("changed"))


def version_diff(changes: DataFrame, old_col: str = "old_body", new_col: str = "new_body") -> DataFrame:
    """Line-level comparison of two versions of each page.

    Lines are compared as multisets (order changes are not edits): one pass cuts both
    versions into (side, line), one aggregate counts each line on both sides, and a line
    that occurs o times before and n times after is kept min(o, n), added max(n - o, 0) and
    removed max(o - n, 0) times.
    """
    key = ["instance", "page_id"]

    def side(col: str, old: int):
        return F.transform(F.split(F.col(col), "\n", -1), lambda line: F.struct(F.lit(old).alias("old"), line.alias("line")))

    empty = F.array().cast("array<struct<old:int,line:string>>")
    lines = changes.select(*key, F.explode(F.concat(F.coalesce(side(old_col, 1), empty), F.coalesce(side(new_col, 0), empty))).alias("l"))
    per_line = lines.groupBy(*key, "l.line").agg(F.sum("l.old").alias("o"), F.sum(1 - F.col("l.old")).alias("n"))
    return per_line.groupBy(*key).agg(
        F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))).cast("long").alias("n_added"),
        F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).cast("long").alias("n_removed"),
        F.sum(F.least("o", "n")).cast("long").alias("n_kept"),
    )


def version_conflicts(pages: DataFrame, reqs: DataFrame) -> DataFrame:
    """U2 option: edits whose base version differs from the stored version of their page."""
    e = reqs.filter(F.col("action") == "edit").withColumn("page_id", page_id_from_url("url"))
    j = e.join(pages.select("instance", "page_id", F.col("version").alias("stored_version")), ["instance", "page_id"])
    return j.filter(F.col("base_version") != F.col("stored_version")).select(
        "request_seq", "instance", "page_id", "base_version", "stored_version")
