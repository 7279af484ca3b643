"""Registered queries: one per operator of the inventory, each over whole derived tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Column names match
the DuckDB twins in ``plans/oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import page_id_from_url
from ..operators import search, search_many
from ..sources import fixtures as fx
from ..sources import listing as L

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Fixed parameters of the registered search queries.
SEARCH_QUERY = "en the"
SEARCH_QUERY_EXTENDED = "^EN 'tion !zz th | qx"
SPACE_FOR_S3 = "EN"


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _all_raw(spark, sf):
    return fx.listing_raw(spark, sf).unionByName(fx.space_listing_raw(spark, sf))


def _listing(spark, sf):
    return L.page_listing(_all_raw(spark, sf))


@register("page_id_from_url")
def q_page_id_from_url(spark, sf):
    u = fx.url_cases(spark, sf)
    return u.select("instance", "url", F.col("page_id").alias("listed_id"), page_id_from_url("url").alias("page_id"))


@register("page_url")
def q_page_url(spark, sf):
    p = fx.wiki_pages(spark, sf).select("instance", "page_id")
    inst = fx.instances(spark, sf)
    return R.join_profiles(p, inst).select("instance", "page_id", T.page_url("base_url", "page_id").alias("url"))


@register("slug")
def q_slug(spark, sf):
    p = fx.wiki_pages(spark, sf)
    return p.select("page_id", "title", T.slug("title").alias("file_name"))


@register("metadata_header")
def q_header(spark, sf):
    p = fx.wiki_pages(spark, sf).drop("storage_html")
    inst = fx.instances(spark, sf)
    j = R.join_profiles(p, inst)
    url = T.page_url("base_url", "page_id")
    return j.select("page_id", T.metadata_header("title", "space_name", "page_id", "version", url).alias("header"))


@register("page_listing")
def q_page_listing(spark, sf):
    raw = _all_raw(spark, sf).unionByName(fx.odd_listing_raw(spark, sf))
    return L.page_listing(raw).drop("req_space_key")


@register("listing_rejects")
def q_listing_rejects(spark, sf):
    raw = _all_raw(spark, sf).unionByName(fx.odd_listing_raw(spark, sf))
    return L.listing_rejects(raw).select("instance", "kind", "start", F.length("body").alias("n_chars"), F.col("body").alias("bad_text"))


@register("space_listing")
def q_space_listing(spark, sf):
    return L.space_listing(_all_raw(spark, sf))


@register("pages_in_space")
def q_pages_in_space(spark, sf):
    return L.pages_in_space(_listing(spark, sf), SPACE_FOR_S3)


@register("page_details")
def q_page_details(spark, sf):
    return L.page_details(fx.page_raw(spark, sf))


@register("listing_audit")
def q_listing_audit(spark, sf):
    return L.listing_audit(_all_raw(spark, sf).unionByName(fx.odd_listing_raw(spark, sf)))


@register("listing_counts")
def q_listing_counts(spark, sf):
    return L.listing_counts(_listing(spark, sf))


@register("space_counts")
def q_space_counts(spark, sf):
    return L.space_counts(L.space_listing(_all_raw(spark, sf)))


@register("search_pages")
def q_search(spark, sf):
    return search.search_pages(_listing(spark, sf).drop("req_space_key"), SEARCH_QUERY)


@register("search_pages_extended")
def q_search_ext(spark, sf):
    return search.search_pages(_listing(spark, sf).drop("req_space_key"), SEARCH_QUERY_EXTENDED)


@register("search_many")
def q_search_many(spark, sf):
    found = search_many.search_many(_listing(spark, sf).drop("req_space_key"), fx.search_queries(spark, sf))
    return found.select("query_id", "instance", "ordinal", "page_id", "title", "space_key")


@register("clean_edit")
def q_clean_edit(spark, sf):
    r = fx.request_table(spark, sf).filter(F.col("action") == "edit")
    return r.select("request_seq", T.clean_edit("content").alias("cleaned"))


# --- document transforms ---------------------------------------------------------------
from ..operators import html2md as H  # noqa: E402


# What every seventh page of the conversion fixture gets before its article ends: entities,
# empty and blank-edged pairs, a code macro, code in a list, cells with blocks and pipes, a
# nested table, link text in CDATA.
ODD_HTML = ("<p>caf&eacute; &rarr; &NotEqualTilde; &#00233; &nosuchname; a<b> x </b>b<b></b><i><b> </b></i>c</p>"
            "<ac:structured-macro ac:name=\"code\"><ac:plain-text-body><![CDATA[x = \"&amp;\"\n```\n# no heading]]></ac:plain-text-body>"
            "</ac:structured-macro><ul><li>code<pre>in\n  list</pre></li></ul><table><tr><th>k|v</th><td><p>one</p><p>two</p>"
            "<ul><li>x</li></ul></td></tr><tr><td>p<table><tr><td>q</td></tr></table>s</td><td><em>t </em>u</td></tr></table>"
            "<p>see <ac:link><ac:plain-text-link-body><![CDATA[this * page]]></ac:plain-text-link-body></ac:link></p></article>")


def html_fixture(spark, sf):
    """Pages for the conversion: the stored HTML, plus deterministic rewrites that bring in
    the tags the generated pages lack (ordered lists, quotes, tables, pre, images, code,
    emphasis), chosen by page_id % 4 over the whole table."""
    p = fx.wiki_pages(spark, sf)
    n = F.col("page_id").cast("long")
    h = F.col("storage_html")
    h1 = F.when(n % 4 == 1, F.regexp_replace(F.regexp_replace(h, "<nav><ul>", "<nav><ol start=\"3\">"), "</ul></nav>", "</ol></nav>")).otherwise(h)
    h2 = F.when(n % 4 == 2, F.regexp_replace(h1, r"<div class=\"ad\">([^<]*)</div>",
                                             "<blockquote><p>$1</p><p><em>quoted</em> <code>a_b*c</code></p></blockquote>")).otherwise(h1)
    h3 = F.when(n % 4 == 3, F.regexp_replace(h2, "<footer>",
                                             "<table><tr><th>Key</th><th>Value</th></tr><tr><td>id</td><td><i>x</i></td></tr>"
                                             "<tr><td>n</td><td>2</td></tr></table><pre>  a &lt; b\n\n  c</pre>"
                                             "<img src=\"/i.png\" alt=\"pic\" title=\"T\"><hr><footer>")).otherwise(h2)
    h4 = F.when(n % 4 == 0, F.regexp_replace(h3, "</h1>", "</h1><ul><li>one<ul><li>two<ol><li>three</li></ol></li></ul></li>"
                                             "<li><a href=\"http://x.org\">http://x.org</a></li></ul><table><tr><td>a</td><td>b</td></tr></table>")).otherwise(h3)
    h5 = F.when(n % 7 == 3, F.replace(h4, F.lit("</article>"), F.lit(ODD_HTML))).otherwise(h4)
    return p.select("page_id", h5.alias("html"))


@register("html_to_markdown")
def q_html_to_markdown(spark, sf):
    return H.html_to_markdown(html_fixture(spark, sf))


@register("html_tokens")
def q_html_tokens(spark, sf):
    return H.html_tokens_check(html_fixture(spark, sf))


from ..operators import md2html as M  # noqa: E402
from ..session import partitions_for  # noqa: E402


@register("markdown_to_html")
def q_markdown_to_html(spark, sf):
    docs = fx.markdown_inputs(spark, sf)
    return M.markdown_to_html(docs, num_partitions=partitions_for(docs))


# --- requests, lookups, updates ----------------------------------------------------------
from ..operators import requests as R  # noqa: E402
from ..operators import updates as U  # noqa: E402

LIST_SPACE = "DOCS"


@register("validate_requests")
def q_validate(spark, sf):
    return R.validate_requests(fx.request_table(spark, sf)).select("request_seq", "action", "reject_reason")


@register("pages_by_url")
def q_pages_by_url(spark, sf):
    u = fx.url_cases(spark, sf).withColumnRenamed("page_id", "listed_id")
    out = R.pages_by_url(u, fx.wiki_pages(spark, sf), fx.instances(spark, sf))
    return out.select("instance", "url", "listed_id", "page_id", "found", "title",
                      F.col("version").cast("string").alias("version"), "host_mismatch")


@register("pages_by_title")
def q_pages_by_title(spark, sf):
    keys = fx.wiki_pages(spark, sf).select("instance", "space_key", "title", F.col("page_id").alias("key_page_id"))
    return R.pages_by_title(keys, _listing(spark, sf))


@register("resolve_parents")
def q_resolve_parents(spark, sf):
    return R.resolve_parents(fx.request_table(spark, sf), _listing(spark, sf))


@register("render_templates")
def q_render_templates(spark, sf):
    return R.render_templates(fx.document_template_requests(spark, sf), fx.document_templates(spark, sf))


@register("render_document_templates")
def q_render_document_templates(spark, sf):
    return R.render_templates(fx.document_template_requests(spark, sf), fx.document_templates(spark, sf))


@register("with_base_url")
def q_with_base_url(spark, sf):
    r = fx.request_table(spark, sf).select("request_seq", "instance")
    return R.with_base_url(r, fx.instances(spark, sf))


@register("requests_from_list")
def q_requests_from_list(spark, sf):
    return R.requests_from_list(fx.create_list(spark, sf), LIST_SPACE)


def _apply(spark, sf, action=None):
    reqs = fx.request_table(spark, sf)
    if action:
        reqs = reqs.filter(F.col("action") == action)
    return U.apply_requests(fx.wiki_pages(spark, sf), reqs)


@register("apply_requests")
def q_apply_requests(spark, sf):
    return _apply(spark, sf)


@register("apply_requests_hot")
def q_apply_requests_hot(spark, sf):
    return U.apply_requests(fx.wiki_pages(spark, sf), fx.hot_requests(spark, sf))


@register("apply_adds")
def q_apply_adds(spark, sf):
    return _apply(spark, sf, "add")


@register("apply_edits")
def q_apply_edits(spark, sf):
    return _apply(spark, sf, "edit")


def edit_buffer_requests(spark, sf):
    """One edit per page with the page's own buffer: untouched for even page ids, with a
    line added for odd ones."""
    pages = fx.wiki_pages(spark, sf)
    buf = X.edit_buffers(pages).select("instance", "page_id", "buffer")
    n = F.col("page_id").cast("long")
    meta = pages.select("instance", "page_id", "version")
    return buf.join(meta, ["instance", "page_id"]).select(
        n.alias("request_seq"), "instance", F.lit("edit").alias("action"),
        F.concat(F.lit("https://wiki.example.com/pages/viewpage.action?pageId="), F.col("page_id")).alias("url"),
        F.when(n % 2 == 0, F.col("buffer")).otherwise(F.concat("buffer", F.lit("\n\nadded line\n"))).alias("content"),
        F.lit("markdown").alias("content_type"), F.lit(True).alias("append"),
        *[F.lit(None).cast("string").alias(c) for c in ("space_key", "title", "parent_id", "parent_title", "template")],
        F.col("version").alias("base_version"))


@register("apply_edit_buffers")
def q_apply_edit_buffers(spark, sf):
    out = U.apply_requests(fx.wiki_pages(spark, sf), edit_buffer_requests(spark, sf))
    return out.select("instance", "page_id", "old_version", "new_version", "n_applied", "n_edits", "lost_macros",
                      F.col("new_body").endswith("<p>added line</p>").alias("has_added_line"))


@register("update_payloads")
def q_update_payloads(spark, sf):
    return U.update_payloads(_apply(spark, sf))


def _creates(spark, sf):
    return U.apply_creates(fx.request_table(spark, sf), _listing(spark, sf))


@register("apply_creates")
def q_apply_creates(spark, sf):
    return _creates(spark, sf)


@register("create_payloads")
def q_create_payloads(spark, sf):
    return U.create_payloads(_creates(spark, sf))


@register("request_rejects")
def q_request_rejects(spark, sf):
    return U.request_rejects(fx.request_table(spark, sf), fx.wiki_pages(spark, sf))


# --- read / export / edit buffers ---------------------------------------------------------
from ..operators import export as X  # noqa: E402


@register("export_documents")
def q_export_documents(spark, sf):
    return X.export_documents(fx.wiki_pages(spark, sf), fx.instances(spark, sf))


@register("read_pages")
def q_read_pages(spark, sf):
    return X.read_pages(fx.wiki_pages(spark, sf), fx.instances(spark, sf))


@register("edit_buffers")
def q_edit_buffers(spark, sf):
    return X.edit_buffers(fx.wiki_pages(spark, sf))


# --- streaming forms -------------------------------------------------------------------------
from ..streaming import stream as ST  # noqa: E402


@register("stream_listing")
def q_stream_listing(spark, sf):
    work = ST._run_dir(spark, "listing")
    src = work + "/source"
    # two captures: in the later one, written first, pages stand ten places earlier and are renamed
    raw = fx.listing_raw(spark, sf)
    later = raw.withColumn("body", F.regexp_replace("body", '"title":"', '"title":"new ')).withColumn("start", F.col("start") - 10)
    ST.write_listing_source(later, src, capture=2)
    ST.write_listing_source(raw, src, capture=1)
    return ST.stream_listing(spark, src, work, max_files=3)


@register("stream_convert")
def q_stream_convert(spark, sf):
    return ST.stream_convert(spark, f"{sf.rstrip('/')}/pages.parquet")


# --- file sources and edit change check --------------------------------------------------------
from ..sources import files as FS  # noqa: E402


@register("load_templates")
def q_load_templates(spark, sf):
    path = ST._run_dir(spark, "templates")
    FS.write_template_store(fx.document_templates(spark, sf), path)
    return FS.load_template_store(spark, path)


@register("load_document_templates")
def q_load_document_templates(spark, sf):
    path = ST._run_dir(spark, "document_templates")
    FS.write_templates(fx.document_templates(spark, sf), path)
    return FS.load_templates(spark, path)


@register("load_instances")
def q_load_instances(spark, sf):
    path = ST._run_dir(spark, "profiles")
    FS.write_instances(fx.instances(spark, sf), path)
    return FS.load_instances(spark, path)


@register("edit_changes")
def q_edit_changes(spark, sf):
    return U.edit_changes(fx.wiki_pages(spark, sf), fx.request_table(spark, sf))


# --- SQL functions, side tables, bag union ------------------------------------------------------
from ..functions.sqlfuncs import register_sql_functions  # noqa: E402


@register("sql_functions")
def q_sql_functions(spark, sf):
    register_sql_functions(spark)
    p = fx.wiki_pages(spark, sf).drop("storage_html")
    return spark.sql("""
        SELECT p.page_id,
               wiki_slug(p.title) AS file_name,
               wiki_page_url(i.base_url, p.page_id) AS url,
               wiki_header(p.title, p.space_name, p.page_id, p.version, wiki_page_url(i.base_url, p.page_id)) AS header,
               wiki_page_id(u.url) AS url_page_id,
               wiki_clean_edit(wiki_header(p.title, p.space_name, p.page_id, p.version, u.url)) AS cleaned_header
        FROM {p} p JOIN {i} i ON p.instance = i.instance JOIN {u} u ON u.page_id = p.page_id""",
                     p=p, i=fx.instances(spark, sf), u=fx.url_cases(spark, sf))


@register("html_headings")
def q_html_headings(spark, sf):
    return H.html_headings(html_fixture(spark, sf))


@register("html_tables")
def q_html_tables(spark, sf):
    return H.html_tables(html_fixture(spark, sf))


@register("html_links")
def q_html_links(spark, sf):
    return H.html_links(html_fixture(spark, sf))


@register("listing_union")
def q_listing_union(spark, sf):
    raw = fx.listing_raw(spark, sf)
    return L.page_listing(raw.unionByName(raw)).drop("req_space_key")


# --- roadmap: search by content, version compare ------------------------------------------------
CONTENT_QUERY = "^EN 'example.com !zzz"


@register("search_content")
def q_search_content(spark, sf):
    md = X.with_markdown(fx.wiki_pages(spark, sf))
    return search.search_content(md, CONTENT_QUERY).select("instance", "page_id", "title", "space_key")


@register("version_diff")
def q_version_diff(spark, sf):
    new = _apply(spark, sf).select("instance", "page_id", "new_body")
    old = fx.wiki_pages(spark, sf).select("instance", "page_id", F.col("storage_html").alias("old_body"))
    return U.version_diff(new.join(old, ["instance", "page_id"]))


@register("apply_edits_checked")
def q_apply_edits_checked(spark, sf):
    reqs = fx.request_table(spark, sf).filter(F.col("action") == "edit")
    return U.apply_requests(fx.wiki_pages(spark, sf), reqs, check_version=True)


@register("version_conflicts")
def q_version_conflicts(spark, sf):
    return U.version_conflicts(fx.wiki_pages(spark, sf), fx.request_table(spark, sf))


@register("pages_in_space_stored")
def q_pages_in_space_stored(spark, sf):
    path = ST._run_dir(spark, "listing_table")
    L.write_listing(_listing(spark, sf).drop("req_space_key"), path)
    return L.read_space(spark, path, SPACE_FOR_S3)


def _filled(reqs, templates):
    rendered = R.render_templates(reqs, templates).join(reqs.select("request_seq", "title"), "request_seq")
    date = F.date_format(F.date_add(F.to_date(F.lit("2025-01-01")), (F.col("request_seq") % 365).cast("int")), "yyyy-MM-dd")
    values = F.create_map(F.lit("Date"), date, F.lit("Title"), F.col("title"))
    return R.fill_templates(rendered.withColumn("vals", values), "body", "vals").select("request_seq", "body")


@register("fill_templates")
def q_fill_templates(spark, sf):
    return _filled(fx.document_template_requests(spark, sf), fx.document_templates(spark, sf))


@register("fill_document_templates")
def q_fill_document_templates(spark, sf):
    return _filled(fx.document_template_requests(spark, sf), fx.document_templates(spark, sf))


FIRST_N = 10


@register("first_pages")
def q_first_pages(spark, sf):
    return L.first_pages(_listing(spark, sf).drop("req_space_key"), FIRST_N)


# --- history, restore (R4) and dry run (R6) ------------------------------------------------------

from ..operators import coverage as CO  # noqa: E402
from ..operators import dryrun as DR  # noqa: E402
from ..operators import export_store as ES  # noqa: E402
from ..operators import history as HI  # noqa: E402
from ..operators import selection as SE  # noqa: E402
from ..session import checkpoint_dir  # noqa: E402


def _versions(spark, sf):
    """The version table over stored pages and later versions, written in two batches."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    HI.append_versions(HI.stored_versions(fx.wiki_pages(spark, sf)), path, 0)
    HI.append_versions(fx.version_batch(spark, sf), path, 1)
    return path, HI.read_versions(spark, path)


@register("page_history")
def q_page_history(spark, sf):
    return HI.page_history(_versions(spark, sf)[1])


@register("page_as_of")
def q_page_as_of(spark, sf):
    found = HI.page_as_of(_versions(spark, sf)[1], fx.version_asks(spark, sf))
    return found.select("request_seq", "instance", "page_id", "as_of", "found_version", "title", F.sha2("storage_html", 256).alias("body_sha256"))


@register("restore_versions")
def q_restore_versions(spark, sf):
    path, versions = _versions(spark, sf)
    HI.append_versions(HI.restore(versions, fx.version_asks(spark, sf).filter("request_seq % 4 = 0")), path, 2)
    after = HI.read_versions(spark, path)
    return after.filter("change = 'restore'").select("instance", "page_id", "version", "title", F.sha2("storage_html", 256).alias("body_sha256"))


@register("current_pages")
def q_current_pages(spark, sf):
    return HI.current_pages(_versions(spark, sf)[1]).select("instance", "page_id", "version", "title", "change", F.sha2("storage_html", 256).alias("body_sha256"))


@register("export_space")
def q_export_space(spark, sf):
    """Every space of the store, each read back from its files."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    ES.write_page_store(fx.wiki_pages(spark, sf), f"{base}/store")
    ES.export_space(spark, f"{base}/store", fx.instances(spark, sf), f"{base}/out")
    return ES.checked_files(spark, f"{base}/out").drop("path")


@register("listing_coverage")
def q_listing_coverage(spark, sf):
    return CO.listing_coverage(L.response_extents(fx.captures(spark, sf)))


@register("listing_moves")
def q_listing_moves(spark, sf):
    return CO.listing_moves(L.page_listing(fx.captures(spark, sf), "capture"))


def _selected(spark, sf):
    return SE.expand_requests(fx.selector_table(spark, sf), _listing(spark, sf).drop("req_space_key"), fx.instances(spark, sf))


@register("expand_requests")
def q_expand_requests(spark, sf):
    return _selected(spark, sf).select("request_seq", "selector_id", "instance", "url", "content", "content_type", "append")


@register("apply_selected")
def q_apply_selected(spark, sf):
    done = U.apply_requests(fx.wiki_pages(spark, sf), _selected(spark, sf).drop("selector_id"))
    return done.select("instance", "page_id", "old_version", "new_version", "n_applied", F.sha2("new_body", 256).alias("body_sha256"))


@register("dry_run")
def q_dry_run(spark, sf):
    report = DR.change_report(DR.dry_run(fx.wiki_pages(spark, sf), fx.request_table(spark, sf)))
    return report.select("instance", "page_id", "old_version", "new_version", "lost_macros", (F.col("n_added") - F.col("n_removed")).alias("net_lines"),
                         "rebuilt_sha256", "exact", "backup_sha256")


@register("dry_run_hunks")
def q_dry_run_hunks(spark, sf):
    return DR.dry_run(fx.wiki_pages(spark, sf), fx.request_table(spark, sf)).hunks
