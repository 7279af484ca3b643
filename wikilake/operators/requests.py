"""Request checks and lookups.

All lookups are equi-joins or partial aggregates: "first match in listing order" is a
``min(struct(ordinal, page_id))`` per key, which Spark pre-aggregates map-side, so a
title shared by a third of all pages does not land whole in one task. Joins are left
to Catalyst + AQE: a small side is broadcast only after AQE has measured it, and a
skewed key is split by the skew-join rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cache import cached_expr
from ..functions.urls import page_id_from_url

# Actions and content types the client accepts, and the reject texts.
URL_ACTIONS = ["download", "read", "add", "edit"]
ACTIONS = URL_ACTIONS + ["create"]
CONTENT_TYPES = ["markdown", "html"]
NO_PARENT = "No Parent"
# Fixed value: the page skeleton used when no template file exists (title substituted).
SKELETON = """# {title}

## Overview

Write your page content here using Markdown.

## Sections

### Section 1

Content goes here...

### Section 2

More content...

## Tips

- Use **bold** for emphasis
- Use *italic* for subtle emphasis
- Use tables, lists, and code blocks
- Delete this template content and write your own!
"""


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def reject_reasons(r: DataFrame | None = None, page_id: str | None = None) -> Column:
    """Reasons a request is refused (argument checks of the client), as an array column.
    ``page_id`` names a column that holds the id of the URL already."""
    return _reject_reasons(page_id)


@cached_expr
def _reject_reasons(page_id: str | None) -> Column:
    action = F.col("action")
    ctype = F.coalesce(F.col("content_type"), F.lit("markdown"))
    pid = page_id_from_url("url") if page_id is None else F.col(page_id)
    reasons = F.array(
        F.when(~action.isin(*ACTIONS) | action.isNull(), F.lit("unknown action")),
        F.when(action.isin(*URL_ACTIONS) & _missing(F.col("url")), F.lit("url required")),
        F.when(action.isin(*URL_ACTIONS) & ~_missing(F.col("url")) & _missing(pid), F.lit("no page id in url")),
        F.when((action == "create") & _missing(F.col("space_key")), F.lit("space required")),
        F.when((action == "create") & _missing(F.col("title")), F.lit("title required")),
        F.when(action.isin("add", "create") & _missing(F.col("content")), F.lit("content required")),
        F.when(~ctype.isin(*CONTENT_TYPES), F.lit("bad content_type")),
    )
    return F.filter(reasons, lambda x: x.isNotNull())


def validate_requests(reqs: DataFrame) -> DataFrame:
    """P10: every request with ``reject_reason`` ('; '-joined, null when accepted)."""
    rr = F.array_join(reject_reasons(reqs), "; ")
    return reqs.withColumn("reject_reason", F.when(rr != "", rr))


HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def pages_by_url(urls: DataFrame, pages: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """Id from the URL, then the page of the same instance; a missing page is kept
    with ``found = false`` (the client raises there). The client ignores the URL's host and
    asks its configured instance; with ``instances`` given, ``host_mismatch`` marks URLs
    whose host is not the instance's."""
    u = urls.select("*", page_id_from_url("url").alias("page_id"))
    p = pages.select("instance", "page_id", "title", "version", F.lit(True).alias("_hit"))
    j = u.join(p, ["instance", "page_id"], "left")
    j = j.withColumn("found", F.coalesce("_hit", F.lit(False)) & ~_missing(F.col("page_id"))).drop("_hit")
    if instances is None:
        return j
    inst = instances.select("instance", F.lower(F.regexp_extract("base_url", HOST_RE, 1)).alias("_base_host"))
    url_host = F.lower(F.regexp_extract(F.col("url"), HOST_RE, 1))
    j = join_profiles(j, inst)
    return j.withColumn("host_mismatch", (url_host != "") & (url_host != F.coalesce(F.col("_base_host"), F.lit(""))))\
        .drop("_base_host")


def first_by_title(listing: DataFrame) -> DataFrame:
    """(instance, space_key, title) → first page in listing order and the number of matches."""
    return listing.groupBy("instance", "space_key", "title").agg(
        F.min(F.struct("ordinal", "page_id"))["page_id"].alias("first_page_id"),
        F.count(F.lit(1)).alias("n_matches"),
    )


def pages_by_title(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """Page id by (instance, space, title), first match in listing order."""
    j = keys.join(first_by_title(listing), ["instance", "space_key", "title"], "left")
    return j.select("*", F.coalesce("n_matches", F.lit(0)).alias("n_found")).drop("n_matches") \
        .withColumnRenamed("first_page_id", "page_id")


def _at_root() -> Column:
    return _missing(F.col("parent_title")) | (F.col("parent_title") == NO_PARENT)


def resolved_parent() -> Column:
    """No parent at the root; else the id given, else the first page of that title."""
    return F.when(~_at_root(), F.coalesce(F.col("parent_id"), F.col("first_page_id")))


def resolve_parents(reqs: DataFrame, listing: DataFrame) -> DataFrame:
    """Parent id of create requests by title within the chosen space."""
    creates = reqs.filter(F.col("action") == "create")
    root = _at_root()
    lk = first_by_title(listing).withColumnRenamed("title", "parent_title")
    j = creates.join(lk, ["instance", "space_key", "parent_title"], "left")
    return j.select(
        "request_seq", "instance", "space_key", "parent_title",
        resolved_parent().alias("parent_id"),
        F.when(root, F.lit(0)).otherwise(F.coalesce(F.col("n_matches"), F.lit(0))).cast("long").alias("n_matches"),
        F.when(root, F.lit("root")).when(F.col("first_page_id").isNull(), F.lit("missing")).otherwise(F.lit("found")).alias("parent_status"),
    )


@cached_expr
def skeleton(title: Column) -> Column:
    head, tail = SKELETON.split("{title}")
    return F.concat(F.lit(head), title, F.lit(tail))


def render_templates(reqs: DataFrame, templates: DataFrame) -> DataFrame:
    """The text a create starts from: the named template, else the skeleton; trailing
    newlines dropped as a shell command substitution does; ``n_lines`` as ``wc -l`` counts
    the echoed text."""
    creates = reqs.filter(F.col("action") == "create")
    t = templates.select(F.col("name").alias("template"), F.col("body").alias("_tbody"))
    j = creates.join(t, "template", "left")
    body = F.regexp_replace(F.coalesce(F.col("_tbody"), skeleton(F.col("title"))), "\n+$", "")
    return j.select(
        "request_seq", "template", F.col("_tbody").isNotNull().alias("template_found"), body.alias("body"),
        (F.size(F.split(body, "\n", -1))).cast("long").alias("n_lines"),
    )


PROFILE_ROWS = 10_000  # instance profiles that may be broadcast
PROFILE_SALTS = 32


def join_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """``df`` left-joined with ``profiles`` on ``instance``, without shuffling ``df`` by that
    column (few values, so few partitions). The number of profiles is checked first: up to
    ``PROFILE_ROWS`` they are broadcast, beyond that the join key is salted."""
    if profiles.limit(PROFILE_ROWS + 1).count() <= PROFILE_ROWS:
        return df.join(F.broadcast(profiles), "instance", "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(PROFILE_SALTS - 1))).alias("_salt")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != "instance"]), F.lit(PROFILE_SALTS)).cast("int"))
    return salted.join(profiles.select("*", salts), ["instance", "_salt"], "left").drop("_salt")


def with_base_url(df: DataFrame, instances: DataFrame, given: str | None = None) -> DataFrame:
    """Base URL per row: an explicit one wins, else the instance profile's; rows of an
    unknown profile get ``base_status = 'unknown profile'``."""
    inst = instances.select("instance", F.col("base_url").alias("_profile_url"))
    j = join_profiles(df, inst)
    explicit = F.col(given) if given else F.lit(None).cast("string")
    base = F.coalesce(F.when(explicit != "", explicit), F.col("_profile_url"))
    return j.withColumn("base_url", base).withColumn(
        "base_status", F.when(base.isNull(), F.lit("unknown profile")).otherwise(F.lit("ok"))).drop("_profile_url")


def requests_from_list(lines: DataFrame, space_key: str) -> DataFrame:
    """S7: 'title|content' lines → create requests (fields 1 and 2 only, as ``cut`` does;
    a line without '|' gives itself for both)."""
    line = F.col("line")
    has = line.contains("|")
    return lines.select(
        F.split_part(line, F.lit("|"), F.lit(1)).alias("title"),
        F.when(has, F.split_part(line, F.lit("|"), F.lit(2))).otherwise(line).alias("content"),
        F.lit("create").alias("action"), F.lit(space_key).alias("space_key"), F.lit("markdown").alias("content_type"),
    )


def fill_templates(df: DataFrame, body_col: str, values_col: str) -> DataFrame:
    """Replace each ``[name]`` in the body with its value from a per-row map column."""
    filled = F.aggregate(F.map_entries(F.col(values_col)), F.col(body_col),
                         lambda acc, e: F.replace(acc, F.concat(F.lit("["), e["key"], F.lit("]")), e["value"]))
    return df.withColumn(body_col, filled)
