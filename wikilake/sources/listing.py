"""Listing responses → tables (S1 page listing, S2 space listing, S3 pages of a space,
S4 page details, S5 completeness audit, A1 counts; L1 order and X1 bag union inside).

A listing is a bag of captured REST responses, one row per response. Parsing is a
``from_json`` with an explicit schema and a ``posexplode``: both are per-row, so the
work is spread over all scan tasks and nothing is shuffled. Order is carried as an
explicit ``ordinal`` (``start + position``), never by sorting the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults a listing uses for missing keys.
PAGE_DEFAULTS = {"id": "", "title": "Untitled", "space_key": "UNKNOWN", "space_name": "Unknown Space"}
SPACE_DEFAULTS = {"key": "UNKNOWN", "name": "Unknown Space", "type": "unknown"}
REQUEST_LIMIT = 100  # assumed where a response does not state its own limit

PAGE_BODY = ("struct<results:array<struct<id:string,title:string,space:struct<key:string,name:string>>>,"
             "start:int,limit:int,size:int,_links:struct<next:string>,_corrupt_record:string>")
SPACE_BODY = ("struct<results:array<struct<key:string,name:string,type:string>>,"
              "start:int,limit:int,size:int,_links:struct<next:string>,_corrupt_record:string>")
DETAIL_BODY = ("struct<id:string,title:string,space:struct<key:string,name:string>,version:struct<number:int>,"
               "ancestors:array<struct<id:string>>,body:struct<storage:struct<value:string>>,_corrupt_record:string>")
AUDIT_BODY = ("struct<results:array<struct<id:string,key:string>>,limit:int,_links:struct<next:string>,"
              "_corrupt_record:string>")
JSON_MODE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _blank(body):
    return body.isNull() | (F.trim(body) == "")


def _is_corrupt(j, body):
    """A response that is not empty and yet not a whole JSON object with a results list."""
    return ~_blank(body) & (j.isNull() | j["_corrupt_record"].isNotNull() | j["results"].isNull())


def _parse(raw: DataFrame, kind: str, schema: str, *more: str) -> DataFrame:
    """Responses of one kind. A corrupt response contributes no rows (its text is in
    ``listing_rejects`` and flagged by ``listing_audit``), never some of its rows."""
    j = F.from_json("body", schema, JSON_MODE)
    return raw.filter(F.col("kind") == kind).select(
        "instance", F.col("space_key").alias("req_space_key"), "start", "body", *more, j.alias("j")) \
        .filter(~_is_corrupt(F.col("j"), F.col("body"))).drop("body")


def listing_rejects(raw: DataFrame) -> DataFrame:
    """Corrupt listing responses (any kind) with their whole text, so nothing is lost
    silently; the client stops with an error on such a response."""
    j = F.from_json("body", AUDIT_BODY, JSON_MODE)
    parsed = raw.select("instance", "kind", "space_key", "start", "body", j.alias("j"))
    return parsed.filter(_is_corrupt(F.col("j"), F.col("body"))).select("instance", "kind", "space_key", "start", "body")


def page_listing(raw: DataFrame, *more: str) -> DataFrame:
    """S1 + P4 + L1 + X1: one row per listed page, defaults filled, ordinal kept, with the
    columns ``more`` of its response.

    ``raw`` may be the union of several captures (bag union, no dedupe).
    """
    items = _parse(raw, "page", PAGE_BODY, *more).select(
        "instance", "req_space_key", "start", *more, F.posexplode("j.results").alias("pos", "it"))
    d = PAGE_DEFAULTS
    return items.select(
        "instance",
        F.col("start").alias("resp_start"),
        F.col("pos").alias("item_pos"),
        (F.col("start") + F.col("pos")).cast("long").alias("ordinal"),
        F.coalesce(F.col("it.id"), F.lit(d["id"])).alias("page_id"),
        F.coalesce(F.col("it.title"), F.lit(d["title"])).alias("title"),
        F.coalesce(F.col("it.space.key"), F.lit(d["space_key"])).alias("space_key"),
        F.coalesce(F.col("it.space.name"), F.lit(d["space_name"])).alias("space_name"),
        F.col("req_space_key"), *more,
    )


def space_listing(raw: DataFrame) -> DataFrame:
    """One row per listed space."""
    items = _parse(raw, "space", SPACE_BODY).select("instance", "start", F.posexplode("j.results").alias("pos", "it"))
    d = SPACE_DEFAULTS
    return items.select(
        "instance",
        (F.col("start") + F.col("pos")).cast("long").alias("ordinal"),
        F.coalesce(F.col("it.key"), F.lit(d["key"])).alias("space_key"),
        F.coalesce(F.col("it.name"), F.lit(d["name"])).alias("space_name"),
        F.coalesce(F.col("it.type"), F.lit(d["type"])).alias("space_type"),
    )


def pages_in_space(listing: DataFrame, space_key: str) -> DataFrame:
    """S3: the pages of one space. A listing captured per space carries ``req_space_key``;
    a whole-instance listing is filtered on the item's space. Stored listings are
    partitioned by ``space_key`` so this filter prunes files."""
    k = F.lit(space_key)
    return listing.filter(F.coalesce(F.col("req_space_key"), F.col("space_key")) == k).drop("req_space_key")


def page_details(raw: DataFrame) -> DataFrame:
    """Page detail responses flattened to the page table; bad JSON is flagged and kept
    as text in ``bad_text``. Ancestors run from the top of the tree down, so the last one
    is the parent."""
    j = F.from_json("body", DETAIL_BODY, JSON_MODE)
    parsed = raw.select("instance", "body", j.alias("j"))
    corrupt = F.col("j._corrupt_record").isNotNull() | F.col("j").isNull()

    def ok(c):  # a corrupt record keeps no partial fields
        return F.when(~corrupt, c)

    return parsed.select(
        "instance",
        ok(F.col("j.id")).alias("page_id"),
        ok(F.col("j.title")).alias("title"),
        ok(F.col("j.space.key")).alias("space_key"),
        ok(F.col("j.space.name")).alias("space_name"),
        ok(F.col("j.version.number")).cast("string").alias("version"),
        ok(F.col("j.body.storage.value")).alias("storage_html"),
        ok(F.get(F.col("j.ancestors"), F.size("j.ancestors") - 1)["id"]).alias("parent_id"),
        corrupt.alias("is_corrupt"),
        F.when(corrupt, F.col("body")).alias("bad_text"),
    )


def listing_audit(raw: DataFrame) -> DataFrame:
    """Per response, the stop rule and completeness checks.

    * ``is_corrupt``: not empty, but not a whole JSON object with a results list; such a
      response is never ``is_last`` and its items count as missing (``gap_after``);
    * ``is_last``: empty body, or fewer items than the response's own limit (the client's
      stop rule; ``REQUEST_LIMIT`` where none is stated);
    * ``fetched_so_far``: the running figure the client prints, ``start + limit``;
    * ``has_next_link`` / ``stops_early``: a "last" response that still links onwards;
    * ``gap_after``: a non-last response with no response starting right after its items;
    * ``n_dup_ids``: ids listed more than once in the same listing.

    Every response is read and parsed once: it is cut into marks (its start, the offset
    after its items, its ids) that one aggregate counts per listing and value, so neither a
    self-join nor a window over a whole listing is needed.
    """
    j = F.from_json("body", AUDIT_BODY, JSON_MODE)
    key = ["instance", "kind", "space_key"]
    resp = raw.select(*key, "start", "body", j.alias("j"))
    corrupt = _is_corrupt(F.col("j"), F.col("body"))
    resp = resp.select(
        *key, "start", _blank(F.col("body")).alias("empty_body"), corrupt.alias("is_corrupt"),
        F.when(corrupt, 0).otherwise(F.coalesce(F.size("j.results"), F.lit(0))).cast("int").alias("n_items"),
        F.coalesce(F.when(~corrupt, F.col("j.limit")), F.lit(REQUEST_LIMIT)).alias("page_limit"),
        (~corrupt & F.col("j._links.next").isNotNull()).alias("has_next_link"),
        F.when(~corrupt, F.when(F.col("kind") == "space", F.col("j.results.key")).otherwise(F.col("j.results.id"))).alias("ids"),
    )
    resp = resp.withColumn("is_last", F.col("empty_body") | (~F.col("is_corrupt") & (F.col("n_items") < F.col("page_limit"))))
    own = F.struct("start", "n_items", "empty_body", "is_corrupt", "is_last", "page_limit", "has_next_link")
    none = F.lit(None).cast(resp.select(own.alias("o")).schema["o"].dataType)

    def mark(tag: str, value, response, begins: bool):
        return F.struct(F.lit(tag).alias("tag"), value.cast("string").alias("value"), response.alias("own"), F.lit(begins).alias("begins"))

    ids = F.transform(F.filter(F.coalesce("ids", F.array().cast("array<string>")), lambda x: x.isNotNull()),
                      lambda x: mark("id", x, none, False))
    marks = resp.select(*key, F.explode(F.concat(F.array(
        mark("at", F.col("start"), none, True), mark("at", F.col("start") + F.col("n_items"), own, False)), ids)).alias("m"))
    met = marks.groupBy(*key, "m.tag", "m.value").agg(
        F.max("m.begins").alias("has_successor"), F.collect_list("m.own").alias("owns"), F.count(F.lit(1)).alias("c"))
    dups = met.groupBy(*key).agg(F.sum(F.when(F.col("tag") == "id", F.col("c") - 1).otherwise(0)).cast("long").alias("n_dup_ids"))
    dups = dups.select(*[F.col(k).alias("d_" + k) for k in key], "n_dup_ids")
    out = met.select(*key, "has_successor", F.explode("owns").alias("o")).join(
        dups, [F.col(k).eqNullSafe(F.col("d_" + k)) for k in key], "left")
    return out.select(
        *key, F.col("o.start").alias("start"), F.col("o.n_items").alias("n_items"), F.col("o.empty_body").alias("empty_body"),
        F.col("o.is_corrupt").alias("is_corrupt"), F.col("o.is_last").alias("is_last"),
        (F.col("o.start") + F.col("o.page_limit")).cast("int").alias("fetched_so_far"),
        F.col("o.has_next_link").alias("has_next_link"),
        (F.col("o.is_last") & F.col("o.has_next_link")).alias("stops_early"),
        (F.col("o.is_corrupt") | (~F.col("o.is_last") & ~F.col("has_successor"))).alias("gap_after"),
        F.coalesce(F.col("n_dup_ids"), F.lit(0).cast("long")).alias("n_dup_ids"),
    )


def response_extents(raw: DataFrame) -> DataFrame:
    """(instance, kind, space_key, capture, start, n_items): what each response covers; a
    corrupt response covers nothing. Without a ``capture`` column all is one capture, 0."""
    j = F.from_json("body", AUDIT_BODY, JSON_MODE)
    capture = F.col("capture") if "capture" in raw.columns else F.lit(0)
    parsed = raw.select("instance", "kind", "space_key", capture.cast("long").alias("capture"), "start", "body", j.alias("j"))
    n = F.when(_is_corrupt(F.col("j"), F.col("body")), 0).otherwise(F.greatest(F.coalesce(F.size("j.results"), F.lit(0)), F.lit(0)))
    return parsed.select("instance", "kind", "space_key", "capture", "start", n.cast("int").alias("n_items"))


def listing_counts(listing: DataFrame) -> DataFrame:
    """A1: pages per (instance, space), per instance and in all. Rows are counted per space
    first (partial counts before the shuffle, so one hot space loads no task) and only the
    counts are rolled up."""
    per_space = listing.groupBy("instance", "space_key").agg(F.count(F.lit(1)).alias("n"))
    return per_space.rollup("instance", "space_key").agg(F.sum("n").cast("long").alias("n_pages"))


def space_counts(spaces: DataFrame) -> DataFrame:
    """A1: spaces per instance."""
    return spaces.groupBy("instance").agg(F.count(F.lit(1)).alias("n_spaces"))


def write_listing(listing: DataFrame, path: str) -> None:
    """Store a listing partitioned by instance and space, so a per-space read prunes files."""
    listing.write.mode("overwrite").partitionBy("instance", "space_key").parquet(path)


def read_space(spark, path: str, space_key: str) -> DataFrame:
    """S3 over a stored listing: the space filter becomes a partition filter of the scan."""
    return spark.read.parquet(path).filter(F.col("space_key") == space_key)


def first_pages(listing: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pages of each (instance, space) in listing order. The limit is the
    feature; written as ``row_number() <= n`` so Spark keeps only ``n`` rows per group in
    every task before the shuffle (partial window group limit)."""
    from pyspark.sql import Window

    w = Window.partitionBy("instance", "space_key").orderBy("ordinal")
    return listing.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
