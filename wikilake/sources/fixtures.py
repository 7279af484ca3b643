"""Wiki views derived from the driver's tables (FIXTURES.md §3).

The driver ships web pages, conversations and documents, not wiki tables. These
functions derive the wiki inputs from them with plain projections, one aggregate per
listing response and no window over a whole table, so every view grows with the
tables and is computed in parallel. The DuckDB twins live in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cache import cached_expr
from ..functions.text import decode_entities, edit_buffer
from .tables import read_table

# Fixed values of the derived data (FIXTURES.md §3).
PAGE_LIMIT = 100
TEMPLATE_HEAD = "# Notes - [Date]\n\n## [Title]\n\n"
# Fixed value of the derived data: what every sixteenth document line stands after.
MD_ODD = ("**use `x*y` now** [`code`](http://u/a_b_(c)) **bold *it* x** __s__ _e_ snake_case *a **b** c* ![p_q](/i_j.png \"T\")\n\n"
          "<div class=\"n\">raw *kept*</div>\n\n| a \\| b | `c|d` |\n| --- | --- |\n| 1 | 2 |\n\n~~~~ md\n```\n~~~\n# kept\n~~~~ no end\n~~~~~  \n``` a `b`\n\n"
          "1. one\n\n2. two\n   more\n\n    para *of* two\n\n    > quoted\n    > twice\n\n    ```py\n      code <x>\n    ```\n\n    - inner\n\n    - last\n"
          "        1. deep\n3. three\n4. four\n\n- other\n\nend\n\n    not listed\n\n* a\n\n        far\n\n")
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title"
LANG_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]+)"


@cached_expr
def _page_title(html: str) -> F.Column:
    return decode_entities(F.regexp_extract(html, TITLE_RE, 1))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(instance, page_id, title, space_key, space_name, version, storage_html)."""
    raw = read_table(spark, sf_dir, "pages")
    key = F.upper(F.regexp_extract("url", LANG_RE, 1))
    return raw.select(
        F.concat(F.lit("i"), (F.col("page_id") % 2).cast("string")).alias("instance"),
        F.col("page_id").cast("string").alias("page_id"),
        _page_title("html").alias("title"),
        key.alias("space_key"),
        F.concat(F.lit("Space "), key).alias("space_name"),
        (F.col("page_id") % 5 + 1).cast("int").alias("version"),
        F.col("html").alias("storage_html"),
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instances(instance, base_url): one row per instance that has pages.

    ``i0`` keeps a trailing slash on purpose, to exercise the canonical URL rule.
    """
    raw = read_table(spark, sf_dir, "pages")
    inst = raw.select((F.col("page_id") % 2).alias("n")).distinct()
    return inst.select(
        F.concat(F.lit("i"), F.col("n").cast("string")).alias("instance"),
        F.concat(
            F.lit("https://wiki"), F.col("n").cast("string"), F.lit(".example.com"),
            F.when(F.col("n") == 0, F.lit("/")).otherwise(F.lit("")),
        ).alias("base_url"),
    )


def _base(n) -> F.Column:
    return F.concat(F.lit("https://wiki"), n.cast("string"), F.lit(".example.com"))


def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urls(instance, page_id, url): six URL forms, by page_id % 6 (the last on a mirror host)."""
    p = wiki_pages(spark, sf_dir).select("instance", "page_id", "title", "space_key")
    n = F.col("page_id").cast("long")
    base = _base(n % 2)
    words = F.replace(F.col("title"), F.lit(" "), F.lit("+"))
    form = n % 6
    url = (
        F.when(form == 0, F.concat(base, F.lit("/pages/viewpage.action?pageId="), F.col("page_id")))
        .when(form == 1, F.concat(base, F.lit("/spaces/"), F.col("space_key"), F.lit("/pages/"), F.col("page_id"), F.lit("/"), words))
        .when(form == 2, F.concat(base, F.lit("/display/"), F.col("space_key"), F.lit("/"), words))
        .when(form == 3, F.concat(base, F.lit("/pages/viewpage.action?src=nav&pageId="), F.col("page_id")))
        .when(form == 4, F.concat(base, F.lit("/pages/viewpage.action?xpageId="), F.col("page_id")))
        .otherwise(F.concat(F.lit("https://mirror"), (n % 2).cast("string"), F.lit(".example.com/spaces/"),
                            F.col("space_key"), F.lit("/pages/"), F.col("page_id"), F.lit("/x?focusedCommentId=7#comment-7")))
    )
    return p.select("instance", "page_id", url.alias("url"))


def listing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_raw(instance, kind, space_key, start, body): captured listing responses.

    Per instance, pages in page-id order are cut into responses of 100. Page ids are
    dense and the instance is ``page_id % 2``, so the position inside an instance is
    ``page_id div 2``: no global row numbering is needed. ``title`` is left out where
    ``page_id % 17 = 0`` and ``space`` where ``page_id % 19 = 0``.
    """
    p = wiki_pages(spark, sf_dir).select("instance", "page_id", "title", "space_key", "space_name")
    n = F.col("page_id").cast("long")
    ordinal = F.floor(n / 2)
    item = F.struct(
        F.col("page_id").alias("id"),
        F.when(n % 17 != 0, F.col("title")).alias("title"),
        F.when(n % 19 != 0, F.struct(F.col("space_key").alias("key"), F.col("space_name").alias("name"))).alias("space"),
    )
    chunks = (
        p.select("instance", (F.floor(ordinal / PAGE_LIMIT) * PAGE_LIMIT).cast("int").alias("start"),
                 F.struct(ordinal.alias("o"), item.alias("item")).alias("e"))
        .groupBy("instance", "start")
        .agg(F.collect_list("e").alias("es"))
    )
    items = F.transform(F.array_sort("es"), lambda e: e["item"])
    nxt = F.when(F.size("es") == PAGE_LIMIT, F.concat(
        F.lit("/rest/api/content?type=page&limit=100&start="), (F.col("start") + PAGE_LIMIT).cast("string")))
    body = F.to_json(F.struct(
        items.alias("results"), F.col("start"), F.lit(PAGE_LIMIT).alias("limit"), F.size("es").alias("size"),
        F.struct(nxt.alias("next")).alias("_links"),
    ))
    return chunks.select("instance", F.lit("page").alias("kind"), F.lit(None).cast("string").alias("space_key"),
                         "start", body.alias("body"))


def odd_listing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing responses with faults, of the instances ``a0`` and ``a1``: pages in responses
    of 10; by response number mod 5: whole, cut short, empty, first item listed twice, and
    (mod 5 = 0 after the first, when full) last item missing although a next link is given."""
    p = wiki_pages(spark, sf_dir).select("page_id", "title", "space_key", "space_name")
    n = F.col("page_id").cast("long")
    ordinal = F.floor(n / 2)
    item = F.struct(F.col("page_id").alias("id"), F.col("title"),
                    F.struct(F.col("space_key").alias("key"), F.col("space_name").alias("name")).alias("space"))
    chunks = (p.select(F.concat(F.lit("a"), (n % 2).cast("string")).alias("instance"), F.floor(ordinal / 10).cast("int").alias("r"),
                       F.struct(ordinal.alias("o"), item.alias("item")).alias("e"))
              .groupBy("instance", "r").agg(F.array_sort(F.collect_list("e")).alias("es")))
    items = F.transform("es", lambda e: e["item"])
    k = F.col("r") % 5
    shown = (F.when(k == 3, F.concat(items, F.slice(items, 1, 1)))
             .when((k == 0) & (F.col("r") > 0) & (F.size("es") == 10), F.slice(items, 1, 9)).otherwise(items))
    nxt = F.when(F.size("es") == 10, F.concat(F.lit("/rest/api/content?limit=10&start="), (F.col("r") * 10 + 10).cast("string")))
    body = F.to_json(F.struct(shown.alias("results"), (F.col("r") * 10).alias("start"), F.lit(10).alias("limit"),
                              F.size(shown).alias("size"), F.struct(nxt.alias("next")).alias("_links")))
    body = F.when(k == 1, F.substring(body, 1, 60)).when(k == 2, F.lit("")).otherwise(body)
    return chunks.select("instance", F.lit("page").alias("kind"), F.lit(None).cast("string").alias("space_key"),
                         (F.col("r") * 10).alias("start"), body.alias("body"))


def space_listing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space listing responses: the distinct spaces of each instance, 100 per response.

    ``type`` is left out for space ``DE`` (default ``unknown``).
    """
    p = wiki_pages(spark, sf_dir).select("instance", "space_key", "space_name").distinct()
    per_inst = p.groupBy("instance").agg(F.array_sort(F.collect_list(F.struct("space_key", "space_name"))).alias("sp"))
    chunked = per_inst.select(
        "instance", "sp",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("sp") / PAGE_LIMIT).cast("int") - 1))).alias("c"),
    )
    sl = F.slice("sp", F.col("c") * PAGE_LIMIT + 1, PAGE_LIMIT)
    items = F.transform(sl, lambda s: F.struct(
        s["space_key"].alias("key"), s["space_name"].alias("name"),
        F.when(s["space_key"] != "DE", F.lit("global")).alias("type")))
    start = (F.col("c") * PAGE_LIMIT).cast("int")
    nxt = F.when(F.size(sl) == PAGE_LIMIT, F.concat(F.lit("/rest/api/space?limit=100&start="), (start + PAGE_LIMIT).cast("string")))
    body = F.to_json(F.struct(items.alias("results"), start.alias("start"), F.lit(PAGE_LIMIT).alias("limit"),
                              F.size(sl).alias("size"), F.struct(nxt.alias("next")).alias("_links")))
    return chunked.select("instance", F.lit("space").alias("kind"), F.lit(None).cast("string").alias("space_key"),
                          start.alias("start"), body.alias("body"))


def page_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_raw(instance, body): page detail responses; every 29th one is cut short (corrupt)."""
    p = wiki_pages(spark, sf_dir)
    n = F.col("page_id").cast("long")
    # from the top of the tree down: the root, a page in between (every second one), the parent
    anc = F.when(n % 3 != 0, F.concat(
        F.array(F.struct(F.lit("root").alias("id"))),
        F.when(n % 2 == 0, F.array(F.struct(F.concat(F.lit("m"), F.col("page_id")).alias("id")))).otherwise(
            F.array().cast("array<struct<id:string>>")),
        F.array(F.struct((n - 1).cast("string").alias("id"))))).otherwise(F.array().cast("array<struct<id:string>>"))
    js = F.to_json(F.struct(
        F.col("page_id").alias("id"), F.col("title"),
        F.struct(F.col("space_key").alias("key"), F.col("space_name").alias("name")).alias("space"),
        F.struct(F.col("version").alias("number")).alias("version"),
        anc.alias("ancestors"),
        F.struct(F.struct(F.col("storage_html").alias("value")).alias("storage")).alias("body"),
    ))
    body = F.when(n % 29 == 0, F.substring(js, 1, 50)).otherwise(js)
    return p.select("instance", body.alias("body"))


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests(request_seq, instance, action, url, content, content_type, append,
    space_key, title, parent_id, parent_title, template, base_version), one per turn.

    target page = conv_id % number of pages; action create where (conv_id + turn) % 9 = 4,
    edit where (conv_id + turn) % 7 = 3, else add; html where turn % 5 = 0; prepend where turn % 3 = 0;
    empty content where conv_id % 23 = 0; stale base version where conv_id % 13 = 0.
    A create names the target page's space, and as parent the target's title, except
    'No Parent' where conv_id % 4 = 0 and an unknown title where conv_id % 9 = 0.
    """
    conv = read_table(spark, sf_dir, "conversations")
    pages = wiki_pages(spark, sf_dir).select("page_id", "title", "space_key")
    n_pages = read_table(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("n"))
    c = spark.sql("SELECT conv_id, turn, text, CAST(conv_id % (SELECT n FROM {np}) AS STRING) AS target FROM {conv}",
                  conv=conv, np=n_pages)
    c = c.join(pages.withColumnRenamed("page_id", "target"), "target", "left")
    tgt = F.col("target").cast("long")
    inst_n = tgt % 2
    ct = F.col("conv_id") + F.col("turn")
    action = F.when(ct % 9 == 4, "create").when(ct % 7 == 3, "edit").otherwise("add")
    url = F.concat(_base(inst_n), F.lit("/pages/viewpage.action?pageId="), F.col("target"))
    text = F.when(F.col("conv_id") % 23 == 0, F.lit("")).otherwise(F.col("text"))
    version = (tgt % 5 + 1).cast("int")
    base_version = F.when(F.col("conv_id") % 13 == 0, version - 1).otherwise(version)
    edit_text = edit_buffer(F.lit("Edited"), F.col("target"), base_version, text)
    content = F.when((action == "edit") & (text != ""), edit_text).otherwise(text)
    parent = (F.when(F.col("conv_id") % 4 == 0, F.lit("No Parent"))
              .when(F.col("conv_id") % 9 == 0, F.lit("Missing page")).otherwise(F.col("title")))
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    template = F.concat(F.lit("tpl_"), F.when(F.col("conv_id") % 3 == 0, F.lit("xx")).otherwise(
        F.element_at(langs, (F.col("conv_id") % 4 + 1).cast("int"))))
    is_create = action == "create"
    return c.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("request_seq"),
        F.concat(F.lit("i"), inst_n.cast("string")).alias("instance"),
        action.alias("action"),
        F.when(~is_create, url).alias("url"),
        content.alias("content"),
        F.when(F.col("turn") % 5 == 0, "html").otherwise("markdown").alias("content_type"),
        (F.col("turn") % 3 != 0).alias("append"),
        F.when(is_create, F.col("space_key")).alias("space_key"),
        F.when(is_create, F.concat(F.lit("Note "), F.col("conv_id").cast("string"), F.lit("-"),
                                   F.col("turn").cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("parent_id"),
        F.when(is_create, parent).alias("parent_title"),
        F.when(is_create, template).alias("template"),
        F.when(action == "edit", base_version).alias("base_version"),
    )


def hot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request table with one number per conversation (all its turns share it), a third
    of the conversations writing to page 0 of ``i0``."""
    number = F.floor(F.col("request_seq") / 100000).cast("long")
    hot = number % 3 == 0
    url = F.when(F.col("url").isNotNull(), F.lit("https://wiki0.example.com/pages/viewpage.action?pageId=0"))
    return request_table(spark, sf_dir).withColumns({
        "instance": F.when(hot, F.lit("i0")).otherwise(F.col("instance")), "url": F.when(hot, url).otherwise(F.col("url")),
        "request_seq": number})


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries(query_id, query), one per page, made of the words a, b of its title and its id in
    one of eight forms (page_id % 8)."""
    words = F.filter(F.split("title", " ", -1), lambda w: F.length(w) > 2)
    p = wiki_pages(spark, sf_dir).select(F.col("page_id").cast("long").alias("query_id"), "page_id", "space_key",
                                         F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("a"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("b"))
    return p.select("query_id", F.expr("""CASE query_id % 8
        WHEN 0 THEN concat(substr(lower(a), 1, 1), substr(lower(a), 3, 1), substr(lower(a), 5, 2), " '", lower(b))
        WHEN 1 THEN concat('^', space_key, ' ', lower(a))
        WHEN 2 THEN concat("'", lower(a), " | '", lower(b), ' !', page_id)
        WHEN 3 THEN concat(page_id, '$ ', a)
        WHEN 4 THEN concat(a, ' | ', b, ' | qqq ', substr(page_id, 1, 1))
        WHEN 5 THEN concat(lower(substr(a, 1, 3)), lower(substr(b, 1, 3)))
        WHEN 6 THEN concat('!', lower(substr(a, 1, 2)), " '", substr(lower(b), 1, 3), ' ', page_id)
        ELSE concat('| ', a, ' |') END""").alias("query"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_raw captured twice: in capture 2 every third response (start / 100 % 3 = 1) begins
    ten places earlier, and the first response of each listing is missing."""
    raw = listing_raw(spark, sf_dir)
    early = F.when(F.floor(F.col("start") / 100) % 3 == 1, F.col("start") - 10).otherwise(F.col("start")).cast("int")
    return raw.withColumn("capture", F.lit(1)).unionByName(raw.filter("start > 0").withColumn("start", early).withColumn("capture", F.lit(2)))


def selector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """selectors: for each (instance, space) of the pages a note to every page of the space; for
    every page whose id is divisible by 4 an html remark to its neighbours by list (ids n, n + 2
    and one that no page has) or, where divisible by 16, to what its title's first word finds."""
    pages = wiki_pages(spark, sf_dir)
    spaces = pages.select("instance", "space_key").distinct().select(
        F.concat_ws("/", F.lit("s"), "instance", "space_key").alias("selector_id"), "instance", F.lit("space").alias("select_by"),
        F.col("space_key").alias("select_value"), F.concat(F.lit("Note to **"), "space_key", F.lit("**")).alias("content"),
        F.lit("markdown").alias("content_type"), F.lit(True).alias("append"))
    n = F.col("page_id").cast("long")
    word = F.coalesce(F.get(F.filter(F.split("title", " ", -1), lambda w: F.length(w) > 2), F.lit(0)), F.lit("qqq"))
    some = pages.filter(n % 4 == 0).select(
        F.concat(F.lit("p/"), "page_id").alias("selector_id"), "instance", F.when(n % 16 == 0, "search").otherwise("list").alias("select_by"),
        F.when(n % 16 == 0, F.concat(F.lit("'"), F.lower(word))).otherwise(
            F.concat_ws(", ", "page_id", (n + 2).cast("string"), (n + 900000000).cast("string"))).alias("select_value"),
        F.concat(F.lit("<p>see "), "page_id", F.lit("</p>")).alias("content"), F.lit("html").alias("content_type"), (n % 8 == 0).alias("append"))
    return spaces.unionByName(some).withColumn("action", F.lit("add"))


def version_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later versions of pages, one per document: of page 0 where doc_id % 3 = 0, else of page
    doc_id % number of pages; version 10 + doc_id; every line of the text a paragraph."""
    docs, pages = (read_table(spark, sf_dir, t) for t in ("documents", "pages"))
    n = spark.sql("SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % (SELECT count(*) FROM {p}) END AS n FROM {d}", p=pages, d=docs)
    body = F.concat(F.lit("<p>"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>"))
    return n.select(F.concat(F.lit("i"), (F.col("n") % 2).cast("string")).alias("instance"), F.col("n").cast("string").alias("page_id"),
                    (F.col("doc_id") + 10).cast("int").alias("version"), F.concat(F.lit("Draft "), F.col("doc_id").cast("string")).alias("title"),
                    body.alias("storage_html"), F.lit("update").alias("change"))


def version_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asks(request_seq, instance, page_id, as_of), one per turn: of page 0 where conv_id % 3 =
    0, else of page conv_id % number of pages; the newest version where turn % 6 = 5."""
    conv, docs, pages = (read_table(spark, sf_dir, t) for t in ("conversations", "documents", "pages"))
    n = spark.sql("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id % (SELECT count(*) FROM {p}) END AS n,
                            (conv_id * 31 + turn * 17) % (20 + (SELECT count(*) FROM {d})) AS v FROM {c}""", p=pages, d=docs, c=conv)
    return n.select((F.col("conv_id") * 100000 + F.col("turn")).alias("request_seq"), F.concat(F.lit("i"), (F.col("n") % 2).cast("string")).alias("instance"),
                    F.col("n").cast("string").alias("page_id"), F.when(F.col("turn") % 6 != 5, F.col("v")).cast("int").alias("as_of"))


def markdown_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """md_docs(doc_id, md): each document line gets a markdown form by its index % 8."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.split(F.col("text"), "\n", -1)

    def shape(line, i):
        k = i % 8
        return (
            F.when(k == 0, F.concat(F.lit("# "), line))
            .when(k == 1, F.when(i % 16 == 1, F.concat(F.lit(MD_ODD), line)).otherwise(line))
            .when(k == 2, F.concat(F.lit("\n- "), line))
            .when(k == 3, F.concat(F.lit("    1. "), line))
            .when(k == 4, F.concat(F.lit("> "), line))
            .when(k == 5, F.concat(F.lit("```\n"), line, F.lit("\n```")))
            .when(k == 6, F.concat(F.lit("\n---\n"), line))
            .otherwise(F.concat(F.lit("\n| h | n |\n| --- | :---: |\n| "), line, F.lit(" | "), i.cast("string"), F.lit(" |")))
        )

    return docs.select("doc_id", F.array_join(F.transform(lines, shape), "\n").alias("md"))


def document_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """templates(name, body): every document as a template, named by its id."""
    name = F.concat(F.lit("tpl_"), F.col("doc_id").cast("string"))
    return markdown_inputs(spark, sf_dir).select(name.alias("name"), F.concat(F.lit(TEMPLATE_HEAD), F.col("md")).alias("body"))


def document_template_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request table, its creates naming templates over all documents: ``conv_id`` %
    number of documents, and a name without a template where ``conv_id % 3 = 0``."""
    n_docs = read_table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    return spark.sql("""SELECT * EXCEPT (template), CASE WHEN action = 'create' THEN 'tpl_' || CASE
        WHEN request_seq DIV 100000 % 3 = 0 THEN 'xx'
        ELSE CAST(request_seq DIV 100000 % (SELECT n FROM {nd}) AS STRING) END END AS template FROM {reqs}""",
                     reqs=request_table(spark, sf_dir), nd=n_docs)


def create_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """create_list(line): 'title|content' lines, content on one line with literal '\\n'."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(F.concat(F.lit("Page "), F.col("doc_id").cast("string"), F.lit("|"),
                                F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))).alias("line"))
