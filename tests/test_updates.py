"""Versioned batch changes (U1-U4) against a one-call-at-a-time restatement."""

import random

from pyspark.sql import functions as F

from conftest import SMALL
from wikilake.operators import requests as R
from wikilake.operators import updates as U

PAGE_SCHEMA = "instance string, page_id string, title string, space_key string, space_name string, version int, storage_html string"
REQ_SCHEMA = ("request_seq long, instance string, action string, url string, content string, content_type string, "
              "append boolean, space_key string, title string, parent_id string, parent_title string, template string, "
              "base_version int")


def _pages():
    return [("i0", str(i), f"P{i}", "S", "Space S", i + 1, f"<p>body {i}</p>") for i in range(6)]


def _requests(seed=7, n=60):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        pid = rnd.choice(["0", "1", "2", "3", "99"])  # 99 is missing
        action = rnd.choice(["add", "add", "add", "edit"])
        content = f"<i>c{k}</i>" if action == "add" else f"# X\n<!-- c -->\nedit {k}"
        ctype = "html" if action == "add" else "markdown"
        url = f"https://w/pages/viewpage.action?pageId={pid}"
        out.append((k * 10, "i0", action, url, content, ctype, rnd.random() < 0.6, None, None, None, None, None, None))
    rnd.shuffle(out)
    return out


def _sequential(pages, reqs):
    """Apply requests one by one in request_seq order, as one client call each."""
    state = {p[1]: {"body": p[6], "version": p[5], "n": 0} for p in pages}
    for r in sorted(reqs, key=lambda r: r[0]):
        pid = r[3].rsplit("=", 1)[1]
        if pid not in state:
            continue
        s = state[pid]
        if r[2] == "edit":
            s["body"] = "<p>" + r[4].split("\n")[-1] + "</p>"
        elif r[6]:
            s["body"] = s["body"] + "\n" + r[4]
        else:
            s["body"] = r[4] + "\n" + s["body"]
        s["version"] += 1
        s["n"] += 1
    return {k: (v["body"], v["version"]) for k, v in state.items() if v["n"]}


def test_batch_equals_sequential(spark):
    pages, reqs = _pages(), _requests()
    got = U.apply_requests(spark.createDataFrame(pages, PAGE_SCHEMA), spark.createDataFrame(reqs, REQ_SCHEMA))
    got = {r.page_id: (r.new_body, r.new_version) for r in got.collect()}
    assert got == _sequential(pages, reqs)


def test_one_request_is_a_plain_add(spark):
    pages = _pages()
    reqs = [(1, "i0", "add", "https://w/pages/2", "**new**", "markdown", False, None, None, None, None, None, None)]
    r = U.apply_requests(spark.createDataFrame(pages, PAGE_SCHEMA), spark.createDataFrame(reqs, REQ_SCHEMA)).first()
    assert r.new_body == "<p><strong>new</strong></p>\n<p>body 2</p>" and r.new_version == 4


def test_rejects_and_validation(spark):
    reqs = [
        (1, "i0", "add", "https://w/x", "c", "markdown", True, None, None, None, None, None, None),
        (2, "i0", "add", "https://w/pages/1", "", "markdown", True, None, None, None, None, None, None),
        (3, "i0", "create", None, "c", "markdown", True, None, "T", None, None, None, None),
        (4, "i0", "frob", None, None, "text", True, None, None, None, None, None, None),
        (5, "i0", "add", "https://w/pages/99", "c", "html", True, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(reqs, REQ_SCHEMA)
    v = {r.request_seq: r.reject_reason for r in R.validate_requests(df).collect()}
    assert v[1] == "no page id in url" and v[2] == "content required" and v[3] == "space required"
    assert v[4] == "unknown action; bad content_type" and v[5] is None
    rej = {r.request_seq: r.reject_reason for r in U.request_rejects(df, spark.createDataFrame(_pages(), PAGE_SCHEMA)).collect()}
    assert rej[5] == "page not found" and set(rej) == {1, 2, 3, 4, 5}


def test_create_payload_has_ancestors_only_with_parent(spark):
    import json
    reqs = [(1, "i0", "create", None, "# Hi", "markdown", True, "S", "T1", None, None, None, None),
            (2, "i0", "create", None, "<p>x</p>", "html", True, "S", "T2", "42", None, None, None)]
    c = U.apply_creates(spark.createDataFrame(reqs, REQ_SCHEMA))
    p = {r.request_seq: json.loads(r.payload) for r in U.create_payloads(c).collect()}
    assert p[1] == {"type": "page", "title": "T1", "space": {"key": "S"},
                    "body": {"storage": {"value": "<h1>Hi</h1>", "representation": "storage"}}}
    assert p[2]["ancestors"] == [{"id": "42"}] and p[2]["body"]["storage"]["value"] == "<p>x</p>"


def test_hot_page_across_ranges_equals_sequential(spark):
    """One page gets most requests, spread over many request_seq ranges (two-phase concat)."""
    rnd = random.Random(11)
    reqs = []
    for k in range(120):
        pid = "1" if rnd.random() < 0.8 else rnd.choice(["0", "2"])
        action = "edit" if rnd.random() < 0.05 else "add"
        content = f"<i>h{k}</i>" if action == "add" else f"# X\nedit {k}"
        ctype = "html" if action == "add" else "markdown"
        reqs.append((k * 700_001, "i0", action, f"https://w/pages/viewpage.action?pageId={pid}", content, ctype,
                     rnd.random() < 0.5, None, None, None, None, None, None))
    rnd.shuffle(reqs)
    pages = _pages()
    got = U.apply_requests(spark.createDataFrame(pages, PAGE_SCHEMA), spark.createDataFrame(reqs, REQ_SCHEMA))
    got = {r.page_id: (r.new_body, r.new_version) for r in got.collect()}
    assert got == _sequential(pages, reqs)


def test_lost_macros_counted_on_replace(spark):
    pages = [("i0", "1", "P", "S", "Space S", 1,
              '<p>a</p><ac:structured-macro ac:name="info"><ac:rich-text-body><p>x</p></ac:rich-text-body></ac:structured-macro>')]
    reqs = [(1, "i0", "edit", "https://w/pages/1", "# T\nnew", "markdown", True, None, None, None, None, None, None)]
    r = U.apply_requests(spark.createDataFrame(pages, PAGE_SCHEMA), spark.createDataFrame(reqs, REQ_SCHEMA)).first()
    assert r.lost_macros == 2 and r.new_body == "<p>new</p>"


def test_write_markdown_files(spark, tmp_path):
    from wikilake.operators.export import write_markdown

    docs = spark.createDataFrame([("i0", "1", "a.md", "# A"), ("i0", "2", "a.md", "# A2"), ("i1", "3", "b.md", "# B")],
                                 "instance string, page_id string, file_name string, content string")
    write_markdown(docs, str(tmp_path))
    assert (tmp_path / "i0" / "a.md").read_text() == "# A2"  # same name: the last page id wins
    assert (tmp_path / "i1" / "b.md").read_text() == "# B"


def test_fill_templates(spark):
    df = spark.createDataFrame([("# Meeting Notes - [Date]\n[Date] [Title] [Other]", {"Date": "2025-01-02", "Title": "T"})],
                               "body string, vals map<string,string>")
    assert R.fill_templates(df, "body", "vals").first().body == "# Meeting Notes - 2025-01-02\n2025-01-02 T [Other]"


def test_pages_by_url_flags_other_hosts(spark):
    urls = spark.createDataFrame([("i0", "https://wiki.example.com/pages/viewpage.action?pageId=1"),
                                  ("i0", "https://MIRROR.example.com/pages/2"),
                                  ("i0", "example.com/pages/3"), ("i0", "https://wiki.example.com/display/x")],
                                 "instance string, url string")
    inst = spark.createDataFrame([("i0", "https://Wiki.Example.com/")], "instance string, base_url string")
    got = {r.url: (r.page_id, r.found, r.host_mismatch)
           for r in R.pages_by_url(urls, spark.createDataFrame(_pages(), PAGE_SCHEMA), inst).collect()}
    assert got["https://wiki.example.com/pages/viewpage.action?pageId=1"] == ("1", True, False)
    assert got["https://MIRROR.example.com/pages/2"] == ("2", True, True)
    assert got["example.com/pages/3"] == ("3", True, False)
    assert got["https://wiki.example.com/display/x"] == (None, False, False)


def test_untouched_edit_buffers_step_no_version(spark):
    html = '<p>one <b>two</b></p><ac:structured-macro ac:name="info"><p>three</p></ac:structured-macro>'
    pages = spark.createDataFrame([("i0", str(i), f"T{i}", "K", "N", 3, html) for i in range(4)],
                                  "instance string, page_id string, title string, space_key string, space_name string, version int, storage_html string")
    md = "one **two**\n\nthree"
    url = "https://w/pages/viewpage.action?pageId="
    cols = ("request_seq long, instance string, action string, url string, body string, content_type string, append boolean, space_key string, "
            "title string, parent_id string, parent_title string, template string, base_version int, page_id string")
    rows = [(1, "i0", "edit", url + "0", md, "markdown", True, None, None, None, None, None, 3, "0"),          # untouched
            (2, "i0", "edit", url + "1", md + "\n\nfour", "markdown", True, None, None, None, None, None, 3, "1"),  # changed
            (3, "i0", "edit", url + "2", md, "markdown", True, None, None, None, None, None, 2, "2"),          # from another version
            (4, "i0", "edit", url + "3", md, "markdown", True, None, None, None, None, None, None, "3")]
    reqs = spark.createDataFrame(rows, cols)
    reqs = reqs.withColumn("content", F.concat(F.lit("# T\n\n<!-- note -->\n\n"), "body")).drop("body", "page_id")
    got = {r.page_id: (r.new_version, r.n_edits, r.lost_macros) for r in U.apply_requests(pages, reqs).collect()}
    assert got == {"1": (4, 1, 1), "2": (4, 1, 1)}


def test_export_shuffles_bodies_once_and_nothing_by_instance_alone(spark):
    import re

    from wikilake.operators.export import export_documents
    from wikilake.sources import fixtures as fx

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = export_documents(fx.wiki_pages(spark, SMALL), fx.instances(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any(re.match(r"instance#\d+, \d+$", k) for k in keys)


def _mixed(seed, n, hot=0.5):
    """Requests with repeated numbers, one page taking ``hot`` of them."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        pid = "1" if rnd.random() < hot else rnd.choice(["0", "2", "3"])
        action = "edit" if rnd.random() < 0.04 else "add"
        content = f"<i>c{k % 37}</i>" if action == "add" else f"# X\nedit {k}"
        out.append((rnd.randrange(n // 3), "i0", action, f"https://w/pages/viewpage.action?pageId={pid}", content,
                    "html" if action == "add" else "markdown", rnd.random() < 0.5, None, None, None, None, None, None))
    return out


def _in_order(reqs):
    """The order of requests that share a number, as the operator states it."""
    from hashlib import sha256
    def src(r):
        return r[4].split("\n", 1)[1] if r[2] == "edit" else r[4]
    return [(i, *r[1:]) for i, r in enumerate(sorted(reqs, key=lambda r: (r[0], r[2], r[6], r[5], sha256(src(r).encode()).hexdigest())))]


def test_hot_page_with_repeated_numbers_in_small_segments(spark):
    pages, reqs = _pages(), _mixed(3, 400)
    p, r = spark.createDataFrame(pages, PAGE_SCHEMA), spark.createDataFrame(reqs, REQ_SCHEMA).repartition(5)
    expect = _sequential(pages, _in_order(reqs))
    for segment_rows in (3, 16, 1000):  # five rounds, three rounds, one group a page
        got = {x.page_id: (x.new_body, x.new_version) for x in U.apply_requests(p, r, segment_rows=segment_rows).collect()}
        assert got == expect


def test_no_group_is_larger_than_a_segment(spark):
    """The rows that one merge puts into a list, read from the merged table itself."""
    rows = spark.range(1000).select(F.lit("i0").alias("instance"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("page_id"),
                                    F.col("id").alias("request_seq"), F.lit("add").alias("action"), F.lit(True).alias("append"),
                                    F.lit("html").alias("content_type"), F.sha2(F.col("id").cast("string"), 256).alias("src_key"))
    placed = U.numbered(U.staged(rows), U.KEY, U.ORDER, 1000)
    hot = placed.filter("page_id = 'hot'").orderBy("pos").collect()
    assert [(x.pos, x.request_seq) for x in hot] == [(i, 3 * i) for i in range(334)]
    sizes = placed.groupBy(*U.KEY, F.floor(F.col("pos") / 32)).count().agg(F.max("count")).first()[0]
    assert sizes == 32


def test_batch_reads_its_requests_once(spark):
    """Everything after the check reads the staged table, never the requests again."""
    from wikilake.plans import catalog as C
    plan = C.REGISTRY["apply_requests"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "staged-" not in SMALL and plan.count("conv_id") == 0
    assert "cartesian" not in plan.lower()


def test_equal_numbers_of_creates_stay_two_pages(spark):
    reqs = [(1, "i0", "create", None, "# A", "markdown", True, "S", "T1", None, None, None, None),
            (1, "i0", "create", None, "# B", "markdown", True, "S", "T2", None, None, None, None)]
    got = sorted((r.title, r.body) for r in U.apply_creates(spark.createDataFrame(reqs, REQ_SCHEMA)).collect())
    assert got == [("T1", "<h1>A</h1>"), ("T2", "<h1>B</h1>")]


def test_untouched_buffers_are_not_converted(spark, monkeypatch):
    converted = []
    real = U.markdown_to_html
    monkeypatch.setattr(U, "markdown_to_html", lambda texts, **k: converted.extend(r.src for r in texts.select("src").collect()) or real(texts, **k))
    pages = spark.createDataFrame([("i0", str(i), "T", "S", "S", 1, f"<p>body {i}</p>") for i in range(4)],
                                  "instance string, page_id string, title string, space_key string, space_name string, version int, storage_html string")
    reqs = spark.createDataFrame([(i, "i0", "edit", f"http://h/pages/viewpage.action?pageId={i}", f"body {i}" + ("\n\nmore" if i == 3 else ""), "markdown", True, 1) for i in range(4)],
                                 "request_seq long, instance string, action string, url string, content string, content_type string, append boolean, base_version int")
    for c in ("space_key", "title", "parent_id", "parent_title", "template"):
        reqs = reqs.withColumn(c, F.lit(None).cast("string"))
    got = [(r.page_id, r.new_body) for r in U.apply_requests(pages, reqs).collect()]
    assert got == [("3", "<p>body 3</p>\n<p>more</p>")] and converted == ["body 3\n\nmore"]


def test_shuffle_width_follows_the_stored_size(spark, tmp_path):
    import os
    from wikilake.session import partitions_for
    rows = [(i, os.urandom(2000).hex(), *range(12)) for i in range(1000)]
    spark.createDataFrame(rows, ["id", "text", *[f"n{i}" for i in range(12)]]).coalesce(1).write.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    table = spark.read.parquet(str(tmp_path / "t")).select("id", "text")
    assert partitions_for(table, 20_000) >= size // 20_000
    assert partitions_for(table) == 2 * spark.sparkContext.defaultParallelism


def test_the_url_of_a_request_is_taken_apart_once(spark):
    reqs, pages = spark.createDataFrame(_requests(), REQ_SCHEMA), spark.createDataFrame(_pages(), PAGE_SCHEMA)
    plan = U.checked_requests(reqs, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("pageId=") == 1 and plan.count("^//[^/?#]*") == 1
    urls = ["https://w/pages/viewpage.action?pageId=1", "https://w/x/pages/2/T", "https://w/x", "", None, "https://w/p?pageId=", "https://w/pages/99"]
    odd = [(i, "i0", "add", u, "c", "html", True, None, None, None, None, None, None) for i, u in enumerate(urls)]
    got = {r.request_seq: (r.page_id, r.reasons) for r in U.checked_requests(spark.createDataFrame(odd, REQ_SCHEMA), pages).collect()}
    assert got == {0: ("1", []), 1: ("2", []), 2: (None, ["no page id in url"]), 3: (None, ["url required"]), 4: (None, ["url required"]),
                   5: ("", ["no page id in url"]), 6: ("99", ["page not found"])}
