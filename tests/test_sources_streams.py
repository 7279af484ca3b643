"""File sources (S6, S8), SQL functions (2.10) and the streaming forms."""

import os
import tempfile

from pyspark.sql import functions as F

from wikilake.functions import text as T
from wikilake.functions.sqlfuncs import register_sql_functions
from wikilake.functions.urls import page_id_from_url
from wikilake.operators.html2md import html_to_markdown
from wikilake.sources import files as FS
from wikilake.sources import fixtures as fx
from wikilake.sources.listing import page_listing
from wikilake.streaming import stream as ST

from conftest import SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="wikilake-test-")


def test_templates_and_profiles_round_trip(spark):
    tpl = spark.createDataFrame([("meeting", "# Notes - [Date]\n\n## Attendees\n-"), ("plan", "# Project")],
                                "name string, body string")
    path = os.path.join(_tmp(), "t")
    FS.write_templates(tpl, path)
    got = {r.name: r.body for r in FS.load_templates(spark, path).collect()}
    assert got == {"meeting": "# Notes - [Date]\n\n## Attendees\n-\n", "plan": "# Project\n"}
    cfg = os.path.join(_tmp(), "profiles.json")
    with open(cfg, "w") as f:
        f.write('{"default": {"base_url": "https://a.example.com", "username": "u", "token": "secret"},\n'
                ' "work": {"base_url": "https://b.example.com/", "password": "p"}}')
    rows = {r.instance: r.base_url for r in FS.load_instances(spark, cfg).collect()}
    assert rows == {"default": "https://a.example.com", "work": "https://b.example.com/"}
    assert "token" not in FS.load_instances(spark, cfg).columns


def test_sql_functions_match_dataframe_functions(spark):
    register_sql_functions(spark)
    u = fx.url_cases(spark, SMALL).join(fx.wiki_pages(spark, SMALL).select("page_id", "title"), "page_id")
    u.createOrReplaceTempView("u_cases")
    a = spark.sql("SELECT url, wiki_page_id(url) AS pid, wiki_slug(title) AS s FROM u_cases")
    b = u.select("url", page_id_from_url("url").alias("pid"), T.slug("title").alias("s"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_stream_convert_equals_batch(spark):
    streamed = ST.stream_convert(spark, f"{SMALL}/pages.parquet", work_dir=_tmp())
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select(F.col("page_id").cast("string").alias("page_id"), "html")
    batch = html_to_markdown(pages)
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_stream_listing_keeps_latest_capture(spark):
    raw = fx.listing_raw(spark, SMALL)
    work = _tmp()
    src = os.path.join(work, "source")
    ST.write_listing_source(raw, src)
    first = ST.stream_listing(spark, src, os.path.join(work, "w"))
    expected = page_listing(raw).select("instance", "page_id", "title", "space_key", "space_name", "ordinal")
    assert sorted(first.collect()) == sorted(expected.collect())
    # a second capture with changed titles arrives: the same work folder picks up only the new files
    renamed = raw.withColumn("body", F.regexp_replace("body", '"title":"', '"title":"v2 '))
    ST.write_listing_source(renamed, src, capture=1)
    second = ST.stream_listing(spark, src, os.path.join(work, "w"))
    titles = [r.title for r in second.collect()]
    assert len(titles) == len(expected.collect())
    assert all(t.startswith("v2 ") or t == "Untitled" for t in titles)


def test_stream_listing_orders_by_capture_whatever_the_batches(spark):
    def raw(title, start):
        body = '{"results":[{"id":"p","title":"%s"}],"start":%d,"limit":100,"size":1}' % (title, start)
        return spark.createDataFrame([("i0", "page", None, start, body)], "instance string, kind string, space_key string, start int, body string")

    for order in ((1, 2), (2, 1)):
        for max_files in (1, 64):
            src = os.path.join(_tmp(), "source")
            for capture in order:  # the older capture lists the page further down
                ST.write_listing_source(raw("OLD", 100) if capture == 1 else raw("NEW", 0), src, capture=capture)
            got = ST.stream_listing(spark, src, _tmp(), max_files=max_files).collect()
            assert [r.title for r in got] == ["NEW"]


def test_template_store_keeps_bodies_exactly(spark, tmp_path):
    rows = [("a", "x\n\ny\n"), ("b/../c", ""), ("ä", "\"q\" \\ \t \u2028 end"), ("a", "second of the name"), ("n", None)]
    path = str(tmp_path / "store")
    FS.write_template_store(spark.createDataFrame(rows, "name string, body string").repartition(2), path)
    got = FS.load_template_store(spark, path)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    assert len([f for f in (tmp_path / "store").iterdir() if f.name.startswith("part-")]) <= 2


TABLE_SCHEMA = "k string, v string, at long"


def _merged(spark, path):
    from wikilake.streaming.merged import MergedTable
    return MergedTable(spark, path, TABLE_SCHEMA, ["k"], ["at", "v"], buckets=8)


def test_merged_table_is_the_newest_row_per_key_for_any_batches_and_replays(spark, tmp_path):
    import random
    rnd = random.Random(1)
    rows = [(f"k{rnd.randrange(40)}", f"v{i}", rnd.randrange(30)) for i in range(200)]
    expect = {k: max((at, v) for q, v, at in rows if q == k) for k in {r[0] for r in rows}}
    for n, size in enumerate((200, 7, 50)):
        table = _merged(spark, str(tmp_path / f"t{n}"))
        batches = [rows[i:i + size] for i in range(0, len(rows), size)][:6] + [rows[6 * size:]]
        batches = [b for b in batches if b]
        for i, b in enumerate(batches):
            table.merge(spark.createDataFrame(b, TABLE_SCHEMA).repartition(3), i)
            if i == 2:
                table.merge(spark.createDataFrame(b, TABLE_SCHEMA), i)  # the batch runs again
        assert {r.k: (r.at, r.v) for r in table.read().collect()} == expect


def test_reading_a_merged_table_costs_its_keys_not_its_batches(spark, tmp_path):
    table = _merged(spark, str(tmp_path / "t"))
    for i in range(6):
        table.merge(spark.createDataFrame([(f"k{j}", f"{i}", i) for j in range(20)], TABLE_SCHEMA), i)
    found = table.read()
    assert found.count() == 20 and {r.v for r in found.collect()} == {"5"}
    assert len(found.inputFiles()) <= 8  # one folder per bucket
    import os
    kept = [d for d in os.listdir(tmp_path / "t") if d.startswith("v=")]
    assert set(kept) <= {"v=4", "v=5"} and len(os.listdir(tmp_path / "t" / "_manifest")) == 2
    assert table.merge(spark.createDataFrame([], TABLE_SCHEMA), 6) is None and table.read().count() == 20


def test_a_second_run_converts_only_new_versions(spark, tmp_path):
    def pages(rows):
        spark.createDataFrame(rows, "page_id long, html string, version int").coalesce(1).write.mode("append").parquet(src)

    src, work = str(tmp_path / "src"), str(tmp_path / "work")
    pages([(1, "<p>a</p>", 1), (2, "<p>b</p>", 1), (2, "<p>b2</p>", 2), (3, None, 1)])
    made: list = []
    first = ST.stream_convert(spark, src, work, version_col="version", converted=made)
    assert {r.page_id: r.markdown for r in first.collect()} == {"1": "a", "2": "b2", "3": ""} and sum(made) == 3
    pages([(1, "<p>a</p>", 1), (2, "<p>b2</p>", 2), (3, "<p>c</p>", 2), (4, "<p>d</p>", 1)])
    again: list = []
    second = ST.stream_convert(spark, src, work, version_col="version", converted=again)
    assert {r.page_id: r.markdown for r in second.collect()} == {"1": "a", "2": "b2", "3": "c", "4": "d"} and sum(again) == 2
