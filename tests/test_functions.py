"""Scalar rules: page id from URL (P1), canonical URL (P2), slug (P7), header (P8),
edit buffers (P12, P13)."""

import pytest
from pyspark.sql import functions as F

from wikilake.functions import text as T
from wikilake.functions.urls import page_id_from_url

URL_CASES = [
    # the two cases the reference's own tests use
    ("https://example.com/pages/viewpage.action?pageId=123456", "123456"),
    ("https://example.com/spaces/SPACE/pages/123456/Page+Title", "123456"),
    # edge cases
    ("https://x.org/pages/viewpage.action?pageId=1&pageId=2", "1"),
    ("https://x.org/pages/viewpage.action?pageId=", ""),
    ("https://x.org/pages/viewpage.action?pageId=5=6", "5"),
    ("https://x.org/display/A/B#pageId=7", None),
    ("https://pages/x/12", None),
    ("https://x.org/pages/12 3/45", "45"),
    ("x.org/pages/123", "123"),
    ("https://x.org/pages/123;v=1", "123"),
    ("https://x.org/mypages/12", None),
    ("https://x.org/pages/12a/13", "13"),
    ("", None),
    (None, None),
    ("https://x.org/pages/10/20", "10"),
    ("https://x.org/p?src=a&pageId=77#frag", "77"),
    ("https://x.org/pages/viewpage.action?xpageId=9", None),
    ("https://x.org/spaces/S/pages/5/T?focusedCommentId=7#comment-7", "5"),
    ("localhost:8090/pages/42", "42"),
]


def test_page_id_from_url(spark):
    df = spark.createDataFrame([(u,) for u, _ in URL_CASES], "url string")
    got = [r.pid for r in df.select(page_id_from_url("url").alias("pid")).collect()]
    assert got == [e for _, e in URL_CASES]


def test_page_url_and_header(spark):
    df = spark.createDataFrame([("https://w.example.com//", "12", "T", "Space S", 3)],
                               "base string, id string, title string, space string, v int")
    r = df.select(T.page_url("base", "id").alias("u")).first()
    assert r.u == "https://w.example.com/pages/viewpage.action?pageId=12"
    h = df.select(T.metadata_header("title", "space", "id", "v", T.page_url("base", "id")).alias("h")).first().h
    assert h == ("# T\n\n**Space:** Space S  \n**Page ID:** 12  \n**Version:** 3  \n"
                 "**URL:** https://w.example.com/pages/viewpage.action?pageId=12\n\n---\n\n")


@pytest.mark.parametrize("title,expected", [
    ("Elephant Migration Patterns", "elephant-migration-patterns.md"),
    ("Café Olé", "caf-ol.md"),
    ("İstanbul", "stanbul.md"),
    ("Kelvin", "elvin.md"),
    ("!!!", ".md"),
    ("A|B  c", "ab--c.md"),
])
def test_slug(spark, title, expected):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(T.slug("t").alias("s")).first().s == expected


def test_slug_idempotent_on_stem(spark):
    df = spark.createDataFrame([("Some Title-2",)], "t string")
    once = df.select(F.regexp_replace(T.slug("t"), r"\.md$", "").alias("s"))
    twice = once.select(T.slug("s").alias("s2")).first().s2
    assert twice == once.first().s + ".md"


@pytest.mark.parametrize("buffer,expected", [
    ("# Title\n\n<!-- c -->\n<!-- Page ID: 1, Version: 2 -->\n\nbody text", "body text"),
    ("# One\n# Two\nx", "# Two\nx"),
    ("no title\n<!-- note -->\nline", "no title\nline"),
    ("```\n<!-- in fence -->\n# inside\n```", "```\n```"),
    ("  \n# T\n\n  body  \n\n", "body"),
])
def test_clean_edit(spark, buffer, expected):
    df = spark.createDataFrame([(buffer,)], "b string")
    assert df.select(T.clean_edit("b").alias("c")).first().c == expected


def test_edit_buffer_round_trip(spark):
    md = "## Heading\n\n- item\n\ntext"
    df = spark.createDataFrame([("Title", "9", 4, md)], "t string, id string, v int, md string")
    buf = df.select(T.edit_buffer("t", "id", "v", "md").alias("b"))
    b = buf.first().b
    assert b.startswith("# Title\n\n<!-- Edit the content below.")
    assert "<!-- Page ID: 9, Version: 4 -->" in b
    assert buf.select(T.clean_edit("b").alias("c")).first().c == md


def test_entities(spark):
    df = spark.createDataFrame([("a &amp;lt; b &#65;&#x42; &copy; &#38;amp; &bogus; &",)], "s string")
    assert df.select(T.decode_entities("s").alias("d")).first().d == "a &lt; b AB © &amp; &bogus; &"
