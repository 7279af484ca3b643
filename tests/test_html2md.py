"""HTML → markdown rules H0-H15 on small literal pages."""

import pytest

from wikilake.operators.html2md import html_headings, html_tables, html_to_markdown, html_tokens_check

CASES = [
    ("<h2>Title</h2><p>Content</p>", "## Title\n\nContent"),
    ("<h2>Alert</h2>\n<p><strong>Warning:</strong> Elephant migration in progress.</p>\n<ul>\n"
     "  <li>Route: North to South</li>\n  <li>Duration: 2 weeks</li>\n  <li>Herd size: ~200</li>\n</ul>",
     "## Alert\n\n**Warning:** Elephant migration in progress.\n\n- Route: North to South\n- Duration: 2 weeks\n- Herd size: ~200"),
    ('<ac:structured-macro ac:name="info">\n  <ac:rich-text-body>\n    <p>This is an info panel</p>\n'
     "  </ac:rich-text-body>\n</ac:structured-macro>", "This is an info panel"),
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "- a\n  - b\n- c"),
    ('<ol start="3"><li>x</li><li>y<ul><li>z</li></ul></li></ol>', "3. x\n4. y\n   - z"),
    ("<table><tr><th>K</th><th>V</th></tr><tr><td>a</td><td><b>b</b></td></tr></table>",
     "| K | V |\n| --- | --- |\n| a | **b** |"),
    ("<table><tr><td>a</td><td>b</td></tr></table>", "|  |  |\n| --- | --- |\n| a | b |"),
    ("<pre>if a &lt; b:\n    x = 1</pre>", "```\nif a < b:\n    x = 1\n```"),
    ("<p>a < b and c</p>", "a < b and c"),
    ('<p><a href="/x" title="a>b">link</a></p>', '[link](/x "a>b")'),
    ('<p><a href="http://x.org">http://x.org</a></p>', "<http://x.org>"),
    ("<p><b>bold but never closed<br>next</p>", "bold but never closed  \nnext"),
    ("<p>keep</p><script>var t=\"</p>\";</script><style>p{}</style><p>this</p>", "keep\n\nthis"),
    ("<p>2 * 3 = x_y</p>", "2 \\* 3 = x\\_y"),
    ("<p>caf&eacute; &#233;t&#xE9; &amp;amp;</p>", "café été &amp;"),
    ("<blockquote><p>one</p><p>two</p></blockquote>", "> one\n>\n> two"),
    ("<p>x</p><hr><p>y</p>", "x\n\n---\n\ny"),
    ('<p><img src="/i.png" alt="pic" title="T"> and <code>a_b*c</code></p>', '![pic](/i.png "T") and `a_b*c`'),
    ("<!-- note --><p>  spaced \n\n  text </p>", "spaced text"),
    ("<p>&uuml;&rarr;&NotEqualTilde;&CounterClockwiseContourIntegral; &nosuchname; &#0000000233; &#99999999999; &equals;</p>",
     "ü→≂̸∳ &nosuchname; é &#99999999999; ="),
    ("<p>a<b> x </b>b<b></b><i><b> </b></i>c</p>", "a **x** b c"),
    ('<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[print("&amp;")\nif a < b: pass]]></ac:plain-text-body>'
     "</ac:structured-macro><p>x</p>", '```\nprint("&amp;")\nif a < b: pass\n```\n\nx'),
    ("<p>see <ac:link><ac:plain-text-link-body><![CDATA[this page]]></ac:plain-text-link-body></ac:link></p>", "see this page"),
    ("<pre>a\n```\nb</pre>", "````\na\n```\nb\n````"),
    ("<ul><li>x<pre>a\nb</pre></li></ul>", "- x\n  ```\n  a\n  b\n  ```"),
    ("<table><tr><td><p>one</p><p>two</p><ul><li>x</li><li>y</li></ul></td><td>a|b</td></tr></table>",
     "|  |  |\n| --- | --- |\n| one two x y | a\\|b |"),
    ("<table><tr><td>p<table><tr><td>q</td><td>r</td></tr></table>s</td><td>t</td></tr><tr><td>u</td><td>v</td></tr></table>",
     "|  |  |\n| --- | --- |\n| p q r s | t |\n| u | v |"),
    ("", ""),
]


@pytest.mark.parametrize("html,expected", CASES)
def test_rules(spark, html, expected):
    df = spark.createDataFrame([("p1", html)], "page_id string, html string")
    got = html_to_markdown(df).first().markdown
    assert got == expected


def test_all_pages_in_one_job(spark):
    df = spark.createDataFrame([(str(i), h) for i, (h, _) in enumerate(CASES)], "page_id string, html string")
    got = {r.page_id: r.markdown for r in html_to_markdown(df).collect()}
    assert got == {str(i): e for i, (_, e) in enumerate(CASES)}


def test_tokens_lossless_on_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = html_tokens_check(pages.selectExpr("CAST(page_id AS STRING) AS page_id", "html"))
    assert out.filter("NOT lossless").count() == 0
    assert out.count() == pages.count()


def test_plan_has_one_exchange_and_no_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr(
        "CAST(page_id AS STRING) AS page_id", "html")
    plan = html_to_markdown(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan


def test_no_internal_mark_is_left(spark):
    html = "<p>a\x01b\x02c\x03d</p><table><tr><td>x\x02y</td></tr></table></td><b>z</b><td>w"
    got = html_to_markdown(spark.createDataFrame([("p", html)], "page_id string, html string")).first().markdown
    assert not any(ord(c) < 9 for c in got)


def test_headings_and_tables_come_from_blocks(spark):
    html = "<h1>T <b>x</b></h1><pre># no heading</pre><table><tr><th>k</th></tr><tr><td>a|b</td></tr></table><h2>U</h2>"
    df = spark.createDataFrame([("p", html)], "page_id string, html string")
    assert [(r.level, r.text) for r in html_headings(df).orderBy("block_no").collect()] == [(1, "T **x**"), (2, "U")]
    rows = html_tables(df).orderBy("row_no").collect()
    assert [(r.row_no, r.is_header, r.n_cells, r.cells) for r in rows] == [(1, True, 1, "k"), (2, False, 1, "a\\|b")]
