"""Main text of web pages by nearest-URL page differencing; the structure a page marks
protects its article and drops its boilerplate.

A task reads each page's tags in order and splits its text into lines, one per block.
Lines inside elements that are boilerplate by tag, role, visibility or name (menus, page
headers, footers, sidebars, notices, adverts, forms, comments) go.

The other lines of every page are differenced: all pages of a host stand in the order of
their path, each is paired with the neighbour of another path that shares the longest path
prefix, the lines of both are aligned by longest common subsequence, and the shared ones
are deleted as template.

Shared lines inside the page's article (or else its main element) are put back: there they
are passages of the article itself (the same article under two addresses, quoted passages),
and deleting them loses text. Lines outside it stay if the differencing leaves them, so an
article element that only points elsewhere does not hide the text beside it.

Two versions of one page share their article as well. Lines that recur on many different
pages of the host are template in any case and go; if most of the other lines of a pair are
shared, the pair is one page and those lines stay.

Scale: lines are aligned by 64-bit hash, once per distinct content of a path, so of the
texts only those of pages that lose a line may move (if the list of these pages is too long
to send to every task). The distinct paths are dealt by ranges of (host, path); the last
path of a range is carried to the next one and the first to the one before, so no host has
to fit a task. Each path's neighbour is named by one page, the one of the smallest content
hash, and its line hashes join back by path. Lines are counted by hash, once per distinct
content, in partial sums.

Defined results: null or empty html has the empty text; a null url is the empty host and
path; a page without lines is no neighbour; a page without a neighbour keeps its lines;
repeated rows are extracted each. A family of versions that is itself ``MANY_PAGES``
different pages and ``HOST_SHARE`` of its host cannot be told from a template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, free_name, pieces, shuffle_width, written

#: Two pages that share more than this part of the shorter one's lines are one page; lines
#: that recur on the host do not count.
SAME_PAGE = 0.8
#: A line recurs if it is on so many different pages of the host, and on this part of them.
MANY_PAGES = 8
HOST_SHARE = 0.1
#: Copies of a host's recurring lines, so that the pages of one host meet them in many tasks.
SALTS = 32

#: HTML elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video nav footer aside form button "
                    "select textarea fieldset dialog menu head title".split())
NAMED = frozenset("div section ul ol dl table p span details center article".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
                          "sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar notice "
                          "notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
                          "share sharing social related recommended comment comments disqus reply replies respond login search "
                          "pagination pager toolbar".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond".split())
ARTICLE_NAMES = frozenset("article post entry content story".split())
IMPLIED_END = {"p": frozenset("p".split()), "li": frozenset("li p".split()), "dt": frozenset("dt dd p".split()),
               "dd": frozenset("dt dd p".split()), "tr": frozenset("tr td th p".split()), "td": frozenset("td th p".split()),
               "th": frozenset("td th p".split()), "option": frozenset("option".split())}
SCOPES = frozenset("ul ol dl table article section div body main aside nav form td th".split())

WORDS_IN_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN_STYLE = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


def is_boilerplate(tag: str, attrs: list, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    named: list[str] = []
    for key, value in attrs:
        value = value or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN_STYLE.search(value):
            return True
        if key == "role" and value.lower() in DROPPED_ROLES:
            return True
        if key in ("class", "id"):
            named.append(value)
    if not named or tag not in NAMED:
        return False
    for name in " ".join(named).split():
        words = {w.lower() for w in WORDS_IN_NAME.findall(name)}
        if tag == "article":
            words &= COMMENT_NAMES
        if words & DROPPED_NAMES and not (words & ARTICLE_NAMES and not words & COMMENT_NAMES and "header" in words):
            return True
    return False


class PageLines(HTMLParser):
    """Lines of a page with the container each stands in (2 article, 1 main, 0 neither)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, boilerplate, container
        self.lines: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.level = 0

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            self.text.clear()
            if line:
                self.lines.append((self.level, line))

    def state(self) -> tuple[bool, int]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            if tag == "br":
                self.text.append(" ")
                return
            self.end_line()
        if tag in VOID:
            return
        ends = IMPLIED_END.get(tag)
        if ends or tag not in INLINE:
            ends = ends or IMPLIED_END["p"]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in ends:
                    del self.open[i:]
                    break
                if self.open[i][0] in SCOPES and self.open[i][0] not in INLINE:
                    break
        dropped, container = self.state()
        dropped = dropped or is_boilerplate(tag, attrs, container == 2)
        if not dropped:
            if tag == "article":
                container = 2
            elif tag == "main" or ("role", "main") in attrs:
                container = max(container, 1)
        self.open.append((tag, dropped, container))
        self.level = container

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
            if tag in INLINE and self.open[i][0] not in INLINE:
                break
        self.level = self.state()[1]

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def leveled_lines(html: str | None) -> list[tuple[int, str]]:
    """(container, line) of all lines outside marked boilerplate."""
    if not html:
        return []
    parser = PageLines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser.lines


def protected_lines(html: str | None) -> tuple[list[bool], list[str]]:
    """(is the line in the page's article or else its main element, line), as two lists."""
    found = leveled_lines(html)
    best = max((level for level, _ in found), default=0)
    return [level == best > 0 for level, _ in found], [line for _, line in found]


def page_lines(html: str | None) -> tuple[bool, list[str]]:
    """(is the article marked, its lines or else all lines): what the structure alone says."""
    protected, lines = protected_lines(html)
    marked = any(protected) or not html
    return marked, [line for line, inside in zip(lines, protected) if inside or not marked]


def shared_lines(a: list, b: list) -> list[bool]:
    """For each line of ``a`` whether it is in a longest common subsequence with ``b``.

    Bit-parallel rows over ``b``; if all rows would take too much memory, ``a`` is halved
    and ``b`` cut where both halves reach the longest total (Hirschberg).
    """
    if not a or not b:
        return [False] * len(a)
    if len(a) * len(b) > 1 << 28 and len(a) > 1:
        mid = len(a) // 2
        head, tail = row_lengths(a[:mid], b), row_lengths(a[mid:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: head[j] + tail[j])
        return shared_lines(a[:mid], b[:cut]) + shared_lines(a[mid:], b[cut:])
    rows = [(1 << len(b)) - 1, *(row for _, row in lcs_rows(a, b))]
    out, j = [False] * len(a), len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        # the length falls by one at j exactly where the row has a zero bit
        while j >= 0 and rows[i + 1] >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[i] >> j & 1:  # the zero is new in this row: line i matches at or after j
            out[i] = True
            j -= 1
    return out


def lcs_rows(a: list, b: list) -> Iterator[tuple[int, int]]:
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for i, line in enumerate(a):
        u = row & places.get(line, 0)
        row = ((row + u) | (row - u)) & full
        yield i, row


def row_lengths(a: list, b: list) -> list[int]:
    """Longest common subsequence of ``a`` with each prefix of ``b``."""
    row = (1 << len(b)) - 1
    for _, row in lcs_rows(a, b):
        pass
    out = [0]
    for bit in bin(row | 1 << len(b))[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def nearest(path: str, before: str | None, after: str | None) -> str | None:
    """The neighbour in path order with the longer common prefix (the one before on a tie)."""
    if before is None or after is None:
        return after if before is None else before
    return after if common_prefix(path, after) > common_prefix(path, before) else before


def difference(lines: list, protected: list[bool], other: list | None, recurring: set) -> list[bool]:
    """For each line of a page whether it stays: protected or no template by its nearest page."""
    if other is None:
        return [True] * len(lines)
    shared = shared_lines(lines, other)
    own = [gone for line, gone in zip(lines, shared) if line not in recurring]
    versions = sum(own) > SAME_PAGE * min(len(own), sum(line not in recurring for line in other))
    return [inside or not gone or versions and line not in recurring for line, inside, gone in zip(lines, protected, shared)]


def nearest_paths(paths: DataFrame) -> DataFrame:
    """(host, path, near) of distinct (host, path), each with its nearest path in the host."""
    spark = paths.sparkSession
    n = shuffle_width(spark, 1, 1)
    ranged = written(paths.repartitionByRange(n, "host", "path").withColumn("part", F.spark_partition_id()))
    key = F.struct("host", "path")
    ends = sorted((r["part"], r["low"], r["high"]) for r in  # one row per range
                  ranged.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())
    border = spark.createDataFrame(
        [(part, ends[i - 1][2] if i else None, ends[i + 1][1] if i + 1 < len(ends) else None) for i, (part, _, _) in enumerate(ends)],
        "part int, last struct<host:string,path:string>, first struct<host:string,path:string>")
    order = Window.partitionBy("part").orderBy("host", "path")
    found = ranged.withColumn("before", F.lag(key).over(order)).withColumn("after", F.lead(key).over(order))
    found = found.join(F.broadcast(border), "part")

    def in_host(end):
        return F.when(end.getField("host") == F.col("host"), end.getField("path"))

    @F.arrow_udf("string")
    def choose(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array((nearest(*x) for x in zip(*(c.to_pylist() for c in columns))), pa.string())

    return found.select("host", "path", choose("path", in_host(F.coalesce("before", "last")),
                                               in_host(F.coalesce("after", "first"))).alias("near"))


def recurring_lines(pages: DataFrame) -> DataFrame:
    """(host, recurring): hashes of the lines on many different pages of a host, at most
    1 / HOST_SHARE times the lines of a page."""
    contents = pages.groupBy("host", "content").agg(F.first("hashes").alias("hashes"))
    hosts = contents.groupBy("host").agg(F.count("*").alias("n_host")).filter(F.col("n_host") >= MANY_PAGES)
    counts = contents.select("host", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("host", "h").agg(
        F.count("*").alias("n")).filter(F.col("n") >= MANY_PAGES)
    return counts.join(hosts, "host").filter(F.col("n") >= HOST_SHARE * F.col("n_host")).groupBy("host").agg(
        F.collect_list("h").alias("recurring"))


def kept_lines(pages: DataFrame) -> DataFrame:
    """(host, path, content, keep) of distinct (host, path, content, hashes, protected): for
    each line whether it stays after the differencing with the page of the nearest path."""
    one = pages.groupBy("host", "path").agg(F.min_by("hashes", "content").alias("other"))
    near = nearest_paths(pages.select("host", "path").distinct())
    pairs = near.join(one.withColumnRenamed("path", "near"), ["host", "near"]).select("host", "path", "other")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    recurring = recurring_lines(pages).select("host", "recurring", salts)
    placed = pages.join(pairs, ["host", "path"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("path", "content"), F.lit(SALTS)).cast("int")).join(recurring, ["host", "salt"], "left")
    known = F.array_intersect(F.array_union("hashes", "other"), "recurring")

    @F.arrow_udf("array<boolean>")
    def stay(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in pieces(batches):
            yield pa.array((difference(lines, protected, other, set(often or ()))
                            for lines, protected, other, often in zip(*(c.to_pylist() for c in columns))), pa.list_(pa.bool_()))

    return placed.select("host", "path", "content", stay("hashes", "protected", "other", known).alias("keep"))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None,
                      out: str = "main") -> DataFrame:
    """Columns ``keep`` of ``pages`` (all by default) with a struct ``out``: text, n_chars."""
    keep = pages.columns if keep is None else keep
    out = free_name(pages, out)

    @F.arrow_udf("struct<protected:array<boolean>,lines:array<string>>")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces(batches):
            found = [protected_lines(h.as_py()) for h in batch]
            yield pa.StructArray.from_arrays([pa.array([p for p, _ in found], pa.list_(pa.bool_())),
                                              pa.array([x for _, x in found], pa.list_(pa.string()))], ["protected", "lines"])

    names = [f"c{i}" for i in range(len(keep))]
    url = F.coalesce(column(pages, url_col).cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    read = written(pages.select(*[column(pages, c).alias(n) for c, n in zip(keep, names)],
                                F.lower(F.regexp_extract(bare, r"^[^/]*", 0)).alias("host"),
                                F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"(?:/|\.html?)$", "").alias("path"),
                                parse(column(pages, html_col).cast("string")).alias("p")).select(
        *names, "host", "path", "p.lines", "p.protected", F.xxhash64("p.lines", "p.protected").alias("content")))

    hashes = F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes")
    distinct = written(read.filter(F.size("lines") > 0).select("host", "path", "content", hashes, "protected").dropDuplicates(
        ["host", "path", "content"]))
    shortened = written(kept_lines(distinct).filter(F.array_contains("keep", False)))
    lines = F.when(F.col("keep").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: F.get("keep", i)))
    text = read.join(shortened, ["host", "path", "content"], "left").select(*names, F.concat_ws(" ", lines).alias("text"))
    return text.select(*[F.col(n).alias(c) for c, n in zip(keep, names)],
                       F.struct(F.col("text"), F.length("text").cast("bigint").alias("n_chars")).alias(out))
