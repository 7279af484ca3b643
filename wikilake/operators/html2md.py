"""HTML → markdown (H0-H15) as a Spark job over a token table.

Plan
----
1. Pages are hash-partitioned by ``page_id`` once (compact page rows move, not tokens).
2. H0: ``regexp_extract_all`` + ``posexplode`` cut each page into tokens: CDATA, comment,
   script and style elements, tags, text, stray ``<``. Concatenating the tokens gives
   the input back (checked by ``html_tokens``).
3. State is a set of running sums over ``(page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)``:
   pre / list / quote / code depths, clamped at zero (``s - least(0, running min s)``)
   so stray closing tags cannot drive a depth negative; the table-cell context is the
   last cell-or-row token seen. ``block_no`` counts block boundaries.
4. Inline pairs (``b strong i em code a``) and list items are numbered in a second window
   keyed by ``(page_id, group)``, where the group is ``tag#block`` for inline tags and
   ``L#depth`` for lists: an opening tag is emitted only when a matching close follows in
   the same block; a close only when something is open. Both windows partition by
   ``page_id`` only at the exchange level, so the one shuffle serves every step.
5. Each token becomes a fragment (``CASE``); blocks are ordered aggregates of fragments;
   the document is an ordered aggregate of rendered blocks with separators.

No Python runs per row; one page's tokens form one window group, so a page's size
bounds the largest group (not a table's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cache import cached_expr

from ..functions.text import decode_entities
from ..session import partitions_for

# The token pattern (Java regex; possessive forms keep long tags from
# recursing) and the tag classes the rules use.
TOKEN_RE = (r"(?is)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
            r"|<[/!?A-Za-z](?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<")
BLOCK_TAGS = ["p", "div", "article", "section", "nav", "header", "footer", "main", "aside", "body", "html",
              "head", "title", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "caption", "tr", "ul",
              "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "dl", "dt", "dd", "figure", "figcaption",
              "address", "form", "fieldset", "details", "summary", "center"]
INLINE_MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
CELL_BREAKS = [*BLOCK_TAGS, "td", "th"]
# Internal marks of a fragment, all resolved before the output: 1 line break, 2 cell start,
# 3 / 4 strong opens / closes, 5 / 6 emphasis opens / closes. They are removed from inputs.
MARKS = "\x01\x02\x03\x04\x05\x06"
OPEN_MARK = {"b": "\x03", "strong": "\x03", "i": "\x05", "em": "\x05", "code": "`"}
CLOSE_MARK = {"b": "\x04", "strong": "\x04", "i": "\x06", "em": "\x06", "code": "`"}
LIST_INDENT = {"ul": 2, "ol": 3}
CODE_BODY = "ac:plain-text-body"
# ---------------------------------------------------------------------------



def _win():
    w = Window.partitionBy("page_id").orderBy("pos")
    return w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


@cached_expr
def _attr(tok: Column, name: str) -> Column:
    """Attribute value (quoted or bare), entities decoded; null when absent."""
    pat = r"(?i)\s" + name + r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    has = tok.rlike(pat)
    val = F.concat(F.regexp_extract(tok, pat, 1), F.regexp_extract(tok, pat, 2), F.regexp_extract(tok, pat, 3))
    return F.when(has, decode_entities(val))


@cached_expr
def _ascii_lower(c: Column) -> Column:
    # tag names are ASCII: a plain translate avoids the locale-aware lower-casing path
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenize(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """H0: one row per token, with its kind, tag name and closing flag."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    p = p.repartition(partitions_for(p), "page_id")
    t = p.select("page_id", F.posexplode_outer(F.regexp_extract_all("html", F.lit(TOKEN_RE), 0)).alias("pos", "tok"))
    tok = F.col("tok")
    low = _ascii_lower(F.substring(tok, 1, 10))
    name = _ascii_lower(F.regexp_extract(tok, r"^</?([A-Za-z][A-Za-z0-9:_-]*)", 1))
    name = F.when(name == CODE_BODY, F.lit("pre")).otherwise(name)  # a code macro's body is preformatted
    kind = (
        F.when(tok.isNull(), "none")
        .when(~tok.startswith("<") | (tok == "<"), "text")
        .when(tok.startswith("<!--"), "comment")
        .when(tok.startswith("<![CDATA["), "cdata")
        .when(tok.startswith("<!") | tok.startswith("<?"), "decl")
        .when((low.startswith("<script") | low.startswith("<style")) & tok.contains("</"), "skip")
        .when(tok.startswith("</"), "close")
        .otherwise("open")
    )
    return t.select("page_id", F.coalesce("pos", F.lit(0)).alias("pos"), "tok", kind.alias("kind"),
                    F.when(kind.isin("open", "close"), name).otherwise("").alias("tag"))


def html_to_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                     keep_stripped_text: bool = False) -> DataFrame:
    """Convert a page table to ``(page_id, markdown)``."""
    return _assemble(_token_steps(tokenize(pages, id_col, html_col), keep_stripped_text))


@cached_expr
def _h2m_steps(keep_stripped_text: bool) -> list:
    """The token job as a list of column steps, built once per session."""
    steps: list = []
    _W, _RUN = _win()
    is_open = F.col("kind") == "open"
    is_close = F.col("kind") == "close"
    tag = F.col("tag")
    # decoded text and the few attributes used, computed once per token
    steps.append(("add", [
        F.when(F.col("kind") == "text", F.translate(decode_entities(F.col("tok")), MARKS, ""))
        .when(F.col("kind") == "cdata", F.translate(F.regexp_extract("tok", r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1), MARKS, "")).alias("dtext"),
        F.when(is_open & (tag == "a"), _attr(F.col("tok"), "href")).alias("a_href"),
        F.when(is_open & tag.isin("a", "img"), _attr(F.col("tok"), "title")).alias("a_title"),
    ]))

    def pm(name: str) -> Column:  # +1 on open, -1 on close of this tag
        return F.when(is_open & (tag == name), 1).when(is_close & (tag == name), -1).otherwise(0)

    steps.append(("add", [
        F.sum(pm("pre")).over(_RUN).alias("pre_s"),
        F.sum(pm("ul")).over(_RUN).alias("ul_s"),
        F.sum(pm("ol")).over(_RUN).alias("ol_s"),
        F.sum(pm("blockquote")).over(_RUN).alias("bq_s"),
        F.sum(pm("code")).over(_RUN).alias("code_s"),
        F.sum(pm("table")).over(_RUN).alias("tbl_s"),
        F.lead("kind", 1).over(_W).alias("k1"), F.lead("dtext", 1).over(_W).alias("t1"),
        F.lead("kind", 2).over(_W).alias("k2"), F.lead("tag", 2).over(_W).alias("g2"),
    ]))
    depth = {}
    for c in ("pre", "ul", "ol", "bq", "code", "tbl"):
        s = F.col(c + "_s")
        depth[c] = s - F.least(F.lit(0), F.min(s).over(_RUN))
    steps.append(("add", [d.alias(c) for c, d in depth.items()]))
    # a table inside a cell is part of the cell: only outer tables make rows and cells
    inner = (F.col("tbl") > 1) | (is_close & (tag == "table") & (F.col("tbl") == 1))
    cell_mark = F.when(~inner, F.when(is_open & tag.isin("td", "th"), "cell")
                       .when(tag.isin("td", "th", "tr", "table", "thead", "tbody", "tfoot"), "out"))
    steps.append(("add", [
        inner.alias("inner"),
        F.last(cell_mark, ignorenulls=True).over(_RUN).alias("cellctx"),
        F.sum(F.when(is_open & (tag == "tr") & ~inner, 1).otherwise(0)).over(_RUN).alias("tr_run"),
    ]))
    in_pre = F.col("pre") > 0
    in_cell = F.coalesce(F.col("cellctx"), F.lit("out")) == "cell"
    boundary = (is_open | is_close) & tag.isin(*BLOCK_TAGS) & (~in_pre | (tag == "pre")) & (~in_cell | (tag.isin("tr", "table") & ~F.col("inner")))
    steps.append(("add", [boundary.alias("is_boundary")]))
    steps.append(("add", [
        F.sum(F.col("is_boundary").cast("int")).over(_RUN).alias("block_no"),
        F.last(F.when(is_open & (tag == "table") & ~F.col("inner"), F.col("tr_run")), ignorenulls=True).over(_RUN).alias("tbl_base"),
    ]))

    # --- second window: inline pairs per (tag, block) and list items per depth -----------
    href = F.col("a_href")
    is_inline = (is_open | is_close) & ~in_pre & (tag.isin(*INLINE_MARK) | ((tag == "a") & (is_close | href.isNotNull())))
    list_depth = F.col("ul") + F.col("ol")
    is_list_open = is_open & tag.isin("ul", "ol")
    is_li = is_open & (tag == "li") & ~in_pre
    gkey = (F.when(is_inline, F.concat(tag, F.lit("#"), F.col("block_no").cast("string")))
            .when(is_list_open | is_li, F.concat(F.lit("L#"), list_depth.cast("string")))
            .otherwise(F.lit("")))
    steps.append(("add", [gkey.alias("gkey"), is_inline.alias("inl"), is_li.alias("li_open"),
                          is_list_open.alias("list_open"), F.when(is_open & (tag == "a"), href).alias("href")]))
    wg = Window.partitionBy("page_id", "gkey").orderBy("pos")
    g_run = wg.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("inl") & is_open, 1).when(F.col("inl") & is_close, -1).otherwise(0)
    start_attr = F.coalesce(F.regexp_extract(F.col("tok"), r"(?i)\sstart\s*=\s*[\"']?([0-9]+)", 1).try_cast("int"), F.lit(1))
    title_attr = F.col("a_title")
    autolink = (F.col("k1") == "text") & (F.col("k2") == "close") & (F.col("g2") == "a") & \
        (F.col("t1") == F.col("href")) & title_attr.isNull()
    steps.append(("add", [
        F.sum(step).over(g_run).alias("is_s"),
        F.sum(F.col("li_open").cast("int")).over(g_run).alias("li_run"),
        F.last(F.when(F.col("list_open"), tag), ignorenulls=True).over(g_run).alias("list_type"),
        F.last(F.when(F.col("list_open"), start_attr), ignorenulls=True).over(g_run).alias("list_start"),
        F.last(F.when(F.col("inl") & is_open & (tag == "a"), F.struct(
            F.col("href").alias("h"), title_attr.alias("ti"), autolink.alias("au"))), ignorenulls=True).over(g_run).alias("a_open"),
    ]))
    steps.append(("add", [
        (F.col("is_s") - F.least(F.lit(0), F.min("is_s").over(g_run))).alias("is_c"),
        F.last(F.when(F.col("list_open"), F.col("li_run")), ignorenulls=True).over(g_run).alias("li_base"),
    ]))
    # "does a close follow?" = running minimum in reverse order (a frame reaching to the
    # end of the partition would be recomputed per row, quadratic in the group size)
    wg_rev = Window.partitionBy("page_id", "gkey").orderBy(F.col("pos").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    steps.append(("add", [
        F.min("is_c").over(wg_rev).alias("is_after_min"),
        F.lead("is_c", 1).over(Window.partitionBy("page_id", "gkey").orderBy(F.col("pos").desc())).alias("is_prev"),
    ]))
    open_ok = F.col("inl") & is_open & F.col("is_after_min").isNotNull() & (F.col("is_after_min") < F.col("is_c"))
    close_ok = F.col("inl") & is_close & (F.coalesce(F.col("is_prev"), F.lit(0)) >= 1)

    # --- fragments ----------------------------------------------------------------------
    raw_text = F.col("tok")
    txt = F.col("dtext")
    plain = F.regexp_replace(txt, r"[ \t\n\r\f]+", " ")
    escaped = F.regexp_replace(plain, r"([*_])", r"\\$1")
    text_frag = F.when(in_pre & ~in_cell, txt).when(F.col("code") > 0, plain).otherwise(escaped)
    text_frag = F.when(in_cell, F.replace(text_frag, F.lit("|"), F.lit("\\|"))).otherwise(text_frag)

    def mark_of(marks: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in marks.items() for x in kv]), tag)
    a = F.col("a_open")
    link_tail = F.when(a["au"], F.lit(">")).otherwise(F.concat(
        F.lit("]("), a["h"], F.when(a["ti"].isNotNull(), F.concat(F.lit(' "'), a["ti"], F.lit('"'))).otherwise(F.lit("")), F.lit(")")))
    img_title = F.col("a_title")
    img = F.concat(F.lit("!["), F.coalesce(_attr(F.col("tok"), "alt"), F.lit("")), F.lit("]("),
                   F.coalesce(_attr(F.col("tok"), "src"), F.lit("")),
                   F.when(img_title.isNotNull(), F.concat(F.lit(' "'), img_title, F.lit('"'))).otherwise(F.lit("")), F.lit(")"))
    skip_text = F.lit("") if not keep_stripped_text else F.regexp_replace(
        F.regexp_replace(raw_text, r"(?is)^<[^>]*>", ""), r"(?is)</[a-z]+\s*>$", "")
    frag = (
        F.when(F.col("kind").isin("text", "cdata"), text_frag)
        .when(F.col("kind") == "skip", skip_text)
        .when(open_ok & (tag == "a"), F.when(a["au"], F.lit("<")).otherwise(F.lit("[")))
        .when(close_ok & (tag == "a"), link_tail)
        .when(open_ok | close_ok, F.when((tag != "code") & (F.col("code") > 0), F.lit(""))
              .when(open_ok, mark_of(OPEN_MARK)).otherwise(mark_of(CLOSE_MARK)))
        .when(is_open & (tag == "br"), F.when(in_pre, F.lit("\n")).otherwise(F.lit("\u0001")))
        .when(is_open & (tag == "img"), img)
        .when(is_open & tag.isin("td", "th") & in_cell & ~F.col("inner"), F.lit("\u0002"))
        .when(in_cell & (is_open | is_close) & tag.isin(*CELL_BREAKS), F.lit(" "))  # blocks of a cell stay apart
        .otherwise(F.lit(""))
    )
    # block attributes, taken from the boundary token that opens the block
    first_row = is_open & (tag == "tr") & ~F.col("inner") & ((F.col("tr_run") - F.coalesce(F.col("tbl_base"), F.lit(0))) == 1)
    bkind = (F.when(~F.col("is_boundary"), F.lit(None))
             .when(is_open & tag.rlike("^h[1-6]$"), F.lit("h"))
             .when(F.col("li_open"), F.lit("li"))
             .when(is_open & (tag == "pre"), F.lit("pre"))
             .when(is_open & (tag == "tr"), F.lit("tr"))
             .when(is_open & (tag == "hr"), F.lit("hr"))
             .otherwise(F.lit("p")))
    li_no = F.col("li_run") - F.coalesce(F.col("li_base"), F.lit(0))
    battrs = F.struct(
        bkind.alias("kind"),
        F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).alias("level"),
        F.col("ul").alias("ul"), F.col("ol").alias("ol"), F.col("bq").alias("bq"),
        F.coalesce(F.col("list_type"), F.lit("ul")).alias("list_type"),
        (F.coalesce(F.col("list_start"), F.lit(1)) + li_no - 1).alias("number"),
        first_row.alias("first_row"),
        F.coalesce(F.col("tbl_base"), F.lit(-1)).alias("table_id"),
    )
    steps.append(("project", [F.col("page_id"), F.col("pos"), F.col("block_no"), frag.alias("frag"),
                              F.when(F.col("is_boundary"), battrs).alias("battrs"),
                              (is_open & (tag == "th") & in_cell & ~F.col("inner")).alias("is_th")]))
    # only fragments that render, block openers and header cells go on to the aggregates
    steps.append(("filter", (F.col("frag") != "") | F.col("battrs").isNotNull() | F.col("is_th") | (F.col("pos") == 0)))
    return steps


def _render_inline(x: Column) -> Column:
    """Text of a block: pairs with nothing inside go (also nested ones), blanks at the inner
    edge of a pair move outside, marks and breaks become markdown."""
    y = F.regexp_replace(x, " {2,}", " ")
    for _ in range(2):
        y = F.regexp_replace(F.regexp_replace(y, "\u0003( ?)\u0004", "$1"), "\u0005( ?)\u0006", "$1")
    y = F.regexp_replace(F.regexp_replace(y, "([\u0003\u0005]+) +", " $1"), " +([\u0004\u0006]+)", "$1 ")
    y = F.regexp_replace(F.regexp_replace(y, "[\u0003\u0004]", "**"), "[\u0005\u0006]", "*")
    y = F.regexp_replace(y, " {2,}", " ")
    y = F.regexp_replace(y, " ?\u0001 ?", "  \n")
    return F.regexp_replace(F.regexp_replace(y, r"^[ \t\n\r\f]+", ""), r"[ \t\n\r\f]+$", "")


def _assemble(t: DataFrame) -> DataFrame:
    e = _assemble_exprs()
    pieces = _blocks(t).select(*e["pieces"])
    docs = pieces.groupBy("page_id").agg(*e["docs"])
    return docs.select(*e["final"])


def _blocks(t: DataFrame) -> DataFrame:
    """One row per block of a page: rendered text, kind, heading and table cells."""
    e = _assemble_exprs()
    return t.groupBy("page_id", "block_no").agg(*e["blocks"]).select(*e["rows"])


def _token_steps(t: DataFrame, keep_stripped_text: bool = False) -> DataFrame:
    for op, arg in _h2m_steps(keep_stripped_text):
        t = t.select("*", *arg) if op == "add" else t.select(*arg) if op == "project" else t.filter(arg)
    return t


def html_headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Side table of headings, from the blocks themselves (a line of a code block that looks
    like a heading is none): page_id, block_no, level, text."""
    rows = _blocks(_token_steps(tokenize(pages, id_col, html_col)))
    return rows.filter((F.col("kind") == "h") & (F.col("heading") != "")).select(
        "page_id", F.col("block_no").cast("long").alias("block_no"), "level", F.col("heading").alias("text"))


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Side table of table rows: page_id, table_id (rows of the page before the table),
    row_no within the table, is_header, n_cells and the cells joined as in markdown."""
    rows = _blocks(_token_steps(tokenize(pages, id_col, html_col))).filter(F.col("cells").isNotNull())
    no = F.row_number().over(Window.partitionBy("page_id", "table_id").orderBy("block_no"))
    return rows.select("page_id", F.col("table_id").cast("long").alias("table_id"), no.cast("long").alias("row_no"),
                       F.col("has_th").alias("is_header"), F.size("cells").cast("long").alias("n_cells"),
                       F.array_join("cells", " | ").alias("cells"))


def html_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Side table of link targets: page_id, pos, href."""
    t = tokenize(pages, id_col, html_col)
    a = t.filter((F.col("kind") == "open") & (F.col("tag") == "a"))
    return a.select("page_id", "pos", _attr(F.col("tok"), "href").alias("href")).filter(F.col("href").isNotNull())


@cached_expr
def _assemble_exprs() -> dict:
    """Columns of the block and document aggregates, built once per session."""
    e: dict = {"blocks": [
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "frag"))), lambda x: x["frag"]), "").alias("body"),
        F.first("battrs", ignorenulls=True).alias("b"),  # one boundary token per block, at its start
        F.max(F.col("is_th").cast("int")).alias("has_th"),
    ]}
    b = F.col("b")
    kind = F.coalesce(b["kind"], F.lit("p"))
    body = F.col("body")
    inline = _render_inline(body)
    cells = F.transform(F.slice(F.split(F.regexp_replace(body, "\u0001", " "), "\u0002", -1), 2, 1 << 30),
                        lambda c: _render_inline(c))
    n = F.size(cells)
    row = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    delim = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    blank = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(""), n), " | "), F.lit(" |"))
    table_row = (F.when(~F.coalesce(b["first_row"], F.lit(False)), row)
                 .when(F.col("has_th") == 1, F.concat(row, F.lit("\n"), delim))
                 .otherwise(F.concat(blank, F.lit("\n"), delim, F.lit("\n"), row)))
    ul = F.coalesce(b["ul"], F.lit(0))
    ol = F.coalesce(b["ol"], F.lit(0))
    ltype = b["list_type"]
    width = F.when(ltype == "ol", LIST_INDENT["ol"]).otherwise(LIST_INDENT["ul"])
    indent = F.greatest(F.lit(0), ul * LIST_INDENT["ul"] + ol * LIST_INDENT["ol"] - width)
    bullet = F.when(ltype == "ol", F.concat(b["number"].cast("string"), F.lit("."))).otherwise(F.lit("-"))
    pre_text = F.regexp_replace(body, r"^\n", "")
    # a fence longer than any run of backticks inside
    ticks = F.array_max(F.transform(F.regexp_extract_all(pre_text, F.lit("`+"), 0), F.length))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(ticks, F.lit(0)) + 1))
    fenced = F.concat(fence, F.lit("\n"), pre_text, F.lit("\n"), fence)
    cont_indent = F.repeat(F.lit(" "), ul * LIST_INDENT["ul"] + ol * LIST_INDENT["ol"])
    rendered = (
        F.when(kind == "pre", F.when(pre_text != "", F.when(ul + ol > 0, F.regexp_replace(fenced, "(?m)^", cont_indent)).otherwise(fenced)))
        .when(kind == "hr", F.lit("---"))
        .when(kind == "tr", F.when(n > 0, table_row))
        .when(inline == "", F.lit(None))
        .when(kind == "h", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), F.regexp_replace(inline, r"\s*\n\s*", " ")))
        .when(kind == "li", F.concat(F.repeat(F.lit(" "), indent), bullet, F.lit(" "),
                                     F.regexp_replace(inline, "\n", F.concat(F.lit("\n"), F.repeat(F.lit(" "), indent + 2)))))
        .when(ul + ol > 0, F.concat(cont_indent, inline))
        .otherwise(inline)
    )
    bq = F.coalesce(b["bq"], F.lit(0))
    quoted = F.when(bq > 0, F.regexp_replace(rendered, "(?m)^", F.repeat(F.lit("> "), bq))).otherwise(rendered)
    e["rows"] = [
        F.col("page_id"), F.col("block_no"), quoted.alias("md"), kind.alias("kind"), bq.alias("bq"),
        (ul + ol).alias("ldepth"), F.coalesce(b["table_id"], F.lit(-1)).alias("table_id"),
        b["level"].alias("level"), F.when(kind == "h", F.regexp_replace(inline, r"\s*\n\s*", " ")).alias("heading"),
        F.when((kind == "tr") & (n > 0), cells).alias("cells"), (F.coalesce(F.col("has_th"), F.lit(0)) == 1).alias("has_th"),
    ]
    # separators look at the previous block that renders to something
    before = Window.partitionBy("page_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.col("md").isNotNull()
    prev = {c: F.last(F.when(kept, F.col(c)), ignorenulls=True).over(before) for c in ("kind", "bq", "ldepth", "table_id")}
    tight = ((F.col("kind") == "tr") & (prev["kind"] == "tr") & (prev["table_id"] == F.col("table_id"))) | \
            ((F.col("ldepth") > 0) & (prev["ldepth"] > 0))
    both_q = F.least(F.col("bq"), prev["bq"])
    sep = (F.when(prev["kind"].isNull(), F.lit(""))
           .when(tight, F.lit("\n"))
           .when(both_q > 0, F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), both_q)), F.lit("\n")))
           .otherwise(F.lit("\n\n")))
    e["pieces"] = [F.col("page_id"), F.col("block_no"), F.concat(sep, F.col("md")).alias("piece")]
    e["docs"] = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "piece"))),
                                          lambda x: x["piece"]), "").alias("md")]
    e["final"] = [F.col("page_id"),
                  F.regexp_replace(F.regexp_replace(F.translate("md", MARKS, ""), r"^[ \t\n\r\f]+", ""), r"[ \t\n\r\f]+$", "").alias("markdown")]
    return e


def html_tokens_check(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """H0 property: per page, token count and whether the tokens give the input back."""
    t = tokenize(pages, id_col, html_col)
    agg = t.groupBy("page_id").agg(
        F.count("tok").alias("n_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda e: e["tok"]), "").alias("joined"),
        F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).alias("n_open"),
        F.sum(F.when(F.col("kind") == "close", 1).otherwise(0)).alias("n_close"),
        F.sum(F.when(F.col("kind") == "text", 1).otherwise(0)).alias("n_text"),
    )
    src = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return agg.join(src, "page_id").select(
        "page_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_open").cast("long").alias("n_open"),
        F.col("n_close").cast("long").alias("n_close"), F.col("n_text").cast("long").alias("n_text"),
        (F.coalesce(F.col("joined"), F.lit("")) == F.coalesce(F.col("html"), F.lit(""))).alias("lossless"))
