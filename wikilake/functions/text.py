"""Scalar text functions (P7 slug, P8 header, P12/P13 edit buffers, entity decoding).

All are plain Catalyst expressions: they stay inside whole-stage codegen where the
expression supports it and never leave the JVM.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cache import cached_expr

# ---------------------------------------------------------------------------
# Named character references decoded by the HTML reader (H13): the HTML standard's table, as
# Python's standard library has it. Decoding is a single pass, so `&amp;lt;` stays `&lt;`.
# A short list of common names is looked up first.
COMMON_NAMES = "amp lt gt quot apos nbsp copy reg trade middot hellip mdash ndash lsquo rsquo ldquo rdquo euro".split()
NAMED_ENTITIES = {f"&{n}": " " if c == "\xa0" else c for n, c in html5.items() if n.endswith(";")}
# Fixed value: whitespace removed by the edit-buffer strip and the final trim.
STRIP_CHARS = " \t\n\r\x0b\x0c"
# The metadata header and edit buffer layouts.
HEADER_LAYOUT = "# {title}\n\n**Space:** {space}  \n**Page ID:** {id}  \n**Version:** {version}  \n**URL:** {url}\n\n---\n\n"
EDIT_NOTE = "<!-- Edit the content below. Lines starting with <!-- are comments and will be ignored -->"
# ---------------------------------------------------------------------------

ENTITY_PIECES = r"&[A-Za-z][A-Za-z0-9]+;|&#[0-9]+;|&#[xX][0-9a-fA-F]+;|[^&]+|&"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(x: Column, use) -> Column:
    """``use(x)`` with ``x`` evaluated once, however often its lambdas read it."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _codepoint_char(cp: Column) -> Column:
    """Character for a code point: Spark's ``chr`` wraps at 256, so go through UTF-32."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


@cached_expr
def decode_entities(c) -> Column:
    """One left-to-right pass over ``&...;`` pieces (an entity's output is never decoded
    again): named references of the HTML table, ``&#n;`` and ``&#xh;`` code points of any
    number of digits. What names no character stays as it is."""
    s = _col(c)

    def table(entities: dict[str, str]) -> Column:
        return F.expr("map(" + ", ".join(sql_str(x) for kv in entities.items() for x in kv) + ")")

    common = table({f"&{n};": NAMED_ENTITIES[f"&{n};"] for n in COMMON_NAMES})
    # the whole table as one literal: a map of its size in every expression would make plans large
    names = F.lit("\x01" + "\x01".join(f"{n}\x02{c}" for n, c in NAMED_ENTITIES.items()) + "\x01")

    def listed(p: Column) -> Column:
        entry = F.concat(F.lit("\x01"), p, F.lit("\x02"))
        return F.when(names.contains(entry), F.substring_index(F.call_function("substring_index", names, entry, F.lit(-1)), "\x01", 1))

    def one(p: Column) -> Column:
        is_hex = p.rlike("^&#[xX]")
        digits = F.regexp_extract(p, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        short = F.regexp_replace(digits, "^0+", "")  # more than seven digits are no code point
        cp = F.when(F.length(short) <= 7, F.when(is_hex, F.conv(short, 16, 10)).otherwise(short)).try_cast("long")
        ok = cp.between(1, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
        numeric = F.when(ok, _codepoint_char(cp)).otherwise(p)
        return F.when(p.startswith("&#"), numeric).when(~(p.startswith("&") & p.endswith(";")), p).otherwise(
            F.coalesce(F.try_element_at(common, p), listed(p), p))

    pieces = F.regexp_extract_all(s, F.lit(ENTITY_PIECES), 0)
    return F.when(s.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(s)


@cached_expr
def strip_ws(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"^[ \t\n\r\x0B\f]+", ""), r"[ \t\n\r\x0B\f]+$", "")


@cached_expr
def slug(c) -> Column:
    """ASCII upper→lower, space→'-', keep only [a-z0-9-], add '.md'."""
    t = F.translate(F.translate(_col(c), _UPPER, _LOWER), " ", "-")
    return F.concat(F.regexp_replace(t, "[^a-z0-9-]", ""), F.lit(".md"))


@cached_expr
def page_url(base_url, page_id) -> Column:
    """Canonical page URL; trailing '/' of the base removed (all of them)."""
    return F.concat(F.regexp_replace(_col(base_url), "/+$", ""), F.lit("/pages/viewpage.action?pageId="), _col(page_id))


@cached_expr
def metadata_header(title, space_name, page_id, version, url) -> Column:
    """The markdown header put before an exported page."""
    return F.concat(
        F.lit("# "), _col(title),
        F.lit("\n\n**Space:** "), _col(space_name),
        F.lit("  \n**Page ID:** "), _col(page_id),
        F.lit("  \n**Version:** "), _col(version).cast("string"),
        F.lit("  \n**URL:** "), _col(url),
        F.lit("\n\n---\n\n"),
    )


@cached_expr
def edit_buffer(title, page_id, version, markdown) -> Column:
    """The text a user edits: title, two comment lines, blank line, markdown."""
    return F.concat(
        F.lit("# "), _col(title), F.lit("\n\n"),
        F.lit(EDIT_NOTE + "\n"),
        F.lit("<!-- Page ID: "), _col(page_id), F.lit(", Version: "), _col(version).cast("string"), F.lit(" -->\n\n"),
        _col(markdown),
    )


@cached_expr
def clean_edit(c) -> Column:
    """Drop comment lines, drop the first remaining '# ' line, join, strip."""
    lines = F.split(_col(c), "\n", -1)
    kept = F.filter(lines, lambda l: ~(l.startswith("<!--") & l.contains("-->")))
    title_at = F.array_position(F.transform(kept, lambda l: l.startswith("# ")), True)
    body = F.filter(kept, lambda l, i: (i + 1) != title_at)
    return strip_ws(F.array_join(body, "\n"))
