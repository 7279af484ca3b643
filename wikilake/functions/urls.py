"""P1 page id from a page URL, as Catalyst expressions.

The URL is taken apart the way a standard URL splitter does it: tabs and line
breaks removed, leading blanks stripped, scheme cut, network location cut when the
rest starts with ``//``, then fragment, then query, then the ``;params`` of the last
path segment. The id is

1. the value of the first ``&``-part of the query that starts with ``pageId=``, up
   to the next ``=`` (may be empty, is not decoded, need not be numeric);
2. else the first all-digit path segment after the first ``pages`` segment;
3. else null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cache import cached_expr
from .text import _col, bound, page_url  # noqa: F401  (re-export)


def url_rest(c) -> Column:
    """What follows scheme and network location, up to the fragment."""
    u = F.regexp_replace(F.translate(_col(c), "\t\r\n", ""), "^[\\x00-\\x20]+", "")
    after_scheme = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    after_netloc = F.regexp_replace(after_scheme, "^//[^/?#]*", "")
    return F.regexp_extract(after_netloc, "^([^#]*)", 1)


@cached_expr
def page_id_from_url(c) -> Column:
    url = _col(c)

    def from_path(rest: Column) -> Column:
        path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), ";[^/]*$", "")

        def found(segs: Column) -> Column:
            pages_at = F.array_position(segs, "pages")
            return F.get(F.filter(segs, lambda s, i: (i >= pages_at) & (pages_at > 0) & s.rlike("^[0-9]+$")), 0)

        return bound(F.split(path, "/", -1), found)

    def page_id(rest: Column) -> Column:
        q_parts = F.split(F.regexp_extract(rest, "^[^?]*\\?(.*)$", 1), "&", -1)
        hit = F.get(F.filter(q_parts, lambda p: p.startswith("pageId=")), 0)
        return bound(hit, lambda h: F.when(h.isNotNull(), F.get(F.split(h, "=", -1), 1)).otherwise(from_path(rest)))

    return (
        F.when(url.isNull() | (url == ""), F.lit(None).cast("string"))
        .otherwise(bound(url_rest(url), page_id))
    )
