"""DuckDB oracle SQL, one text per registered query (same column names as the Spark side)."""

from __future__ import annotations

from . import sqlparts as S
from .catalog import SEARCH_QUERY, SEARCH_QUERY_EXTENDED, SPACE_FOR_S3

ORACLE: dict[str, str] = {}


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


REQUESTS = f"""requests AS (
  SELECT c.conv_id * 100000 + c.turn AS request_seq,
         'i' || CAST(CAST(c.target AS BIGINT) % 2 AS VARCHAR) AS instance,
         c.action,
         CASE WHEN c.action <> 'create' THEN 'https://wiki' || CAST(CAST(c.target AS BIGINT) % 2 AS VARCHAR)
              || '.example.com/pages/viewpage.action?pageId=' || c.target END AS url,
         CASE WHEN c.action = 'edit' AND c.txt <> ''
              THEN {S.edit_buffer_expr("'Edited'", "c.target", "c.base_version", "c.txt")} ELSE c.txt END AS content,
         CASE WHEN c.turn % 5 = 0 THEN 'html' ELSE 'markdown' END AS content_type,
         c.turn % 3 <> 0 AS append,
         CASE WHEN c.action = 'create' THEN p.space_key END AS space_key,
         CASE WHEN c.action = 'create' THEN 'Note ' || CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR) END AS title,
         CAST(NULL AS VARCHAR) AS parent_id,
         CASE WHEN c.action = 'create' THEN CASE WHEN c.conv_id % 4 = 0 THEN 'No Parent'
              WHEN c.conv_id % 9 = 0 THEN 'Missing page' ELSE p.title END END AS parent_title,
         CASE WHEN c.action = 'create' THEN 'tpl_' || CASE WHEN c.conv_id % 3 = 0 THEN 'xx'
              ELSE ['en', 'de', 'fr', 'es'][CAST(c.conv_id % 4 + 1 AS INTEGER)] END END AS template,
         CASE WHEN c.action = 'edit' THEN c.base_version END AS base_version
  FROM (SELECT conv_id, turn,
               CASE WHEN conv_id % 23 = 0 THEN '' ELSE text END AS txt,
               CAST(conv_id % (SELECT count(*) FROM pages) AS VARCHAR) AS target,
               CASE WHEN (conv_id + turn) % 9 = 4 THEN 'create' WHEN (conv_id + turn) % 7 = 3 THEN 'edit' ELSE 'add' END AS action,
               CAST(CASE WHEN conv_id % 13 = 0 THEN conv_id % (SELECT count(*) FROM pages) % 5
                         ELSE conv_id % (SELECT count(*) FROM pages) % 5 + 1 END AS INTEGER) AS base_version
        FROM conversations) c
  LEFT JOIN wiki_pages p ON p.page_id = c.target)"""


ORACLE["page_id_from_url"] = with_(S.WIKI_PAGES, S.URLS) + f"""
SELECT instance, url, page_id AS listed_id, {S.page_id_expr("url")} AS page_id FROM urls"""

ORACLE["page_url"] = with_(S.WIKI_PAGES, S.INSTANCES) + f"""
SELECT p.instance, p.page_id, {S.page_url_expr("i.base_url", "p.page_id")} AS url
FROM wiki_pages p LEFT JOIN instances i ON p.instance = i.instance"""

ORACLE["slug"] = with_(S.WIKI_PAGES) + f"""
SELECT page_id, title, {S.slug_expr("title")} AS file_name FROM wiki_pages"""

ORACLE["metadata_header"] = with_(S.WIKI_PAGES, S.INSTANCES) + f"""
SELECT p.page_id, {S.header_expr("p.title", "p.space_name", "p.page_id", "p.version", S.page_url_expr("i.base_url", "p.page_id"))} AS header
FROM wiki_pages p LEFT JOIN instances i ON p.instance = i.instance"""

_LISTING_COLS = "instance, resp_start, item_pos, ordinal, page_id, title, space_key, space_name"

# Faulty responses of ten items (r: response number), item by item.
ODD = """odd AS (
  SELECT 'a' || CAST(pid % 2 AS VARCHAR) AS instance, CAST(floor(floor(pid / 2) / 10) AS INTEGER) AS r,
         CAST(floor(pid / 2) AS BIGINT) % 10 AS pos, page_id, title, space_key, space_name
  FROM wiki_pages),
odd_resp AS (SELECT instance, r, r % 5 AS k, count(*) AS n FROM odd GROUP BY 1, 2)"""

ORACLE["page_listing"] = with_(S.WIKI_PAGES, S.LISTING, ODD) + f"""
SELECT {_LISTING_COLS} FROM listing
UNION ALL
SELECT instance, r * 10, CAST(pos AS INTEGER), r * 10 + pos, page_id, title, space_key, space_name
FROM odd JOIN odd_resp USING (instance, r)
WHERE k IN (3, 4) OR (k = 0 AND NOT (r > 0 AND n = 10 AND pos = 9))
UNION ALL
SELECT instance, r * 10, CAST(n AS INTEGER), r * 10 + n, page_id, title, space_key, space_name
FROM odd JOIN odd_resp USING (instance, r) WHERE k = 3 AND pos = 0"""

ORACLE["listing_rejects"] = with_(S.WIKI_PAGES, ODD) + """
SELECT o.instance, 'page' AS kind, o.r * 10 AS start, length(bad_text)::INTEGER AS n_chars, bad_text
FROM (SELECT instance, r, substr('{"results":[{"id":"' || page_id || '","title":"' || title || '","space":{"key":"' || space_key || '","name":"' || space_name, 1, 60) AS bad_text
      FROM odd WHERE pos = 0 AND r % 5 = 1) o"""

SPACES = """spaces AS (
  SELECT instance,
         CAST(row_number() OVER (PARTITION BY instance ORDER BY space_key, space_name) - 1 AS BIGINT) AS ordinal,
         space_key, space_name, CASE WHEN space_key = 'DE' THEN 'unknown' ELSE 'global' END AS space_type
  FROM (SELECT DISTINCT instance, space_key, space_name FROM wiki_pages))"""

ORACLE["space_listing"] = with_(S.WIKI_PAGES, SPACES) + "SELECT * FROM spaces"

ORACLE["pages_in_space"] = with_(S.WIKI_PAGES, S.LISTING) + f"""
SELECT {_LISTING_COLS} FROM listing WHERE coalesce(req_space_key, space_key) = {S.q(SPACE_FOR_S3)}"""

ORACLE["page_details"] = with_(S.WIKI_PAGES) + """
SELECT instance,
       CASE WHEN pid % 29 <> 0 THEN page_id END AS page_id,
       CASE WHEN pid % 29 <> 0 THEN title END AS title,
       CASE WHEN pid % 29 <> 0 THEN space_key END AS space_key,
       CASE WHEN pid % 29 <> 0 THEN space_name END AS space_name,
       CASE WHEN pid % 29 <> 0 THEN CAST(version AS VARCHAR) END AS version,
       CASE WHEN pid % 29 <> 0 THEN storage_html END AS storage_html,
       CASE WHEN pid % 29 <> 0 AND pid % 3 <> 0 THEN CAST(pid - 1 AS VARCHAR) END AS parent_id,
       pid % 29 = 0 AS is_corrupt,
       CASE WHEN pid % 29 = 0 THEN substr('{"id":"' || page_id || '","title":"' || title || '","space":{"key":"' || space_key || '","name":"' || space_name, 1, 50) END AS bad_text
FROM wiki_pages"""

ORACLE["listing_audit"] = with_(S.WIKI_PAGES, SPACES, ODD) + """,
resp AS (
  SELECT instance, 'page' AS kind, CAST(floor(pid / 2 / 100) * 100 AS INTEGER) AS start, count(*) AS n, 100 AS lim,
         false AS empty, false AS bad, count(*) = 100 AS nxt
  FROM wiki_pages GROUP BY 1, 2, 3
  UNION ALL
  SELECT instance, 'space', CAST(floor(ordinal / 100) * 100 AS INTEGER), count(*), 100, false, false, count(*) = 100
  FROM spaces GROUP BY 1, 2, 3
  UNION ALL
  SELECT instance, 'page', r * 10,
         CASE k WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN n + 1 WHEN 0 THEN CASE WHEN r > 0 AND n = 10 THEN 9 ELSE n END ELSE n END,
         CASE WHEN k IN (1, 2) THEN 100 ELSE 10 END, k = 2, k = 1, n = 10 AND k NOT IN (1, 2)
  FROM odd_resp),
lasts AS (SELECT *, empty OR (NOT bad AND n < lim) AS is_last FROM resp),
dups AS (SELECT instance, count(*) AS d FROM odd_resp WHERE k = 3 GROUP BY 1)
SELECT r.instance, r.kind, CAST(NULL AS VARCHAR) AS space_key, r.start, CAST(r.n AS INTEGER) AS n_items,
       r.empty AS empty_body, r.bad AS is_corrupt, r.is_last, r.start + r.lim AS fetched_so_far,
       r.nxt AS has_next_link, r.is_last AND r.nxt AS stops_early,
       r.bad OR (NOT r.is_last AND NOT EXISTS (SELECT 1 FROM resp s WHERE s.instance = r.instance AND s.kind = r.kind AND s.start = r.start + r.n))
         AS gap_after, coalesce(d, 0) AS n_dup_ids
FROM lasts r LEFT JOIN dups ON dups.instance = r.instance"""

ORACLE["listing_counts"] = with_(S.WIKI_PAGES, S.LISTING) + """
SELECT instance, space_key, count(*) AS n_pages FROM listing GROUP BY ROLLUP (instance, space_key)"""

ORACLE["space_counts"] = with_(S.WIKI_PAGES, SPACES) + "SELECT instance, count(*) AS n_spaces FROM spaces GROUP BY instance"


def _term_sql(text: str, term: str) -> str:
    """One search term as LIKE patterns (a plain term: its letters in order on one line)."""
    neg, t = term.startswith("!"), term.removeprefix("!")
    quoted, t = neg or t.startswith("'"), t.removeprefix("'")
    head, t = t.startswith("^"), t.removeprefix("^")
    tail, t = len(t) > 1 and t.endswith("$"), t[:-1] if len(t) > 1 and t.endswith("$") else t
    like = "ILIKE" if t == t.lower() else "LIKE"
    safe = [("!" + c if c in "!%_" else c) for c in t]
    if quoted or head or tail:
        found = f"{text} {like} {S.q(('' if head else '%') + ''.join(safe) + ('' if tail else '%'))} ESCAPE '!'"
    else:
        one = f"line {like} {S.q('%' + '%'.join(safe) + '%')} ESCAPE '!'"
        found = f"len(list_filter(string_split({text}, chr(10)), lambda line: {one})) > 0"
    return f"NOT ({found})" if neg else f"({found})"


def _where(text: str, query: str) -> str:
    groups = " ".join(query.split()).replace(" | ", "\0").split(" ")
    return " AND ".join("(" + " OR ".join(_term_sql(text, t) for t in g.split("\0")) + ")" for g in groups if g) or "true"


def _search_sql(query: str) -> str:
    where = _where("concat_ws(' | ', space_key, space_name, title, page_id)", query)
    return with_(S.WIKI_PAGES, S.LISTING) + f"SELECT {_LISTING_COLS} FROM listing WHERE {where}"


ORACLE["search_pages"] = _search_sql(SEARCH_QUERY)
ORACLE["search_pages_extended"] = _search_sql(SEARCH_QUERY_EXTENDED)

# every query against every row; terms become LIKE patterns, groups are cut at ' | '
ORACLE["search_many"] = with_(S.WIKI_PAGES, S.LISTING) + r""",
w AS (SELECT page_id::BIGINT AS query_id, page_id, space_key, list_filter(string_split(title, ' '), lambda x: length(x) > 2) AS ws FROM wiki_pages),
ab AS (SELECT *, coalesce(ws[1], '') AS a, coalesce(ws[2], '') AS b FROM w),
q AS (SELECT query_id, CASE query_id % 8
        WHEN 0 THEN substr(lower(a), 1, 1) || substr(lower(a), 3, 1) || substr(lower(a), 5, 2) || ' ' || chr(39) || lower(b)
        WHEN 1 THEN '^' || space_key || ' ' || lower(a)
        WHEN 2 THEN chr(39) || lower(a) || ' | ' || chr(39) || lower(b) || ' !' || page_id
        WHEN 3 THEN page_id || '$ ' || a
        WHEN 4 THEN a || ' | ' || b || ' | qqq ' || substr(page_id, 1, 1)
        WHEN 5 THEN lower(substr(a, 1, 3)) || lower(substr(b, 1, 3))
        WHEN 6 THEN '!' || lower(substr(a, 1, 2)) || ' ' || chr(39) || substr(lower(b), 1, 3) || ' ' || page_id
        ELSE '| ' || a || ' |' END AS query FROM ab),
n AS (SELECT query_id, regexp_replace(' ' || query || ' ', '( +\|)+ +', ' | ', 'g') AS qn FROM q),
g AS (SELECT query_id, unnest(list_filter(string_split(replace(regexp_replace(regexp_replace(qn, '^ \| ', ''), ' \| $', ''), ' | ', chr(1)), ' '),
                                          lambda x: x <> '')) AS grp FROM n),
gn AS (SELECT query_id, grp, row_number() OVER (PARTITION BY query_id) AS no FROM g),
t0 AS (SELECT query_id, no, unnest(string_split(grp, chr(1))) AS tok FROM gn),
t1 AS (SELECT *, starts_with(tok, '!') AS neg, regexp_replace(tok, '^!', '') AS r1 FROM t0),
t2 AS (SELECT *, starts_with(r1, chr(39)) AS quoted, regexp_replace(r1, '^\x27', '') AS r2 FROM t1),
t3 AS (SELECT *, starts_with(r2, '^') AS head, regexp_replace(r2, '^\^', '') AS r3 FROM t2),
t4 AS (SELECT *, length(r3) > 1 AND ends_with(r3, '$') AS tail, CASE WHEN length(r3) > 1 THEN regexp_replace(r3, '\$$', '') ELSE r3 END AS txt FROM t3),
pat AS (SELECT *, neg OR quoted OR head OR tail AS exact, list_transform(string_split(txt, ''), lambda c: CASE WHEN c IN ('!', '%', '_') THEN '!' || c ELSE c END) AS cs FROM t4),
pt AS (SELECT query_id, no, neg, txt = lower(txt) AS fold,
         CASE WHEN exact THEN (CASE WHEN head THEN '' ELSE '%' END) || array_to_string(cs, '') || (CASE WHEN tail THEN '' ELSE '%' END)
              ELSE '%' || array_to_string(cs, '%') || '%' END AS p FROM pat),
shown AS (SELECT row_number() OVER () AS rid, *, concat_ws(' | ', space_key, space_name, title, page_id) AS row_txt FROM listing),
hit AS (SELECT query_id, rid, no, bool_or((CASE WHEN fold THEN lower(row_txt) LIKE p ESCAPE '!' ELSE row_txt LIKE p ESCAPE '!' END) <> neg) AS ok
        FROM pt, shown GROUP BY query_id, rid, no),
yes AS (SELECT query_id, rid FROM hit GROUP BY query_id, rid HAVING bool_and(ok)
        UNION ALL SELECT query_id, rid FROM q, shown WHERE query_id NOT IN (SELECT query_id FROM t0))
SELECT y.query_id, r.instance, r.ordinal, r.page_id, r.title, r.space_key FROM yes y JOIN shown r ON r.rid = y.rid"""

ORACLE["clean_edit"] = with_(S.WIKI_PAGES, REQUESTS) + f"""
SELECT request_seq, {S.clean_edit_expr("content")} AS cleaned FROM requests WHERE action = 'edit'"""

# --- document transforms ---------------------------------------------------------------
from .oracle_html import html_fixture_sql, html_to_markdown_sql  # noqa: E402

ORACLE["html_to_markdown"] = "WITH " + S.WIKI_PAGES + ",\n" + html_to_markdown_sql(html_fixture_sql()) + """
SELECT page_id, markdown FROM md_docs"""

ORACLE["html_tokens"] = "WITH " + S.WIKI_PAGES + ",\n" + html_to_markdown_sql(html_fixture_sql()) + """
SELECT t.page_id, count(tok) AS n_tokens,
       sum(CASE WHEN kind = 'open' THEN 1 ELSE 0 END)::BIGINT AS n_open,
       sum(CASE WHEN kind = 'close' THEN 1 ELSE 0 END)::BIGINT AS n_close,
       sum(CASE WHEN kind = 'text' THEN 1 ELSE 0 END)::BIGINT AS n_text,
       coalesce(string_agg(tok, '' ORDER BY pos), '') = coalesce(any_value(s.html), '') AS lossless
FROM tk2 t JOIN src s ON s.page_id = t.page_id GROUP BY t.page_id"""

from .oracle_md import markdown_to_html_sql  # noqa: E402

ORACLE["markdown_to_html"] = "WITH " + markdown_to_html_sql(S.MD_SRC) + "\nSELECT doc_id, html FROM html_docs"


# --- requests, lookups, updates ----------------------------------------------------------
from ..operators.requests import ACTIONS, CONTENT_TYPES, SKELETON, URL_ACTIONS  # noqa: E402
from .catalog import LIST_SPACE  # noqa: E402


def _in(vals) -> str:
    return "(" + ", ".join(S.q(v) for v in vals) + ")"


def reasons_sql(r: str = "") -> str:
    p = r + "." if r else ""
    pid = S.page_id_expr(f"{p}url")

    def missing(c):
        return f"({c} IS NULL OR {c} = '')"

    items = [
        f"CASE WHEN {p}action IS NULL OR {p}action NOT IN {_in(ACTIONS)} THEN 'unknown action' END",
        f"CASE WHEN {p}action IN {_in(URL_ACTIONS)} AND {missing(p + 'url')} THEN 'url required' END",
        f"CASE WHEN {p}action IN {_in(URL_ACTIONS)} AND NOT {missing(p + 'url')} AND {missing(pid)} THEN 'no page id in url' END",
        f"CASE WHEN {p}action = 'create' AND {missing(p + 'space_key')} THEN 'space required' END",
        f"CASE WHEN {p}action = 'create' AND {missing(p + 'title')} THEN 'title required' END",
        f"CASE WHEN {p}action IN ('add', 'create') AND {missing(p + 'content')} THEN 'content required' END",
        f"CASE WHEN coalesce({p}content_type, 'markdown') NOT IN {_in(CONTENT_TYPES)} THEN 'bad content_type' END",
    ]
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


ORACLE["validate_requests"] = with_(S.WIKI_PAGES, REQUESTS) + f"""
SELECT request_seq, action, nullif(array_to_string({reasons_sql()}, '; '), '') AS reject_reason FROM requests"""

ORACLE["pages_by_url"] = with_(S.WIKI_PAGES, S.URLS, S.INSTANCES) + f"""
SELECT u.instance, u.url, u.listed_id, u.page_id, coalesce(p.hit, false) AND NOT (u.page_id IS NULL OR u.page_id = '') AS found,
       p.title, CAST(p.version AS VARCHAR) AS version,
       split_part(split_part(split_part(split_part(lower(u.url), '://', 2), '/', 1), '?', 1), '#', 1) <> ''
       AND split_part(split_part(split_part(split_part(lower(u.url), '://', 2), '/', 1), '?', 1), '#', 1)
           <> coalesce(split_part(split_part(lower(i.base_url), '://', 2), '/', 1), '') AS host_mismatch
FROM (SELECT instance, url, page_id AS listed_id, {S.page_id_expr("url")} AS page_id FROM urls) u
LEFT JOIN (SELECT instance, page_id, title, version, true AS hit FROM wiki_pages) p
  ON p.instance = u.instance AND p.page_id = u.page_id
LEFT JOIN instances i ON i.instance = u.instance"""

LOOKUP = """lk AS (
  SELECT instance, space_key, title, arg_min(page_id, ordinal) AS first_page_id, count(*) AS n
  FROM listing GROUP BY instance, space_key, title)"""

ORACLE["pages_by_title"] = with_(S.WIKI_PAGES, S.LISTING, LOOKUP) + """
SELECT k.instance, k.space_key, k.title, k.page_id AS key_page_id, lk.first_page_id AS page_id, coalesce(lk.n, 0) AS n_found
FROM wiki_pages k LEFT JOIN lk ON lk.instance = k.instance AND lk.space_key = k.space_key AND lk.title = k.title"""

_ROOT = "(r.parent_title IS NULL OR r.parent_title = '' OR r.parent_title = 'No Parent')"
PARENTS = f"""parents AS (
  SELECT r.request_seq, r.instance, r.space_key, r.parent_title,
         CASE WHEN {_ROOT} THEN NULL ELSE coalesce(r.parent_id, lk.first_page_id) END AS parent_id,
         CAST(CASE WHEN {_ROOT} THEN 0 ELSE coalesce(lk.n, 0) END AS BIGINT) AS n_matches,
         CASE WHEN {_ROOT} THEN 'root' WHEN lk.first_page_id IS NULL THEN 'missing' ELSE 'found' END AS parent_status
  FROM requests r LEFT JOIN lk ON lk.instance = r.instance AND lk.space_key = r.space_key AND lk.title = r.parent_title
  WHERE r.action = 'create')"""

ORACLE["resolve_parents"] = with_(S.WIKI_PAGES, REQUESTS, S.LISTING, LOOKUP, PARENTS) + "SELECT * FROM parents"

_SK_HEAD, _SK_TAIL = SKELETON.split("{title}")
ORACLE["with_base_url"] = with_(S.WIKI_PAGES, REQUESTS, S.INSTANCES) + """
SELECT r.request_seq, r.instance, i.base_url, CASE WHEN i.base_url IS NULL THEN 'unknown profile' ELSE 'ok' END AS base_status
FROM requests r LEFT JOIN instances i ON i.instance = r.instance"""

ORACLE["requests_from_list"] = f"""
SELECT split_part(line, '|', 1) AS title, CASE WHEN contains(line, '|') THEN split_part(line, '|', 2) ELSE line END AS content,
       'create' AS action, {S.q(LIST_SPACE)} AS space_key, 'markdown' AS content_type
FROM (SELECT 'Page ' || CAST(doc_id AS VARCHAR) || '|' || replace(text, chr(10), '\\n') AS line FROM documents)"""


def _apply_sql(action: str | None, check_version: bool = False, requests: str = "requests", more: str = "") -> str:
    filt = f"AND action = {S.q(action)}" if action else ""
    conflict = ("AND NOT (v.action = 'edit' AND v.base_version IS NOT NULL AND v.base_version <> p.version)"
                if check_version else "")
    chk = f"""{more}val AS (
  SELECT *, {reasons_sql()} AS reasons, {S.page_id_expr("url")} AS page_id_x FROM {requests} WHERE action <> 'create' {filt}),
ok AS (
  SELECT v.*, CASE WHEN v.action = 'edit' THEN {S.clean_edit_expr("content")} ELSE content END AS src
  FROM val v LEFT JOIN (SELECT instance, page_id, version, true AS hit FROM wiki_pages) p
    ON p.instance = v.instance AND p.page_id = v.page_id_x
  WHERE len(v.reasons) = 0 AND p.hit IS NOT NULL {conflict}),
md_src AS (
  SELECT DISTINCT src AS doc_id, src AS md FROM ok
  WHERE (coalesce(content_type, 'markdown') = 'markdown' OR action = 'edit') AND src IS NOT NULL)"""
    from .oracle_md import markdown_to_html_sql
    return "WITH " + S.WIKI_PAGES + ",\n" + REQUESTS + ",\n" + markdown_to_html_sql(chk) + """,
conv AS (
  SELECT ok.* REPLACE (row_number() OVER (PARTITION BY ok.instance, page_id_x
                        ORDER BY ok.request_seq, ok.action, ok.append, ok.content_type, sha256(ok.src)) AS request_seq),
         CASE WHEN coalesce(ok.content_type, 'markdown') = 'markdown' OR ok.action = 'edit'
              THEN coalesce(h.html, '') ELSE ok.content END AS html
  FROM ok LEFT JOIN html_docs h ON h.doc_id = ok.src),
le AS (
  SELECT instance, page_id_x AS page_id, max(CASE WHEN action = 'edit' THEN request_seq END) AS last_edit_seq,
         count(*) AS n_applied, arg_max(html, request_seq) FILTER (WHERE action = 'edit') AS edit_body,
         sum(CASE WHEN action = 'edit' THEN 1 ELSE 0 END) AS n_edits
  FROM conv GROUP BY instance, page_id_x),
live AS (
  SELECT c.* FROM conv c JOIN le ON le.instance = c.instance AND le.page_id = c.page_id_x
  WHERE le.last_edit_seq IS NULL OR c.request_seq > le.last_edit_seq),
ag AS (
  SELECT instance, page_id_x AS page_id,
         string_agg(html, chr(10) ORDER BY request_seq) FILTER (WHERE append) AS appends,
         string_agg(html, chr(10) ORDER BY request_seq DESC) FILTER (WHERE NOT append) AS prepends
  FROM live GROUP BY instance, page_id_x),
applied AS (
  SELECT le.instance, le.page_id, p.title, p.version AS old_version,
         CAST(p.version + le.n_applied AS INTEGER) AS new_version, CAST(le.n_applied AS BIGINT) AS n_applied,
         CAST(le.n_edits AS BIGINT) AS n_edits,
         concat_ws(chr(10), ag.prepends, coalesce(le.edit_body, p.storage_html), ag.appends) AS new_body,
         CAST(CASE WHEN le.n_edits > 0 THEN (length(p.storage_html) - length(replace(p.storage_html, '<ac:', ''))) // 4
              ELSE 0 END AS BIGINT) AS lost_macros
  FROM le LEFT JOIN ag ON ag.instance = le.instance AND ag.page_id = le.page_id
  JOIN wiki_pages p ON p.instance = le.instance AND p.page_id = le.page_id)
"""


ORACLE["apply_edit_buffers"] = with_(S.WIKI_PAGES) + """
SELECT instance, page_id, version AS old_version, version + 1 AS new_version, CAST(1 AS BIGINT) AS n_applied, CAST(1 AS BIGINT) AS n_edits,
       CAST((length(storage_html) - length(replace(storage_html, '<ac:', ''))) // 4 AS BIGINT) AS lost_macros, true AS has_added_line
FROM wiki_pages WHERE pid % 2 = 1"""

ORACLE["apply_requests"] = _apply_sql(None) + "SELECT * FROM applied"
ORACLE["apply_adds"] = _apply_sql("add") + "SELECT * FROM applied"
ORACLE["apply_edits"] = _apply_sql("edit") + "SELECT * FROM applied"
# a third of the conversations write to one page, all turns of a conversation under one number
HOT = """hot_requests AS (
  SELECT * REPLACE (request_seq // 100000 AS request_seq,
                    CASE WHEN request_seq // 100000 % 3 = 0 THEN 'i0' ELSE instance END AS instance,
                    CASE WHEN request_seq // 100000 % 3 = 0 AND url IS NOT NULL
                         THEN 'https://wiki0.example.com/pages/viewpage.action?pageId=0' ELSE url END AS url) FROM requests),
"""
ORACLE["apply_requests_hot"] = _apply_sql(None, requests="hot_requests", more=HOT) + "SELECT * FROM applied"
ORACLE["update_payloads"] = _apply_sql(None) + """
SELECT instance, page_id, to_json({'version': {'number': new_version}, 'title': title, 'type': 'page',
       'body': {'storage': {'value': new_body, 'representation': 'storage'}}})::VARCHAR AS payload FROM applied"""


def _creates_sql() -> str:
    ok = f"""cr AS (
  SELECT r.*, pa.parent_id AS resolved_parent FROM requests r LEFT JOIN parents pa ON pa.request_seq = r.request_seq
  WHERE r.action = 'create' AND len({reasons_sql("r")}) = 0),
md_src AS (
  SELECT request_seq AS doc_id, content AS md FROM cr WHERE coalesce(content_type, 'markdown') = 'markdown' AND content IS NOT NULL)"""
    from .oracle_md import markdown_to_html_sql
    return "WITH " + ",\n".join([S.WIKI_PAGES, REQUESTS, S.LISTING, LOOKUP, PARENTS]) + ",\n" + markdown_to_html_sql(ok) + """,
created AS (
  SELECT cr.request_seq, cr.instance, cr.space_key, cr.title, cr.resolved_parent AS parent_id,
         CASE WHEN coalesce(cr.content_type, 'markdown') = 'markdown' THEN coalesce(h.html, '') ELSE cr.content END AS body,
         CAST(len(string_split(regexp_replace(cr.content, '\\n+$', ''), chr(10))) AS BIGINT) AS n_lines
  FROM cr LEFT JOIN html_docs h ON h.doc_id = cr.request_seq)
"""


ORACLE["apply_creates"] = _creates_sql() + "SELECT * FROM created"
ORACLE["create_payloads"] = _creates_sql() + """
SELECT request_seq, to_json(CASE WHEN coalesce(parent_id, '') <> ''
  THEN {'type': 'page', 'title': title, 'space': {'key': space_key},
        'body': {'storage': {'value': body, 'representation': 'storage'}}, 'ancestors': [{'id': parent_id}]}::JSON
  ELSE {'type': 'page', 'title': title, 'space': {'key': space_key},
        'body': {'storage': {'value': body, 'representation': 'storage'}}}::JSON END)::VARCHAR AS payload FROM created"""

ORACLE["request_rejects"] = with_(S.WIKI_PAGES, REQUESTS) + f""",
val AS (SELECT *, {reasons_sql()} AS reasons, {S.page_id_expr("url")} AS page_id_x FROM requests)
SELECT v.request_seq, v.action,
       array_to_string(CASE WHEN len(v.reasons) = 0 AND v.action <> 'create' AND p.hit IS NULL THEN ['page not found'] ELSE v.reasons END, '; ') AS reject_reason
FROM val v LEFT JOIN (SELECT instance, page_id, true AS hit FROM wiki_pages) p ON p.instance = v.instance AND p.page_id = v.page_id_x
WHERE len(v.reasons) > 0 OR (v.action <> 'create' AND p.hit IS NULL)"""


# --- read / export / edit buffers ---------------------------------------------------------
_PAGE_MD = "WITH " + S.WIKI_PAGES + ",\n" + S.INSTANCES + ",\n" + html_to_markdown_sql(
    "src AS (SELECT page_id, storage_html AS html FROM wiki_pages)")

ORACLE["export_documents"] = _PAGE_MD + f""",
doc AS (
  SELECT p.instance, p.page_id, {S.slug_expr("p.title")} AS file_name,
         {S.header_expr("p.title", "p.space_name", "p.page_id", "p.version", S.page_url_expr("i.base_url", "p.page_id"))}
           || coalesce(m.markdown, '') AS content
  FROM wiki_pages p LEFT JOIN md_docs m ON m.page_id = p.page_id LEFT JOIN instances i ON i.instance = p.instance)
SELECT d.instance, d.page_id, d.file_name, d.content, s.n AS n_same_slug
FROM doc d JOIN (SELECT instance, file_name, count(*) AS n FROM doc GROUP BY instance, file_name) s
  ON s.instance = d.instance AND s.file_name = d.file_name"""

ORACLE["read_pages"] = _PAGE_MD + f"""
SELECT p.instance, p.page_id AS id, p.title, p.space_name AS space, p.space_key, p.version,
       p.storage_html AS html_content, m.markdown AS markdown_content, {S.page_url_expr("i.base_url", "p.page_id")} AS url
FROM wiki_pages p LEFT JOIN md_docs m ON m.page_id = p.page_id LEFT JOIN instances i ON i.instance = p.instance"""

ORACLE["edit_buffers"] = _PAGE_MD + f""",
b AS (
  SELECT p.instance, p.page_id, coalesce(m.markdown, '') AS markdown,
         {S.edit_buffer_expr("p.title", "p.page_id", "p.version", "coalesce(m.markdown, '')")} AS buffer
  FROM wiki_pages p LEFT JOIN md_docs m ON m.page_id = p.page_id)
SELECT instance, page_id, buffer, {S.clean_edit_expr("buffer")} AS cleaned,
       {S.clean_edit_expr("buffer")} = {S.strip_ws("markdown")} AS unchanged
FROM b"""


# --- streaming forms -------------------------------------------------------------------------
ORACLE["stream_listing"] = with_(S.WIKI_PAGES, S.LISTING) + """
SELECT instance, page_id, CASE WHEN title = 'Untitled' THEN title ELSE 'new ' || title END AS title,
       space_key, space_name, ordinal - 10 AS ordinal FROM listing"""

ORACLE["stream_convert"] = "WITH " + html_to_markdown_sql(
    "src AS (SELECT CAST(page_id AS VARCHAR) AS page_id, html FROM pages)") + "\nSELECT page_id, markdown FROM md_docs"


# --- file sources and edit change check --------------------------------------------------------

ORACLE["load_instances"] = with_(S.INSTANCES) + "SELECT instance, base_url FROM instances"

ORACLE["edit_changes"] = "WITH " + S.WIKI_PAGES + ",\n" + REQUESTS + ",\n" + html_to_markdown_sql(
    "src AS (SELECT page_id, storage_html AS html FROM wiki_pages)") + f""",
e AS (SELECT request_seq, instance, content, {S.page_id_expr("url")} AS page_id FROM requests WHERE action = 'edit')
SELECT e.request_seq, e.instance, e.page_id, m.markdown IS NOT NULL AS page_found,
       {S.clean_edit_expr("e.content")} <> {S.strip_ws("coalesce(m.markdown, '')")} AS changed
FROM e LEFT JOIN wiki_pages p ON p.instance = e.instance AND p.page_id = e.page_id
LEFT JOIN md_docs m ON m.page_id = p.page_id"""


# --- SQL functions, side tables, bag union ------------------------------------------------------
from .oracle_html import attr as _html_attr  # noqa: E402

ORACLE["sql_functions"] = with_(S.WIKI_PAGES, S.INSTANCES, S.URLS) + f"""
SELECT p.page_id, {S.slug_expr("p.title")} AS file_name, {S.page_url_expr("i.base_url", "p.page_id")} AS url,
       {S.header_expr("p.title", "p.space_name", "p.page_id", "p.version", S.page_url_expr("i.base_url", "p.page_id"))} AS header,
       {S.page_id_expr("u.url")} AS url_page_id,
       {S.clean_edit_expr(S.header_expr("p.title", "p.space_name", "p.page_id", "p.version", "u.url"))} AS cleaned_header
FROM wiki_pages p JOIN instances i ON p.instance = i.instance JOIN urls u ON u.page_id = p.page_id"""

ORACLE["html_headings"] = "WITH " + S.WIKI_PAGES + ",\n" + html_to_markdown_sql(html_fixture_sql()) + """
SELECT page_id, block_no, b_level AS level, regexp_replace(inline, '\\s*\\n\\s*', ' ', 'g') AS text
FROM bl2 WHERE kind = 'h' AND inline <> ''"""

ORACLE["html_tables"] = "WITH " + S.WIKI_PAGES + ",\n" + html_to_markdown_sql(html_fixture_sql()) + """
SELECT page_id, table_id, row_number() OVER (PARTITION BY page_id, table_id ORDER BY block_no) AS row_no,
       coalesce(has_th, 0) = 1 AS is_header, len(cells) AS n_cells, array_to_string(cells, ' | ') AS cells
FROM bl2 WHERE kind = 'tr' AND len(cells) > 0"""

ORACLE["html_links"] = "WITH " + S.WIKI_PAGES + ",\n" + html_to_markdown_sql(html_fixture_sql()) + f"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM (
  SELECT page_id, pos, {_html_attr("tok", "href")} AS href FROM tk2 WHERE kind = 'open' AND tag = 'a')
WHERE href IS NOT NULL"""

ORACLE["listing_union"] = with_(S.WIKI_PAGES, S.LISTING) + f"""
SELECT {_LISTING_COLS} FROM listing UNION ALL SELECT {_LISTING_COLS} FROM listing"""


# --- roadmap: search by content ---------------------------------------------------------------
from .catalog import CONTENT_QUERY  # noqa: E402


def _content_sql(query: str) -> str:
    where = _where("concat_ws(' | ', p.space_key, p.space_name, p.title, p.page_id, m.markdown)", query)
    return _PAGE_MD + f"""
SELECT p.instance, p.page_id, p.title, p.space_key
FROM wiki_pages p LEFT JOIN md_docs m ON m.page_id = p.page_id WHERE {where}"""


ORACLE["search_content"] = _content_sql(CONTENT_QUERY)

ORACLE["version_diff"] = _apply_sql(None) + """,
pairs AS (SELECT a.instance, a.page_id, p.storage_html AS old_body, a.new_body FROM applied a
          JOIN wiki_pages p ON p.instance = a.instance AND p.page_id = a.page_id),
ol AS (SELECT instance, page_id, line, row_number() OVER (PARTITION BY instance, page_id, line ORDER BY i) AS occ
       FROM (SELECT instance, page_id, parts[i + 1] AS line, i
             FROM (SELECT instance, page_id, parts, unnest(range(len(parts))) AS i
                   FROM (SELECT instance, page_id, string_split(old_body, chr(10)) AS parts FROM pairs)))),
nl AS (SELECT instance, page_id, line, row_number() OVER (PARTITION BY instance, page_id, line ORDER BY i) AS occ
       FROM (SELECT instance, page_id, parts[i + 1] AS line, i
             FROM (SELECT instance, page_id, parts, unnest(range(len(parts))) AS i
                   FROM (SELECT instance, page_id, string_split(new_body, chr(10)) AS parts FROM pairs))))
SELECT coalesce(o.instance, n.instance) AS instance, coalesce(o.page_id, n.page_id) AS page_id,
       CAST(sum(CASE WHEN o.line IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_added,
       CAST(sum(CASE WHEN n.line IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       CAST(sum(CASE WHEN o.line IS NOT NULL AND n.line IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
FROM ol o FULL OUTER JOIN nl n
  ON o.instance = n.instance AND o.page_id = n.page_id AND o.line = n.line AND o.occ = n.occ
GROUP BY 1, 2"""

ORACLE["apply_edits_checked"] = _apply_sql("edit", check_version=True) + "SELECT * FROM applied"

ORACLE["version_conflicts"] = with_(S.WIKI_PAGES, REQUESTS) + f"""
SELECT e.request_seq, e.instance, e.page_id, e.base_version, p.version AS stored_version
FROM (SELECT request_seq, instance, base_version, {S.page_id_expr("url")} AS page_id FROM requests WHERE action = 'edit') e
JOIN wiki_pages p ON p.instance = e.instance AND p.page_id = e.page_id
WHERE e.base_version <> p.version"""

ORACLE["pages_in_space_stored"] = ORACLE["pages_in_space"]

# Every document a template, and the creates' template names over all of them.
DOCUMENT_TEMPLATES = """tpl AS (
  SELECT 'tpl_' || CAST(doc_id AS VARCHAR) AS name, '# Notes - [Date]' || chr(10) || chr(10) || '## [Title]' || chr(10) || chr(10) || md AS body
  FROM md_src),
creates AS (
  SELECT request_seq, title, 'tpl_' || CASE WHEN request_seq // 100000 % 3 = 0 THEN 'xx'
         ELSE CAST(request_seq // 100000 % (SELECT count(*) FROM documents) AS VARCHAR) END AS template
  FROM requests WHERE action = 'create'),
rendered AS (
  SELECT r.request_seq, r.title, r.template, t.body IS NOT NULL AS template_found,
         regexp_replace(coalesce(t.body, """ + S.q(_SK_HEAD) + """ || r.title || """ + S.q(_SK_TAIL) + """), '\\n+$', '') AS b
  FROM creates r LEFT JOIN tpl t ON t.name = r.template)"""

ORACLE["load_document_templates"] = with_(S.WIKI_PAGES, REQUESTS, S.MD_SRC, DOCUMENT_TEMPLATES) + "SELECT name, body || chr(10) AS body FROM tpl"

ORACLE["render_document_templates"] = with_(S.WIKI_PAGES, REQUESTS, S.MD_SRC, DOCUMENT_TEMPLATES) + """
SELECT request_seq, template, template_found, b AS body, CAST(len(string_split(b, chr(10))) AS BIGINT) AS n_lines FROM rendered"""

ORACLE["fill_document_templates"] = with_(S.WIKI_PAGES, REQUESTS, S.MD_SRC, DOCUMENT_TEMPLATES) + """
SELECT request_seq, replace(replace(b, '[Date]', strftime(DATE '2025-01-01' + CAST(request_seq % 365 AS INTEGER), '%Y-%m-%d')),
                            '[Title]', title) AS body FROM rendered"""

from .catalog import FIRST_N  # noqa: E402

ORACLE["first_pages"] = with_(S.WIKI_PAGES, S.LISTING) + f"""
SELECT {_LISTING_COLS}, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY instance, space_key ORDER BY ordinal) AS INTEGER) AS rank FROM listing)
WHERE rank <= {FIRST_N}"""


VERSIONS = """versions AS (
  SELECT instance, page_id, version, title, storage_html, 'stored' AS change FROM wiki_pages
  UNION ALL
  SELECT 'i' || n % 2, n::VARCHAR, (doc_id + 10)::INTEGER, 'Draft ' || doc_id,
         '<p>' || replace(coalesce(text, ''), chr(10), '</p>' || chr(10) || '<p>') || '</p>', 'update'
  FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % (SELECT count(*) FROM pages) END AS n FROM documents)),
asks AS (
  SELECT conv_id * 100000 + turn AS request_seq, 'i' || n % 2 AS instance, n::VARCHAR AS page_id,
         CASE WHEN turn % 6 <> 5 THEN v END::INTEGER AS as_of
  FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id % (SELECT count(*) FROM pages) END AS n,
               (conv_id * 31 + turn * 17) % (20 + (SELECT count(*) FROM documents)) AS v FROM conversations)),
found AS (
  SELECT a.*, v.version AS found_version, v.title, v.storage_html
  FROM (SELECT *, coalesce(as_of, 2147483647) AS upto FROM asks) a
  ASOF LEFT JOIN versions v ON a.instance = v.instance AND a.page_id = v.page_id AND a.upto >= v.version)"""

ORACLE["page_history"] = with_(S.WIKI_PAGES, VERSIONS) + """
SELECT instance, page_id, version, row_number() OVER w - 1 AS position, title, change, lag(version) OVER w AS previous_version,
       length(storage_html) AS n_chars, length(storage_html) - lag(length(storage_html)) OVER w AS chars_added,
       storage_html IS DISTINCT FROM lag(storage_html) OVER w AS body_changed, lead(version) OVER w IS NULL AS is_latest
FROM versions WINDOW w AS (PARTITION BY instance, page_id ORDER BY version)"""
ORACLE["page_as_of"] = with_(S.WIKI_PAGES, VERSIONS) + """
SELECT request_seq, instance, page_id, as_of, found_version, title, sha256(storage_html) AS body_sha256 FROM found"""
ORACLE["restore_versions"] = with_(S.WIKI_PAGES, VERSIONS) + """,
turns AS (
  SELECT f.*, n.newest, coalesce(lag(found_version) OVER (PARTITION BY f.instance, f.page_id ORDER BY request_seq), newest) AS state
  FROM found f JOIN (SELECT instance, page_id, max(version) AS newest FROM versions GROUP BY ALL) n USING (instance, page_id)
  WHERE found_version IS NOT NULL AND request_seq % 4 = 0)
SELECT instance, page_id, (newest + row_number() OVER (PARTITION BY instance, page_id ORDER BY request_seq))::INTEGER AS version,
       title, sha256(storage_html) AS body_sha256
FROM turns WHERE found_version <> state"""
ORACLE["current_pages"] = with_(S.WIKI_PAGES, VERSIONS) + """
SELECT instance, page_id, version, title, change, sha256(storage_html) AS body_sha256 FROM versions
QUALIFY version = max(version) OVER (PARTITION BY instance, page_id)"""
ORACLE["dry_run"] = _apply_sql(None) + """
SELECT a.instance, a.page_id, old_version, new_version, lost_macros,
       (len(string_split(new_body, chr(10))) - len(string_split(storage_html, chr(10))))::BIGINT AS net_lines,
       sha256(new_body) AS rebuilt_sha256, true AS exact, sha256(storage_html) AS backup_sha256
FROM applied a JOIN wiki_pages p ON p.instance = a.instance AND p.page_id = a.page_id"""

# The three template operators over every document; the twins named after documents read files.
ORACLE["load_templates"] = with_(S.WIKI_PAGES, REQUESTS, S.MD_SRC, DOCUMENT_TEMPLATES) + "SELECT name, body FROM tpl"
ORACLE["render_templates"] = ORACLE["render_document_templates"]
ORACLE["fill_templates"] = ORACLE["fill_document_templates"]

SELECTED = """selectors AS (
  SELECT DISTINCT 's/' || instance || '/' || space_key AS selector_id, instance, 'space' AS select_by, space_key AS select_value,
         'Note to **' || space_key || '**' AS content, 'markdown' AS content_type, true AS append FROM wiki_pages
  UNION ALL
  SELECT 'p/' || page_id, instance, CASE WHEN pid % 16 = 0 THEN 'search' ELSE 'list' END,
         CASE WHEN pid % 16 = 0 THEN lower(coalesce(list_filter(string_split(title, ' '), lambda x: length(x) > 2)[1], 'qqq'))
              ELSE page_id || ', ' || (pid + 2) || ', ' || (pid + 900000000) END,
         '<p>see ' || page_id || '</p>', 'html', pid % 8 = 0
  FROM wiki_pages WHERE pid % 4 = 0),
firsts AS (SELECT instance, page_id, min(ordinal) AS ordinal FROM listing GROUP BY ALL),
picked AS (
  SELECT s.selector_id, l.instance, l.page_id, l.ordinal FROM selectors s JOIN listing l
    ON s.instance = l.instance AND (s.select_by = 'space' AND s.select_value = l.space_key
       OR s.select_by = 'search' AND contains(lower(concat_ws(' | ', l.space_key, l.space_name, l.title, l.page_id)), s.select_value))
  UNION ALL
  SELECT s.selector_id, s.instance, s.page_id, f.ordinal
  FROM (SELECT *, trim(unnest(string_split(select_value, ','))) AS page_id FROM selectors WHERE select_by = 'list') s
  LEFT JOIN firsts f ON f.instance = s.instance AND f.page_id = s.page_id),
once AS (SELECT selector_id, instance, page_id, min(ordinal) AS ordinal FROM picked GROUP BY ALL),
expanded AS (
  SELECT row_number() OVER (ORDER BY selector_id, ordinal NULLS FIRST, o.page_id, o.instance) - 1 AS request_seq, o.selector_id, o.instance,
         rtrim(i.base_url, '/') || '/pages/viewpage.action?pageId=' || o.page_id AS url, s.content, s.content_type, s.append,
         'add' AS action, o.page_id AS target, NULL::INTEGER AS base_version, NULL::VARCHAR AS space_key, NULL::VARCHAR AS title
  FROM once o JOIN selectors s USING (selector_id) JOIN instances i ON i.instance = o.instance)"""
ORACLE["expand_requests"] = with_(S.WIKI_PAGES, S.INSTANCES, S.LISTING, SELECTED) + """
SELECT request_seq, selector_id, instance, url, content, content_type, append FROM expanded"""
ORACLE["apply_selected"] = _apply_sql(None, requests="expanded", more=",\n".join([S.INSTANCES, S.LISTING, SELECTED]) + ",\n") + """
SELECT instance, page_id, old_version, new_version, n_applied, sha256(new_body) AS body_sha256 FROM applied"""

ORACLE["export_space"] = ORACLE["export_documents"].split("SELECT d.instance")[0] + """,
spaced AS (SELECT doc.*, p.space_key FROM doc JOIN wiki_pages p ON p.instance = doc.instance AND p.page_id = doc.page_id)
SELECT instance, space_key, file_name, page_id, strlen(content)::BIGINT AS n_bytes, sha256(content) AS sha256, true AS intact
FROM spaced QUALIFY page_id = max(page_id) OVER (PARTITION BY instance, space_key, file_name)"""

# offset by offset: every item of every response is a row
CAPTURED = """captured AS (
  SELECT instance, 1 AS capture, page_id, ordinal, ordinal // 100 AS resp FROM listing
  UNION ALL
  SELECT instance, 2, page_id, CASE WHEN ordinal // 100 % 3 = 1 THEN ordinal - 10 ELSE ordinal END, ordinal // 100
  FROM listing WHERE ordinal >= 100),
spots AS (SELECT instance, capture, ordinal, count(*) AS depth FROM captured GROUP BY ALL),
line AS (
  SELECT *, lag(ordinal) OVER w AS before, lag(depth) OVER w AS last_depth FROM spots WINDOW w AS (PARTITION BY instance, capture ORDER BY ordinal))"""
ORACLE["listing_coverage"] = with_(S.WIKI_PAGES, S.LISTING, CAPTURED) + """
SELECT instance, 'page' AS kind, CAST(NULL AS VARCHAR) AS space_key, CAST(capture AS BIGINT) AS capture, r.n_responses, r.n_items,
       min(ordinal) AS first_offset, max(ordinal) + 1 AS end_offset, count(*) AS covered,
       count(*) FILTER (WHERE ordinal > before + 1) AS n_gaps, coalesce(sum(ordinal - before - 1) FILTER (WHERE ordinal > before + 1), 0)::BIGINT AS gap_items,
       count(*) FILTER (WHERE depth >= 2 AND (before IS NULL OR ordinal > before + 1 OR last_depth < 2)) AS n_overlaps, sum(depth - 1)::BIGINT AS extra_items
FROM line JOIN (SELECT instance, capture, count(DISTINCT resp) AS n_responses, count(*) AS n_items FROM captured GROUP BY ALL) r USING (instance, capture)
GROUP BY instance, capture, r.n_responses, r.n_items"""
ORACLE["listing_moves"] = with_(S.WIKI_PAGES, S.LISTING, CAPTURED) + """,
f AS (SELECT instance, capture, page_id, min(ordinal) AS o FROM captured GROUP BY ALL),
m AS (SELECT coalesce(a.instance, b.instance) AS instance, a.o AS was, b.o AS now
      FROM (SELECT * FROM f WHERE capture = 1) a FULL JOIN (SELECT * FROM f WHERE capture = 2) b ON a.instance = b.instance AND a.page_id = b.page_id)
SELECT instance, 1 AS capture, 2 AS next_capture, count(*) FILTER (WHERE was = now) AS n_kept, count(*) FILTER (WHERE was <> now) AS n_moved,
       count(*) FILTER (WHERE was IS NULL) AS n_added, count(*) FILTER (WHERE now IS NULL) AS n_removed
FROM m WHERE instance IN (SELECT instance FROM f WHERE capture = 2) GROUP BY instance"""
