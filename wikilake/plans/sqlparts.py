"""DuckDB SQL pieces for the oracle queries (independent formulations, RE2 regexes).

The oracle side restates each rule with DuckDB string and list functions. Views that
derive wiki tables from the driver's tables are CTEs, so each oracle text is one
self-contained SELECT.
"""

from __future__ import annotations

# The character references that occur in the checked tables and fixtures.
NAMED_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"),
    ("&eacute;", "\u00e9"), ("&rarr;", "\u2192"), ("&NotEqualTilde;", "\u2242\u0338"), ("&uuml;", "\u00fc"), ("&hellip;", "\u2026"),
    ("&mdash;", "\u2014"), ("&ndash;", "\u2013"), ("&reg;", "\u00ae"), ("&euro;", "\u20ac"),
]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def dec(x: str) -> str:
    """Entity decoding, one pass over pieces (same contract as the Spark side)."""
    pieces = "regexp_extract_all(" + x + r", '&[A-Za-z][A-Za-z0-9]+;|&#[0-9]+;|&#[xX][0-9a-fA-F]+;|[^&]+|&')"
    cp = ("(CASE WHEN substr(p, 3, 1) IN ('x', 'X') THEN TRY_CAST('0x' || substr(p, 4, length(p) - 4) AS BIGINT) "
          "ELSE TRY_CAST(substr(p, 3, length(p) - 3) AS BIGINT) END)")
    named = "CASE p " + " ".join(f"WHEN {q(n)} THEN {q(c)}" for n, c in NAMED_ENTITIES + [("&amp;", "&")]) + " ELSE p END"
    one = (f"CASE WHEN starts_with(p, '&#') THEN CASE WHEN {cp} BETWEEN 1 AND 1114111 AND NOT ({cp} BETWEEN 55296 AND 57343) "
           f"THEN chr(CAST({cp} AS INTEGER)) ELSE p END ELSE {named} END")
    return f"(CASE WHEN contains({x}, '&') THEN array_to_string(list_transform({pieces}, lambda p: {one}), '') ELSE {x} END)"


def strip_ws(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[ \\t\\n\\r\\x0B\\f]+', ''), '[ \\t\\n\\r\\x0B\\f]+$', '')"


WIKI_PAGES = f"""wiki_pages AS (
  SELECT 'i' || CAST(page_id % 2 AS VARCHAR) AS instance,
         CAST(page_id AS VARCHAR) AS page_id,
         {dec("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")} AS title,
         upper(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]+)', 1)) AS space_key,
         'Space ' || upper(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]+)', 1)) AS space_name,
         CAST(page_id % 5 + 1 AS INTEGER) AS version,
         html AS storage_html,
         page_id AS pid
  FROM pages)"""

INSTANCES = """instances AS (
  SELECT DISTINCT 'i' || CAST(page_id % 2 AS VARCHAR) AS instance,
         'https://wiki' || CAST(page_id % 2 AS VARCHAR) || '.example.com' || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END AS base_url
  FROM pages)"""

URLS = """urls AS (
  SELECT instance, page_id, pid,
    CASE pid % 6
      WHEN 0 THEN b || '/pages/viewpage.action?pageId=' || page_id
      WHEN 1 THEN b || '/spaces/' || space_key || '/pages/' || page_id || '/' || replace(title, ' ', '+')
      WHEN 2 THEN b || '/display/' || space_key || '/' || replace(title, ' ', '+')
      WHEN 3 THEN b || '/pages/viewpage.action?src=nav&pageId=' || page_id
      WHEN 4 THEN b || '/pages/viewpage.action?xpageId=' || page_id
      ELSE 'https://mirror' || CAST(pid % 2 AS VARCHAR) || '.example.com/spaces/' || space_key || '/pages/' || page_id
           || '/x?focusedCommentId=7#comment-7' END AS url
  FROM (SELECT *, 'https://wiki' || CAST(pid % 2 AS VARCHAR) || '.example.com' AS b FROM wiki_pages))"""

# The listing as the derived responses state it, item by item (no JSON round trip).
LISTING = """listing AS (
  SELECT instance,
         CAST(floor(pid / 2 / 100) * 100 AS INTEGER) AS resp_start,
         CAST(floor(pid / 2) - floor(pid / 2 / 100) * 100 AS INTEGER) AS item_pos,
         CAST(floor(pid / 2) AS BIGINT) AS ordinal,
         page_id,
         CASE WHEN pid % 17 = 0 THEN 'Untitled' ELSE title END AS title,
         CASE WHEN pid % 19 = 0 THEN 'UNKNOWN' ELSE space_key END AS space_key,
         CASE WHEN pid % 19 = 0 THEN 'Unknown Space' ELSE space_name END AS space_name,
         CAST(NULL AS VARCHAR) AS req_space_key
  FROM wiki_pages)"""


def page_id_expr(u: str) -> str:
    """P1 restated with list functions: split the URL step by step."""
    clean = f"regexp_replace(regexp_replace({u}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', '')"
    no_scheme = f"regexp_replace({clean}, '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
    no_net = f"(CASE WHEN starts_with({no_scheme}, '//') THEN regexp_replace({no_scheme}, '^//[^/?#]*', '') ELSE {no_scheme} END)"
    no_frag = f"split_part({no_net}, '#', 1)"
    query = f"(CASE WHEN contains({no_frag}, '?') THEN substr({no_frag}, strpos({no_frag}, '?') + 1) ELSE '' END)"
    path0 = f"split_part({no_frag}, '?', 1)"
    last_slash = f"(length({path0}) - strpos(reverse({path0}), '/') + 1)"
    path = (f"(CASE WHEN strpos(reverse({path0}), '/') = 0 THEN split_part({path0}, ';', 1) "
            f"WHEN strpos(substr({path0}, {last_slash}), ';') > 0 "
            f"THEN substr({path0}, 1, {last_slash} + strpos(substr({path0}, {last_slash}), ';') - 2) ELSE {path0} END)")
    hit = f"list_filter(string_split({query}, '&'), lambda x: starts_with(x, 'pageId='))[1]"
    segs = f"string_split({path}, '/')"
    first_pages = f"list_position({segs}, 'pages')"
    from_path = f"list_filter({segs}, lambda s, i: {first_pages} IS NOT NULL AND i > {first_pages} AND regexp_full_match(s, '[0-9]+'))[1]"
    return (f"(CASE WHEN {u} IS NULL OR {u} = '' THEN NULL "
            f"WHEN {hit} IS NOT NULL THEN string_split({hit}, '=')[2] ELSE {from_path} END)")


def page_url_expr(base: str, pid: str) -> str:
    return f"(regexp_replace({base}, '/+$', '') || '/pages/viewpage.action?pageId=' || {pid})"


def slug_expr(t: str) -> str:
    return (f"(regexp_replace(replace(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ', '-'), "
            f"'[^a-z0-9-]', '', 'g') || '.md')")


def header_expr(title: str, space: str, pid: str, version: str, url: str) -> str:
    return (f"('# ' || {title} || chr(10) || chr(10) || '**Space:** ' || {space} || '  ' || chr(10) || "
            f"'**Page ID:** ' || {pid} || '  ' || chr(10) || '**Version:** ' || CAST({version} AS VARCHAR) || '  ' || chr(10) || "
            f"'**URL:** ' || {url} || chr(10) || chr(10) || '---' || chr(10) || chr(10))")


EDIT_NOTE_SQL = q("<!-- Edit the content below. Lines starting with <!-- are comments and will be ignored -->")


def edit_buffer_expr(title: str, pid: str, version: str, md: str) -> str:
    return (f"('# ' || {title} || chr(10) || chr(10) || {EDIT_NOTE_SQL} || chr(10) || "
            f"'<!-- Page ID: ' || {pid} || ', Version: ' || CAST({version} AS VARCHAR) || ' -->' || chr(10) || chr(10) || {md})")


def clean_edit_expr(x: str) -> str:
    kept = f"list_filter(string_split({x}, chr(10)), lambda l: NOT (starts_with(l, '<!--') AND contains(l, '-->')))"
    first = f"coalesce(list_position(list_transform({kept}, lambda l: starts_with(l, '# ')), true), 0)"
    body = f"list_filter({kept}, lambda l, i: i <> {first})"
    return strip_ws(f"array_to_string({body}, chr(10))")


# Fixed value of the derived data: what every sixteenth document line stands after.
MD_ODD = ("**use `x*y` now** [`code`](http://u/a_b_(c)) **bold *it* x** __s__ _e_ snake_case *a **b** c* ![p_q](/i_j.png \"T\")\n\n"
          "<div class=\"n\">raw *kept*</div>\n\n| a \\| b | `c|d` |\n| --- | --- |\n| 1 | 2 |\n\n~~~~ md\n```\n~~~\n# kept\n~~~~ no end\n~~~~~  \n``` a `b`\n\n"
          "1. one\n\n2. two\n   more\n\n    para *of* two\n\n    > quoted\n    > twice\n\n    ```py\n      code <x>\n    ```\n\n    - inner\n\n    - last\n"
          "        1. deep\n3. three\n4. four\n\n- other\n\nend\n\n    not listed\n\n* a\n\n        far\n\n")
MD_SRC = """md_src AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
    CASE (i - 1) % 8
      WHEN 0 THEN '# ' || line
      WHEN 1 THEN CASE WHEN (i - 1) % 16 = 1 THEN """ + q(MD_ODD) + """ || line ELSE line END
      WHEN 2 THEN chr(10) || '- ' || line
      WHEN 3 THEN '    1. ' || line
      WHEN 4 THEN '> ' || line
      WHEN 5 THEN '```' || chr(10) || line || chr(10) || '```'
      WHEN 6 THEN chr(10) || '---' || chr(10) || line
      ELSE chr(10) || '| h | n |' || chr(10) || '| --- | :---: |' || chr(10) || '| ' || line || ' | ' || CAST(i - 1 AS VARCHAR) || ' |' END),
    chr(10)) AS md
  FROM documents)"""
