"""DuckDB twin of the HTML → markdown job (same contract, written as SQL windows)."""

from __future__ import annotations

from .sqlparts import dec, q

# Fixed values, stated here on their own: block and inline tags of the contract.
BLOCK_TAGS = ("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
              "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody tfoot thead title tr ul").split()
INLINE_TAGS = ["b", "strong", "i", "em", "code"]

TOKEN_RE2 = (r"(?is)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
             r"""|<[/!?A-Za-z](?:[^"'<>]+|"[^"]*"|'[^']*')*>|[^<]+|<""")


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def attr(tok: str, name: str) -> str:
    pat = q(r"(?i)\s" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    val = f"(regexp_extract({tok}, {pat}, 1) || regexp_extract({tok}, {pat}, 2) || regexp_extract({tok}, {pat}, 3))"
    return f"(CASE WHEN regexp_matches({tok}, {pat}) THEN {dec(val)} END)"


def render_inline(x: str) -> str:
    y = f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"
    for _ in range(2):
        for a, b in ((3, 4), (5, 6)):
            y = f"regexp_replace({y}, '\\x0{a}( ?)\\x0{b}', '\\1', 'g')"
    y = f"regexp_replace(regexp_replace({y}, '([\\x03\\x05]+) +', ' \\1', 'g'), ' +([\\x04\\x06]+)', '\\1 ', 'g')"
    y = f"replace(replace(replace(replace({y}, chr(3), '**'), chr(4), '**'), chr(5), '*'), chr(6), '*')"
    y = f"regexp_replace({y}, ' {{2,}}', ' ', 'g')"
    y = f"regexp_replace({y}, ' ?' || chr(1) || ' ?', '  ' || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({y}, '^[ \\t\\n\\r\\f]+', ''), '[ \\t\\n\\r\\f]+$', '')"


def html_to_markdown_sql(src_cte: str) -> str:
    """CTE chain ending in ``md_docs(page_id, markdown)``; ``src_cte`` defines src(page_id, html)."""
    mark_case = ("CASE WHEN tag = 'code' THEN '`' WHEN tag IN ('b', 'strong') THEN CASE WHEN open_ok THEN chr(3) ELSE chr(4) END "
                 "ELSE CASE WHEN open_ok THEN chr(5) ELSE chr(6) END END")
    clean = lambda x: f"regexp_replace({x}, '[\\x01-\\x06]', '', 'g')"
    href = attr("tok", "href")
    title = attr("tok", "title")
    return f"""{src_cte},
tk0 AS (
  SELECT page_id, toks, unnest(range(greatest(coalesce(len(toks), 0), 1))) AS i
  FROM (SELECT page_id, regexp_extract_all(html, {q(TOKEN_RE2)}) AS toks FROM src)),
tk1 AS (
  SELECT page_id, CASE WHEN coalesce(len(toks), 0) = 0 THEN 0 ELSE i END AS pos, toks[i + 1] AS tok FROM tk0),
tk2 AS (
  SELECT page_id, pos, tok, kind,
         CASE WHEN kind IN ('open', 'close') THEN CASE lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:_-]*)', 1)) WHEN 'ac:plain-text-body' THEN 'pre'
              ELSE lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:_-]*)', 1)) END ELSE '' END AS tag
  FROM (SELECT *, CASE WHEN tok IS NULL THEN 'none'
         WHEN NOT starts_with(tok, '<') OR tok = '<' THEN 'text'
         WHEN starts_with(tok, '<!--') THEN 'comment'
         WHEN starts_with(tok, '<![CDATA[') THEN 'cdata'
         WHEN starts_with(tok, '<!') OR starts_with(tok, '<?') THEN 'decl'
         WHEN (starts_with(lower(substr(tok, 1, 10)), '<script') OR starts_with(lower(substr(tok, 1, 10)), '<style'))
              AND contains(tok, '</') THEN 'skip'
         WHEN starts_with(tok, '</') THEN 'close' ELSE 'open' END AS kind FROM tk1)),
tk3 AS (
  SELECT *,
    sum(CASE WHEN kind = 'open' AND tag = 'pre' THEN 1 WHEN kind = 'close' AND tag = 'pre' THEN -1 ELSE 0 END) OVER w AS pre_s,
    sum(CASE WHEN kind = 'open' AND tag = 'ul' THEN 1 WHEN kind = 'close' AND tag = 'ul' THEN -1 ELSE 0 END) OVER w AS ul_s,
    sum(CASE WHEN kind = 'open' AND tag = 'ol' THEN 1 WHEN kind = 'close' AND tag = 'ol' THEN -1 ELSE 0 END) OVER w AS ol_s,
    sum(CASE WHEN kind = 'open' AND tag = 'blockquote' THEN 1 WHEN kind = 'close' AND tag = 'blockquote' THEN -1 ELSE 0 END) OVER w AS bq_s,
    sum(CASE WHEN kind = 'open' AND tag = 'code' THEN 1 WHEN kind = 'close' AND tag = 'code' THEN -1 ELSE 0 END) OVER w AS code_s,
    sum(CASE WHEN kind = 'open' AND tag = 'table' THEN 1 WHEN kind = 'close' AND tag = 'table' THEN -1 ELSE 0 END) OVER w AS tbl_s,
    lead(kind, 1) OVER wo AS k1, lead(tok, 1) OVER wo AS t1, lead(kind, 2) OVER wo AS k2, lead(tag, 2) OVER wo AS g2
  FROM tk2
  WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wo AS (PARTITION BY page_id ORDER BY pos)),
tk4 AS (
  SELECT *,
    CAST(pre_s - least(0, min(pre_s) OVER w) AS BIGINT) AS pre,
    CAST(ul_s - least(0, min(ul_s) OVER w) AS BIGINT) AS ul,
    CAST(ol_s - least(0, min(ol_s) OVER w) AS BIGINT) AS ol,
    CAST(bq_s - least(0, min(bq_s) OVER w) AS BIGINT) AS bq,
    CAST(code_s - least(0, min(code_s) OVER w) AS BIGINT) AS code,
    CAST(tbl_s - least(0, min(tbl_s) OVER w) AS BIGINT) AS tbl
  FROM tk3
  WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tk4b AS (
  SELECT *,
    last_value(CASE WHEN nested THEN NULL WHEN kind = 'open' AND tag IN ('td', 'th') THEN 'cell'
                    WHEN tag IN ('td', 'th', 'tr', 'table', 'thead', 'tbody', 'tfoot') THEN 'out' END IGNORE NULLS) OVER w AS cellctx,
    CAST(sum(CASE WHEN kind = 'open' AND tag = 'tr' AND NOT nested THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tr_run
  FROM (SELECT *, tbl > 1 OR (kind = 'close' AND tag = 'table' AND tbl = 1) AS nested FROM tk4)
  WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tk5 AS (
  SELECT *, last_value(CASE WHEN kind = 'open' AND tag = 'table' AND NOT nested THEN tr_run END IGNORE NULLS)
              OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tbl_base,
         CAST(sum(CAST(is_boundary AS INTEGER)) OVER (PARTITION BY page_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block_no
  FROM (SELECT *, coalesce(cellctx, 'out') = 'cell' AS in_cell, pre > 0 AS in_pre,
          kind IN ('open', 'close') AND tag IN {_in(BLOCK_TAGS)} AND (NOT pre > 0 OR tag = 'pre')
          AND (NOT coalesce(cellctx, 'out') = 'cell' OR (tag IN ('tr', 'table') AND NOT nested)) AS is_boundary
        FROM tk4b)),
tk6 AS (
  SELECT *,
    CASE WHEN inl THEN tag || '#' || CAST(block_no AS VARCHAR)
         WHEN list_open OR li_open THEN 'L#' || CAST(ul + ol AS VARCHAR) ELSE '' END AS gkey
  FROM (SELECT *,
          kind IN ('open', 'close') AND NOT in_pre AND (tag IN {_in(INLINE_TAGS)} OR (tag = 'a' AND (kind = 'close' OR href IS NOT NULL))) AS inl,
          kind = 'open' AND tag IN ('ul', 'ol') AS list_open,
          kind = 'open' AND tag = 'li' AND NOT in_pre AS li_open
        FROM (SELECT *, CASE WHEN kind = 'open' AND tag = 'a' THEN {href} END AS href FROM tk5))),
tk7 AS (
  SELECT *,
    CAST(sum(CASE WHEN inl AND kind = 'open' THEN 1 WHEN inl AND kind = 'close' THEN -1 ELSE 0 END) OVER g AS BIGINT) AS is_s,
    CAST(sum(CAST(li_open AS INTEGER)) OVER g AS BIGINT) AS li_run,
    last_value(CASE WHEN list_open THEN tag END IGNORE NULLS) OVER g AS list_type,
    last_value(CASE WHEN list_open THEN coalesce(TRY_CAST(nullif(regexp_extract(tok, '(?i)\\sstart\\s*=\\s*["'']?([0-9]+)', 1), '') AS INTEGER), 1) END IGNORE NULLS) OVER g AS list_start,
    last_value(CASE WHEN inl AND kind = 'open' AND tag = 'a' THEN href END IGNORE NULLS) OVER g AS a_h,
    last_value(CASE WHEN inl AND kind = 'open' AND tag = 'a' THEN coalesce({title}, chr(1)) END IGNORE NULLS) OVER g AS a_ti,
    last_value(CASE WHEN inl AND kind = 'open' AND tag = 'a'
                    THEN coalesce(k1 = 'text' AND k2 = 'close' AND g2 = 'a' AND {clean(dec("t1"))} = href AND {title} IS NULL, false) END IGNORE NULLS) OVER g AS a_au
  FROM tk6
  WINDOW g AS (PARTITION BY page_id, gkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tk8 AS (
  SELECT *,
    CAST(is_s - least(0, min(is_s) OVER g) AS BIGINT) AS is_c,
    last_value(CASE WHEN list_open THEN li_run END IGNORE NULLS) OVER g AS li_base
  FROM tk7
  WINDOW g AS (PARTITION BY page_id, gkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tk9 AS (
  SELECT *,
    min(is_c) OVER (PARTITION BY page_id, gkey ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS is_after_min,
    lag(is_c, 1) OVER (PARTITION BY page_id, gkey ORDER BY pos) AS is_prev
  FROM tk8),
tk10 AS (
  SELECT page_id, pos, block_no, is_boundary,
    CASE
      WHEN kind IN ('text', 'cdata') THEN replace(CASE WHEN in_pre AND NOT in_cell THEN said
           WHEN code > 0 THEN regexp_replace(said, '[ \\t\\n\\r\\f]+', ' ', 'g')
           ELSE regexp_replace(regexp_replace(said, '[ \\t\\n\\r\\f]+', ' ', 'g'), '([*_])', '\\\\\\1', 'g') END,
           '|', CASE WHEN in_cell THEN chr(92) || '|' ELSE '|' END)
      WHEN kind = 'skip' THEN ''
      WHEN open_ok AND tag = 'a' THEN CASE WHEN a_au THEN '<' ELSE '[' END
      WHEN close_ok AND tag = 'a' THEN CASE WHEN a_au THEN '>' ELSE '](' || a_h ||
           CASE WHEN a_ti <> chr(1) THEN ' "' || a_ti || '"' ELSE '' END || ')' END
      WHEN open_ok OR close_ok THEN CASE WHEN tag <> 'code' AND code > 0 THEN '' ELSE {mark_case} END
      WHEN kind = 'open' AND tag = 'br' THEN CASE WHEN in_pre THEN chr(10) ELSE chr(1) END
      WHEN kind = 'open' AND tag = 'img' THEN '![' || coalesce({attr("tok", "alt")}, '') || '](' || coalesce({attr("tok", "src")}, '') ||
           CASE WHEN {title} IS NOT NULL THEN ' "' || {title} || '"' ELSE '' END || ')'
      WHEN kind = 'open' AND tag IN ('td', 'th') AND in_cell AND NOT nested THEN chr(2)
      WHEN in_cell AND kind IN ('open', 'close') AND tag IN {_in(BLOCK_TAGS + ["td", "th"])} THEN ' '
      ELSE '' END AS frag,
    kind = 'open' AND tag IN ('th') AND in_cell AND NOT nested AS is_th,
    CASE WHEN NOT is_boundary THEN NULL
         WHEN kind = 'open' AND regexp_full_match(tag, 'h[1-6]') THEN 'h'
         WHEN li_open THEN 'li'
         WHEN kind = 'open' AND tag = 'pre' THEN 'pre'
         WHEN kind = 'open' AND tag = 'tr' THEN 'tr'
         WHEN kind = 'open' AND tag = 'hr' THEN 'hr' ELSE 'p' END AS b_kind,
    CASE WHEN is_boundary AND regexp_full_match(tag, 'h[1-6]') THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS b_level,
    CASE WHEN is_boundary THEN ul END AS b_ul, CASE WHEN is_boundary THEN ol END AS b_ol,
    CASE WHEN is_boundary THEN bq END AS b_bq,
    CASE WHEN is_boundary THEN coalesce(list_type, 'ul') END AS b_list_type,
    CASE WHEN is_boundary THEN coalesce(list_start, 1) + li_run - coalesce(li_base, 0) - 1 END AS b_number,
    CASE WHEN is_boundary THEN kind = 'open' AND tag = 'tr' AND NOT nested AND tr_run - coalesce(tbl_base, 0) = 1 END AS b_first_row,
    CASE WHEN is_boundary THEN coalesce(tbl_base, -1) END AS b_table_id
  FROM (SELECT *,
          CASE kind WHEN 'text' THEN {clean(dec("tok"))} WHEN 'cdata' THEN {clean("substr(tok, 10, length(tok) - 12)")} END AS said,
          inl AND kind = 'open' AND is_after_min IS NOT NULL AND is_after_min < is_c AS open_ok,
          inl AND kind = 'close' AND coalesce(is_prev, 0) >= 1 AS close_ok
        FROM tk9)),
bl0 AS (
  SELECT page_id, block_no, coalesce(string_agg(frag, '' ORDER BY pos), '') AS body,
         max(b_kind) AS b_kind, max(b_level) AS b_level, max(b_ul) AS b_ul, max(b_ol) AS b_ol, max(b_bq) AS b_bq,
         max(b_list_type) AS b_list_type, max(b_number) AS b_number, bool_or(b_first_row) AS b_first_row,
         max(b_table_id) AS b_table_id, max(CAST(is_th AS INTEGER)) AS has_th
  FROM tk10 GROUP BY page_id, block_no),
bl1 AS (
  SELECT *,
    {render_inline("body")} AS inline,
    list_transform(string_split(replace(body, chr(1), ' '), chr(2))[2:], lambda c: {render_inline("c")}) AS cells,
    coalesce(b_kind, 'p') AS kind, coalesce(b_ul, 0) AS ul, coalesce(b_ol, 0) AS ol, coalesce(b_bq, 0) AS bq,
    CASE WHEN b_list_type = 'ol' THEN 3 ELSE 2 END AS width
  FROM bl0),
bl2 AS (
  SELECT page_id, block_no, kind, b_level, inline, cells, has_th, bq, ul + ol AS ldepth, coalesce(b_table_id, -1) AS table_id,
    CASE WHEN bq > 0 THEN regexp_replace(rendered, '(?m)^', repeat('> ', bq), 'g') ELSE rendered END AS md
  FROM (SELECT *,
    CASE
      WHEN kind = 'pre' THEN CASE WHEN code_text <> ''
           THEN CASE WHEN ul + ol > 0 THEN regexp_replace(fence || chr(10) || code_text || chr(10) || fence, '(?m)^', repeat(' ', ul * 2 + ol * 3), 'g')
                ELSE fence || chr(10) || code_text || chr(10) || fence END END
      WHEN kind = 'hr' THEN '---'
      WHEN kind = 'tr' THEN CASE WHEN len(cells) > 0 THEN
           CASE WHEN NOT coalesce(b_first_row, false) THEN row_text
                WHEN has_th = 1 THEN row_text || chr(10) || delim
                ELSE blank || chr(10) || delim || chr(10) || row_text END END
      WHEN inline = '' THEN NULL
      WHEN kind = 'h' THEN repeat('#', b_level) || ' ' || regexp_replace(inline, '\\s*\\n\\s*', ' ', 'g')
      WHEN kind = 'li' THEN repeat(' ', greatest(0, ul * 2 + ol * 3 - width)) ||
           CASE WHEN b_list_type = 'ol' THEN CAST(b_number AS VARCHAR) || '.' ELSE '-' END || ' ' ||
           replace(inline, chr(10), chr(10) || repeat(' ', greatest(0, ul * 2 + ol * 3 - width) + 2))
      WHEN ul + ol > 0 THEN repeat(' ', ul * 2 + ol * 3) || inline
      ELSE inline END AS rendered
    FROM (SELECT *,
      '| ' || array_to_string(cells, ' | ') || ' |' AS row_text,
      '| ' || array_to_string(list_transform(range(len(cells)), lambda x: '---'), ' | ') || ' |' AS delim,
      '| ' || array_to_string(list_transform(range(len(cells)), lambda x: ''), ' | ') || ' |' AS blank
      FROM (SELECT *, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(code_text, '`+'), lambda t: length(t))), 0))::INTEGER) AS fence
            FROM (SELECT *, regexp_replace(body, '^\\n', '') AS code_text FROM bl1))))),
bl3 AS (
  SELECT page_id, block_no,
    CASE WHEN p_kind IS NULL THEN ''
         WHEN (kind = 'tr' AND p_kind = 'tr' AND p_table = table_id) OR (ldepth > 0 AND p_ldepth > 0) THEN chr(10)
         WHEN least(bq, p_bq) > 0 THEN chr(10) || rtrim(repeat('> ', least(bq, p_bq))) || chr(10)
         ELSE chr(10) || chr(10) END || md AS piece
  FROM (SELECT *,
    last_value(CASE WHEN md IS NOT NULL THEN kind END IGNORE NULLS) OVER bw AS p_kind,
    last_value(CASE WHEN md IS NOT NULL THEN bq END IGNORE NULLS) OVER bw AS p_bq,
    last_value(CASE WHEN md IS NOT NULL THEN ldepth END IGNORE NULLS) OVER bw AS p_ldepth,
    last_value(CASE WHEN md IS NOT NULL THEN table_id END IGNORE NULLS) OVER bw AS p_table
    FROM bl2
    WINDOW bw AS (PARTITION BY page_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
md_docs AS (
  SELECT page_id,
    regexp_replace(regexp_replace({clean("coalesce(string_agg(piece, '' ORDER BY block_no), '')")}, '^[ \\t\\n\\r\\f]+', ''),
                   '[ \\t\\n\\r\\f]+$', '') AS markdown
  FROM bl3 GROUP BY page_id)"""


# Fixed value of the derived data: what every seventh page gets before its article ends.
ODD_HTML = ("<p>caf&eacute; &rarr; &NotEqualTilde; &#00233; &nosuchname; a<b> x </b>b<b></b><i><b> </b></i>c</p>"
            "<ac:structured-macro ac:name=\"code\"><ac:plain-text-body><![CDATA[x = \"&amp;\"\n```\n# no heading]]></ac:plain-text-body>"
            "</ac:structured-macro><ul><li>code<pre>in\n  list</pre></li></ul><table><tr><th>k|v</th><td><p>one</p><p>two</p>"
            "<ul><li>x</li></ul></td></tr><tr><td>p<table><tr><td>q</td></tr></table>s</td><td><em>t </em>u</td></tr></table>"
            "<p>see <ac:link><ac:plain-text-link-body><![CDATA[this * page]]></ac:plain-text-link-body></ac:link></p></article>")


def html_fixture_sql() -> str:
    """src(page_id, html): the same deterministic rewrites as ``catalog.html_fixture``."""
    h = "storage_html"
    h1 = (f"CASE WHEN pid % 4 = 1 THEN regexp_replace(regexp_replace({h}, '<nav><ul>', '<nav><ol start=\"3\">', 'g'), "
          f"'</ul></nav>', '</ol></nav>', 'g') ELSE {h} END")
    h2 = (f"CASE WHEN pid % 4 = 2 THEN regexp_replace(h1, '<div class=\"ad\">([^<]*)</div>', "
          f"'<blockquote><p>\\1</p><p><em>quoted</em> <code>a_b*c</code></p></blockquote>', 'g') ELSE h1 END")
    h3 = (f"CASE WHEN pid % 4 = 3 THEN regexp_replace(h2, '<footer>', "
          + q("<table><tr><th>Key</th><th>Value</th></tr><tr><td>id</td><td><i>x</i></td></tr>"
              "<tr><td>n</td><td>2</td></tr></table><pre>  a &lt; b\n\n  c</pre>"
              "<img src=\"/i.png\" alt=\"pic\" title=\"T\"><hr><footer>") + ", 'g') ELSE h2 END")
    h4 = (f"CASE WHEN pid % 4 = 0 THEN regexp_replace(h3, '</h1>', "
          + q("</h1><ul><li>one<ul><li>two<ol><li>three</li></ol></li></ul></li>"
              "<li><a href=\"http://x.org\">http://x.org</a></li></ul><table><tr><td>a</td><td>b</td></tr></table>")
          + ", 'g') ELSE h3 END")
    h5 = (f"CASE WHEN pid % 7 = 3 THEN regexp_replace(h4, '</article>', " + q(ODD_HTML) + ", 'g') ELSE h4 END")
    return f"""src AS (
  SELECT page_id, {h5} AS html FROM (
  SELECT *, {h4} AS h4 FROM (
    SELECT *, {h3} AS h3 FROM (SELECT *, {h2} AS h2 FROM (SELECT *, {h1} AS h1 FROM wiki_pages)))))"""
