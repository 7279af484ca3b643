"""DuckDB twin of the markdown → HTML job."""

from __future__ import annotations

from .sqlparts import q

# Fixed values of the markdown contract, stated here on their own (RE2 syntax).
FENCE_RE = r"^ {0,3}(`{3,}|~{3,})(.*)$"
HEADING_RE = r"^#{1,6}"
HR_RE = r"^ {0,3}(?:(?:- {0,2}){3,}|(?:_ {0,2}){3,}|(?:\* {0,2}){3,})$"
QUOTE_RE = r"^ {0,3}>"
LIST_RE = r"^( *)([-*+]|[0-9]+\.)[ \t]+(.*)$"
INDENT_RE = r"^(?: {4}|\t)"
DELIM_RE = r"^ *\|? *:?-+:? *(\| *:?-+:? *)*\|? *$"
BLOCK_TAGS = ("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr iframe "
              "main nav ol p pre section summary table tbody td tfoot th thead tr ul").split()
RAW_RE = r"(?i)^ {0,3}(?:<!--|</?(?:" + "|".join(BLOCK_TAGS) + r")(?:[\s/>]|$))"
ESCAPED = [("\\\\", 16), ("\\*", 17), ("\\_", 18), ("\\`", 19)]
TARGET = r"\(((?:[^()\s]|\([^()\s]*\))*)"
LINKS = [
    (r"!\[([^\]]*)\]" + TARGET + r"\s+\"([^\"]*)\"\)", r'<img alt="\1" src="\2" title="\3" />'),
    (r"!\[([^\]]*)\]" + TARGET + r"\)", r'<img alt="\1" src="\2" />'),
    (r"\[([^\]]+)\]" + TARGET + r"\s+\"([^\"]*)\"\)", r'<a href="\2" title="\3">\1</a>'),
    (r"\[([^\]]+)\]" + TARGET + r"\)", r'<a href="\2">\1</a>'),
    (r"<(https?://[^>\s]+)>", r'<a href="\1">\1</a>'),
]
EMPHASIS = [
    (r"\*\*\*([^*]+)\*\*\*", r"<strong><em>\1</em></strong>"),
    (r"\*\*((?:[^*]|\*[^*]+\*)+)\*\*", r"<strong>\1</strong>"),
    (r"\*([^*\s](?:[^*]*[^*\s])?)\*", r"<em>\1</em>"),
    (r"\b__([^_\s](?:[^_]*[^_\s])?)__\b", r"<strong>\1</strong>"),
    (r"\b_([^_\s](?:[^_]*[^_\s])?)_\b", r"<em>\1</em>"),
]

WS = r"[ \t\n\r\x0B\f]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q('^' + WS + '+')}, ''), {q(WS + '+$')}, '')"


def esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _kept_apart(tag: str, text: str, pattern: str, a: int, b: int, rules: str, render) -> str:
    """Numbered stand-ins for the matches of ``pattern`` while ``rules`` (over ``y_tag``) run."""
    s, y, f = f"s_{tag}", f"y_{tag}", f"f_{tag}"
    hidden = (f"array_to_string(list_transform(string_split_regex({s}, {q(pattern)}), lambda p, i: CASE WHEN i = 1 THEN p "
              f"ELSE chr({a}) || CAST(i - 2 AS VARCHAR) || chr({b}) || p END), '')")
    mark = q(f"\\x{a:02x}([0-9]+)\\x{b:02x}")
    shown = render(f"{f}[CAST(regexp_extract_all(z_{tag}, {mark}, 1)[i - 1] AS INTEGER) + 1]")
    back = (f"array_to_string(list_transform(string_split_regex(z_{tag}, {mark}), lambda p, i: CASE WHEN i = 1 THEN p "
            f"ELSE {shown} || p END), '')")
    body = _let(f, f"regexp_extract_all({s}, {q(pattern)})", _let(y, hidden, _let(f"z_{tag}", rules, back)))
    return _let(s, text, body)


def inline(x: str) -> str:
    s = x
    for seq, n in ESCAPED:
        s = f"replace({s}, {q(seq)}, chr({n}))"
    t = "regexp_replace(y_code, '&(#?[A-Za-z0-9]+;)', chr(20) || '\\1', 'g')"
    t = f"replace({t}, '&', '&amp;')"
    t = f"regexp_replace({t}, '<([A-Za-z/!?])', chr(21) || '\\1', 'g')"
    t = f"replace({t}, '<', '&lt;')"
    t = f"replace(replace({t}, chr(20), '&'), chr(21), '<')"
    for pat, rep in LINKS:
        t = f"regexp_replace({t}, {q(pat)}, {q(rep)}, 'g')"
    e = "y_tag"
    for pat, rep in EMPHASIS:
        e = f"regexp_replace({e}, {q(pat)}, {q(rep)}, 'g')"
    rules = _kept_apart("tag", t, "<[A-Za-z/!?][^<>]*>", 24, 25, e, lambda m: m)
    out = _kept_apart("code", s, "`[^`]+`", 22, 23, rules,
                      lambda m: f"'<code>' || {esc(strip(f'substr({m}, 2, length({m}) - 2)'))} || '</code>'")
    for seq, n in ESCAPED:
        out = f"replace({out}, chr({n}), {q(seq[1])})"
    return out


def para(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    brk = (f"list_transform({lines}, lambda l, i: CASE WHEN i < len({lines}) AND regexp_matches(l, ' {{2,}}$') "
           f"THEN regexp_replace(l, ' +$', '') || '<br />' ELSE l END)")
    return inline(strip(f"array_to_string({brk}, chr(10))"))


def close_from(stack: str, keep: str, sep_last: bool) -> str:
    parts = (f"list_transform(range(length({stack}), {keep}, -1), lambda k: '</li>' || chr(10) || '</' || "
             f"CASE WHEN substr({stack}, k, 1) = 'o' THEN 'ol' ELSE 'ul' END || '>')")
    joined = f"array_to_string({parts}, chr(10))" + ("" if sep_last else " || chr(10)")
    return f"(CASE WHEN length({stack}) > {keep} THEN {joined} ELSE '' END)"


def element_block(x: str) -> str:
    """A loose element as a block inside its item."""
    ls = f"string_split({x}.dedented, chr(10))"
    code = f"'<pre><code>' || {esc(f"array_to_string(list_transform({ls}[2:len({ls}) - 1], lambda l: l || chr(10)), '')")} || '</code></pre>'"
    quote = f"'<blockquote>' || chr(10) || '<p>' || {para(f"regexp_replace({x}.txt, '(?m)^> ?', '', 'g')")} || '</p>' || chr(10) || '</blockquote>'"
    run = f"regexp_extract({ls}[1], {q('^(`{3,}|~{3,})[^`]*$')}, 1)"
    is_code = f"{run} <> '' AND len({ls}) >= 2 AND starts_with({ls}[-1], {run}) AND regexp_full_match({ls}[-1], '`+|~+')"
    return f"(CASE WHEN {is_code} THEN {code} WHEN starts_with({x}.txt, '>') THEN {quote} ELSE '<p>' || coalesce({x}.item_html, '') || '</p>' END || chr(10))"


def list_html(items: str) -> str:
    """One pass over the elements of a list with the open lists as a stack of letters."""
    d = "length(acc.stack)"
    eff = f"CASE WHEN x.own THEN least(x.lvl, {d}) ELSE least(greatest(x.lvl - 1, 0), {d} - 1) END"
    tag = "CASE WHEN x.ltype = 'o' THEN 'ol' ELSE 'ul' END"
    back = close_from('acc.stack', '(x.eff + 1)', False)
    piece = (f"CASE WHEN NOT x.own THEN {back} WHEN x.eff = {d} THEN '<' || {tag} || '>' || chr(10) || '<li>' "
             f"ELSE {back} || '</li>' || chr(10) || '<li>' END")
    stack = f"CASE WHEN x.own AND x.eff = {d} THEN acc.stack || x.ltype ELSE substr(acc.stack, 1, x.eff + 1) END"
    step = f"{{'html': acc.html || {piece} || x.body, 'stack': {stack}}}"
    step = f"list_transform([struct_insert(x0, eff := {eff.replace('x.', 'x0.')})], lambda x: {step})[1]"
    red = f"list_reduce({items}, lambda acc, x0: {step}, {{'html': '', 'stack': ''}})"
    return f"(SELECT r.html || {close_from('r.stack', '0', True)} FROM (SELECT {red} AS r))"


def cells(row: str) -> str:
    safe = (f"array_to_string(list_transform(regexp_extract_all(replace({strip(row)}, chr(92) || '|', chr(14)), '`[^`]+`|[^`]+|`'), "
            f"lambda p: CASE WHEN regexp_full_match(p, '`[^`]+`') THEN replace(p, '|', chr(14)) ELSE p END), '')")
    core = f"regexp_replace(regexp_replace({safe}, '^\\|', ''), '\\|$', '')"
    return f"list_transform(string_split({core}, '|'), lambda c: replace({strip('c')}, chr(14), '|'))"


def table_html(text: str) -> str:
    rows = f"string_split({text}, chr(10))"
    head = cells(f"{rows}[1]")
    aligns = (f"list_transform({cells(f'{rows}[2]')}, lambda c: CASE WHEN regexp_full_match(c, ':-+:') THEN 'center' "
              f"WHEN regexp_full_match(c, ':-+') THEN 'left' WHEN regexp_full_match(c, '-+:') THEN 'right' ELSE '' END)")

    def cell(tagname: str, cs: str) -> str:
        al = f"coalesce(({aligns})[i], '')"
        attr = f"CASE WHEN {al} <> '' THEN ' style=\"text-align: ' || {al} || ';\"' ELSE '' END"
        return f"'<{tagname}' || {attr} || '>' || {inline(f'coalesce(({cs})[i], {chr(39)}{chr(39)})')} || '</{tagname}>'"

    n = f"len({head})"
    head_html = f"array_to_string(list_transform(range(1, {n} + 1), lambda i: {cell('th', head)}), chr(10))"
    body = (f"list_transform({rows}[3:], lambda r: '<tr>' || chr(10) || array_to_string(list_transform(range(1, {n} + 1), "
            f"lambda i: {cell('td', cells('r'))}), chr(10)) || chr(10) || '</tr>')")
    tbody = (f"CASE WHEN len({rows}) > 2 THEN '<tbody>' || chr(10) || array_to_string({body}, chr(10)) || chr(10) || '</tbody>' "
             f"ELSE '<tbody></tbody>' END")
    return (f"('<table>' || chr(10) || '<thead>' || chr(10) || '<tr>' || chr(10) || {head_html} || chr(10) || '</tr>' || chr(10) "
            f"|| '</thead>' || chr(10) || {tbody} || chr(10) || '</table>')")


def markdown_to_html_sql(src_cte: str) -> str:
    """CTE chain ending in ``html_docs(doc_id, html)``; ``src_cte`` defines md_src(doc_id, md)."""
    return f"""{src_cte},
ml0 AS (
  SELECT doc_id, parts, unnest(range(len(parts))) AS i
  FROM (SELECT doc_id, string_split(coalesce(md, ''), chr(10)) AS parts FROM md_src)),
ml1 AS (
  SELECT doc_id, i AS ln, regexp_replace(parts[i + 1], '\\r$', '') AS line FROM ml0),
fz AS (
  SELECT doc_id, ln, run, {strip('rest')} = '' AS bare, NOT (run[1] = '`' AND contains(rest, '`')) AS may_open
  FROM (SELECT doc_id, ln, regexp_extract(line, {q(FENCE_RE)}, 1) AS run, regexp_extract(line, {q(FENCE_RE)}, 2) AS rest FROM ml1)
  WHERE run <> ''),
fc AS (
  SELECT a.doc_id, a.ln, coalesce(min(b.ln), 2000000000) AS upto
  FROM fz a LEFT JOIN fz b ON b.doc_id = a.doc_id AND b.ln > a.ln AND b.bare AND starts_with(b.run, a.run)
  WHERE a.may_open GROUP BY a.doc_id, a.ln),
fb AS (
  SELECT doc_id, unnest(list_reduce(list({{'ln': ln, 'upto': upto}} ORDER BY ln),
           lambda acc, x: CASE WHEN x.ln > acc[-1].upto THEN list_append(acc, x) ELSE acc END, [{{'ln': -1, 'upto': -1}}])) AS f
  FROM (SELECT doc_id, CAST(ln AS BIGINT) AS ln, CAST(upto AS BIGINT) AS upto FROM fc) GROUP BY doc_id),
ml2 AS (
  SELECT m.doc_id, m.ln, m.line, coalesce(m.ln = f.ln, false) AS opens, coalesce(m.ln <= f.upto, false) AS inside,
         coalesce(m.ln = f.ln OR m.ln = f.upto, false) AS is_fence
  FROM ml1 m ASOF LEFT JOIN (SELECT doc_id, f.ln AS ln, f.upto AS upto FROM fb) f ON m.doc_id = f.doc_id AND m.ln >= f.ln),
ml3 AS (
  SELECT *, blank OR heading OR hr OR codeish AS is_sep FROM (
    SELECT *,
      opens AS fence_open,
      inside AND NOT is_fence AS in_code,
      inside AS codeish,
      NOT inside AND {strip('line')} = '' AS blank,
      NOT inside AND regexp_matches(line, {q(HEADING_RE)}) AS heading,
      NOT inside AND NOT regexp_matches(line, {q(HEADING_RE)}) AND regexp_matches(line, {q(HR_RE)}) AS hr,
      NOT inside AND NOT regexp_matches(line, {q(HEADING_RE)}) AND NOT regexp_matches(line, {q(HR_RE)})
        AND regexp_matches(line, {q(QUOTE_RE)}) AS quote,
      regexp_matches(line, {q(LIST_RE)}) AS is_item,
      contains(line, '|') AND regexp_matches(line, {q(DELIM_RE)}) AS is_delim
    FROM ml2)),
ml4 AS (
  SELECT *,
    NOT is_sep AND (coalesce(lag(is_sep) OVER w, true) OR quote <> coalesce(lag(quote) OVER w, false)) AS run_start,
    coalesce(lead(is_delim) OVER w AND NOT lead(is_sep) OVER w, false) AS next_delim
  FROM ml3 WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
ml4b AS (
  SELECT *, max(CASE WHEN heading OR hr OR codeish OR (run_start AND NOT may_go_on) THEN ln END) OVER (PARTITION BY doc_id ORDER BY ln
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_break,
            max(CASE WHEN run_start AND is_item THEN ln END) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_item_run
  FROM (SELECT *, run_start AND NOT quote AND (is_item OR regexp_matches(line, {q(INDENT_RE)})) AS may_go_on FROM ml4)),
ml5 AS (
  SELECT *,
    CAST(sum(CAST(heading OR hr OR fence_open OR (run_start AND NOT goes_on) AS INTEGER)) OVER r AS BIGINT) AS block_id,
    last_value(CASE WHEN run_start THEN CASE WHEN goes_on THEN 'li' WHEN quote THEN 'q' WHEN is_item THEN 'li' WHEN regexp_matches(line, {q(RAW_RE)}) THEN 'raw'
                    WHEN contains(line, '|') AND next_delim THEN 'tbl' ELSE 'p' END END IGNORE NULLS) OVER r AS run_kind,
    CAST(sum(CAST((is_item AND NOT is_sep) OR goes_on AS INTEGER)) OVER r AS BIGINT) AS item_seq
  FROM (SELECT *, may_go_on AND coalesce(last_item_run > coalesce(last_break, -1), false) AS goes_on FROM ml4b)
  WINDOW r AS (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ml6 AS (
  SELECT doc_id, block_id, ln, kind, line, goes_on,
    CASE WHEN kind = 'li' THEN item_seq ELSE 0 END AS sub,
    CASE WHEN kind = 'code' THEN CASE WHEN in_code THEN line END
         WHEN kind = 'q' THEN regexp_replace(line, '^ {{0,3}}> ?', '')
         WHEN kind = 'li' AND is_item THEN regexp_extract(line, {q(LIST_RE)}, 3)
         WHEN kind = 'li' THEN {strip('line')}
         ELSE line END AS text
  FROM (SELECT * REPLACE (CASE WHEN blank THEN -1 ELSE block_id END AS block_id),
               CASE WHEN blank THEN 'blank' WHEN heading THEN 'h' WHEN hr THEN 'hr' WHEN codeish THEN 'code' ELSE run_kind END AS kind
        FROM ml5)),
mb1 AS (
  SELECT *,
    regexp_matches(first_line, {q(LIST_RE)}) AS own,
    CAST(floor(length(replace(regexp_extract(first_line, '^([ \\t]*)', 1), chr(9), '    ')) / 4) AS INTEGER) AS lvl,
    array_to_string(list_transform(string_split(raw, chr(10)), lambda l: CASE
      WHEN length(l) - length(ltrim(l, ' ' || chr(9))) >= length(regexp_extract(first_line, '^([ \\t]*)', 1))
      THEN substr(l, length(regexp_extract(first_line, '^([ \\t]*)', 1)) + 1) ELSE ltrim(l, ' ' || chr(9)) END), chr(10)) AS dedented,
    CASE WHEN ends_with(regexp_extract(first_line, {q(LIST_RE)}, 2), '.') THEN 'o' ELSE 'u' END AS ltype,
    CASE WHEN kind IN ('li', 'h') THEN {inline(f"CASE WHEN kind = 'h' THEN {strip(chr(39) + '' + chr(39) + ' || regexp_extract(first_line, ' + q('^#{1,6}(.*?)#*$') + ', 1)')} ELSE text END")} END AS item_html
  FROM (SELECT doc_id, block_id, sub, coalesce(string_agg(text, chr(10) ORDER BY ln), '') AS text, bool_or(goes_on) AS goes_on,
               coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE kind = 'li'), '') AS raw,
               arg_min(line, ln) AS first_line, any_value(kind) AS kind, count(text) AS n_text
        FROM ml6 GROUP BY doc_id, block_id, sub)),
mb1b AS (
  SELECT *, CASE WHEN goes_on OR next_loose OR NOT own THEN CASE WHEN own THEN chr(10) ELSE '' END || {element_block('e')} ELSE coalesce(item_html, '') END AS body
  FROM (SELECT *, {{'dedented': dedented, 'txt': text, 'item_html': item_html}} AS e,
               coalesce(lead(goes_on) OVER (PARTITION BY doc_id, block_id ORDER BY sub), false) AS next_loose FROM mb1)),
mb2 AS (
  SELECT doc_id, block_id, any_value(kind) AS kind, arg_min(first_line, sub) AS first_line, arg_min(text, sub) AS text,
         arg_min(n_text, sub) AS n_text, arg_min(item_html, sub) AS h_html,
         list({{'own': own, 'lvl': lvl, 'ltype': ltype, 'body': body}} ORDER BY sub) AS items
  FROM mb1b GROUP BY doc_id, block_id),
mb3 AS (
  SELECT doc_id, block_id,
    CASE kind
      WHEN 'blank' THEN NULL
      WHEN 'h' THEN '<h' || CAST(length(regexp_extract(first_line, '^(#{{1,6}})', 1)) AS VARCHAR) || '>' || h_html
                 || '</h' || CAST(length(regexp_extract(first_line, '^(#{{1,6}})', 1)) AS VARCHAR) || '>'
      WHEN 'hr' THEN '<hr />'
      WHEN 'code' THEN '<pre><code' || CASE WHEN regexp_extract(first_line, {q(r"^ {0,3}(?:`{3,}|~{3,})[ \t]*([^\s`]*)")}, 1) <> ''
                 THEN ' class="language-' || regexp_extract(first_line, {q(r"^ {0,3}(?:`{3,}|~{3,})[ \t]*([^\s`]*)")}, 1) || '"' ELSE '' END
                 || '>' || CASE WHEN n_text > 0 THEN {esc('text')} || chr(10) ELSE '' END || '</code></pre>'
      WHEN 'q' THEN '<blockquote>' || chr(10) || '<p>' || {para('text')} || '</p>' || chr(10) || '</blockquote>'
      WHEN 'li' THEN {list_html('items')}
      WHEN 'tbl' THEN {table_html('text')}
      WHEN 'raw' THEN text
      ELSE '<p>' || {para('text')} || '</p>' END AS html
  FROM mb2),
html_docs AS (
  SELECT doc_id, coalesce(string_agg(html, chr(10) ORDER BY block_id), '') AS html FROM mb3 GROUP BY doc_id)"""
