"""SQL functions (2.10): the scalar rules as SQL UDFs, for ``spark.sql`` users.

``CREATE TEMPORARY FUNCTION ... RETURN <expr>`` bodies are plain SQL expressions, which
Catalyst inlines into the calling plan (no Python, no serialization per row). They
state the same rules as ``functions/urls.py`` and ``functions/text.py``; the tests check
that both forms agree.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_U = r"regexp_replace(regexp_replace(url, '[\\t\\r\\n]', ''), '^[\\\\x00-\\\\x20]+', '')"
_NOSCHEME = f"regexp_replace({_U}, '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
_NONET = f"regexp_replace({_NOSCHEME}, '^//[^/?#]*', '')"
_NOFRAG = f"regexp_extract({_NONET}, '^([^#]*)', 1)"
_QUERY = f"regexp_extract({_NOFRAG}, '^[^?]*\\\\?(.*)$', 1)"
_PATH = f"regexp_replace(regexp_extract({_NOFRAG}, '^([^?]*)', 1), ';[^/]*$', '')"
_HIT = f"get(filter(split({_QUERY}, '&', -1), p -> startswith(p, 'pageId=')), 0)"
_SEGS = f"split({_PATH}, '/', -1)"
_AT = f"array_position({_SEGS}, 'pages')"

PAGE_ID_SQL = (f"CASE WHEN url IS NULL OR url = '' THEN NULL "
               f"WHEN {_HIT} IS NOT NULL THEN get(split({_HIT}, '=', -1), 1) "
               f"ELSE get(filter({_SEGS}, (s, i) -> i >= {_AT} AND {_AT} > 0 AND s RLIKE '^[0-9]+$'), 0) END")

PAGE_URL_SQL = "concat(regexp_replace(base_url, '/+$', ''), '/pages/viewpage.action?pageId=', page_id)"

SLUG_SQL = ("concat(regexp_replace(translate(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz'), ' ', '-'), '[^a-z0-9-]', ''), '.md')")

HEADER_SQL = ("concat('# ', title, '\\n\\n**Space:** ', space_name, '  \\n**Page ID:** ', page_id, "
              "'  \\n**Version:** ', CAST(version AS STRING), '  \\n**URL:** ', url, '\\n\\n---\\n\\n')")

_KEPT = "filter(split(buffer, '\\n', -1), l -> NOT (startswith(l, '<!--') AND contains(l, '-->')))"
_TITLE_AT = f"array_position(transform({_KEPT}, l -> startswith(l, '# ')), true)"
CLEAN_EDIT_SQL = (f"regexp_replace(regexp_replace(array_join(filter({_KEPT}, (l, i) -> i + 1 <> {_TITLE_AT}), '\\n'), "
                  f"'^[ \\t\\n\\r\\\\x0B\\f]+', ''), '[ \\t\\n\\r\\\\x0B\\f]+$', '')")

FUNCTIONS = {
    "wiki_page_id": ("url STRING", "STRING", PAGE_ID_SQL),
    "wiki_page_url": ("base_url STRING, page_id STRING", "STRING", PAGE_URL_SQL),
    "wiki_slug": ("title STRING", "STRING", SLUG_SQL),
    "wiki_header": ("title STRING, space_name STRING, page_id STRING, version INT, url STRING", "STRING", HEADER_SQL),
    "wiki_clean_edit": ("buffer STRING", "STRING", CLEAN_EDIT_SQL),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions in this session; returns their names."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
