"""For each registered query the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import json

from harvestlens.functions import html as H
from harvestlens.functions import urls as U
from harvestlens.functions.text import BLANK
from harvestlens.operators import contracts, pages, prompts
from harvestlens.plans import inputs
from harvestlens.sources import paged


def _q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    """SQL string literal of a pattern; this regex engine never backtracks and knows no possessive quantifiers."""
    return _q(pattern.replace(H.MOST_ATTRIBUTES, "*").replace("++", "+").replace("*+", "*").replace("?+", "?"))


def _sub(value: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({value}, {_q(pattern)}, {_q(by)}, 'g')"


def _trim(value: str) -> str:
    return _sub(value, rf"^{BLANK}+|{BLANK}+\z")


def _blank(value: str) -> str:
    return f"regexp_full_match(coalesce({value}, ''), {_q(BLANK + "*")})"


def _round4(value: str) -> str:
    return f"cast(round(cast({value} as decimal(18,8)), 4) as double)"


# ---------------------------------------------------------------- pages


#: The references that the pages hold.
_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": "\u00a0", "copy": "\u00a9", "middot": "\u00b7"}


def _entities(value: str) -> str:
    for name, char in _REFERENCES.items():
        value = f"replace({value}, '&{name};', {_q(char)})"
    return _sub(value, "&amp;", "&")


_EDGES = r"^[ \t\r\n\f]+|[ \t\r\n\f]+\z"


def _tidy(value: str) -> str:
    return _sub(_sub(_sub(value, H.SPACE_RUN, " "), H.AROUND_BREAK, "\n"), _EDGES)


def _body(markup: str) -> str:
    found = f"regexp_extract({markup}, {_q(H.BODY)}, 1)"
    return f"CASE WHEN {found} = '' THEN {_sub(markup, H.HEAD)} ELSE {_sub(found, H.TITLE_PART)} END"


_VISIBLE = _sub(_sub(_sub(_body("markup"), H.LINE_TAG, H.BREAK), H.CELL_TAG, " "), H.TAG)
_ALL_TEXT = _sub(_body(_sub("html", H.COMMENT)), H.TAG)
_TITLE = _sub(_sub(f"regexp_extract(markup, {_q(H.TITLE)}, 1)", H.SPACE_RUN, " "), _EDGES)

_PAGE_CTE = f"""
WITH d AS ({inputs.DIRTY_PAGES}),
m AS (SELECT page_id, url, html, {_sub('html', H.UNRENDERED)} AS markup FROM d),
v AS (SELECT *, {_entities(_TITLE)} AS title,
 {_tidy(_entities(_VISIBLE))} AS visible,
 len(regexp_extract_all(markup, {_re(H.ANCHOR_WITH_HREF)})) AS link_count,
 1 + len(regexp_extract_all(markup, {_q(H.FRAME)})) AS iframe_count FROM m),
t AS (SELECT *, CASE WHEN {_blank('visible')} THEN {_entities(_ALL_TEXT)} ELSE visible END AS full_text FROM v),
b AS (SELECT *, CASE WHEN {' OR '.join(
    f"contains(lower(concat_ws(chr(10), html, full_text, title, url)), {_q(m)})" for m in pages.CHALLENGE_MARKS
)} THEN 'anti_bot_challenge' END AS block_type FROM t),
e AS (SELECT *, block_type IS NULL AND {_blank('full_text')} AND link_count = 0 AS is_empty FROM b)
"""

_LINKS = f"""
WITH m AS (SELECT page_id, url, {_sub('html', H.UNRENDERED)} AS markup FROM pages),
c AS (SELECT page_id, url, regexp_split_to_array(markup, {_q(H.ANCHOR)}) AS chunks FROM m),
x AS (SELECT page_id, url, unnest(list_slice(chunks, 2, len(chunks))) AS chunk, generate_subscripts(list_slice(chunks, 2, len(chunks)), 1) AS nth FROM c),
a AS (SELECT *, regexp_extract(regexp_extract(chunk, {_q(H.ANCHOR_ATTRS)}, 1), {_re(H.HREF)}, 1) AS raw FROM x),
h AS (SELECT *, {_entities(_sub('raw', H.HREF_WRAP))} AS href0,
 {_tidy(_entities(_sub(_sub(f"regexp_extract(chunk, {_q(H.ANCHOR_BODY)}, 1)", H.LINE_TAG, H.BREAK), H.TAG)))} AS text
 FROM a WHERE raw <> ''),
r AS (SELECT page_id, nth, text, CASE WHEN href0 = '' THEN regexp_extract(url, {_q(U.NO_FRAGMENT)}, 1)
 WHEN regexp_matches(href0, {_q(U.SCHEME)}) THEN href0
 WHEN starts_with(href0, '//') THEN regexp_extract(url, {_q(U.SCHEME)}, 1) || ':' || href0
 WHEN starts_with(href0, '/') THEN regexp_extract(url, {_q(U.ORIGIN)}, 1) || href0
 WHEN starts_with(href0, '?') THEN regexp_extract(url, {_q(U.NO_QUERY)}, 1) || href0
 WHEN starts_with(href0, '#') THEN regexp_extract(url, {_q(U.NO_FRAGMENT)}, 1) || href0
 ELSE regexp_extract(url, {_q(U.DIRECTORY)}, 1) || href0 END AS href FROM h)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1 AS pos, text, href FROM r WHERE href <> ''
QUALIFY pos < {pages.MAX_LINKS}
"""

_NORMAL_URL = _trim(
    _sub(_trim(_sub(_trim(_sub(_trim("raw_url"), U.QUOTED, r"\1\2")), U.MARKDOWN_LINK, r"\1")), U.ANGLED, r"\1")
)
_URL_OK = (
    f"lower(regexp_extract(url_norm, {_q(U.SCHEME)}, 1)) IN ('http', 'https') "
    f"AND regexp_extract(url_norm, {_q(U.HOST)}, 1) <> ''"
)

# ---------------------------------------------------------------- fetches and results

_REQUEST_ERROR = f"""CASE WHEN {_blank('source_id')} OR contains(source_id, '/') OR contains(source_id, chr(92))
  OR source_id IN ('.', '..') THEN 'InvalidSourceId'
 WHEN {_blank('filename')} OR contains(filename, '/') OR contains(filename, chr(92)) OR filename IN ('.', '..')
  THEN 'InvalidFilename' END"""

_DOWNLOADS_OK = f"SELECT * FROM ({inputs.DOWNLOADS}) WHERE event_id % 13 > 1 AND event_id % 9 > 0"

# ---------------------------------------------------------------- actions: classes known from how the text was made

_ERROR_CLASS = """CASE event_id % 11 WHEN 0 THEN 'empty' WHEN 1 THEN 'thinking' WHEN 2 THEN 'fence' WHEN 3 THEN 'invalid_json'
 WHEN 4 THEN 'not_object' WHEN 5 THEN 'no_action' WHEN 6 THEN 'no_arguments' WHEN 7 THEN 'action_not_string'
 WHEN 8 THEN 'arguments_not_object' END"""
_ACTION = """CASE WHEN event_id % 11 = 10 THEN 'read_csv' WHEN event_id % 11 = 9 THEN CASE event_id % 7 WHEN 0 THEN 'finish'
 WHEN 1 THEN 'does_not_exist' WHEN 2 THEN 'browser_click' WHEN 3 THEN 'http_download' WHEN 4 THEN 'http_download'
 ELSE 'read_csv' END END"""
_CALLS = f"SELECT event_id, {_ACTION} AS action FROM events WHERE event_id % 11 IN (9, 10)"

# ---------------------------------------------------------------- runs

_KEPT = """
WITH t AS ({turns}),
s AS (SELECT *, turn_seq - 1 AS step, greatest(max_steps, 1) AS lim,
 min(CASE WHEN kind IN ('finish', 'model_failure') THEN turn_seq - 1 END) OVER (PARTITION BY run_id) AS ending FROM t),
k AS (SELECT * FROM s WHERE step < lim AND step <= coalesce(ending, step))
"""
_KEPT_TURNS = _KEPT.format(turns=inputs.NUMBERED_TURNS)
_KEPT_DETAILS = _KEPT.format(turns=inputs.NUMBERED_DETAILED_TURNS)
_FAILED = "(kind = 'call' AND NOT success)"

_RUN_STATE = f"""{_KEPT_TURNS}
SELECT run_id, CASE WHEN bool_or(kind = 'finish') THEN 'finished' WHEN bool_or(kind = 'model_failure') THEN 'failed'
 WHEN count(*) >= max(lim) THEN 'max_steps_reached' ELSE 'running' END AS status,
 CASE WHEN bool_or(kind IN ('finish', 'model_failure')) THEN count(*) - 1 ELSE count(*) END AS current_step,
 count(*) FILTER (kind IN ('call', 'finish')) AS n_calls,
 count(*) FILTER (kind IN ('parse_error', 'action_error', 'model_failure') OR {_FAILED}) AS n_errors
FROM k GROUP BY run_id
"""

_RUN_STATE_WITH_REASON = _RUN_STATE.replace(_KEPT_TURNS, _KEPT_DETAILS).replace(" AS n_errors\n", """ AS n_errors,
 max(CASE kind WHEN 'finish' THEN coalesce(reason, '') WHEN 'model_failure'
  THEN 'Model generation error: ' || coalesce(message, 'unknown error') END) AS finish_reason
""")

_AUDIT = f"""{_KEPT_DETAILS}
SELECT timestamp, source_id, step, action AS tool_name, arguments, NOT {_FAILED} AS success,
 CASE WHEN {_FAILED} THEN message END AS error,
 CASE WHEN kind = 'finish' THEN 0.0 ELSE duration_seconds END AS duration_seconds
FROM k WHERE kind IN ('call', 'finish')
"""

_ERROR_TEXT = f"""CASE kind WHEN 'parse_error' THEN 'PARSE_ERROR: ' || coalesce(message, 'unknown error')
 WHEN 'action_error' THEN 'ACTION_ERROR (' || error_type || '): ' || coalesce(message, 'unknown error')
 WHEN 'model_failure' THEN 'Model generation error: ' || coalesce(message, 'unknown error')
 ELSE CASE WHEN {_FAILED} THEN 'step=' || step || ' action=' || action || ': ' || coalesce(message, 'unknown error') END END"""
_OBSERVATION = f"""CASE WHEN kind IN ('call', 'finish') THEN 'step=' || step || ' action=' || action || ' result=' || result
 WHEN kind <> 'model_failure' THEN {_ERROR_TEXT} END"""


def _quoted_json(value: str) -> str:
    return f"""'"' || replace(replace({value}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'"""


def _tools_json() -> str:
    names = ("argument", "type", "nullable", "item_type", "required", "minimum", "default_value")
    tools = [
        {"name": n, "category": c, "description": d, "arguments": [dict(zip(names, a)) for a in contract]}
        for n, c, d, contract in sorted(contracts.TOOLS)
    ]
    return json.dumps(tools, separators=(",", ":"))


_PROMPTS = f"""{_KEPT_DETAILS},
calls AS (SELECT run_id, string_agg('{{"step":' || step || ',"action":"' || action || '","arguments":' || {_quoted_json('arguments')}
  || ',"result":' || {_quoted_json('result')} || ',"duration_seconds":'
  || cast(CASE WHEN kind = 'finish' THEN 0 ELSE cast(duration_seconds as decimal(18,4)) END as varchar) || '}}', ',' ORDER BY step) AS calls
 FROM k WHERE kind IN ('call', 'finish') GROUP BY run_id),
seen AS (SELECT run_id, string_agg({_quoted_json('observation')}, ',' ORDER BY step) AS seen
 FROM (SELECT run_id, step, {_OBSERVATION} AS observation FROM k) WHERE observation IS NOT NULL GROUP BY run_id),
r AS (SELECT DISTINCT user_id AS run_id FROM events),
u AS (SELECT run_id, 'SOURCE CONFIGURATION:' || chr(10) || chr(10) || coalesce(cfg_json, '{{}}') || chr(10) || chr(10)
  || 'AVAILABLE TOOLS:' || chr(10) || chr(10) || {_q(_tools_json())} || chr(10) || chr(10)
  || 'PREVIOUS TOOL CALLS:' || chr(10) || chr(10) || '[' || coalesce(calls, '') || ']' || chr(10) || chr(10)
  || 'OBSERVATIONS FROM PREVIOUS STEPS:' || chr(10) || chr(10) || '[' || coalesce(seen, '') || ']' || chr(10) || chr(10)
  || {_q(prompts.CLOSING)} AS content
 FROM r LEFT JOIN calls USING (run_id) LEFT JOIN seen USING (run_id)
 LEFT JOIN (SELECT s_suppkey AS run_id, cfg_json FROM ({inputs.CONFIGS})) USING (run_id))
SELECT run_id, cast(0 as bigint) AS part, 'user' AS role, content FROM u
UNION ALL SELECT run_id, cast(0 as bigint), 'system', {_q(prompts.INSTRUCTIONS)} FROM r
"""

_GRID_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"

_COUNT_COLUMN = "SELECT {d} AS dataset, cast({i} as bigint) AS ordinal, {c} AS \"column\", {t} AS dtype, count(*) FILTER ({n} IS NULL) AS n_null FROM ({src})"


def _column_rows(dataset: str, source: str, columns: list[tuple[str, str]]) -> list[str]:
    return [
        _COUNT_COLUMN.format(d=_q(dataset), i=i, c=_q(c), t=_q(t), n=c, src=source)
        for i, (c, t) in enumerate(columns)
    ]


_TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SQL: dict[str, str] = {
    # sources
    "scan_csv": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as varchar) AS o_orderdate,
 o_orderpriority || ', "q"' AS note FROM orders""",
    "scan_workbook": """SELECT 'w' || (o_orderkey // 500) || '.xlsx' AS path, 'Orders' AS sheet_name,
 row_number() OVER (PARTITION BY o_orderkey // 500 ORDER BY o_orderkey) AS row_idx, 'key,status' AS header,
 cast(o_orderkey as varchar) AS order_key, o_orderstatus AS order_status FROM orders""",
    "inventory_files": "SELECT name || '.parquet' AS file_name, '.parquet' AS extension, 'unknown' AS guessed_mime_type, "
    "true AS has_content, true AS no_sheets FROM (VALUES "
    + ", ".join(f"('{n}')" for n in _TABLE_NAMES)
    + ") t(name)",
    "describe_files": """SELECT event_id, 'storage/raw/s/f' || event_id || ['.csv', '.XLSX', '.csv.gz', '', '.parquet', '.pdf'][event_id % 6 + 1] AS path,
 length(props) AS size_bytes, ['.csv', '.xlsx', '.gz', '', '.parquet', '.pdf'][event_id % 6 + 1] AS extension,
 ['text/csv', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'text/csv', 'unknown', 'unknown',
  'application/pdf'][event_id % 6 + 1] AS guessed_mime_type FROM events""",
    "missing_files": """SELECT 'raw/s' || c_custkey AS path,
 CASE WHEN u.user_id IS NULL THEN 'FileNotFoundError' ELSE 'NotAFileError' END AS error_type,
 CASE WHEN u.user_id IS NULL THEN 'File not found: ' ELSE 'Path is not a file: ' END || 'raw/s' || c_custkey AS message,
 false AS recoverable FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON c_custkey = u.user_id""",
    "preview_pages": f"""SELECT conv_id, turn + 1 AS page_number, left(coalesce(text, ''), {paged.PAGE_TEXT}) AS text_sample,
 count(*) OVER (PARTITION BY conv_id) AS total_pages, least(count(*) OVER (PARTITION BY conv_id), 3) AS pages_previewed
 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""",
    "check_page_numbers": """WITH n AS (SELECT conv_id, count(*) AS total_pages FROM conversations GROUP BY conv_id),
 a AS (SELECT conv_id, (turn + 1) * 2 - 2 AS asked_page FROM conversations)
SELECT conv_id, asked_page, total_pages,
 CASE WHEN asked_page < 1 OR asked_page > total_pages THEN 'InvalidPageNumber' END AS error_type,
 CASE WHEN asked_page < 1 OR asked_page > total_pages THEN 'page_number ' || asked_page || ' out of range (1-' || total_pages || ')' END
  AS message FROM a JOIN n USING (conv_id)""",
    "summarize_grids": f"""WITH g AS ({inputs.GRID_ROWS}),
 n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY {_GRID_ORDER}) AS i FROM g)
SELECT table_id, count(*) AS row_count, cast(3 as bigint) AS col_count,
 '[' || string_agg('["' || c0 || '","' || c1 || '","' || c2 || '"]', ',' ORDER BY i) FILTER (i <= {paged.SAMPLE_ROWS}) || ']' AS sample_rows
FROM n GROUP BY table_id""",
    "scan_source_configs": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '1a' WHEN 1 THEN 'webpage' WHEN 2 THEN '1a' WHEN 4 THEN '1a' END
 AS source_type, CASE WHEN s_suppkey % 5 = 3 THEN 'Source configuration must be a mapping' END AS parse_error FROM supplier""",
    # sinks
    "land_raw": f"SELECT event_id, source_id, filename, strlen(body) AS bytes, body FROM ({_DOWNLOADS_OK})",
    "landing_manifest": f"""SELECT true AS success, url, source_id, filename, 'storage/raw/' || source_id || '/' || filename AS file_path,
 strlen(body) AS bytes, coalesce(content_type, 'unknown') AS content_type FROM ({_DOWNLOADS_OK})""",
    "write_processed": f"""SELECT event_id, source_id, cast(regexp_extract(body, '([0-9]+)', 1) as bigint) AS k
 FROM ({_DOWNLOADS_OK})""",
    "append_audit": _AUDIT,
    "stream_audit": _AUDIT,
    "dump_run_state": _RUN_STATE_WITH_REASON.replace("SELECT run_id, CASE WHEN bool_or(kind = 'finish')", f"""SELECT run_id, cast(0 as bigint) AS part,
 '{{"source_id":"s' || run_id || '"}}' AS source_config, cast(max(max_steps) as bigint) AS max_steps,
 coalesce(string_agg(concat_ws('|', step, action, arguments, NOT {_FAILED}, CASE WHEN kind = 'call' AND success THEN file_path END,
  CASE WHEN {_FAILED} THEN 'm' || event_id END, CASE WHEN kind = 'finish' THEN reason END), ';' ORDER BY step) FILTER (kind IN ('call', 'finish')), '') AS tool_history,
 coalesce(string_agg({_OBSERVATION}, ';' ORDER BY step), '') AS observations,
 coalesce(string_agg(CASE WHEN kind = 'call' AND success AND file_path <> '' THEN file_path END, ';' ORDER BY step), '') AS artifacts,
 coalesce(string_agg({_ERROR_TEXT}, ';' ORDER BY step), '') AS errors,
 'row_count|' || ((SELECT count(*) FROM t x WHERE x.run_id = k.run_id) >= 60) || '|{{"row_count":' || (SELECT count(*) FROM t x WHERE x.run_id = k.run_id) || '}}'
  AS validation_results, CASE WHEN bool_or(kind = 'finish')"""),
    # profiles
    "profile_shape": " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS \"rows\", cast({c} as bigint) AS \"columns\" FROM {n}"
        for n, c in (("orders", 6), ("lineitem", 11), ("events", 6), ("documents", 5))
    ),
    "profile_columns": " UNION ALL ".join(
        _column_rows("customer", inputs.ROWS_WITH_NULLS, [
            ("c_custkey", "bigint"), ("c_name", "string"), ("c_acctbal", "double"), ("c_mktsegment", "string")])
        + _column_rows("events", "SELECT * FROM events", [
            ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
            ("value", "double"), ("props", "string")])
    ),
    "profile_sample": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5",
    # pages
    "inspect_pages": _PAGE_CTE + f"""SELECT page_id, block_type IS NULL AND NOT is_empty AS success, block_type IS NOT NULL AS blocked, block_type,
 CASE WHEN block_type IS NULL THEN is_empty END AS empty_page, title,
 CASE WHEN is_empty THEN 0 ELSE length(left(full_text, {pages.MAX_TEXT})) END AS text_len, link_count, iframe_count,
 length(html) AS html_length FROM e""",
    "open_results": _PAGE_CTE + "SELECT page_id, true AS success, url, title, cast(NULL as integer) AS status_code FROM e",
    "normalize_urls": f"SELECT page_id, {_NORMAL_URL} AS url_norm FROM ({inputs.DIRTY_URLS})",
    "validate_urls": f"""WITH n AS (SELECT page_id, {_NORMAL_URL} AS url_norm FROM ({inputs.DIRTY_URLS}))
SELECT page_id, url_norm, {_URL_OK} AS valid, CASE WHEN NOT ({_URL_OK}) THEN 'InvalidURL' END AS error_type,
 CASE WHEN NOT ({_URL_OK}) THEN false END AS recoverable FROM n""",
    "detect_blocked": _PAGE_CTE + "SELECT page_id, block_type FROM e",
    "page_titles": _PAGE_CTE + "SELECT page_id, title FROM e",
    "page_texts": _PAGE_CTE + f"SELECT page_id, left(full_text, {pages.MAX_TEXT}) AS text FROM e",
    "page_links": _LINKS,
    "page_link_counts": _PAGE_CTE + "SELECT page_id, link_count FROM e",
    "page_frames": _PAGE_CTE + "SELECT page_id, iframe_count FROM e",
    "page_html_stats": f"""SELECT page_id, length(html) AS html_length, left(html, {pages.MAX_HTML_PREVIEW}) AS html_preview
 FROM ({inputs.DIRTY_PAGES})""",
    # fetches
    "check_fetch_requests": f"""WITH f AS (SELECT event_id, {_REQUEST_ERROR} AS error_type FROM ({inputs.FETCHES}))
SELECT event_id, error_type, CASE WHEN error_type IS NOT NULL THEN false END AS recoverable FROM f""",
    "classify_fetch_outcomes": """SELECT event_id, event_id % 6 IN (0, 5) AS success,
 CASE event_id % 6 WHEN 1 THEN 'HTTPError' WHEN 2 THEN 'HTTPError' WHEN 3 THEN 'Timeout' WHEN 4 THEN 'RequestException' END AS error_type,
 CASE event_id % 6 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true END AS recoverable FROM events""",
    "storage_paths": f"""SELECT event_id, 'storage/raw/' || source_id || '/' || filename AS raw_path,
 'storage/processed/' || source_id || '/' || filename AS processed_path
 FROM ({inputs.FETCHES}) WHERE {_REQUEST_ERROR} IS NULL""",
    # checks
    "check_source_configs": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'raw_dir' WHEN 2 THEN 'title,data_link,raw_dir'
 WHEN 4 THEN '' END AS missing_fields, s_suppkey % 5 IN (0, 4) AS valid,
 CASE s_suppkey % 5 WHEN 3 THEN NULL WHEN 4 THEN '{"a":"string"}' ELSE '{}' END AS target_schema FROM supplier""",
    "check_required_fields": """SELECT event_id, cast(0 as bigint) AS ordinal, 'success' AS field FROM events WHERE event_id % 5 IN (3, 4)
UNION ALL SELECT event_id, cast(1 as bigint), 'message' FROM events WHERE event_id % 5 <> 1""",
    "check_schema": """SELECT event_id, 'missing' AS kind, 'success' AS field FROM events WHERE event_id % 5 IN (3, 4)
UNION ALL SELECT event_id, 'missing', 'message' FROM events WHERE event_id % 5 <> 1
UNION ALL SELECT event_id, 'extra', unnest(['file_path', 'bytes']) FROM events WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 'extra', 'shape' FROM events WHERE event_id % 5 = 3""",
    "check_types": """SELECT event_id, 'bytes' AS field, 'STRING' AS expected, 'BIGINT' AS observed FROM events WHERE event_id % 5 = 0""",
    "check_row_count": """SELECT l_returnflag, count(*) AS row_count, cast(10000 as bigint) AS minimum, cast(30000 as bigint) AS maximum,
 count(*) BETWEEN 10000 AND 30000 AS passed FROM lineitem GROUP BY l_returnflag""",
    "check_duplicates": "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "check_duplicates_composite": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "check_date_range": """SELECT o_orderkey, cast(o_orderdate as varchar) AS value,
 CASE WHEN cast(o_orderdate as varchar) < '1996-01-01' THEN 'below' ELSE 'above' END AS side FROM orders
 WHERE cast(o_orderdate as varchar) < '1996-01-01' OR cast(o_orderdate as varchar) > '1998-12-31'""",
    "check_nulls": f"""WITH d AS ({inputs.ROWS_WITH_NULLS})
SELECT 'c_acctbal' AS field, coalesce(bool_or(c_acctbal IS NULL), false) AS has_null FROM d
UNION ALL SELECT 'c_mktsegment', coalesce(bool_or(c_mktsegment IS NULL OR c_mktsegment = ''), false) FROM d
UNION ALL SELECT 'c_name', coalesce(bool_or(c_name IS NULL OR c_name = ''), false) FROM d
UNION ALL SELECT 'c_phone', count(*) > 0 FROM d""",
    "check_report": f"""WITH o AS (SELECT o_orderkey, cast(o_orderdate as varchar) AS d, o_orderstatus, o_custkey FROM orders),
 r AS (SELECT d, d < '1996-01-01' AS below FROM o WHERE d < '1996-01-01' OR d > '1998-12-31'),
 c AS ({inputs.ROWS_WITH_NULLS}),
 od AS (SELECT o_orderkey AS k, count(*) AS n FROM o GROUP BY 1 HAVING count(*) > 1),
 cd AS (SELECT c_mktsegment AS k, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1)
SELECT 'orders' AS dataset, 'required_fields' AS "check", false AS passed, '{{"missing_fields":["o_comment"]}}' AS detail_json
UNION ALL SELECT 'orders', 'schema', false,
 '{{"missing_fields":["o_comment"],"extra_fields":["o_custkey","o_orderstatus","o_orderdate","o_orderpriority"]}}'
UNION ALL SELECT 'orders', 'types', false, '{{"mismatches":[{{"field":"o_totalprice","expected":"decimal","observed":"double"}}]}}'
UNION ALL SELECT 'orders', 'row_count', count(*) >= 1, '{{"row_count":' || count(*) || ',"minimum":1,"maximum":null}}' FROM o
UNION ALL SELECT 'orders', 'duplicates', count(*) = 0, '{{"duplicate_keys":' || count(*) || ',"surplus_rows":' || coalesce(sum(n - 1), 0)
 || ',"first":' || coalesce('{{"o_orderkey":' || min(k) || '}}', 'null') || ',"last":' || coalesce('{{"o_orderkey":' || max(k) || '}}', 'null') || '}}' FROM od
UNION ALL SELECT 'orders', 'date_range', count(*) = 0, '{{"below":' || count(*) FILTER (below) || ',"above":' || count(*) FILTER (NOT below)
 || ',"lowest":' || coalesce('"' || min(d) || '"', 'null') || ',"highest":' || coalesce('"' || max(d) || '"', 'null') || '}}' FROM r
UNION ALL SELECT 'orders', 'nulls', len(f) = 0, '{{"fields_with_nulls":[' || array_to_string(list_transform(f, lambda x: '"' || x || '"'), ',') || ']}}'
 FROM (SELECT list_filter([CASE WHEN bool_or(o_custkey IS NULL) THEN 'o_custkey' END,
  CASE WHEN bool_or(o_orderstatus IS NULL OR o_orderstatus = '') THEN 'o_orderstatus' END], lambda x: x IS NOT NULL) AS f FROM o)
UNION ALL SELECT 'customer', 'row_count', count(*) BETWEEN 1 AND 100, '{{"row_count":' || count(*) || ',"minimum":1,"maximum":100}}' FROM c
UNION ALL SELECT 'customer', 'duplicates', count(*) = 0, '{{"duplicate_keys":' || count(*) || ',"surplus_rows":' || coalesce(sum(n - 1), 0)
 || ',"first":' || coalesce('{{"c_mktsegment":"' || min(k) || '"}}', 'null') || ',"last":' || coalesce('{{"c_mktsegment":"' || max(k) || '"}}', 'null') || '}}' FROM cd
UNION ALL SELECT 'customer', 'nulls', len(f) = 0, '{{"fields_with_nulls":[' || array_to_string(list_transform(f, lambda x: '"' || x || '"'), ',') || ']}}'
 FROM (SELECT list_filter([CASE WHEN bool_or(c_mktsegment IS NULL OR c_mktsegment = '') THEN 'c_mktsegment' END,
  CASE WHEN bool_or(c_name IS NULL OR c_name = '') THEN 'c_name' END], lambda x: x IS NOT NULL) AS f FROM c)""",
    # actions
    "parse_actions": f"SELECT event_id, {_ACTION} AS action, {_ERROR_CLASS} AS error_type FROM events",
    "tool_lookup": f"""SELECT event_id, action, CASE action WHEN 'read_csv' THEN 'file' WHEN 'http_download' THEN 'http'
 WHEN 'browser_click' THEN 'browser' END AS category, CASE WHEN action IN ('read_csv', 'http_download') THEN true
 WHEN action = 'browser_click' THEN false END AS enabled,
 CASE WHEN action IN ('finish', 'does_not_exist') THEN 'ToolNotFoundError' END AS error_type FROM ({_CALLS})""",
    "check_arguments": f"""SELECT event_id, action, 'missing' AS violation, unnest(['source_id', 'filename']) AS argument
 FROM ({_CALLS}) WHERE event_id % 11 = 9 AND event_id % 7 = 3
UNION ALL SELECT event_id, action, 'wrong_type', 'source_id' FROM ({_CALLS}) WHERE event_id % 11 = 9 AND event_id % 7 = 4
UNION ALL SELECT event_id, action, 'unexpected', 'bogus' FROM ({_CALLS}) WHERE event_id % 11 = 9 AND event_id % 7 = 5
UNION ALL SELECT event_id, action, 'below_minimum', 'sample_rows' FROM ({_CALLS}) WHERE event_id % 11 = 9 AND event_id % 7 = 6""",
    "check_argument_types": """WITH e AS (SELECT event_id, event_type AS action, json_type(props, '$.k') AS t,
  cast(json_extract(props, '$.k') as double) AS v FROM events)
SELECT event_id, action, 'wrong_type' AS violation, 'k' AS argument FROM e WHERE action = 'view' AND t <> 'VARCHAR'
 OR action = 'signup' AND t NOT IN ('ARRAY', 'OBJECT', 'NULL') OR action = 'purchase' AND t NOT IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')
 OR action = 'click' AND t NOT IN ('BIGINT', 'UBIGINT') AND NOT (t = 'DOUBLE' AND v = floor(v))
UNION ALL SELECT event_id, action, 'below_minimum', 'k' FROM e WHERE action = 'click' AND t IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND v < 50 AND v = floor(v)
UNION ALL SELECT event_id, action, 'missing', 'q' FROM e WHERE action = 'click'""",
    "route_actions": f"""SELECT event_id, action, CASE WHEN event_id % 11 = 10 THEN 'dispatch' WHEN action = 'finish' THEN 'finish' ELSE 'reject' END AS route,
 CASE WHEN event_id % 11 = 9 THEN CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ToolNotFoundError' WHEN 2 THEN 'ToolDisabledError'
  ELSE 'InvalidArgumentsError' END END AS error_type FROM ({_CALLS})""",
    "finish_results": f"SELECT event_id, true AS success, action, 'done' AS reason FROM ({_CALLS}) WHERE action = 'finish'",
    "tool_error_results": f"""SELECT event_id, false AS success,
 CASE WHEN exception_class = 'ToolExecutionError' THEN coalesce(error_type, 'ToolExecutionError') ELSE exception_class END AS error_type,
 coalesce(message, '') AS message,
 CASE WHEN exception_class = 'ToolExecutionError' THEN coalesce(recoverable, true) ELSE true END AS recoverable,
 {_round4('duration')} AS duration_seconds FROM ({inputs.FAILURES})""",
    "normalize_results": f"""SELECT event_id, event_id % 5 NOT IN (1, 2) AS success, CASE WHEN event_id % 5 = 0 THEN 'storage/raw/s/f' END AS file_path,
 CASE WHEN event_id % 5 = 1 THEN 'boom' END AS message, event_id % 5 = 4 AS wrapped, {_round4('value/1000')} AS duration_seconds FROM events""",
    # runs
    "run_state": _RUN_STATE_WITH_REASON,
    "stream_run_state": _RUN_STATE_WITH_REASON,
    "audit_records": _AUDIT,
    "run_artifacts": f"""{_KEPT_TURNS} SELECT run_id, cast(0 as bigint) AS part, string_agg(file_path, ',' ORDER BY step) AS artifacts
 FROM k WHERE kind = 'call' AND success AND file_path <> '' GROUP BY run_id""",
    "run_errors": f"{_KEPT_DETAILS} SELECT * FROM (SELECT run_id, step, {_ERROR_TEXT} AS error FROM k) WHERE error IS NOT NULL",
    "run_observations": f"""{_KEPT_DETAILS} SELECT * FROM (SELECT run_id, step, {_OBSERVATION} AS observation FROM k)
 WHERE observation IS NOT NULL""",
    "run_history": f"""{_KEPT_DETAILS} SELECT run_id, cast(0 as bigint) AS part,
 string_agg(step || '|' || action || '|' || arguments || '|' || result, ';' ORDER BY step) AS history
 FROM k WHERE kind IN ('call', 'finish') GROUP BY run_id""",
    "build_prompts": _PROMPTS,
}
