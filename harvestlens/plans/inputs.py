"""Inputs derived from the provided tables. The same text runs in Spark and in DuckDB.

FIXTURES.md explains what each input is for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harvestlens.session import spread, table

DIRTY_URLS = """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '  '||url||'  ' WHEN 2 THEN chr(34)||url||chr(34)
 WHEN 3 THEN '['||url||']('||url||')' WHEN 4 THEN '<'||url||'>' WHEN 5 THEN 'ftp'||substr(url, instr(url,'://'))
 WHEN 6 THEN 'https:///p' ELSE chr(39)||' <'||url||'> '||chr(39) END AS raw_url FROM pages
"""

DIRTY_PAGES = """
SELECT page_id, url, CASE WHEN page_id % 10 = 3 THEN html||'<script>window.failureConfig=1</script>'
 WHEN page_id % 10 = 5 THEN html||'<h1>Checking Your Browser</h1>'
 WHEN page_id % 10 = 7 THEN '<html><head><title>Blank</title></head><body>  </body></html>'
 WHEN page_id % 10 = 8 THEN html||'<iframe src="/x"></iframe>' ELSE html END AS html FROM pages
"""

RESPONSES = """
SELECT event_id, CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN '<think>x</think>{"action":"finish","arguments":{}}'
 WHEN 2 THEN '```json {"action":"finish","arguments":{}} ```'
 WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'I will call it now.' ELSE '{"action":"finish","arguments":{}} trailing' END
 WHEN 4 THEN '[1]' WHEN 5 THEN '{"arguments":{}}' WHEN 6 THEN '{"action":"finish"}'
 WHEN 7 THEN '{"action":123,"arguments":{}}' WHEN 8 THEN '{"action":"finish","arguments":"x"}'
 WHEN 9 THEN CASE event_id % 7 WHEN 0 THEN '{"action":"finish","arguments":{"reason":"done"}}'
  WHEN 1 THEN '{"action":"does_not_exist","arguments":{}}' WHEN 2 THEN '{"action":"browser_click","arguments":{}}'
  WHEN 3 THEN '{"action":"http_download","arguments":{"url":"https://e.org"}}'
  WHEN 4 THEN '{"action":"http_download","arguments":{"url":"https://e.org","source_id":123,"filename":"f"}}'
  WHEN 5 THEN '{"action":"read_csv","arguments":{"path":"p","bogus":1}}'
  ELSE '{"action":"read_csv","arguments":{"path":"p","sample_rows":0}}' END
 ELSE '{"action":"read_csv","arguments":{"path":"p'||cast(event_id as varchar(20))||'.csv","sample_rows":5}}' END
 AS response FROM events
"""

_TURNS = """
SELECT user_id AS run_id, event_id, ts, {seq}
 CASE WHEN event_id % 97 = 0 THEN 'model_failure' WHEN event_type='purchase' AND user_id % 10 <> 9 THEN 'finish'
  WHEN event_type='signup' THEN 'parse_error' WHEN event_type='click' OR event_type='purchase' THEN 'action_error'
  ELSE 'call' END AS kind, event_type='view' AS success,
 CASE WHEN event_type='view' THEN 'storage/raw/s'||cast(user_id as varchar(20))||'/f'||cast(event_id as varchar(20)) END AS file_path,
 cast(round(cast(value/1000 as decimal(18,8)),4) as double) AS duration_seconds,
 CASE WHEN user_id % 10 = 9 THEN 500 WHEN user_id % 10 = 0 THEN 0 ELSE 3 + user_id % 4 END AS max_steps FROM events
"""
# Spark ranks the turns itself, in a way that one busy run cannot block; SQL uses a window.
TURNS = _TURNS.format(seq="")
NUMBERED_TURNS = _TURNS.format(seq="row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn_seq,")

_DETAILS = """
SELECT t.*, 's'||cast(run_id as varchar(20)) AS source_id, cast(ts as varchar(40)) AS timestamp,
 CASE kind WHEN 'call' THEN 'http_download' WHEN 'finish' THEN 'finish' END AS action,
 CASE kind WHEN 'call' THEN '{{"filename":"f'||cast(event_id as varchar(20))||'"}}'
  WHEN 'finish' THEN '{{"reason":"r'||cast(event_id as varchar(20))||'"}}' END AS arguments,
 CASE WHEN kind = 'finish' THEN '{{"success":true,"action":"finish","reason":"r'||cast(event_id as varchar(20))||'"}}'
  WHEN kind = 'call' AND success THEN '{{"success":true,"file_path":"'||file_path||'"}}'
  WHEN kind = 'call' THEN '{{"success":false,"message":"m'||cast(event_id as varchar(20))||'"}}' END AS result,
 CASE WHEN kind = 'finish' OR (kind = 'call' AND (success OR event_id % 3 = 0)) THEN NULL
  ELSE 'm'||cast(event_id as varchar(20)) END AS message,
 CASE WHEN kind = 'action_error' THEN CASE WHEN event_id % 2 = 0 THEN 'ToolNotFoundError' ELSE 'ToolDisabledError' END END
  AS error_type,
 CASE WHEN kind = 'finish' THEN 'r'||cast(event_id as varchar(20)) END AS reason
FROM ({turns}) t
"""
DETAILED_TURNS = _DETAILS.format(turns=TURNS)
NUMBERED_DETAILED_TURNS = _DETAILS.format(turns=NUMBERED_TURNS)

ROWS_WITH_NULLS = """
SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN '' ELSE c_name END AS c_name,
 CASE WHEN c_custkey % 70 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
"""

FETCHES = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 5 THEN 302 END AS status_code,
 CASE event_id % 6 WHEN 3 THEN 'Timeout' WHEN 4 THEN 'ConnectionError' END AS exception_class,
 CASE WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 13 = 1 THEN '../up' ELSE 's'||cast(user_id as varchar(20)) END AS source_id,
 CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'a/b.csv' WHEN 2 THEN 'a'||chr(92)||'b.csv' WHEN 3 THEN '..'
  ELSE 'f'||cast(event_id as varchar(20))||'.csv' END AS filename FROM events
"""

GRID_ROWS = """
SELECT l_orderkey AS table_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
 cast(l_linenumber as varchar(20)) AS c0, l_returnflag AS c1, l_linestatus AS c2 FROM lineitem
"""

CONFIGS = """
SELECT s_suppkey, CASE s_suppkey % 5
 WHEN 0 THEN '{"source_id":"x","source_type":"1a","title":"t","data_link":"https://e.org","raw_dir":"raw/x"}'
 WHEN 1 THEN '{"source_id":"x","source_type":"webpage","title":"t","data_link":"https://e.org"}'
 WHEN 2 THEN '{"source_id":"x","source_type":"1a"}' WHEN 3 THEN '["item1","item2"]'
 ELSE '{"source_id":null,"source_type":"1a","title":"t","data_link":"l","raw_dir":"r","target_schema":{"a":"string"}}' END
 AS cfg_json FROM supplier
"""

RESULTS = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"success":true,"file_path":"storage/raw/s/f","bytes":100}'
 WHEN 1 THEN '{"success":false,"message":"boom"}' WHEN 2 THEN '{"success":false}'
 WHEN 3 THEN '{"shape":{"rows":2,"columns":2}}' ELSE '"plain"' END AS result_json, value/1000 AS duration FROM events
"""

FAILURES = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'RuntimeError' WHEN 1 THEN 'KeyError' ELSE 'ToolExecutionError' END
  AS exception_class, CASE WHEN event_id % 4 = 0 THEN 'CsvReadError' END AS error_type,
 CASE WHEN event_id % 7 > 0 THEN 'boom '||cast(event_id as varchar(20)) END AS message,
 CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS recoverable, value/1000 AS duration FROM events
"""

DOWNLOADS = """
SELECT event_id, 'https://e.org/'||cast(event_id as varchar(20)) AS url,
 CASE WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 13 = 1 THEN '../up' ELSE 's'||cast(user_id % 20 as varchar(20)) END AS source_id,
 CASE WHEN event_id % 9 = 0 THEN '..' ELSE 'f'||cast(event_id as varchar(20))||'.json' END AS filename,
 props AS body, CASE WHEN event_id % 2 = 0 THEN 'application/json' END AS content_type FROM events
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, spread_by: str | None = None) -> DataFrame:
    """Run one of the texts above over the tables in ``sf_dir``; costly row-wise work names a key to spread by."""
    for name in ("pages", "events", "customer", "lineitem", "supplier"):
        if f"FROM {name}" in sql:
            rows = table(spark, sf_dir, name)
            (spread(rows, spread_by) if spread_by else rows).createOrReplaceTempView(name)
    return spark.sql(sql)
