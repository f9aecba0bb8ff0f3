"""The named queries as SQL over the same tables, for comparison by an independent engine."""

from __future__ import annotations

from tidemark.plans.inputs import MEMORY_SUFFIXES, METRIC_NAMES, SUFFIXES

DAY_US = 86_400 * 1_000_000
HOUR_US = 3_600 * 1_000_000
WEEK_US = 7 * DAY_US

ORACLE: dict[str, str] = {}

# --- text, scans, tables -------------------------------------------------------------------------

_TOKENS = """
  tokens AS (
    SELECT doc_id, unnest(
      CASE WHEN line = '' THEN ['']
           WHEN rtrim(line, ' ') = '' THEN CAST([] AS VARCHAR[])
           ELSE string_split(rtrim(line, ' '), ' ') END) AS word
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
"""
_WORDS = f"WITH {_TOKENS} SELECT word, count(*) AS n FROM tokens GROUP BY word"
for _name in ("words", "text_file_words", "stream_words", "triggered_stream_words", "restarted_stream_words"):
    ORACLE[_name] = _WORDS
ORACLE["document_tokens"] = f"""
WITH {_TOKENS}
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
       coalesce(t.n, 0) AS n_tokens
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id) t USING (doc_id)
"""
ORACLE["saved_pairs"] = f"SELECT '(' || word || ',' || n || ')' AS value FROM ({_WORDS})"
ORACLE["json_scan"] = """
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1
"""
ORACLE["record_values"] = "SELECT props AS value, count(*) AS n FROM events GROUP BY props"
ORACLE["range_gaps"] = """
SELECT r.id, coalesce(o.n, 0) AS n
FROM (SELECT unnest(range(0, (SELECT max(o_custkey) + 1 FROM orders))) AS id) r
LEFT JOIN (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) o USING (id)
"""
ORACLE["pi_from_lines"] = """
WITH k AS (SELECT l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 AS h FROM lineitem),
p AS (SELECT ((h * 48271) % 1000003) / 1000003.0::DOUBLE * 2 - 1 AS x,
             ((h * 69621) % 1000003) / 1000003.0::DOUBLE * 2 - 1 AS y FROM k)
SELECT inside, points, 4.0::DOUBLE * inside / points AS pi
FROM (SELECT count(*) FILTER (x * x + y * y <= 1) AS inside, count(*) AS points FROM p)
"""
ORACLE["table_round_trip"] = "SELECT c_custkey AS id, c_name AS name FROM customer"
ORACLE["appended_twice"] = "SELECT c_mktsegment AS segment, 2 * count(*) AS n FROM customer GROUP BY 1"
ORACLE["loaded_twice"] = "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1"
ORACLE["previewed_customers"] = "SELECT c_custkey, c_mktsegment FROM customer"
ORACLE["row_count"] = "SELECT count(*) AS n FROM lineitem"

# --- metric series -------------------------------------------------------------------------------

_SAMPLES = """
  samples AS (SELECT event_type AS metric, user_id AS series, epoch_us(ts) AS us, value FROM events)
"""
_DELTAS = f"""
  {_SAMPLES.strip()},
  counters AS (
    SELECT metric, series, us,
           round(sum(value) OVER (PARTITION BY metric, series, us // {WEEK_US} ORDER BY us), 2) AS value
    FROM samples),
  lagged AS (
    SELECT *, lag(value) OVER (PARTITION BY metric, series ORDER BY us) AS before FROM counters),
  deltas AS (
    SELECT *, CASE WHEN value < before THEN value ELSE value - before END AS delta FROM lagged)
"""


def _rates(window_us: int) -> str:
    return f"""
  {_DELTAS.strip()},
  rates AS (
    SELECT metric, series, us, value, increase, increase / {window_us / 1e6!r}::DOUBLE AS rate
    FROM (SELECT *, round(CASE WHEN before IS NOT NULL THEN sum(delta) OVER (
            PARTITION BY metric, series ORDER BY us
            RANGE BETWEEN {window_us - 1} PRECEDING AND CURRENT ROW) END, 6) AS increase
          FROM deltas))
"""


ORACLE["matched_labels"] = """
SELECT event_id, value FROM events
WHERE event_type = 'error' AND user_id % 5 <> 0
  AND regexp_full_match('app-' || user_id, 'app-1.*')
"""
ORACLE["counter_rates"] = f"""
WITH {_rates(WEEK_US)} SELECT * REPLACE (round(rate, 9) AS rate) FROM rates
"""
ORACLE["counter_increases"] = f"""
WITH {_DELTAS}
SELECT metric, series, round(coalesce(sum(delta), 0), 4) AS increase,
       count(*) FILTER (value < before) AS resets
FROM deltas
WHERE us > epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND us <= epoch_us(TIMESTAMP '2024-01-20 00:00:00')
GROUP BY metric, series
"""
ORACLE["counter_resets"] = f"""
WITH {_DELTAS} SELECT metric, series, us, before, value FROM deltas WHERE value < before
"""
ORACLE["container_restarts"] = f"""
WITH {_DELTAS}
SELECT metric, series, round(sum(coalesce(delta, value)), 4) AS restarts
FROM deltas GROUP BY metric, series
"""
ORACLE["step_maximum"] = f"""
SELECT event_type AS metric, epoch_us(ts) - epoch_us(ts) % {HOUR_US} AS step_us, max(value) AS max_value
FROM events GROUP BY 1, 2
"""
_PCT = f"""
  pct AS (
    SELECT step_us, used, "limit", used / nullif("limit", 0) * 100.0::DOUBLE AS pct
    FROM (SELECT epoch_us(ts) - epoch_us(ts) % {6 * HOUR_US} AS step_us,
                 max(value) FILTER (event_type = 'purchase') AS used,
                 max(value) FILTER (event_type = 'signup') AS "limit"
          FROM events GROUP BY 1)
    WHERE used IS NOT NULL AND "limit" IS NOT NULL)
"""
ORACLE["usage_percent"] = f"""
WITH {_PCT} SELECT step_us, used, "limit", round(pct, 6) AS pct FROM pct
"""
ORACLE["threshold_alerts"] = f"""
WITH {_PCT}
SELECT step_us, used, "limit", round(pct, 6) AS pct, 'warning' AS severity, 'sales' AS service
FROM pct WHERE pct > 90
"""
ORACLE["latest_values"] = """
SELECT event_type AS metric, user_id AS series, arg_max(value, ts) AS value, epoch_us(max(ts)) AS us
FROM events GROUP BY 1, 2
"""
ORACLE["current_totals"] = f"""
SELECT metric, round(sum(value), 4) AS total, count(*) AS series
FROM ({ORACLE["latest_values"]}) GROUP BY metric
"""
ORACLE["usage_windows"] = f"""
SELECT event_type AS metric, user_id AS series, epoch_us(ts) - epoch_us(ts) % {DAY_US} AS step_us,
       round(avg(value), 6) AS avg_value, max(value) AS max_value
FROM events GROUP BY 1, 2, 3
"""
ORACLE["network_rates"] = f"""
WITH {_rates(DAY_US)}
SELECT series, us - us % {DAY_US} AS step_us,
       round(max(rate) FILTER (metric = 'click'), 9) AS receive, round(max(rate) FILTER (metric = 'view'), 9) AS transmit
FROM rates WHERE metric IN ('click', 'view') GROUP BY 1, 2
"""
ORACLE["app_rollup"] = """
SELECT user_id AS app, event_id % 4 AS executor, event_type AS metric,
       arg_max(value, ts) AS last_value, max(value) AS peak, round(sum(value), 4) AS total,
       count(*) AS samples
FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2, 3
"""
_SECTIONS = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(METRIC_NAMES))
_METRICS = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(METRIC_NAMES.values()))
ORACLE["dashboard_rollup"] = f"""
SELECT l_suppkey AS app, l_partkey % 4 AS executor, CASE l_orderkey % 9 {_METRICS} END AS metric,
       CASE l_orderkey % 9 {_SECTIONS} END AS section,
       arg_max(l_quantity, (l_orderkey * 8 + l_linenumber) * 100 + l_quantity) AS last_value, max(l_quantity) AS peak,
       sum(l_quantity) AS total, count(*) AS samples
FROM lineitem GROUP BY 1, 2, 3, 4
"""
ORACLE["variable_values"] = "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL"
ORACLE["scoped_samples"] = """
SELECT event_id, event_type, value FROM events
WHERE event_type IN ('click', 'error')
  AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00'
"""
ORACLE["resampled"] = f"""
SELECT event_type AS metric, user_id AS series, epoch_us(ts) - epoch_us(ts) % {DAY_US} AS step_us,
       arg_max(value, ts) AS value, count(*) AS samples
FROM events GROUP BY 1, 2, 3
"""
_GAPS = f"""
  seen AS (
    SELECT DISTINCT event_type AS metric, user_id AS series,
           epoch_us(ts) - epoch_us(ts) % {DAY_US} AS step_us FROM events),
  gaps AS (
    SELECT metric, series, before_us AS last_seen_us, step_us AS seen_again_us,
           (step_us - before_us) // {DAY_US} - 1 AS missing
    FROM (SELECT *, lag(step_us) OVER (PARTITION BY metric, series ORDER BY step_us) AS before_us
          FROM seen)
    WHERE step_us - before_us > {DAY_US})
"""
ORACLE["scrape_gaps"] = f"WITH {_GAPS} SELECT * FROM gaps"
ORACLE["missing_steps"] = f"""
WITH {_GAPS}
SELECT metric, series, unnest(range(last_seen_us + {DAY_US}, seen_again_us, {DAY_US})) AS step_us FROM gaps
"""

# --- alerts --------------------------------------------------------------------------------------

_STATES = f"""
  steps AS (
    SELECT event_type AS metric, epoch_us(ts) - epoch_us(ts) % {2 * HOUR_US} AS step_us, value
    FROM events),
  grid AS (
    SELECT metric, step_us
    FROM (SELECT DISTINCT metric FROM steps),
         (SELECT unnest(range(min(step_us), max(step_us) + 1, {2 * HOUR_US})) AS step_us FROM steps)),
  hits AS (SELECT metric, step_us FROM steps GROUP BY 1, 2 HAVING max(value) > 60),
  states AS (
    SELECT g.metric, g.step_us, CASE WHEN h.metric IS NULL THEN 'inactive' ELSE 'firing' END AS state
    FROM grid g LEFT JOIN hits h ON g.metric = h.metric AND g.step_us = h.step_us)
"""
ORACLE["alert_states"] = f"WITH {_STATES} SELECT * FROM states"
ORACLE["alert_transitions"] = f"""
WITH {_STATES}
SELECT metric, step_us, from_state, state AS to_state
FROM (SELECT *, lag(state, 1, 'inactive') OVER (PARTITION BY metric ORDER BY step_us) AS from_state
      FROM states)
WHERE state <> from_state
"""
ORACLE["alert_episodes"] = f"""
WITH {_STATES},
runs AS (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY step_us)
          - row_number() OVER (PARTITION BY metric, state ORDER BY step_us) AS run FROM states)
SELECT metric, min(step_us) AS start_us, max(step_us) AS end_us, count(*) AS steps,
       (max(step_us) - min(step_us)) / 1000000.0::DOUBLE AS seconds
FROM runs WHERE state = 'firing' GROUP BY metric, run
"""
ORACLE["degraded_orders"] = """
SELECT * FROM (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS ready, count(*) AS wanted
               FROM lineitem GROUP BY 1)
WHERE ready < wanted
"""
ORACLE["absent_lines"] = """
SELECT o_orderkey AS l_orderkey, CAST(i AS INTEGER) AS l_linenumber FROM orders, range(1, 8) t(i)
EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem
"""
ORACLE["reached_in_time"] = """
SELECT user_id, start_us, reached_us, round((reached_us - start_us) / 1000000.0::DOUBLE, 6) AS seconds,
       coalesce((reached_us - start_us) / 1000000.0::DOUBLE <= 86400, FALSE) AS in_time
FROM (SELECT user_id, min(epoch_us(ts)) AS start_us,
             min(epoch_us(ts)) FILTER (event_type = 'error') AS reached_us
      FROM events GROUP BY 1)
"""
ORACLE["health"] = """
SELECT l_suppkey,
       CASE WHEN NOT bool_or(l_linestatus = 'O' AND l_quantity > 49) THEN 'DOWN'
            WHEN NOT bool_and(CASE WHEN l_tax <= 0.06::DOUBLE THEN l_discount < 0.1::DOUBLE END) THEN 'DEGRADED'
            ELSE 'UP' END AS status
FROM lineitem GROUP BY 1
"""
_PHASES = ("Failed", "Pending", "Running", "Succeeded", "Unknown")
ORACLE["pod_counts"] = (
    "SELECT c_nationkey AS namespace, count(*) AS pods, count(*) FILTER (c_custkey % 5 = 2) AS active, "
    + ", ".join(
        f"count(*) FILTER (c_custkey % 5 = {n}) AS {p.lower()}" for n, p in enumerate(_PHASES)
    )
    + " FROM customer GROUP BY 1"
)
ORACLE["stream_threshold_alerts"] = f"""
SELECT grp, step_us, used, "limit", round(pct, 6) AS pct, 'warning' AS severity
FROM (SELECT *, used / nullif("limit", 0) * 100.0::DOUBLE AS pct
      FROM (SELECT user_id % 10 AS grp, epoch_us(ts) - epoch_us(ts) % {DAY_US} AS step_us,
                   max(value) FILTER (event_type = 'purchase') AS used,
                   max(value) FILTER (event_type = 'signup') AS "limit"
            FROM events GROUP BY 1, 2))
WHERE pct > 90
  AND step_us + {DAY_US} <= (SELECT (max(epoch_us(ts)) // 1000) * 1000 - {HOUR_US} FROM events)
"""

ORACLE["component_alerts"] = f"""
WITH e AS (
  SELECT * FROM (
    SELECT *, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(ts) % {HOUR_US // 2} AS step_us,
           CASE WHEN user_id % 2 = 0 THEN 'Controller' ELSE 'Webhook' END AS component,
           user_id % 11 <> 0 AND user_id % 7 <> 0 AS counted
    FROM events)
  WHERE us >= {1_704_499_200_000_000 - DAY_US} AND us < 1706313600000000),
growth AS (
  SELECT *, CASE WHEN value < before THEN value ELSE value - before END AS delta
  FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY us) AS before
        FROM e WHERE event_type = 'click' AND counted)),
rates AS (
  SELECT component, step_us,
         round(sum(delta) OVER (PARTITION BY user_id ORDER BY us
           RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW), 6) / 86400.0::DOUBLE AS rate,
         before
  FROM growth),
cpu AS (
  SELECT component, step_us FROM
    (SELECT component, step_us, max(rate) FILTER (before IS NOT NULL) AS used FROM rates GROUP BY 1, 2)
    JOIN (SELECT component, step_us, max(value / 20000) AS lim FROM e
          WHERE event_type = 'signup' GROUP BY 1, 2) USING (component, step_us)
  WHERE used / nullif(lim, 0) * 100.0::DOUBLE > 90),
memory AS (
  SELECT component, step_us FROM
    (SELECT component, step_us, max(value) AS used FROM e
     WHERE event_type = 'purchase' AND counted GROUP BY 1, 2)
    JOIN (SELECT component, step_us, max(value) AS lim FROM e
          WHERE event_type = 'view' GROUP BY 1, 2) USING (component, step_us)
  WHERE used / nullif(lim, 0) * 100.0::DOUBLE > 80),
low AS (
  SELECT DISTINCT component, step_us FROM
    (SELECT component, user_id, step_us, arg_max(event_id % 3, us) AS ready
     FROM e WHERE event_type = 'signup' GROUP BY 1, 2, 3)
  WHERE ready < 2),
steps AS (
  SELECT component, step_us
  FROM (VALUES ('Controller'), ('Webhook')) c(component),
       (SELECT unnest(range(1704499200000000, 1706313600000000, {HOUR_US // 2})) AS step_us)),
down AS (
  SELECT component, step_us FROM steps
  EXCEPT
  SELECT component, step_us FROM e WHERE event_type = 'error' AND event_id % 2 = 1)
SELECT alert, severity, 'ns' AS namespace, 'release' AS service, step_us FROM (
  SELECT component || 'CPUUsage' AS alert, 'warning' AS severity, step_us FROM cpu
  UNION ALL SELECT component || 'MemoryUsage', 'warning', step_us FROM memory
  UNION ALL SELECT component || 'IsDegraded', 'high', step_us FROM low
  UNION ALL SELECT component || 'IsDown', 'critical', step_us FROM down)
WHERE step_us >= 1704499200000000
"""

# --- durations -----------------------------------------------------------------------------------

_RUNS = """
  runs AS (
    SELECT o_orderstatus, (epoch_us(ended) - epoch_us(o_orderdate)) / 1000000.0::DOUBLE AS run_s,
           CASE WHEN o_orderkey % 50 <> 0 THEN (o_orderkey * 7919 % 14400)::DOUBLE END AS latency_s
    FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS ended FROM lineitem GROUP BY 1)
      ON o_orderkey = l_orderkey)
"""
ORACLE["mean_durations"] = f"""
WITH {_RUNS} SELECT o_orderstatus, round(avg(run_s), 3) AS mean_s, count(run_s) AS n FROM runs GROUP BY 1
"""
ORACLE["start_latency"] = f"""
WITH {_RUNS}
SELECT o_orderstatus, round(avg(latency_s), 3) AS mean_s, count(latency_s) AS n FROM runs GROUP BY 1
"""


def _histogram(edges: list[int], seconds: str) -> str:
    buckets = ", ".join(f"({i}, {e}::DOUBLE)" for i, e in enumerate(edges)) + f", ({len(edges)}, NULL)"
    return f"""
WITH {_RUNS},
buckets AS (SELECT * FROM (VALUES {buckets}) b(i, le)),
counted AS (
  SELECT o_orderstatus, i, le, count(*) FILTER ({seconds} <= coalesce(le, 'infinity'::DOUBLE)) AS cumulative
  FROM runs, buckets GROUP BY 1, 2, 3)
SELECT o_orderstatus, le, cumulative,
       cumulative - coalesce(lag(cumulative) OVER (PARTITION BY o_orderstatus ORDER BY i), 0) AS n
FROM counted
"""


ORACLE["latency_histogram"] = _histogram([d * 86_400 for d in (-1000, -100, 0, 30, 365, 1000)], "run_s")
ORACLE["start_latency_histogram"] = _histogram([60, 300, 900, 3600, 10_000, 14_400, 20_000], "latency_s")

# --- event logs ----------------------------------------------------------------------------------

ORACLE["eventlog_files"] = """
SELECT 'SparkListenerJobStart' AS event, count(*) AS n FROM orders
UNION ALL
SELECT 'SparkListenerJobEnd', count(*) FROM orders WHERE o_orderstatus <> 'O'
"""
ORACLE["app_list"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS app, o_orderpriority AS name, CAST(o_custkey AS VARCHAR) AS "user",
       epoch_ms(o_orderdate) AS start_ms,
       CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) + (o_orderkey % 1000 + 1) * 1000 END AS end_ms,
       CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 1000 + 1) * 1000 END AS duration_ms,
       CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'RUNNING' END AS state
FROM orders
"""
ORACLE["job_summary"] = """
SELECT CAST(o_custkey AS VARCHAR) AS app, o_orderkey AS job, epoch_ms(o_orderdate) AS submitted_ms,
       CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + (o_orderkey % 100 + 1) * 1000 END AS completed_ms,
       o_orderkey % 4 + 1 AS stages,
       CASE o_orderstatus WHEN 'F' THEN 'JobSucceeded' WHEN 'P' THEN 'JobFailed' END AS result,
       CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey % 100 + 1) * 1000 END AS duration_ms
FROM orders
"""
ORACLE["stage_summary"] = """
SELECT CAST(o_custkey AS VARCHAR) AS app, o_orderkey % 5 AS stage, 'stage ' || (o_orderkey % 5) AS name,
       count(*) AS attempts, CAST(sum(o_orderkey % 7 + 1) AS BIGINT) AS tasks,
       CAST(sum((o_orderkey % 60 + 1) * 500) AS BIGINT) AS busy_ms,
       count(*) FILTER (o_orderstatus = 'P') AS failed_attempts
FROM orders GROUP BY o_custkey, o_orderkey % 5
"""
ORACLE["task_summary"] = """
WITH t AS (
  SELECT l_suppkey, l_linenumber, l_returnflag, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
g AS (
  SELECT l_suppkey, l_linenumber, count(*) AS tasks, count(*) FILTER (l_returnflag = 'R') AS failed,
         sum(q) AS total, max(q) AS biggest, list_sort(list(q)) AS sorted
  FROM t GROUP BY 1, 2)
SELECT CAST(l_suppkey AS VARCHAR) AS app, CAST(l_linenumber AS BIGINT) AS stage, CAST(0 AS BIGINT) AS attempt,
       tasks, failed, CAST(total * 900 AS BIGINT) AS run_ms,
       round(total * 1000 / tasks::DOUBLE, 3) AS avg_ms, biggest * 1000 AS max_ms,
       CAST(total * 4096 AS BIGINT) AS input_bytes,
       sorted[CAST(ceil(tasks * 0.5::DOUBLE) AS BIGINT)] * 1000 AS p50_ms,
       sorted[CAST(ceil(tasks * 0.95::DOUBLE) AS BIGINT)] * 1000 AS p95_ms
FROM g
"""
ORACLE["executor_summary"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS app, CAST(x AS VARCHAR) AS executor, min(epoch_ms(l_shipdate)) AS added_ms,
       CASE WHEN x % 2 = 0 THEN max(epoch_ms(l_shipdate)) + 3600000 END AS removed_ms,
       CASE WHEN x % 2 = 0 THEN 'idle' END AS reason,
       'host-' || x AS host, x % 4 + 1 AS cores, count(*) AS tasks,
       count(*) FILTER (l_returnflag = 'R') AS failed, CAST(sum(q) * 900 AS BIGINT) AS run_ms,
       CAST(sum(q) * 10 AS BIGINT) AS gc_ms, CAST(sum(q) * 4096 AS BIGINT) AS input_bytes
FROM (SELECT *, l_partkey % 10 AS x, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_suppkey, x
"""
ORACLE["sql_summary"] = """
SELECT CAST(o_custkey AS VARCHAR) AS app, o_orderkey AS execution, o_orderpriority AS description,
       epoch_ms(o_orderdate) AS started_ms,
       CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + (o_orderkey % 50 + 1) * 100 END AS ended_ms,
       CASE WHEN o_orderstatus = 'P' THEN 'boom ' || o_orderkey END AS error,
       CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey % 50 + 1) * 100 END AS duration_ms,
       CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'P' THEN 'FAILED' ELSE 'COMPLETED' END AS state
FROM orders
"""
ORACLE["retained_files"] = """
SELECT app, seq, CAST(age AS INTEGER) AS age
FROM (SELECT o_custkey AS app, o_orderkey AS seq,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS age FROM orders)
WHERE age <= 5
"""

# --- logs ----------------------------------------------------------------------------------------

ORACLE["attached_lines"] = """
SELECT 'user-' || user_id AS file, event_id * 4 AS record_no,
       CAST(CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS BIGINT) AS n,
       event_id * 4 + CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS last_line
FROM events
"""
_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"
_LOGGER = "upper(event_type[1]) || event_type[2:]"
ORACLE["parsed_logs"] = f"""
SELECT 'user-' || user_id AS file, event_id * 4 AS record_no, epoch_us(date_trunc('second', ts)) AS ts_us,
       {_LEVEL} AS level, {_LOGGER} AS logger, 'event ' || event_id || ' ' || props AS message,
       CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS BIGINT) AS trace_lines,
       CASE WHEN event_type = 'error' THEN 'java.nio.file.AccessDeniedException: ./f' || event_id || '.jar' END AS cause
FROM events
"""
ORACLE["trace_lines"] = """
SELECT 'user-' || user_id AS file, event_id * 4 AS record_no, event_id * 4 + i AS line_no,
       CASE i WHEN 1 THEN 'java.nio.file.AccessDeniedException: ./f' || event_id || '.jar'
              ELSE chr(9) || 'at step.Run(' || event_id || ')' END AS text
FROM events, (VALUES (1), (2)) t(i) WHERE event_type = 'error'
"""
_LOG_LEVELS = f"""
SELECT {_LEVEL} AS level, {_LOGGER} AS logger, count(*) AS n,
       epoch_us(ts) - epoch_us(ts) % {DAY_US} AS step_us
FROM events GROUP BY 1, 2, 4
"""
ORACLE["log_levels"] = _LOG_LEVELS
ORACLE["scanned_log_levels"] = _LOG_LEVELS
ORACLE["signature_hits"] = """
SELECT source, count(*) AS hits FROM documents WHERE contains(text, 'License') GROUP BY source
"""
ORACLE["signature_missing"] = """
SELECT DISTINCT source FROM documents
WHERE source NOT IN (SELECT source FROM documents WHERE contains(text, 'MIT'))
"""
ORACLE["parsed_batches"] = f"""
SELECT 'driver-' || (epoch_us(ts) // {HOUR_US} % 3) AS file, epoch_us(ts) // {HOUR_US} * 3600000 AS time_ms,
       'u' || user_id AS word, count(*) AS n
FROM events GROUP BY epoch_us(ts) // {HOUR_US}, user_id
"""
_AUDIT = """
  audit AS (
    SELECT r.*, epoch_us(date_trunc('second', ts)) AS ts_us,
           CASE WHEN event_type = 'signup' THEN '10.0.0.' || (event_id % 250) END AS ip,
           CASE WHEN event_type = 'signup' THEN 's' || event_id END AS session,
           CASE WHEN event_type = 'signup' THEN 'user' || user_id || '@example.com' END AS "user",
           CASE WHEN event_type = 'signup' THEN epoch_us(ts) END AS created_us,
           CASE WHEN event_type = 'signup' THEN epoch_us(ts) + (event_id % 900 + 60) * 1000000 END AS expires_us,
           CASE WHEN event_type = 'signup' THEN 'role:all role:g' || (user_id % 7) END AS groups
    FROM events JOIN (VALUES
      ('signup', 'High', 'Oauth2 Proxy', 'Login'),
      ('signup', 'High', 'Oauth2 Proxy', 'create session'),
      ('click', 'Low', 'Spark History Server', 'start/stop server-application'),
      ('view', 'Low', 'Spark History Server', 'start/stop server-application')
    ) r(kind, priority, service, event) ON event_type = r.kind)
"""
ORACLE["audit_events"] = f"""
WITH {_AUDIT}
SELECT priority, service, event, ts_us, ip, session, "user", created_us, expires_us, groups FROM audit
"""
ORACLE["audit_sessions"] = f"""
WITH {_AUDIT},
lengths AS (
  SELECT "user", (expires_us - created_us) / 1000000.0::DOUBLE AS s FROM audit WHERE event = 'Login')
SELECT "user", count(*) AS sessions, round(avg(s), 3) AS mean_s, round(max(s), 3) AS longest_s
FROM lengths GROUP BY 1
"""

# --- status --------------------------------------------------------------------------------------

ORACLE["current_states"] = """
SELECT conv_id, arg_max(role, turn) AS state, max(turn) AS turn FROM conversations GROUP BY 1
"""
ORACLE["state_counts"] = f"""
SELECT state, count(*) AS n FROM ({ORACLE["current_states"]}) GROUP BY 1
"""
ORACLE["states_in_order"] = """
WITH k AS (SELECT DISTINCT conv_id FROM conversations),
a AS (SELECT conv_id, min(turn) AS t FROM conversations WHERE role = 'system' GROUP BY 1),
b AS (SELECT c.conv_id, min(c.turn) AS t FROM conversations c JOIN a USING (conv_id)
      WHERE c.role = 'user' AND c.turn > a.t GROUP BY 1),
d AS (SELECT c.conv_id, min(c.turn) AS t FROM conversations c JOIN b USING (conv_id)
      WHERE c.role = 'assistant' AND c.turn > b.t GROUP BY 1)
SELECT conv_id, reached, reached = 3 AS in_order
FROM (SELECT k.conv_id, CAST((a.t IS NOT NULL)::INT + (b.t IS NOT NULL)::INT + (d.t IS NOT NULL)::INT AS INTEGER) AS reached
      FROM k LEFT JOIN a USING (conv_id) LEFT JOIN b USING (conv_id) LEFT JOIN d USING (conv_id))
"""
ORACLE["matched_pods"] = """
SELECT c_nationkey AS namespace,
       bool_or(contains('app-' || c_custkey || '-driver', 'app-77') AND c_custkey % 5 = 2) AS matched
FROM customer GROUP BY 1
"""
ORACLE["queued_pods"] = """
SELECT c_nationkey AS namespace, bool_or(c_custkey % 5 = 1 AND c_custkey % 3 = 0) AS queued,
       count(*) FILTER (c_custkey % 5 = 1 AND c_custkey % 3 = 0) AS waiting
FROM customer GROUP BY 1
"""
ORACLE["retry_report"] = """
WITH f AS (
  SELECT user_id AS app, CASE WHEN event_type = 'error' THEN 'run' ELSE 'submit' END AS kind, epoch_us(ts) AS us
  FROM events WHERE event_type IN ('error', 'signup')),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY app, kind ORDER BY us) AS gap FROM f),
t AS (SELECT app, kind, count(*) AS failures, min(gap) / 1000000.0::DOUBLE AS min_gap_s FROM g GROUP BY 1, 2)
SELECT app, kind, failures, round(min_gap_s, 6) AS min_gap_s,
       CASE app % 3 WHEN 1 THEN failures > CASE kind WHEN 'run' THEN 4 ELSE 6 END
                    WHEN 2 THEN failures > 1 END AS over_budget,
       CASE app % 3 WHEN 1 THEN coalesce(min_gap_s < CASE kind WHEN 'run' THEN 1800 ELSE 3600 END, FALSE)
                    WHEN 2 THEN FALSE END AS too_fast
FROM t
"""

# --- fleet ---------------------------------------------------------------------------------------

_MANIFEST = """
  declared AS (
    SELECT 'deployment' AS type, 'part-' || p_partkey AS name, 'main' AS container,
           'registry.example:5000/' || lower(p_type) || '/app:v' || p_size AS image, p_partkey, p_size, p_type
    FROM part
    UNION ALL
    SELECT 'daemonset', 'part-' || p_partkey, 'agent', 'agent:1.' || p_partkey, p_partkey, p_size, p_type
    FROM part)
"""
ORACLE["manifest_items"] = f"WITH {_MANIFEST} SELECT type, name, container, image FROM declared"
ORACLE["image_mismatches"] = f"""
WITH {_MANIFEST}
SELECT type, name, container, image,
       CASE type WHEN 'deployment' THEN 'registry.example:5000/' || lower(p_type) || '/app:v40' END AS running_image,
       CASE type WHEN 'deployment' THEN 'mismatch' ELSE 'missing' END AS problem
FROM declared
WHERE (type = 'deployment' AND p_size > 40) OR (type = 'daemonset' AND p_partkey % 7 = 0)
"""
_REFS = """
  refs AS (
    SELECT p_partkey, p_size, lower(replace(p_brand, '#', '-')) AS brand,
           CASE p_partkey % 4 WHEN 0 THEN lower(replace(p_brand, '#', '-')) || ':' || p_size
                WHEN 1 THEN lower(replace(p_brand, '#', '-'))
                ELSE 'registry.example:5000/team/' || lower(replace(p_brand, '#', '-')) || ':' || p_size
           END AS image_ref
    FROM part)
"""
ORACLE["image_parts"] = f"""
WITH {_REFS}
SELECT p_partkey,
       CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'registry.example:5000' END AS registry,
       CASE p_partkey % 4 WHEN 0 THEN brand WHEN 1 THEN NULL ELSE 'team/' || brand END AS repository,
       CASE WHEN p_partkey % 4 <> 1 THEN CAST(p_size AS VARCHAR) END AS tag
FROM refs
"""
ORACLE["retagged_images"] = f"""
WITH {_REFS},
rel AS (
  SELECT lower(replace(p_brand, '#', '-')) AS brand, max(p_size) AS newest
  FROM part WHERE NOT p_brand LIKE '%3' GROUP BY 1),
j AS (
  SELECT p_partkey, image_ref, refs.brand, newest,
         p_partkey % 4 IN (2, 3) AND newest IS NOT NULL AND newest <> p_size AS changed
  FROM refs LEFT JOIN rel USING (brand))
SELECT p_partkey, image_ref, changed,
       CASE WHEN changed THEN 'registry.example:5000/team/' || brand || ':' || newest ELSE image_ref END AS new_ref
FROM j
"""
ORACLE["config_drift"] = """
SELECT p_partkey AS doc_id, 'size' AS path, '10' AS expected, CAST(p_size AS VARCHAR) AS actual
FROM part WHERE p_size <> 10
UNION ALL
SELECT p_partkey, 'serial', '9007199254740992', '9007199254740993' FROM part WHERE p_partkey % 2 = 1
UNION ALL
SELECT p_partkey, 'meta.brand', '"Brand#2"', '"' || p_brand || '"' FROM part WHERE p_brand <> 'Brand#2'
UNION ALL
SELECT p_partkey, 'prices.[0].tier', '1', CAST(p_partkey % 2 AS VARCHAR) FROM part WHERE p_partkey % 2 <> 1
UNION ALL
SELECT p_partkey, 'prices.[1].tier', '1', CAST(p_partkey % 3 AS VARCHAR) FROM part WHERE p_partkey % 3 <> 1
"""
_FACTOR = {
    "": "p_size",
    "m": "p_size / 1000.0::DOUBLE",
    "K": "p_size * 1e3::DOUBLE",
    "M": "p_size * 1e6::DOUBLE",
    "G": "p_size * 1e9::DOUBLE",
    "T": "p_size * 1e12::DOUBLE",
    "Ki": f"p_size * {2**10}.0::DOUBLE",
    "Mi": f"p_size * {2**20}.0::DOUBLE",
    "Gi": f"p_size * {2**30}.0::DOUBLE",
    "Ti": f"p_size * {2**40}.0::DOUBLE",
    "g": f"p_size * {2**30}.0::DOUBLE",
}
ORACLE["quantities"] = (
    f"SELECT p_partkey, CAST(CASE p_partkey % {len(SUFFIXES)} "
    + " ".join(f"WHEN {n} THEN {_FACTOR[s]}" for n, s in enumerate(SUFFIXES) if s in _FACTOR)
    + " END AS DOUBLE) AS amount FROM part"
)
_POWERS = {"m": 20, "g": 30, "k": 10, "": 20, "MB": 20, "t": 40, "b": 0}
ORACLE["spark_memory_settings"] = (
    f"SELECT p_partkey, CASE p_partkey % {len(MEMORY_SUFFIXES)} "
    + " ".join(
        f"WHEN {n} THEN p_size * {2 ** _POWERS[s]}::BIGINT" for n, s in enumerate(MEMORY_SUFFIXES) if s in _POWERS
    )
    + " END AS n_bytes FROM part"
)
ORACLE["retagged_nodes"] = """
WITH rel AS (
  SELECT lower(replace(p_brand, '#', '-')) AS brand, max(p_size) AS newest
  FROM part WHERE NOT p_brand LIKE '%3' GROUP BY 1),
j AS (
  SELECT p_partkey, p_size, r.brand, newest, p_partkey % 4 AS w,
         coalesce(p_partkey % 4 <> 3 AND newest <> p_size, FALSE) AS changed
  FROM (SELECT *, lower(replace(p_brand, '#', '-')) AS brand FROM part) r LEFT JOIN rel USING (brand))
SELECT p_partkey, changed,
       CASE w WHEN 0 THEN 'registry.example:5000/team/' || brand WHEN 1 THEN 'registry.example:5000/'
              WHEN 3 THEN 'registry.example:5000' END AS registry,
       CASE w WHEN 1 THEN '/team/' || brand WHEN 2 THEN 'registry.example:5000/team/' || brand
              WHEN 3 THEN 'team/' || brand END AS repository,
       CASE WHEN w <> 3 THEN CAST(CASE WHEN changed THEN newest ELSE p_size END AS VARCHAR) END AS tag
FROM j
"""
ORACLE["profile_capacity"] = """
SELECT profile, optional, temporary, CAST(sum(tenths * n) AS DOUBLE) / 10 AS cpu,
       CAST(sum(tenths * 100 * n) AS BIGINT) AS mem_mi, CAST(sum(n) AS BIGINT) AS containers
FROM (SELECT p_type AS profile, p_size % 2 = 0 AS optional, p_size % 3 = 0 AS temporary,
             p_size AS tenths, p_partkey % 3 + 1 AS n FROM part)
GROUP BY GROUPING SETS ((profile, optional, temporary), (profile), ())
"""
ORACLE["uri_parts"] = """
SELECT page_id, split_part(u, '/', 3) AS bucket,
       array_to_string(string_split(u, '/')[4:], '/') AS "key"
FROM (SELECT page_id, regexp_replace(url, '/$', '') AS u FROM pages)
"""
ORACLE["http_status"] = """
SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 END AS INTEGER) AS code,
       CASE page_id % 4 WHEN 0 THEN 'exists' WHEN 1 THEN 'missing' ELSE 'unknown' END AS found
FROM pages
"""

# --- reports -------------------------------------------------------------------------------------

ORACLE["region_revenue"] = """
SELECT r_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
"""
ORACLE["merged_orders"] = """
SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority, count(*) AS n
FROM orders GROUP BY 1, 2
"""
ORACLE["pushed_scan"] = """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'
"""
ORACLE["partition_scan"] = """
SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1
"""
ORACLE["saved_table"] = "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"
ORACLE["order_customer"] = """
SELECT c_mktsegment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
"""
ORACLE["customer_orders_outer"] = """
SELECT c_custkey, count(o_orderkey) AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
"""
ORACLE["supplier_customer_nations"] = """
SELECT coalesce(s.nation, c.nation) AS nation, suppliers, customers
FROM (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) s
FULL JOIN (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) c
  ON s.nation = c.nation
"""
ORACLE["idle_orders"] = """
SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""
ORACLE["active_orders"] = """
SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""
ORACLE["price_band"] = """
SELECT n_nationkey AS band, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total
FROM orders JOIN nation
  ON o_totalprice >= n_nationkey * 20000 AND o_totalprice < n_nationkey * 20000 + 30000
GROUP BY 1
"""
ORACLE["nation_dim_join"] = """
SELECT n_name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
"""
ORACLE["pricing_summary"] = """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base,
       CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS sum_disc,
       avg(l_quantity) AS avg_qty, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
       count(*) FILTER (l_quantity > 25) AS large
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2
"""
ORACLE["approximate_suppliers"] = """
SELECT l_returnflag, count(DISTINCT l_suppkey) AS exact, TRUE AS near FROM lineitem GROUP BY 1
"""
_SALES = (
    "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, "
    "count(*) AS n FROM lineitem GROUP BY "
)
ORACLE["sales_rollup"] = _SALES + "ROLLUP (l_returnflag, l_linestatus)"
ORACLE["sales_cube"] = _SALES + "CUBE (l_returnflag, l_linestatus)"
ORACLE["sales_grouping_sets"] = _SALES + "GROUPING SETS ((l_returnflag), (l_linestatus))"
ORACLE["top_orders_per_customer"] = """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place
      FROM orders) WHERE place <= 3
"""
ORACLE["running_total"] = """
SELECT o_custkey, o_orderkey,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DOUBLE) AS total
FROM orders
"""
ORACLE["price_against_previous"] = """
SELECT o_custkey, o_orderkey,
       CAST(CAST(o_totalprice AS DECIMAL(12,2))
         - lag(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS change
FROM orders
"""
ORACLE["top_parts"] = """
SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM lineitem GROUP BY 1 ORDER BY qty DESC, l_partkey LIMIT 10
"""
ORACLE["nation_sets"] = """
WITH s AS (SELECT s_nationkey AS nation FROM supplier),
c AS (SELECT c_nationkey AS nation FROM customer)
SELECT 'union' AS how, nation FROM (SELECT * FROM s UNION SELECT * FROM c)
UNION ALL SELECT 'intersect', nation FROM (SELECT * FROM s INTERSECT SELECT * FROM c)
UNION ALL SELECT 'except', nation FROM (SELECT * FROM s EXCEPT SELECT * FROM c)
UNION ALL SELECT 'except_all', nation FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM c)
"""
ORACLE["props_json"] = """
SELECT event_type, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k, count(k) AS n
FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1
"""
ORACLE["scalar_functions"] = """
SELECT p_partkey, upper(p_name) AS upper_name, CAST(substr(p_brand, 7, 5) AS INTEGER) AS brand_no,
       CAST(len(w) AS BIGINT) AS n_words, w[-1] AS last_word,
       array_to_string(list_sort(w), '+') AS sorted_words, CAST(floor(sqrt(p_size)) AS BIGINT) AS root,
       p_partkey % 7 AS mod7, coalesce(nullif(p_size, 10), -1) AS size_or
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
"""
ORACLE["order_calendar"] = """
SELECT year(o_orderdate) AS "year", month(o_orderdate) AS "month", count(*) AS n FROM orders GROUP BY 1, 2
"""
ORACLE["above_average_orders"] = """
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders)
SELECT o_orderkey, o_custkey FROM o
WHERE price * (SELECT count(*) FROM o b WHERE b.o_custkey = o.o_custkey)
    > (SELECT sum(price) FROM o b WHERE b.o_custkey = o.o_custkey)
"""
ORACLE["largest_orders"] = """
SELECT c_custkey, c_mktsegment FROM customer c
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)
  AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 450000)
"""

# --- values as of an instant, open intervals, sessions, partial loads ----------------------------

ORACLE["as_of_values"] = f"""
WITH e AS (SELECT user_id AS series, epoch_us(ts) AS us, event_type, value FROM events),
v AS (SELECT series, us, value FROM e WHERE event_type = 'view')
SELECT p.series, p.us, p.value, CASE WHEN p.us - v.us <= {DAY_US} THEN v.us END AS since,
       CASE WHEN p.us - v.us <= {DAY_US} THEN v.value END AS seen
FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.series = v.series AND p.us >= v.us
"""
ORACLE["lookback_alerts"] = f"""
WITH s AS (
  SELECT user_id % 10 AS grp, epoch_us(ts) - epoch_us(ts) % {900 * 10**6} AS step_us,
         max(value) FILTER (event_type = 'purchase') AS used, max(value) FILTER (event_type = 'signup') AS "limit"
  FROM events GROUP BY 1, 2),
j AS (
  SELECT u.grp, u.step_us, u.used, l."limit", u.used / nullif(l."limit", 0) * 100.0::DOUBLE AS pct
  FROM (SELECT * FROM s WHERE used IS NOT NULL) u
  ASOF JOIN (SELECT * FROM s WHERE "limit" IS NOT NULL) l ON u.grp = l.grp AND u.step_us >= l.step_us
  WHERE u.step_us - l.step_us <= {12 * HOUR_US})
SELECT grp, step_us, used, "limit", round(pct, 6) AS pct, 'warning' AS severity FROM j WHERE pct > 90
"""


def _swept(intervals: str, key: str) -> str:
    """The number of open intervals ``s, e`` (microseconds) of a key after each change."""
    return f"""
  iv AS ({intervals}),
  ch AS (
    SELECT {key}, s AS us, 1 AS c FROM iv WHERE e IS NULL OR e > s
    UNION ALL SELECT {key}, e, -1 FROM iv WHERE e > s),
  net AS (SELECT {key}, us, sum(c) AS c FROM ch GROUP BY 1, 2 HAVING sum(c) <> 0),
  swept AS (SELECT {key}, us, CAST(sum(c) OVER (PARTITION BY {key} ORDER BY us) AS BIGINT) AS "open" FROM net)
"""


ORACLE["concurrent_apps"] = f"""
WITH {_swept(f'SELECT name, start_ms * 1000 AS s, end_ms * 1000 AS e FROM ({ORACLE["app_list"]})', "name")},
l AS (
  SELECT *, lag(us) OVER (PARTITION BY name ORDER BY us) AS since,
         lag("open") OVER (PARTITION BY name ORDER BY us) AS held FROM swept),
p AS (
  SELECT name, us - us % {DAY_US} AS step_us, "open" AS n FROM l
  UNION ALL
  SELECT name, unnest(range(since - since % {DAY_US}, us, {DAY_US})), held FROM l WHERE held > 0)
SELECT name, step_us, max(n) AS peak FROM p GROUP BY 1, 2 HAVING max(n) > 0
"""
ORACLE["running_executors"] = f"""
WITH {_swept(f'SELECT app, added_ms * 1000 AS s, removed_ms * 1000 AS e FROM ({ORACLE["executor_summary"]})', "app")}
SELECT * FROM swept
"""
_CLOSED = f"(epoch_us(max(ts)) // 1000) * 1000 - {HOUR_US}"
ORACLE["stream_degraded_groups"] = f"""
WITH d AS (
  SELECT user_id % 50 AS grp, epoch_us(ts) - epoch_us(ts) % {DAY_US} AS step_us,
         arg_max(value, ts) FILTER (event_type = 'signup') AS ready,
         arg_max(value, ts) FILTER (event_type = 'click') AS wanted
  FROM events GROUP BY 1, 2)
SELECT * FROM d
WHERE ready < wanted AND step_us + {DAY_US} <= (
  SELECT min(c) FROM (SELECT {_CLOSED} AS c FROM events WHERE event_type IN ('signup', 'click') GROUP BY event_type))
"""
ORACLE["stream_absent_groups"] = f"""
SELECT user_id % 50 AS grp, epoch_us(ts) - epoch_us(ts) % {DAY_US} AS step_us
FROM events GROUP BY 1, 2
HAVING count(*) FILTER (event_type = 'error') = 0
   AND step_us + {DAY_US} <= (SELECT {_CLOSED} FROM events WHERE event_type = 'error')
"""
_SESSIONS = f"""
  u AS (
    SELECT user_id AS series, epoch_us(ts) AS us,
           lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
  n AS (
    SELECT series, us, sum(CASE WHEN us - before <= {6 * HOUR_US} THEN 0 ELSE 1 END)
      OVER (PARTITION BY series ORDER BY us) AS k FROM u),
  sessions AS (
    SELECT series, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM n GROUP BY series, k)
"""
ORACLE["activity_sessions"] = f"WITH {_SESSIONS} SELECT * FROM sessions"
ORACLE["stream_activity_sessions"] = f"""
WITH {_SESSIONS} SELECT * FROM sessions WHERE last_us + {6 * HOUR_US} <= (SELECT {_CLOSED} FROM events)
"""
ORACLE["known_issues"] = """
WITH c AS (
  SELECT doc_id AS issue, array_to_string(string_split(text, ' ')[3:6], ' ') AS w, substring(text, 2, 8) AS l
  FROM documents WHERE length(text) >= 10),
s AS (SELECT issue, CASE WHEN issue % 10 = 0 OR length(w) < 3 THEN l ELSE w END AS signature FROM c),
lines AS (SELECT source AS app, unnest(string_split(text, chr(10))) AS value FROM documents)
SELECT app, issue, signature, count(*) AS hits FROM lines JOIN s ON contains(value, signature) GROUP BY 1, 2, 3
"""
ORACLE["counted_load"] = """
SELECT c_mktsegment AS segment, count(*) AS n, (SELECT count(*) FROM customer) AS written FROM customer GROUP BY 1
"""
ORACLE["reloaded_status"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE o_totalprice END AS price,
       o_orderstatus AS status FROM orders
"""
ORACLE["pruned_by_region"] = """
SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1
"""
ORACLE["merged_sketches"] = """
SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
       TRUE AS suppliers_near, TRUE AS p50_near, TRUE AS p95_near
FROM lineitem GROUP BY 1, 2
"""
