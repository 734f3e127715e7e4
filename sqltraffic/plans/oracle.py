"""The queries' SQL twins, for DuckDB over the same tables."""

from __future__ import annotations


def _strip(q: str) -> str:
    return rf"regexp_replace({q}, '^(?:\s+|/\*.*?\*/)+', '')"


def _digest(q: str) -> str:
    """Enough for the statements of the derived log."""
    for pattern, to in ((r"/\*.*?\*/", ""), (r"''(?:[^'']|'''')*''", "?"), (r"IN \([^)]*\)", "IN (?)"), (r"[0-9]+", "?"), (r" +", " ")):
        q = f"regexp_replace({q}, '{pattern}', '{to}', 'g')"
    return f"lower(trim({q}))"


_CATEGORY = f"""CASE
  WHEN regexp_matches({_strip('query')}, '^(SELECT|SHOW|DESC|WITH)\\b') THEN 'Select'
  WHEN regexp_matches({_strip('query')}, '^(SET|USE)\\b') THEN 'SessionState'
  WHEN regexp_matches({_strip('query')}, '^(CREATE|DROP) TEMPORARY\\b') THEN 'TempTable'
  WHEN regexp_matches({_strip('query')}, '^(BEGIN|COMMIT|ROLLBACK)\\b') THEN 'Transaction'
  WHEN regexp_matches({_strip('query')}, '^(INSERT|UPDATE|DELETE|REPLACE)\\b') THEN 'DML' ELSE 'Unknown' END"""
_LOG = f"""
q0 AS (
  SELECT ts, user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    CASE WHEN event_id % 101 = 0 THEN '' ELSE '10.0.' || (user_id % 8) || '.' || (event_id % 250) || ':' || (40000 + event_id % 1000) END AS source_ip,
    'u' || (user_id % 5) AS "user", 'db' || (user_id % 3) AS "database",
    CASE WHEN event_id % 4 = 0 THEN 'execute' ELSE 'query' END AS query_type,
    CASE event_type
      WHEN 'view' THEN 'SELECT * FROM pages WHERE user_id = ' || user_id
      WHEN 'click' THEN '/* trace=' || event_id || ' */ SELECT id FROM items WHERE id IN (1, 2, ' || event_id || ')'
      WHEN 'signup' THEN (CASE WHEN event_id % 2 = 0 THEN 'CREATE' ELSE 'DROP' END) || ' TEMPORARY TABLE scratch_' || (['a', 'b', 'c'])[event_id % 3 + 1]
                         || (CASE WHEN event_id % 2 = 0 THEN ' (id INT)' ELSE '' END)
      WHEN 'purchase' THEN 'INSERT INTO ' || (['scratch_a', 'scratch_b', 'scratch_c', 'sales'])[event_id % 4 + 1] || ' VALUES (' || event_id || ', ''it''''s'')'
      ELSE (['BEGIN', 'COMMIT', 'UPDATE items SET n = ' || event_id || ' WHERE id = 7', 'SELECT NOW()'])[event_id % 4 + 1] END AS query,
    value AS response_time_ms,
    CASE WHEN event_type = 'error' THEN (['ERROR 1146 (42S02): no table', 'i/o timeout: connection was bad', ''])[event_id % 3 + 1] ELSE '' END AS error,
    event_id
  FROM events),
q AS (SELECT *, {_digest('query')} AS digest, {_CATEGORY} AS category, regexp_replace(source_ip, ':[0-9]+$', '') AS host,
        ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS point FROM q0)"""
_COMPARED = _LOG + """,
r0 AS (
  SELECT *, error AS original_error,
    CASE WHEN event_id % 13 = 0 THEN CASE WHEN error = '' THEN 'ERROR 1064 (42000): syntax' ELSE '' END ELSE error END AS replay_error,
    event_id % 5 AS original_affected, event_id % 5 + (event_id % 17 = 0)::BIGINT AS replay_affected,
    response_time_ms + ((event_id % 7) - 3) / 2.0::DOUBLE AS replay_ms
  FROM q),
r AS (
  SELECT *, floor(response_time_ms * 1000.0::DOUBLE) / 1000.0::DOUBLE AS original_time_ms, floor(replay_ms * 1000.0::DOUBLE) / 1000.0::DOUBLE AS replay_time_ms,
    CASE WHEN original_error <> replay_error THEN 'error' WHEN original_error = '' AND original_affected <> replay_affected THEN 'affected_rows' ELSE '' END AS type,
    regexp_matches(query, '(?i)now\\(\\)') AS ignored
  FROM r0),
c AS (SELECT *, type = '' AS match, replay_time_ms - original_time_ms AS time_diff_ms, abs(replay_time_ms - original_time_ms) > 1 AS time_diff_exceeded FROM r)"""
_CAPTURED = """
o AS (SELECT o_custkey AS query_id, o_orderkey::VARCHAR AS c0, o_orderstatus AS c1, o_orderpriority AS c2,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS "row" FROM orders),
s AS (SELECT o_custkey AS query_id, o_orderkey::VARCHAR AS c0, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS c1, o_orderpriority AS c2,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS "row" FROM orders WHERE o_orderkey % 50 <> 0),
n AS (SELECT query_id, count(*) AS n, coalesce(max(m), 0) AS m FROM o LEFT JOIN (SELECT query_id, count(*) AS m FROM s GROUP BY 1) USING (query_id) GROUP BY 1),
d AS (
  SELECT query_id, 'error' AS type, 0 AS "row", '' AS "column", '' AS original, 'ERROR 1146 (42S02): no table' AS replay FROM n WHERE query_id % 31 = 0
  UNION ALL SELECT query_id, 'column_count', 0, '', '3', '2' FROM n WHERE query_id % 31 <> 0 AND query_id % 37 = 0
  UNION ALL SELECT query_id, 'column_name', 0, 'index_1', 'o_orderstatus', 'status' FROM n WHERE query_id % 31 <> 0 AND query_id % 37 <> 0 AND query_id % 41 = 0
  UNION ALL SELECT query_id, 'row_count', 0, '', n::VARCHAR, m::VARCHAR FROM n WHERE query_id % 31 <> 0 AND query_id % 37 <> 0 AND n <> m
  UNION ALL SELECT query_id, 'cell_value', "row", x.name, x.a, x.b FROM (
    SELECT o.query_id, o."row", unnest([{'name': 'o_orderkey', 'a': o.c0, 'b': s.c0}, {'name': 'o_orderstatus', 'a': o.c1, 'b': s.c1}, {'name': 'o_orderpriority', 'a': o.c2, 'b': s.c2}]) AS x
    FROM o JOIN s USING (query_id, "row") JOIN n USING (query_id) WHERE query_id % 31 <> 0 AND query_id % 37 <> 0 AND n = m) WHERE x.a <> x.b)"""
_TIMINGS = """
t AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'direct' ELSE 'proxy' END AS path, l_returnflag AS query,
        l_quantity::BIGINT * 1000 + l_suppkey AS duration_ns, CASE WHEN l_partkey % 211 = 0 THEN 'failed' ELSE '' END AS error FROM lineitem),
k AS (
  SELECT path, query, count(ok) AS n, floor(avg(ok)) AS avg_ns, quantile_disc(ok, 0.5) AS p50_ns, quantile_disc(ok, 0.95) AS p95_ns, quantile_disc(ok, 0.99) AS p99_ns,
    min(ok) AS min_ns, max(ok) AS max_ns, floor(coalesce(stddev_samp(ok), 0)) AS stddev_ns, count(*) FILTER (error <> '') AS errors
  FROM (SELECT *, CASE WHEN error = '' THEN duration_ns END AS ok FROM t) GROUP BY path, query)"""
_METRICS = """
h AS (SELECT date_trunc('hour', ts) AS ts, (user_id % 2)::VARCHAR AS cluster, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2),
m AS (
  SELECT ts, cluster, 'queries_total' AS name, 'counter' AS kind, (sum(n) OVER (PARTITION BY cluster ORDER BY ts))::DOUBLE AS value FROM h
  UNION ALL SELECT ts, cluster, 'sessions_active', 'gauge', users::DOUBLE FROM h)"""
_POLICY = """
p AS (SELECT valid_from + CASE WHEN day(valid_from) % 2 = 1 THEN INTERVAL 630 MINUTE ELSE INTERVAL 0 MINUTE END AS valid_from, day(valid_from) AS n, day(valid_from) % 4 <> 0 AS enabled, CASE WHEN day(valid_from) % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS sample_rate
      FROM (SELECT DISTINCT date_trunc('day', ts) AS valid_from FROM events) WHERE day(valid_from) % 3 = 1)"""
_GATE = _LOG + """,
g0 AS (
  SELECT *, CASE WHEN category = 'TempTable' THEN regexp_extract(query, 'TABLE (\\w+)', 1) WHEN category = 'DML' THEN regexp_extract(query, '(?:INTO|UPDATE) (\\w+)', 1) ELSE '' END AS tbl,
    CASE WHEN query LIKE 'CREATE TEMPORARY%' THEN true WHEN query LIKE 'DROP TEMPORARY%' THEN false END AS event FROM q),
g AS (
  SELECT *, category IN ('Select', 'SessionState', 'TempTable', 'Transaction') OR (category = 'DML' AND tbl <> '' AND
    coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY session_id, tbl ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS passes FROM g0)"""
_EDGES = """
e AS (SELECT *, CASE WHEN query = 'BEGIN' THEN true WHEN query = 'COMMIT' THEN false END AS edge FROM q),
b AS (SELECT *, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS in_transaction,
        sum((edge IS NOT DISTINCT FROM true)::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS span FROM e)"""
_TRANSACTIONS = f"{_LOG}, {_EDGES}"
_AUDIT = _EDGES + """,
a AS (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY session_id))) / 1e6 AS age,
        1000000.0::DOUBLE * (0.9::DOUBLE + 0.2::DOUBLE * (('0x' || substr(md5(session_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) AS deadline FROM b),
l AS (SELECT session_id, min(seq) FILTER (NOT in_transaction) AS closed_at, min(seq) AS first_late FROM a WHERE age >= deadline GROUP BY 1)"""


def _round2(x: str) -> str:
    return f"round(({x}) * 100) / 100"


_SUMMARY = ", ".join(
    [f"{_round2(f'avg({s}_time_ms)')} AS {s}_avg_ms" for s in ("original", "replay")]
    + [f"{_round2(f'quantile_disc({s}_time_ms, 0.{p})')} AS {s}_p{p}_ms" for s in ("original", "replay") for p in (95, 99)]
)
_DIGESTS = _COMPARED + f""",
y AS (SELECT digest, arg_min(query, (ts, session_id, seq)) AS sample_query, count(*) AS count, count(*) FILTER (match) AS match_count,
        count(*) FILTER (NOT match) AS diff_count, count(*) FILTER (type = 'error') AS error_count, {_SUMMARY} FROM c GROUP BY digest),
z AS (SELECT *, {', '.join(f"{_round2(f'replay_{n}_ms - original_{n}_ms')} AS overhead_{n}_ms" for n in ('avg', 'p95', 'p99'))} FROM y)"""
_SAFE = "('Select', 'SessionState', 'TempTable', 'Transaction')"
#: 10.0.0.0/15 without 10.0.1.0/25, as numbers.
_IP = "(TRY_CAST(split_part(host, '.', 1) AS BIGINT) * 16777216 + TRY_CAST(split_part(host, '.', 2) AS BIGINT) * 65536 + TRY_CAST(split_part(host, '.', 3) AS BIGINT) * 256 + TRY_CAST(split_part(host, '.', 4) AS BIGINT))"
_CIDR = f"(host = '' OR ({_IP} BETWEEN 167772160 AND 167903231 AND NOT {_IP} BETWEEN 167772416 AND 167772543))"

SQL = {
    "s1_read_query_log": f"WITH {_LOG} SELECT ts AS timestamp, session_id, source_ip, \"user\", \"database\", query_type, query, event_id || ',x' AS args, response_time_ms, 0::BIGINT AS rows_affected, 0::BIGINT AS rows_returned, error FROM q",
    "s2_log_quality": "SELECT count(*) + 1 AS lines, count(*) AS good, 1::BIGINT AS malformed, 0::BIGINT AS too_long FROM events",
    "s3_pending_files": "SELECT 'queries-' || strftime(d, '%Y-%m-%d') || '.jsonl' AS file_name FROM (SELECT DISTINCT ts::DATE AS d FROM events) WHERE day(d) % 2 = 0",
    "s3_advance_manifest": "SELECT 'queries-' || strftime(ts::DATE, '%Y-%m-%d') || '.jsonl' AS file_name, 'completed' AS status, count(*) AS lines FROM events GROUP BY 1",
    "s4_stream_query_log": f"WITH {_LOG} SELECT session_id, count(*) AS n FROM q GROUP BY session_id",
    "s5_write_diff_report": f"WITH {_COMPARED} SELECT query, session_id, match, CASE type WHEN 'error' THEN 'error|' || original_error || '|' || replay_error WHEN 'affected_rows' THEN 'affected_rows|' || original_affected || '|' || replay_affected END AS differences FROM c WHERE NOT match AND NOT ignored",
    "s6_write_digest_summary": f"WITH {_DIGESTS} SELECT digest, count, diff_count, overhead_avg_ms FROM z",
    "s7_retain_log": f"WITH {_LOG} SELECT session_id, seq, query FROM q WHERE ts::DATE > (SELECT max(ts::DATE) FROM events) - 7",
    "s8_export_query_log": f"WITH {_LOG} SELECT ts AS timestamp, session_id, \"user\", \"database\", query, floor(response_time_ms * 1000.0::DOUBLE) / 1000.0::DOUBLE AS response_time_ms, error, '<redacted>,<redacted>' AS args FROM q",
    "p1_digest_catalog": f"WITH {_LOG} SELECT digest, arg_min(query, (ts, session_id, seq)) AS sample_query, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM q GROUP BY digest",
    "p1_deep_digests": "SELECT 'select ? from t where id in (?) and kind = ?' AS digest, count(*) AS count FROM events WHERE event_id % 10 = 0 HAVING count(*) > 0",
    "p2_statement_mix": f"WITH {_LOG} SELECT category, \"user\", \"database\", count(*) AS count FROM q GROUP BY ALL",
    "p3_replayable_reads": f"WITH {_LOG} SELECT session_id, seq, query FROM q WHERE category = 'Select'",
    "p4_session_safe": f"WITH {_LOG} SELECT session_id, seq, query FROM q WHERE category IN {_SAFE}",
    "p5_mark_ignored": f"WITH {_COMPARED} SELECT session_id, seq, ignored FROM c",
    "p6_gate_by_cidr": f"WITH {_LOG} SELECT session_id, seq, source_ip FROM q WHERE {_CIDR}",
    "p7_gate_by_sample": f"WITH {_LOG} SELECT session_id, seq, event_id FROM q WHERE point < 0.25",
    "p9_redact_args": f"WITH {_LOG} SELECT session_id, seq, '<redacted>,<redacted>' AS args FROM q",
    "p10_redact_diffs": f"WITH {_CAPTURED} SELECT query_id, type, \"row\"::BIGINT AS \"row\", \"column\", CASE WHEN type = 'cell_value' AND \"column\" = 'o_orderstatus' THEN '<redacted>' ELSE original END AS original, CASE WHEN type = 'cell_value' AND \"column\" = 'o_orderstatus' THEN '<redacted>' ELSE replay END AS replay FROM d",
    "p11_normalize_source": f"WITH {_LOG} SELECT session_id, seq, host AS source_ip FROM q",
    "p12_write_targets": f"WITH {_GATE} SELECT tbl AS target, category, count(*) AS count FROM g WHERE category = 'DML' GROUP BY ALL",
    "p13_temp_table_lifetimes": f"WITH {_GATE}, l AS (SELECT session_id, tbl, ts, event, lead(ts) OVER w AS ended, NOT lead(event) OVER w AS dropped FROM g WHERE category = 'TempTable' WINDOW w AS (PARTITION BY session_id, tbl ORDER BY seq)) SELECT session_id, tbl AS \"table\", ts AS created, ended, coalesce(dropped, false) AS dropped FROM l WHERE event",
    "p14_stringify_table": "SELECT s_suppkey::VARCHAR AS s_suppkey, coalesce(s_name, 'NULL') AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'NULL' ELSE s_nationkey::VARCHAR END AS s_nationkey FROM supplier",
    "p15_classify_errors": f"WITH {_LOG} SELECT digest, CASE WHEN error LIKE 'ERROR %' THEN 'sql' ELSE 'transport' END AS kind, count(*) AS count FROM q WHERE error <> '' GROUP BY ALL",
    "p16_flag_slow": f"WITH {_COMPARED} SELECT session_id, seq, time_diff_exceeded FROM c",
    "p17_emit_filter": f"WITH {_COMPARED} SELECT session_id, seq, type FROM c WHERE NOT match AND NOT ignored",
    "p18_attach_user": f"WITH {_COMPARED} SELECT session_id, seq, CASE WHEN NOT match AND NOT ignored THEN \"user\" ELSE '' END AS \"user\" FROM c",
    "j1_pair_results": f"WITH {_COMPARED} SELECT session_id, seq, query, replay_ms FROM c WHERE event_id % 19 <> 0",
    "j2_diff_tables": f"WITH {_CAPTURED} SELECT query_id, \"row\", x.name AS \"column\", x.a AS original, x.b AS replay FROM (SELECT coalesce(o.query_id, s.query_id) AS query_id, coalesce(o.\"row\", s.\"row\") AS \"row\", unnest([{{'name': 'o_orderkey', 'a': o.c0, 'b': s.c0}}, {{'name': 'o_orderstatus', 'a': o.c1, 'b': s.c1}}, {{'name': 'o_orderpriority', 'a': o.c2, 'b': s.c2}}]) AS x FROM o FULL JOIN s ON o.query_id = s.query_id AND o.\"row\" = s.\"row\") WHERE x.a IS DISTINCT FROM x.b",
    "j3_cidr_join": f"WITH {_LOG}, nets AS (SELECT 'net' || (s_suppkey % 8) AS name, '10.0.' || (s_suppkey % 8) || '.0/' || (24 + s_suppkey % 3) AS cidr FROM supplier GROUP BY ALL) SELECT session_id, seq, name FROM (SELECT *, {_IP} AS ip FROM q WHERE host <> '') JOIN (SELECT name, split_part(split_part(cidr, '/', 1), '.', 3)::BIGINT * 256 + 167772160 AS lo, 1 << (32 - split_part(cidr, '/', 2)::INT) AS size FROM nets) ON ip >= lo AND ip < lo + size",
    "j5_asof_policy": f"WITH {_LOG}, {_POLICY} SELECT session_id, seq, enabled, sample_rate FROM q ASOF LEFT JOIN p ON q.ts >= p.valid_from",
    "j6_admitted_digests": f"WITH {_COMPARED}, f AS (SELECT digest, row_number() OVER (ORDER BY min((ts, session_id, seq)), digest) AS rank FROM c GROUP BY digest) SELECT session_id, seq, digest FROM c WHERE digest IN (SELECT digest FROM f WHERE rank <= 4)",
    "j2_diff_whole_tables": """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS "row" FROM orders),
      s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, "row" FROM o WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders))
      SELECT "row", x.name AS "column", x.a AS original, x.b AS replay
      FROM (SELECT "row", unnest([{'name': 'o_orderkey', 'a': o.o_orderkey::VARCHAR, 'b': s.o_orderkey::VARCHAR}, {'name': 'o_orderstatus', 'a': o.o_orderstatus, 'b': s.o_orderstatus}, {'name': 'o_orderpriority', 'a': o.o_orderpriority, 'b': s.o_orderpriority}]) AS x
            FROM o LEFT JOIN s USING ("row")) WHERE x.a IS DISTINCT FROM x.b""",
    "j7_replay_compare": """SELECT 'SELECT n_name FROM {nation} ORDER BY n_nationkey' AS query, count(*) = 0 AS match, count(*) AS n_differences, CASE WHEN count(*) > 0 THEN 'cell_value' END AS type FROM nation WHERE n_nationkey = 3 AND n_name <> 'CHANGED'
      UNION ALL SELECT 'SELECT r_name, count(*) AS n FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_name ORDER BY r_name', true, 0, NULL
      UNION ALL SELECT 'SELECT s_name FROM {supplier} ORDER BY s_suppkey', false, 1, 'error'
      UNION ALL SELECT 'SELECT n_name, 100 DIV part AS share FROM {nation} ORDER BY n_name', false, 1, 'error'
      UNION ALL SELECT 'SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} ORDER BY l_orderkey, l_linenumber', count(*) = 0, count(*), CASE WHEN count(*) > 0 THEN 'cell_value' END FROM lineitem WHERE l_partkey % 100 = 0""",
    "a1_comparison_totals": f"WITH {_COMPARED} SELECT count(*) AS total, count(*) FILTER (NOT ignored AND match) AS matched, count(*) FILTER (NOT ignored AND NOT match) AS differed, count(*) FILTER (ignored) AS ignored FROM c",
    "a2_digest_summary": f"WITH {_DIGESTS} SELECT * FROM z",
    "a3_digest_cap": f"WITH {_COMPARED} SELECT digest, row_number() OVER (ORDER BY min((ts, session_id, seq)), digest) AS rank, count(*) AS count, row_number() OVER (ORDER BY min((ts, session_id, seq)), digest) <= 4 AS admitted FROM c GROUP BY digest",
    "a3_cap_overflow": f"WITH {_COMPARED}, f AS (SELECT row_number() OVER (ORDER BY min((ts, session_id, seq)), digest) <= 4 AS admitted, count(*) AS count FROM c GROUP BY digest) SELECT count(*) FILTER (admitted) AS admitted, coalesce(sum(count) FILTER (NOT admitted), 0)::BIGINT AS overflow FROM f",
    "a4_diff_breakdown": f"WITH {_CAPTURED} SELECT type, \"column\", count(*) AS count FROM d GROUP BY ALL",
    "a5_gate_funnel": f"WITH {_LOG} SELECT CASE WHEN point >= 0.75 THEN 'sampled_out' WHEN NOT {_CIDR} THEN 'cidr' WHEN category NOT IN {_SAFE} THEN 'skipped' ELSE 'eligible' END AS reason, count(*) AS count FROM q GROUP BY 1",
    "a6_latency_stats": f"WITH {_TIMINGS} SELECT path, query, n, avg_ns::BIGINT AS avg_ns, p50_ns, p95_ns, p99_ns, min_ns, max_ns, stddev_ns::BIGINT AS stddev_ns, errors FROM k",
    "a7_latency_overhead": f"WITH {_TIMINGS} SELECT d.query, (p.p50_ns - d.p50_ns) * 100.0::DOUBLE / d.p50_ns AS p50_overhead_pct, (p.p99_ns - d.p99_ns) * 100.0::DOUBLE / d.p99_ns AS p99_overhead_pct FROM k d JOIN k p USING (query) WHERE d.path = 'direct' AND p.path = 'proxy' AND d.n > 0 AND p.n > 0",
    "a8_traffic_summary": f"WITH {_LOG} SELECT \"user\", \"database\", query_type, host AS source, count(*) AS queries, count(*) FILTER (error <> '') AS errors, round(sum(response_time_ms), 3) AS total_ms FROM q GROUP BY ALL",
    "a9_session_summary": f"WITH {_LOG} SELECT session_id, min(ts) AS first_seen, max(ts) AS last_seen, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS age_seconds, count(*) AS queries, count(*) FILTER (error <> '') AS errors, count(DISTINCT \"user\") AS users, count(DISTINCT \"database\") AS databases FROM q GROUP BY session_id",
    "a10_regressions": f"WITH {_COMPARED} SELECT digest, count(*) FILTER (time_diff_exceeded) AS exceeded, max(time_diff_ms) AS max_diff_ms, round(avg(time_diff_ms), 6) AS avg_diff_ms FROM c GROUP BY digest",
    "a11_metric_snapshot": f"""WITH {_COMPARED}, {_AUDIT}, f AS (SELECT CASE WHEN point >= 0.75 THEN 'sampled_out' WHEN NOT {_CIDR} THEN 'cidr' WHEN category NOT IN {_SAFE} THEN 'skipped' ELSE 'eligible' END AS reason FROM q),
      w AS (SELECT max(ts) >= (SELECT max(ts) FROM q) - INTERVAL 1 HOUR AS active FROM q GROUP BY session_id),
      t AS (SELECT replay_error, coalesce(max((replay_error LIKE 'i/o%')::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS dropped FROM c),
      g AS (SELECT row_number() OVER (ORDER BY min((ts, session_id, seq)), digest) <= 4 AS admitted, count(*) AS n FROM c GROUP BY digest)
      SELECT 'active_sessions' AS name, 'gauge' AS kind, count(*)::DOUBLE AS value FROM w WHERE active UNION ALL SELECT 'shadow_active_sessions', 'gauge', count(*) FROM w WHERE active
      UNION ALL SELECT 'shadow_enabled', 'gauge', 1 UNION ALL SELECT 'total_sessions', 'counter', count(*) FROM w
      UNION ALL SELECT 'sessions_closed_max_lifetime', 'counter', count(closed_at) FROM l UNION ALL SELECT 'sessions_lifetime_postponed', 'counter', count(*) FROM l WHERE closed_at IS NULL OR closed_at > first_late
      UNION ALL SELECT 'queries_handled', 'counter', count(*) FROM q UNION ALL SELECT 'query_errors', 'counter', count(*) FROM q WHERE error <> ''
      UNION ALL SELECT 'shadow_' || x.n, 'counter', (SELECT count(*) FROM f WHERE reason = x.r) FROM (SELECT unnest(['disabled', 'sampled_out', 'cidr', 'skipped']) AS r, unnest(['disabled', 'sampled_out', 'filtered_by_cidr', 'skipped']) AS n) x
      UNION ALL SELECT 'shadow_queries_replayed', 'counter', count(*) FROM t WHERE NOT dropped AND replay_error = '' UNION ALL SELECT 'shadow_dropped', 'counter', count(*) FROM t WHERE dropped
      UNION ALL SELECT 'comparisons_total', 'counter', count(*) FROM c UNION ALL SELECT 'comparisons_matched', 'counter', count(*) FROM c WHERE match AND NOT ignored
      UNION ALL SELECT 'comparisons_differed', 'counter', count(*) FROM c WHERE NOT match AND NOT ignored UNION ALL SELECT 'comparisons_ignored', 'counter', count(*) FROM c WHERE ignored
      UNION ALL SELECT 'comparisons_digest_count', 'gauge', count(*) FROM g WHERE admitted UNION ALL SELECT 'comparisons_digest_overflow', 'counter', coalesce(sum(n), 0) FROM g WHERE NOT admitted""",
    "a12_metrics_by_cluster": f"WITH {_METRICS} SELECT cluster, name, CASE WHEN name = 'queries_total' THEN sum(value) ELSE round(avg(value), 6) END AS value FROM m GROUP BY cluster, name UNION ALL SELECT '*', name, CASE WHEN name = 'queries_total' THEN sum(value) ELSE round(avg(value), 6) END FROM m GROUP BY name",
    "a13_diff_fraction": f"WITH {_COMPARED} SELECT date_trunc('hour', ts) AS bucket, count(*) AS total, count(*) FILTER (NOT ignored AND NOT match) AS differed, count(*) FILTER (NOT ignored AND NOT match)::DOUBLE / count(*) AS fraction FROM c GROUP BY 1",
    "a14_unique_digests": f"WITH {_LOG} SELECT count(DISTINCT digest) AS unique_digests FROM q",
    "a15_reservoir_sample": f"WITH {_LOG} SELECT digest, least(count(*), 100) AS sampled FROM q GROUP BY digest",
    "w1_sessionize": f"WITH {_LOG} SELECT session_id, event_id, seq FROM q",
    "w1_file_order": "SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts), event_id) AS seq FROM events",
    "w2_replay_schedule": f"""WITH {_LOG}, g AS (SELECT session_id, seq, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY seq))) / 1000.0::DOUBLE / 20000.0::DOUBLE AS gap FROM q WHERE category = 'Select'),
      h AS (SELECT session_id, seq, CASE WHEN gap > 0 AND gap < 10000 THEN gap ELSE 0 END AS wait_ms FROM g)
      SELECT session_id, seq, round(wait_ms, 6) AS wait_ms, round(sum(wait_ms) OVER (PARTITION BY session_id ORDER BY seq), 6) AS offset_ms FROM h""",
    "w3_temp_table_gate": f"WITH {_GATE} SELECT session_id, seq, passes FROM g",
    "w4_current_database": f"WITH {_LOG} SELECT session_id, seq, coalesce(last_value(CASE WHEN event_id % 11 = 0 THEN 'other' || (event_id % 3) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), \"database\") AS in_force FROM q",
    "w5_heartbeats": f"""WITH {_COMPARED}, b AS (SELECT to_timestamp(epoch(ts)::BIGINT - epoch(ts)::BIGINT % 60)::TIMESTAMP AS x, * FROM (SELECT date_trunc('minute', ts) AS ts, ignored, match FROM c)),
      e AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 1 MINUTE)) AS timestamp),
      h AS (SELECT timestamp, count(ts) AS window_total, count(*) FILTER (NOT ignored AND match) AS window_matched, count(*) FILTER (NOT ignored AND NOT match) AS window_differed, count(*) FILTER (ignored) AS window_ignored FROM e LEFT JOIN b ON b.ts = e.timestamp GROUP BY timestamp)
      SELECT *, (sum(window_total) OVER (ORDER BY timestamp))::BIGINT AS cumulative_total, (sum(window_differed) OVER (ORDER BY timestamp))::BIGINT AS cumulative_differed, 'heartbeat' AS type, 60::BIGINT AS window_seconds FROM h""",
    "w6_counter_rates": f"WITH {_METRICS} SELECT * FROM (SELECT ts, cluster, name, (CASE WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE value END) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6) AS rate FROM m WHERE kind = 'counter' WINDOW w AS (PARTITION BY cluster, name ORDER BY ts)) WHERE rate IS NOT NULL",
    "w7_active_sessions": f"WITH {_LOG}, e AS (SELECT session_id, min(ts) AS a, max(ts) AS b FROM q GROUP BY 1), s AS (SELECT ts, sum(step) AS step FROM (SELECT a AS ts, 1 AS step FROM e UNION ALL SELECT b, -1 FROM e) GROUP BY ts) SELECT ts, (sum(step) OVER (ORDER BY ts))::BIGINT AS active FROM s",
    "w8_teardown_effect": f"WITH {_LOG} SELECT session_id, seq, coalesce(max((error LIKE 'i/o%')::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS dropped FROM q",
    "w8_replay_timeouts": f"WITH {_COMPARED} SELECT session_id, seq, replay_ms > 200 OR coalesce(max((replay_error LIKE 'i/o%' OR replay_ms > 200)::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS dropped FROM c",
    "w9_transaction_spans": f"WITH {_TRANSACTIONS}, l AS (SELECT *, coalesce(lag(in_transaction) OVER (PARTITION BY session_id ORDER BY seq), false) AND edge IS NOT DISTINCT FROM false AS ends FROM b) SELECT session_id, span::BIGINT AS span, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS statements, bool_or(ends) AS ended FROM l WHERE in_transaction OR ends GROUP BY session_id, span",
    "w10_lifetime_audit": f"WITH {_LOG}, {_AUDIT} SELECT session_id, first_late, closed_at, coalesce(closed_at, 1 << 30) > first_late AS postponed FROM l",
    "t1_rank_digests": f"WITH {_DIGESTS} SELECT * FROM z",
    "t2_top_k": f"WITH {_DIGESTS} SELECT digest, diff_count FROM z ORDER BY diff_count DESC, digest LIMIT 5",
    "t3_summary_report": f"WITH {_DIGESTS} SELECT CASE WHEN length(digest) > 58 THEN substr(digest, 1, 55) || '...' ELSE digest END AS digest, count, diff_count, error_count, {', '.join(f'''format('{{:.2f}}', {s}_{n}_ms) AS {s}_{n}''' for s in ('original', 'replay') for n in ('avg', 'p95', 'p99'))} FROM z",
    "c1_compare_results": f"WITH {_CAPTURED} SELECT query_id, type, \"row\"::BIGINT AS \"row\", \"column\", original, replay FROM d",
    "c1_matches": f"WITH {_CAPTURED} SELECT query_id, query_id NOT IN (SELECT query_id FROM d) AS match FROM n",
    "c2_compare_long": f"WITH {_CAPTURED} SELECT query_id, type, \"row\"::BIGINT AS \"row\", \"column\", original, replay FROM d",
    "c2_difference_counts": f"WITH {_CAPTURED} SELECT n.query_id, count(type) = 0 AS match, count(type) AS n, count(DISTINCT CASE WHEN type = 'cell_value' THEN \"row\" END) AS n_rows, coalesce(string_agg(DISTINCT type, ',' ORDER BY type), '') AS types FROM n LEFT JOIN d USING (query_id) GROUP BY n.query_id",
    "c2_difference_pages": f"""WITH {_CAPTURED} SELECT query_id, "row" // 4 AS page, count(*) AS n, count(*) AS listed, first(type ORDER BY type = 'cell_value', type = 'row_count', "row") AS first_type,
      first("row" ORDER BY type = 'cell_value', type = 'row_count', "row")::BIGINT AS first_row FROM d GROUP BY 1, 2""",
    "c2_first_differences": f"""WITH {_CAPTURED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY type = 'cell_value', type = 'row_count', "row", list_position(['o_orderkey', 'o_orderstatus', 'o_orderpriority'], "column")) AS rank FROM d)
      SELECT query_id, type, "row"::BIGINT AS "row", "column", original, replay, rank FROM k WHERE rank <= 2""",
    "c3_result_timing": f"WITH {_COMPARED} SELECT session_id, seq, original_time_ms, replay_time_ms, time_diff_ms FROM c",
    "c4_schema_diff": "SELECT DISTINCT o_custkey AS query_id, 'column_count' AS type, '' AS \"column\", '3' AS original, CASE WHEN o_custkey % 31 = 0 THEN '0' ELSE '2' END AS replay FROM orders WHERE o_custkey % 31 = 0 OR o_custkey % 37 = 0 UNION ALL SELECT DISTINCT o_custkey, 'column_name', 'index_1', 'o_orderstatus', 'status' FROM orders WHERE o_custkey % 31 <> 0 AND o_custkey % 37 <> 0 AND o_custkey % 41 = 0",
    "c5_column_drift": f"WITH {_CAPTURED} SELECT \"column\", count(*) AS count, min(\"row\") AS first_row FROM d WHERE type = 'cell_value' GROUP BY 1",
    "c6_offline_compare": f"WITH {_COMPARED} SELECT session_id, seq, CASE WHEN type = 'error' OR original_error <> '' THEN nullif(type, '') ELSE nullif(concat_ws(',', nullif(type, ''), CASE WHEN category = 'Select' THEN 'column_count' END), '') END AS types FROM c",
    "u1_combined_report": f"WITH {_COMPARED}, e AS (SELECT unnest(generate_series((SELECT min(date_trunc('day', ts)) FROM c), (SELECT max(date_trunc('day', ts)) FROM c), INTERVAL 1 DAY)) AS timestamp) SELECT 'difference' AS type, session_id, seq, NULL::TIMESTAMP AS timestamp, NULL::BIGINT AS window_total FROM c WHERE NOT match AND NOT ignored UNION ALL SELECT 'heartbeat', NULL, NULL, timestamp, (SELECT count(*) FROM c WHERE date_trunc('day', ts) = timestamp) FROM e",
}
SQL |= {
    "x1_stream_digest_counts": f"WITH {_LOG} SELECT digest, count(*) AS count, round(avg(response_time_ms), 9) AS avg_ms FROM q GROUP BY digest",
    "x4_stream_session_gate": SQL["w3_temp_table_gate"],
    "x5_stream_pair": f"WITH {_COMPARED} SELECT session_id, seq, CASE WHEN event_id % 19 <> 0 THEN replay_ms END AS replay_ms FROM c",
    "x7_stream_digest_cap": f"WITH {_LOG}, f AS (SELECT digest FROM q GROUP BY digest ORDER BY min((ts, session_id, seq)) LIMIT 4) SELECT digest, count(*) AS count FROM q JOIN f USING (digest) GROUP BY digest",
    "x8_stream_policy": f"WITH {_LOG}, {_POLICY} SELECT session_id, seq FROM q ASOF JOIN p ON q.ts >= p.valid_from WHERE enabled AND point < sample_rate AND (source_ip = '' OR ((n % 4 <> 1 OR session_id % 8 < 4) AND (n % 2 <> 1 OR session_id % 8 <> 3)))",
    "x9_stream_report": f"""WITH {_COMPARED}, b AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (NOT ignored AND NOT match) AS differed FROM c GROUP BY 1),
      e AS (SELECT unnest(generate_series((SELECT min(day) FROM b), (SELECT max(day) FROM b), INTERVAL 1 DAY)) AS timestamp)
      SELECT 'difference' AS type, session_id, seq, type AS kind, NULL::TIMESTAMP AS timestamp, NULL::BIGINT AS window_total, NULL::BIGINT AS cumulative_differed FROM c WHERE NOT match AND NOT ignored
      UNION ALL SELECT 'heartbeat', NULL, NULL, NULL, timestamp, coalesce(n, 0), (sum(coalesce(differed, 0)) OVER (ORDER BY timestamp))::BIGINT FROM e LEFT JOIN b ON day = timestamp""",
    "x2_stream_heartbeats": f"""WITH {_COMPARED}, b AS (SELECT date_trunc('hour', ts) AS ts, ignored, match FROM c),
      e AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 1 HOUR)) AS timestamp),
      h AS (SELECT timestamp, count(ts) AS window_total, count(*) FILTER (NOT ignored AND match) AS window_matched, count(*) FILTER (NOT ignored AND NOT match) AS window_differed, count(*) FILTER (ignored) AS window_ignored FROM e LEFT JOIN b ON b.ts = e.timestamp GROUP BY timestamp)
      SELECT *, (sum(window_total) OVER (ORDER BY timestamp))::BIGINT AS cumulative_total, (sum(window_differed) OVER (ORDER BY timestamp))::BIGINT AS cumulative_differed, 'heartbeat' AS type, 3600::BIGINT AS window_seconds FROM h""",
    "x3_stream_sketches": f"""WITH {_DIGESTS} SELECT y.digest, y.count, match_count, diff_count, error_count, round(o, 6) AS original_avg_ms, true AS original_p95_near, true AS original_p99_near, true AS replay_p95_near, true AS replay_p99_near, true AS sessions_near
      FROM y JOIN (SELECT digest, avg(original_time_ms) AS o FROM c GROUP BY 1) USING (digest)""",
    "x10_stream_sample": f"""WITH {_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ('0x' || substr(md5(session_id || ':' || seq), 1, 15))::BIGINT, session_id, seq) AS rank FROM q)
      SELECT digest, session_id, seq, response_time_ms FROM k WHERE rank <= 20""",
    "x11_late_rows": f"""WITH {_LOG}, e AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM q)
      SELECT 'late_rows_dropped' AS name, 'counter' AS kind, count(*)::DOUBLE AS value FROM q, e WHERE event_id % 97 = 0 AND (epoch_us(ts) - low) // ((high - low) // 3 + 1) = 0""",
    "x12_stream_replayed": f"WITH {_GATE.replace('AS event FROM q)', f'AS event FROM q WHERE point < 0.75 AND {_CIDR})')} SELECT session_id, seq, CASE WHEN event_id % 19 <> 0 THEN response_time_ms + ((event_id % 7) - 3) / 2.0::DOUBLE END AS replay_ms FROM g WHERE passes",
    "x3_stream_digest_table": f"WITH {_DIGESTS} SELECT y.digest, y.count, match_count, diff_count, error_count, round(o, 9) AS original_avg_ms, round(r, 9) AS replay_avg_ms FROM y JOIN (SELECT digest, avg(original_time_ms) AS o, avg(replay_time_ms) AS r FROM c GROUP BY 1) USING (digest)",
    "x3_stream_summary": f"WITH {_LOG} SELECT count(*) AS total, count(*) FILTER (error <> '') AS errors, count(DISTINCT digest) AS digests FROM q",
}
