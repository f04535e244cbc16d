"""Shared pieces of the oracle SQL: the FIXTURES.md input derivations as CTEs and helpers.

Explicit casts are used where the two engines type results differently (BIGINT sums,
DOUBLE ratios).
"""

from __future__ import annotations

from fleetstats.sources.fixtures import AS_OF_EVENTS, TREND_DAYS

NOW_E = f"TIMESTAMP '{AS_OF_EVENTS}'"

FX = {
    "fx1": """SELECT concat('db_', CAST(user_id % 50 AS STRING)) AS datname, CAST(ts AS DATE) AS snapshot_date,
       count(DISTINCT user_id) AS numbackends,
       count(CASE WHEN event_type = 'purchase' THEN 1 END) AS xact_commit,
       count(CASE WHEN event_type = 'error' THEN 1 END) AS xact_rollback,
       count(CASE WHEN event_type = 'click' THEN 1 END) AS blks_read,
       count(CASE WHEN event_type = 'view' THEN 1 END) AS blks_hit,
       count(CASE WHEN event_type = 'error' AND value > 100 THEN 1 END) AS deadlocks,
       CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS temp_bytes
FROM events GROUP BY 1, 2""",
    "fx2": """SELECT event_id AS pid, concat('db_', CAST(user_id % 4 AS STRING)) AS datname,
       concat('user_', CAST(user_id AS STRING)) AS usename,
       concat('app_', CAST(user_id % 5 AS STRING)) AS application_name,
       CASE event_id % 5 WHEN 0 THEN 'active' WHEN 2 THEN 'idle in transaction' WHEN 3 THEN NULL ELSE 'idle' END AS state,
       CASE WHEN event_id % 5 IN (0, 2) THEN CAST(ts AS TIMESTAMP) END AS xact_start,
       CASE WHEN event_id % 5 <> 3 THEN CAST(ts AS TIMESTAMP) END AS query_start,
       CASE WHEN event_id % 7 = 0 THEN 'Lock' END AS wait_event_type,
       props AS query
FROM events""",
    "fx3": """SELECT queryid, datname, calls, total_exec_time, total_exec_time / calls AS mean_exec_time,
       rows_returned, shared_blks_hit, shared_blks_read, query FROM (
SELECT l_partkey AS queryid, concat('db_', CAST(max(p_size) % 4 AS STRING)) AS datname, count(*) AS calls,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS total_exec_time,
       CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS rows_returned,
       count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS shared_blks_hit,
       count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS shared_blks_read,
       concat('select * from ', max(p_name)) AS query
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey)""",
    "fx4": """SELECT concat('db_', CAST(p_size % 4 AS STRING)) AS datname, p_brand AS schemaname,
       concat('part_', CAST(p_partkey AS STRING)) AS relname,
       count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS n_live_tup,
       count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_dead_tup,
       max(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS last_vacuum,
       max(CASE WHEN l_returnflag = 'N' THEN l_shipdate END) AS last_autovacuum
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey
GROUP BY p_partkey, p_size, p_brand""",
    "fx5": """SELECT CASE WHEN p_size % 4 < 2 THEN 'db_' ELSE 'old_' END || CAST(p_size % 4 AS STRING) AS datname,
       p_brand AS schemaname, CASE WHEN p_partkey % 3 <> 0 THEN 'part_' ELSE 'gone_' END || CAST(p_partkey AS STRING) AS relname,
       CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 100 AS DOUBLE) END AS dead_tuple_percent,
       CASE WHEN p_partkey % 7 = 0 THEN 'measurement failed' END AS error
FROM part""",
    "fx6": """SELECT CAST(ts AS TIMESTAMP) AS snapshot_ts, 'table' AS scope,
       concat('db_', CAST(user_id % 4 AS STRING)) AS dbname, event_type AS schemaname,
       concat('t_', CAST(user_id % 10 AS STRING)) AS relname,
       event_id * 1024 + CAST(floor(value * 100) AS BIGINT) AS size_bytes
FROM events""",
    "fx6b": """SELECT CAST(ts AS TIMESTAMP) AS snapshot_ts, 'db' AS scope,
       concat('db_', CAST(user_id % 4 AS STRING)) AS dbname,
       CAST(NULL AS STRING) AS schemaname, CAST(NULL AS STRING) AS relname,
       event_id * 1048576 + CAST(floor(value * 100) AS BIGINT) AS size_bytes
FROM events""",
    "fx7": """SELECT s_suppkey AS pid, s_name AS application_name,
       CASE WHEN s_suppkey % 10 = 0 THEN 'catchup' ELSE 'streaming' END AS state,
       CASE WHEN s_suppkey % 3 = 0 THEN 'sync' ELSE 'async' END AS sync_state,
       CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 1000 END AS replay_lag_us,
       s_suppkey * 4096 AS sent_lsn_bytes, s_suppkey * 4096 - s_suppkey % 5 AS replay_lsn_bytes
FROM supplier""",
    "fx8": """SELECT o_custkey AS server_id, CASE WHEN o_custkey % 2 = 0 THEN 140000 ELSE 170000 END AS server_version_num,
       CAST(sum(o_orderkey % 7) AS BIGINT) AS buffers_clean, CAST(sum(o_orderkey % 3) AS BIGINT) AS maxwritten_clean,
       CAST(min(o_orderdate) AS TIMESTAMP) AS stats_reset,
       CASE WHEN o_custkey % 2 = 0 THEN count(*) END AS checkpoints_timed,
       CASE WHEN o_custkey % 2 = 1 THEN count(*) END AS num_timed,
       CASE WHEN o_custkey % 2 = 0 THEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) END AS checkpoints_req,
       CASE WHEN o_custkey % 2 = 1 THEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) END AS num_requested
FROM orders GROUP BY o_custkey""",
    "fx9": """SELECT concat('db_', CAST(p_size % 4 AS STRING)) AS datname, concat('part_', CAST(p_partkey AS STRING)) AS table_name,
       CASE p_partkey % 3 WHEN 0 THEN 'scanning heap' WHEN 1 THEN 'vacuuming heap' ELSE 'cleaning up' END AS phase,
       CAST(p_size AS BIGINT) * 100 AS heap_blks_total, CAST(p_size AS BIGINT) * (p_partkey % 100) AS heap_blks_scanned
FROM part""",
    "fx10": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN s_nationkey + 100
       ELSE s_nationkey END AS database_type_id,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE concat('host_', CAST(s_suppkey % 2 AS STRING)) END AS host,
       5432 + s_suppkey % 2 AS port, concat('db_', CAST(s_suppkey % 4 AS STRING)) AS database_name,
       'secret' AS encrypted_password, s_suppkey % 2 = 0 AS connect_at_startup, TRUE AS is_active
FROM supplier""",
    "fx10t": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "fx10c": """SELECT c_custkey % 200 + 1 AS id, c_custkey AS change_ts,
       CASE c_custkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'flag' END AS op,
       c_nationkey AS database_type_id, concat('host_', CAST(c_custkey AS STRING)) AS host,
       c_custkey % 2 = 0 AS is_active, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS description,
       c_custkey % 5 <> 0 AS sets_description
FROM customer""",
    "fx11": """SELECT c_custkey AS job_id, c_name AS job_name, c_mktsegment AS tool_name,
       CASE c_custkey % 3 WHEN 0 THEN '{"connection_id": "1"}' WHEN 1 THEN '{broken' ELSE NULL END AS tool_params,
       CASE WHEN c_custkey % 11 = 0 THEN 'manual' WHEN c_custkey % 2 = 0 THEN 'interval' ELSE 'cron' END AS trigger_type,
       CASE WHEN c_custkey % 2 = 0 THEN 3600 * (1 + c_custkey % 10) END AS interval_seconds,
       CASE WHEN c_custkey % 2 = 1 THEN concat(CAST(c_custkey % 60 AS STRING), ' */6 * * *') END AS cron_expression,
       c_custkey % 5 <> 0 AS is_active
FROM customer""",
    "fx11r": "SELECT o_custkey AS job_id, o_orderdate AS run_ts, o_orderstatus = 'F' AS success FROM orders",
    "fx12": """SELECT event_id AS request_id, concat('key_', CAST(user_id % 10 AS STRING)) AS api_key,
       event_type AS resource_name, CASE WHEN event_id % 2 = 0 THEN 'list' ELSE 'execute' END AS action,
       CASE WHEN user_id % 6 <> 0 THEN 'user_' || CAST(user_id % 12 AS STRING) END AS user_id
FROM events""",
    "fx11c": """SELECT o_custkey AS job_id, o_orderkey AS change_ts, CASE WHEN o_orderkey % 13 = 0 THEN 'delete' ELSE 'patch' END AS op,
       'job ' || CAST(o_orderkey AS STRING) AS job_name, o_orderpriority AS tool_params, o_orderkey % 3 = 0 AS is_active,
       o_orderkey % 4 AS form FROM orders""",
}


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({FX[n]})" for n in names) + "\n"


def _window(src: str, scope: str) -> str:
    return (f"SELECT * FROM {src} WHERE scope = '{scope}' "
            f"AND snapshot_ts >= {NOW_E} - INTERVAL {TREND_DAYS} DAY AND snapshot_ts < {NOW_E}")


def _daily(src: str, scope: str) -> str:
    return (f"SELECT dbname, schemaname, relname, CAST(snapshot_ts AS DATE) AS d, max(size_bytes) AS size_bytes "
            f"FROM ({_window(src, scope)}) GROUP BY dbname, schemaname, relname, CAST(snapshot_ts AS DATE)")


_GROWTH = """round(CAST(end_size - start_size AS DOUBLE) / 1048576.0::DOUBLE, 2) AS growth_mb,
       round(CAST(end_size - start_size AS DOUBLE) / nullif(start_size, 0) * 100, 2) AS growth_pct,
       round(CAST(end_size - start_size AS DOUBLE) / 1048576.0::DOUBLE / nullif({steps}, 0), 2) AS growth_mb_per_day"""

_SPAN = """SELECT dbname, schemaname, relname, min(d) AS start_date, max(d) AS end_date,
       min(size_bytes) AS start_size, max(size_bytes) AS end_size, count(*) AS points
FROM daily GROUP BY dbname, schemaname, relname"""


# Names that PostgreSQL's identifier formatter quotes, from the appendix of SQL
# key words of its manual (reserved, or not free as a function, type or column name).
_QUOTED_WORDS = """
    ALL ANALYSE ANALYZE AND ANY ARRAY AS ASC ASYMMETRIC AUTHORIZATION BETWEEN BIGINT BINARY BIT BOOLEAN BOTH CASE
    CAST CHAR CHARACTER CHECK COALESCE COLLATE COLLATION COLUMN CONCURRENTLY CONSTRAINT CREATE CROSS CURRENT_CATALOG
    CURRENT_DATE CURRENT_ROLE CURRENT_SCHEMA CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER DEC DECIMAL DEFAULT
    DEFERRABLE DESC DISTINCT DO ELSE END EXCEPT EXISTS EXTRACT FALSE FETCH FLOAT FOR FOREIGN FREEZE FROM FULL GRANT
    GREATEST GROUP GROUPING HAVING ILIKE IN INITIALLY INNER INOUT INT INTEGER INTERSECT INTERVAL INTO IS ISNULL JOIN
    JSON JSON_ARRAY JSON_ARRAYAGG JSON_EXISTS JSON_OBJECT JSON_OBJECTAGG JSON_QUERY JSON_SCALAR JSON_SERIALIZE
    JSON_TABLE JSON_VALUE LATERAL LEADING LEAST LEFT LIKE LIMIT LOCALTIME LOCALTIMESTAMP MERGE_ACTION NATIONAL
    NATURAL NCHAR NONE NORMALIZE NOT NOTNULL NULL NULLIF NUMERIC OFFSET ON ONLY OR ORDER OUT OUTER OVERLAPS OVERLAY
    PLACING POSITION PRECISION PRIMARY REAL REFERENCES RETURNING RIGHT ROW SELECT SESSION_USER SETOF SIMILAR SMALLINT
    SOME SUBSTRING SYMMETRIC SYSTEM_USER TABLE TABLESAMPLE THEN TIME TIMESTAMP TO TRAILING TREAT TRIM TRUE UNION
    UNIQUE USER USING VALUES VARCHAR VARIADIC VERBOSE WHEN WHERE WINDOW WITH XMLATTRIBUTES XMLCONCAT XMLELEMENT
    XMLEXISTS XMLFOREST XMLNAMESPACES XMLPARSE XMLPI XMLROOT XMLSERIALIZE XMLTABLE
"""


def _quote_ident_sql(c: str) -> str:
    kws = ", ".join(f"'{k.lower()}'" for k in _QUOTED_WORDS.split())
    return (f"CASE WHEN regexp_matches({c}, '[^a-z0-9_]') OR {c} = '' OR regexp_matches({c}, '^[0-9]') OR {c} IN ({kws}) "
            f"THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END")


def _size_pretty_sql(c: str) -> str:
    """pg_size_pretty of a non-negative size: bytes below 10 kB, else the first unit below 20479 halves, rounded half up."""
    x = f"CAST({c} AS HUGEINT)"
    rungs = [f"WHEN {x} < 10240 THEN CAST({x} AS VARCHAR) || ' bytes'"]
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), start=1):
        # PostgreSQL halves a value that carries one bit more than the unit.
        half = f"({x} // {1024 ** power // 2})"
        rungs.append(f"WHEN {half} < 20479 THEN CAST(({half} + 1) // 2 AS VARCHAR) || ' {unit}'")
    return "CASE " + " ".join(rungs) + f" ELSE CAST((({x} // {1024 ** 5 // 2}) + 1) // 2 AS VARCHAR) || ' PB' END"


def _latest(src: str, scope: str) -> str:
    return (f"SELECT dbname, schemaname, relname, snapshot_ts, size_bytes FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY dbname, schemaname, relname ORDER BY snapshot_ts DESC, size_bytes DESC) AS rn "
            f"FROM {src} WHERE scope = '{scope}' AND snapshot_ts < {NOW_E} "
            f"AND snapshot_ts >= {NOW_E} - INTERVAL {TREND_DAYS} DAY) WHERE rn = 1")


NB, ND, NS, NT = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS TIMESTAMP)"


def _pct(part: str, total: str, zero: str = "NULL") -> str:
    return (f"CASE WHEN ({total}) = 0 THEN {zero} "
            f"ELSE round(CAST({part} AS DOUBLE) * 100.0 / ({total}), 2) END")


def _age(c: str) -> str:
    return f"(epoch_us({NOW_E}) - epoch_us({c})) / 1000000.0::DOUBLE"


def _topn(inner: str, part: str, order: str, n: int) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) "
            f"AS rn FROM ({inner})) WHERE rn <= {n}")
