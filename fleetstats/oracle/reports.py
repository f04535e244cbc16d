"""Oracle SQL for the reports (R1-R15), sources (S1-S5) and catalog."""

from __future__ import annotations

from fleetstats.oracle import base as o
from fleetstats.oracle.base import NB, ND, NS, NT, _age, _pct, _topn
from fleetstats.sources.tables import TABLES


def report_sql() -> dict[str, str]:
    q = {}
    q["health_overview"] = o._with("fx1") + f"""SELECT {o.NOW_E} AS collected_at, datname AS db_name, snapshot_date,
       numbackends, xact_commit, xact_rollback, blks_read, blks_hit,
       {_pct('blks_hit', 'blks_hit + blks_read')} AS cache_hit_ratio,
       {NB} AS tup_returned, {NB} AS tup_fetched, {NB} AS tup_inserted, {NB} AS tup_updated, {NB} AS tup_deleted,
       deadlocks, {NB} AS temp_files, temp_bytes, {ND} AS blk_read_time, {ND} AS blk_write_time
FROM fx1"""
    by_state = ", ".join(f"sum(CASE WHEN state = '{st}' THEN 1 ELSE 0 END)::BIGINT AS {name}"
                         for st, name in (("active", "active_connections"), ("idle", "idle_connections"),
                                          ("idle in transaction", "idle_in_tx_connections")))
    q["connections_summary"] = o._with("fx2") + f"""SELECT datname, count(*) AS total_connections, {by_state},
       max({_age('xact_start')}) AS max_tx_age_seconds, max({_age('query_start')}) AS max_query_age_seconds
FROM fx2 GROUP BY datname"""
    for key, db in (("single", "db_3"), ("unknown", "db_none")):
        q[f"connections_summary_{key}"] = o._with("fx2") + f"""SELECT '{db}' AS datname, count(*) AS total_connections,
       count(*) FILTER (state = 'active') AS active_connections, count(*) FILTER (state = 'idle') AS idle_connections,
       count(*) FILTER (state = 'idle in transaction') AS idle_in_tx_connections,
       max({_age('xact_start')}) AS max_tx_age_seconds, max({_age('query_start')}) AS max_query_age_seconds
FROM fx2 WHERE datname = '{db}'"""
    inner = f"""SELECT datname, pid, usename, application_name, {NS} AS client_addr, state,
       {_age('xact_start')} AS tx_age_seconds, {_age('query_start')} AS query_age_seconds,
       wait_event_type, {NS} AS wait_event, substring(query, 1, 200) AS query_sample FROM fx2"""
    q["connections_top"] = o._with("fx2") + _topn(inner, "datname", "tx_age_seconds DESC NULLS LAST, pid", 20)
    inner = f"""SELECT datname, queryid, calls, round(total_exec_time, 2) AS total_exec_time_ms,
       round(mean_exec_time, 2) AS mean_exec_time_ms, rows_returned, shared_blks_hit, shared_blks_read,
       {_pct('shared_blks_hit', 'shared_blks_hit + shared_blks_read')} AS cache_hit_ratio,
       substring(query, 1, 500) AS query_sample, total_exec_time AS t FROM fx3"""
    q["top_queries"] = (o._with("fx3") + "SELECT * EXCLUDE (t) FROM ("
                        + _topn(inner, "datname", "t DESC NULLS LAST, queryid", 10) + ")")
    q["top_queries_by_oid"] = q["top_queries"]
    cand = f"""SELECT datname, schemaname, relname, n_live_tup, n_dead_tup,
       {_pct('n_dead_tup', 'n_live_tup + n_dead_tup', '0.0::DOUBLE')} AS dead_tuple_pct FROM fx4"""
    cand_top = _topn(cand, "datname", "dead_tuple_pct DESC NULLS LAST, schemaname, relname", 20)
    q["bloat_candidates"] = o._with("fx4") + cand_top
    q["bloat_report"] = o._with("fx4", "fx5") + f""", cand AS ({cand_top}),
m AS (SELECT DISTINCT datname FROM fx5)
SELECT c.datname, CASE WHEN m.datname IS NOT NULL THEN 'pgstattuple' ELSE 'dead_tuple_only_fallback' END AS mode,
       c.schemaname, c.relname, c.n_live_tup, c.n_dead_tup, c.dead_tuple_pct,
       {NB} AS table_len, {NB} AS tuple_count, {NB} AS tuple_len, {ND} AS tuple_percent,
       {NB} AS dead_tuple_count, {NB} AS dead_tuple_len,
       CASE WHEN m.datname IS NOT NULL THEN t.dead_tuple_percent END AS dead_tuple_percent,
       {NB} AS free_space, {ND} AS free_percent,
       CASE WHEN m.datname IS NOT NULL THEN t.error END AS error
FROM cand c LEFT JOIN m ON c.datname = m.datname
LEFT JOIN fx5 t ON c.datname = t.datname AND c.schemaname = t.schemaname AND c.relname = t.relname
WHERE m.datname IS NULL OR t.relname IS NOT NULL"""
    q["table_bloat"] = o._with("fx4", "fx5") + f""", tabs AS (SELECT DISTINCT datname, schemaname AS table_schema,
       relname AS table_name FROM fx4 WHERE schemaname NOT IN ('pg_catalog', 'information_schema')),
m AS (SELECT DISTINCT datname FROM fx5),
j AS (SELECT t.datname, t.table_schema, t.table_name, m.datname AS md, u.relname AS ur, u.dead_tuple_percent,
       u.error, s.relname AS sr, s.n_live_tup, s.n_dead_tup, s.last_vacuum, s.last_autovacuum
FROM tabs t LEFT JOIN m ON t.datname = m.datname
LEFT JOIN fx5 u ON t.datname = u.datname AND t.table_schema = u.schemaname AND t.table_name = u.relname
LEFT JOIN fx4 s ON t.datname = s.datname AND t.table_schema = s.schemaname AND t.table_name = s.relname),
r AS (SELECT datname, table_schema AS schema, table_name AS "table",
       CASE WHEN md IS NOT NULL THEN (CASE WHEN ur IS NULL THEN 0.0::DOUBLE ELSE dead_tuple_percent END)
            ELSE (CASE WHEN sr IS NULL OR n_live_tup + n_dead_tup = 0 THEN 0.0::DOUBLE
                       ELSE n_dead_tup / (n_live_tup + n_dead_tup) * 100 END) END AS dead_tuple_percent,
       CASE WHEN md IS NOT NULL THEN 'pgstattuple' ELSE 'pg_stat_user_tables' END AS source,
       CASE WHEN md IS NULL THEN CAST(last_vacuum AS TIMESTAMP) END AS last_vacuum,
       CASE WHEN md IS NULL THEN CAST(last_autovacuum AS TIMESTAMP) END AS last_autovacuum,
       CASE WHEN md IS NOT NULL THEN error END AS error FROM j)
SELECT *, dead_tuple_percent > 30.0::DOUBLE AS exceeds FROM r"""
    q["vacuum_progress"] = o._with("fx9") + f"""SELECT datname, table_name, phase, heap_blks_total, heap_blks_scanned,
       {NB} AS heap_blks_vacuumed, {NB} AS index_vacuum_count FROM fx9"""
    health = f"""SELECT datname, schemaname, relname, n_live_tup, n_dead_tup, CAST(last_vacuum AS TIMESTAMP) AS last_vacuum,
       CAST(last_autovacuum AS TIMESTAMP) AS last_autovacuum, {NT} AS last_analyze, {NT} AS last_autoanalyze FROM fx4"""
    q["table_health"] = o._with("fx4") + _topn(health, "datname", "n_dead_tup DESC NULLS LAST, schemaname, relname", 50)
    q["collect_statistics"] = o._with("fx4") + health
    q["bgwriter"] = o._with("fx8") + "SELECT server_id, buffers_clean, maxwritten_clean, stats_reset FROM fx8"
    new = "server_version_num >= 150000"
    q["checkpointer"] = o._with("fx8") + f"""SELECT server_id, server_version_num,
       CASE WHEN {new} THEN num_timed ELSE checkpoints_timed END AS num_timed,
       CASE WHEN {new} THEN num_requested ELSE checkpoints_req END AS num_requested,
       {NB} AS buffers_written, {ND} AS write_time, {ND} AS sync_time,
       CASE WHEN {new} THEN stats_reset END AS stats_reset FROM fx8"""
    q["db_capacity"] = (o._with("fx6b") + f"SELECT dbname AS datname, size_bytes FROM ({o._latest('fx6b', 'db')})")
    sizes = (f"SELECT dbname AS datname, schemaname, relname, "
             f"{o._quote_ident_sql('schemaname')} || '.' || {o._quote_ident_sql('relname')} AS table_label, "
             f"size_bytes FROM ({o._latest('fx6', 'table')})")
    q["top_table_sizes"] = o._with("fx6") + _topn(sizes, "datname", "size_bytes DESC NULLS LAST, schemaname, relname", 20)
    q["database_sizes"] = (o._with("fx6b") + f"SELECT dbname AS database_name, {o._size_pretty_sql('size_bytes')} "
                           f"AS size_pretty, size_bytes FROM ({o._latest('fx6b', 'db')})")

    def lsn(c):
        return f"CASE WHEN {c} IS NOT NULL THEN printf('%X/%X', {c} >> 32, {c} & 4294967295) END"

    q["replication_status"] = o._with("fx7") + f"""SELECT pid, {NB} AS usesysid, {NS} AS usename, application_name,
       {NS} AS client_addr, state, sync_state, {NB} AS write_lag_us, {NB} AS flush_lag_us, replay_lag_us,
       {lsn('sent_lsn_bytes')} AS sent_lsn, sent_lsn_bytes, {NS} AS write_lsn, {NB} AS write_lsn_bytes,
       {NS} AS flush_lsn, {NB} AS flush_lsn_bytes, {lsn('replay_lsn_bytes')} AS replay_lsn, replay_lsn_bytes,
       sent_lsn_bytes - replay_lsn_bytes AS replay_gap_bytes FROM fx7"""
    q["scan_stats"] = o._with("fx1") + f"""SELECT datname, snapshot_date, numbackends, xact_commit, xact_rollback,
       blks_read, blks_hit, {NB} AS tup_returned, {NB} AS tup_fetched, {NB} AS tup_inserted, {NB} AS tup_updated,
       {NB} AS tup_deleted, deadlocks, {NB} AS temp_files, temp_bytes, {ND} AS blk_read_time,
       {ND} AS blk_write_time FROM fx1"""
    q["append_db_capacity"] = (o._with("fx6b") + f"SELECT {o.NOW_E} AS snapshot_ts, 'db' AS scope, dbname, "
                               f"{NS} AS schemaname, {NS} AS relname, size_bytes, CAST({o.NOW_E} AS DATE) AS "
                               f"snapshot_date FROM ({o._latest('fx6b', 'db')})")
    q["append_table_capacity"] = (o._with("fx6") + f"SELECT {o.NOW_E} AS snapshot_ts, 'table' AS scope, dbname, "
                                  f"schemaname, relname, size_bytes, CAST({o.NOW_E} AS DATE) AS snapshot_date "
                                  f"FROM ({o._latest('fx6', 'table')})")
    q["daily_max_stream"] = o._with("fx6") + """, wm AS (SELECT max(snapshot_ts) - INTERVAL 1 DAY AS w FROM fx6)
SELECT scope, dbname, schemaname, relname, CAST(snapshot_ts AS DATE) AS d, max(size_bytes) AS size_bytes
FROM fx6 GROUP BY scope, dbname, schemaname, relname, CAST(snapshot_ts AS DATE)
HAVING CAST(CAST(snapshot_ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT w FROM wm)"""
    q["report_json"] = ("SELECT 'Health Overview' AS title, CAST(NULL AS VARCHAR) AS section, "
                        "CAST(to_json(h) AS VARCHAR) AS row_json FROM (" + q["health_overview"] + ") h")
    summary = q["connections_summary"].split("WITH ", 1)[1]
    sizes = q["db_capacity"].split("WITH ", 1)[1]
    q["report_json_sections"] = (
        f"SELECT 'Fleet' AS title, 'summary' AS section, CAST(to_json(h) AS VARCHAR) AS row_json FROM (WITH {summary}) h\n"
        f"UNION ALL SELECT 'Fleet', 'sizes', CAST(to_json(h) AS VARCHAR) FROM (WITH {sizes}) h")
    q["capacity_stream"] = o._with("fx6") + "SELECT *, CAST(snapshot_ts AS DATE) AS snapshot_date FROM fx6"
    return q


def catalog_sql() -> dict[str, str]:
    q = {}
    q["row_counts"] = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)
    from fleetstats.suite import RUN_SQL_ARGS, RUN_SQL_TEXT
    q["run_sql"] = RUN_SQL_TEXT.replace("{lineitem}", "lineitem").replace(":min_qty", str(RUN_SQL_ARGS["min_qty"]))
    return q
