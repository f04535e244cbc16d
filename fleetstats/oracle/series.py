"""Oracle SQL for counters, as-of joins, upserted days and registry history."""

from __future__ import annotations

from fleetstats.oracle import base as o
from fleetstats.oracle.registry import _PRESENCE, CONN

FX13 = """fx13 AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'srv_hot' WHEN user_id % 50 <> 1 THEN concat('srv_', CAST(user_id % 20 AS VARCHAR)) END AS server,
       CAST(ts AS TIMESTAMP) AS snapshot_ts, event_id AS snapshot_id,
       CASE WHEN event_id % 50 <> 0 THEN (event_id * 13 + CAST(floor(value) AS BIGINT)) % 50000 END AS xact_commit,
       (event_id * 3) % 2100 AS buffers_clean, date_trunc('week', CAST(ts AS TIMESTAMP)) AS stats_reset FROM events)"""
FX14 = """fx14 AS (SELECT concat('db_', CAST(l_partkey % 2 AS VARCHAR)) AS datname, CASE WHEN l_partkey % 5 <> 0 THEN 'public' END AS schemaname,
       CASE WHEN l_orderkey % 3 = 0 THEN 'part_hot' ELSE concat('part_', CAST(l_partkey % 40 AS VARCHAR)) END AS relname,
       CAST(l_shipdate AS TIMESTAMP) AS snapshot_ts, l_orderkey AS sample_id, CAST(l_linenumber AS BIGINT) AS sample_no,
       CAST(floor(l_quantity) AS BIGINT) AS n_live_tup, CAST(l_linenumber * 3 AS BIGINT) AS n_dead_tup FROM lineitem),
fx14m AS (SELECT concat('db_', CAST(o_custkey % 2 AS VARCHAR)) AS datname, CASE WHEN o_custkey % 5 <> 0 THEN 'public' END AS schemaname,
       CASE WHEN o_orderkey % 3 = 0 THEN 'part_hot' ELSE concat('part_', CAST(o_custkey % 44 + 3 AS VARCHAR)) END AS relname,
       CAST(o_orderdate AS TIMESTAMP) AS measured_ts, o_orderkey AS measure_id,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS dead_tuple_percent FROM orders)"""


def _counter(c: str) -> str:
    """(server, day, growth, resets, gaps, rate) of one counter, from its own snapshots in order."""
    return f"""SELECT server, CAST(snapshot_ts AS DATE) AS day,
         CAST(sum(CASE WHEN us <= 86400000000 THEN delta END) AS BIGINT) AS {c}_delta,
         count(CASE WHEN fell THEN 1 END) AS {c}_resets, count(CASE WHEN us > 86400000000 THEN 1 END) AS {c}_gaps,
         round(CAST(sum(CASE WHEN us <= 86400000000 THEN delta END) AS DOUBLE)
               / nullif(CAST(sum(CASE WHEN us <= 86400000000 THEN us END) AS BIGINT), 0) * 1000000.0::DOUBLE, 6) AS {c}_per_s
  FROM (SELECT *, CASE WHEN before_at IS NULL THEN NULL WHEN fell THEN {c} ELSE {c} - before_n END AS delta,
               epoch_us(snapshot_ts) - epoch_us(CASE WHEN fell AND stats_reset > before_at AND stats_reset <= snapshot_ts
                                                     THEN stats_reset ELSE before_at END) AS us
        FROM (SELECT *, before_at IS NOT NULL AND ({c} < before_n OR stats_reset IS DISTINCT FROM before_reset) AS fell
              FROM (SELECT *, lag(snapshot_ts) OVER w AS before_at, lag({c}) OVER w AS before_n, lag(stats_reset) OVER w AS before_reset
                    FROM fx13 WHERE {c} IS NOT NULL WINDOW w AS (PARTITION BY server ORDER BY snapshot_ts, snapshot_id))))
  GROUP BY 1, 2"""


def series_sql() -> dict[str, str]:
    q = {}
    q["counter_rates"] = f"""WITH {FX13},
days AS (SELECT server, CAST(snapshot_ts AS DATE) AS day, count(*) AS snapshots FROM fx13 GROUP BY 1, 2),
a AS ({_counter('xact_commit')}),
b AS ({_counter('buffers_clean')})
SELECT days.*, xact_commit_delta, coalesce(xact_commit_resets, 0) AS xact_commit_resets, coalesce(xact_commit_gaps, 0) AS xact_commit_gaps,
       xact_commit_per_s, buffers_clean_delta, coalesce(buffers_clean_resets, 0) AS buffers_clean_resets,
       coalesce(buffers_clean_gaps, 0) AS buffers_clean_gaps, buffers_clean_per_s
FROM days LEFT JOIN a ON days.server IS NOT DISTINCT FROM a.server AND days.day = a.day
          LEFT JOIN b ON days.server IS NOT DISTINCT FROM b.server AND days.day = b.day"""
    age = "(epoch_us(snapshot_ts) - epoch_us(measured_ts))"
    fresh = f"({age} <= 2592000000000 AND dead_tuple_percent IS NOT NULL)"
    q["bloat_asof"] = f"""WITH {FX14},
newest AS (SELECT datname, schemaname, relname, measured_ts, arg_max(struct_pack(p := dead_tuple_percent), measure_id).p AS dead_tuple_percent
           FROM fx14m GROUP BY 1, 2, 3, 4),
joined AS (SELECT s.*, m.measured_ts, m.dead_tuple_percent
           FROM fx14 s ASOF LEFT JOIN newest m ON s.datname = m.datname AND coalesce(s.schemaname, '') = coalesce(m.schemaname, '')
                AND s.relname = m.relname AND s.snapshot_ts >= m.measured_ts)
SELECT datname, schemaname, relname, snapshot_ts, sample_id, sample_no, n_live_tup, n_dead_tup, measured_ts,
       round({age} / 86400000000.0::DOUBLE, 4) AS age_days,
       CASE WHEN {fresh} THEN 'measured' WHEN measured_ts IS NOT NULL AND dead_tuple_percent IS NOT NULL THEN 'stale' ELSE 'estimated' END AS source,
       CASE WHEN {fresh} THEN dead_tuple_percent
            ELSE round(n_dead_tup * 100.0::DOUBLE / nullif(n_live_tup + n_dead_tup, 0), 2) END AS dead_percent
FROM joined"""
    q["daily_max_upsert"] = (o._with("fx6") + "SELECT scope, dbname, schemaname, relname, CAST(snapshot_ts AS DATE) AS d, "
                             "max(size_bytes) AS size_bytes FROM fx6 GROUP BY 1, 2, 3, 4, 5")
    landed = "((op = 'insert' AND NOT present) OR (op <> 'insert' AND present))"

    def last(c: str, sets: str) -> str:
        return (f"last_value(CASE WHEN {sets} THEN struct_pack(v := {c}) END IGNORE NULLS) OVER "
                f"(PARTITION BY id ORDER BY change_ts NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW).v AS {c}")

    whole, ends = "op IN ('initial', 'insert', 'update')", "op IN ('initial', 'insert')"
    q["registry_history"] = (o._with("fx10", "fx10t", "fx10c") + ", " + CONN + f""",
{_PRESENCE.format(log="marked", src="fx10c", key="id", table="conn")},
steps AS (
  SELECT *, CAST(NULL AS BIGINT) AS change_ts, 'initial' AS op FROM conn
  UNION ALL BY NAME
  SELECT CAST(id AS INTEGER) AS id, change_ts, op, CAST(database_type_id AS INTEGER) AS database_type_id, host, is_active, description,
         op = 'insert' AS connect_at_startup FROM marked WHERE {landed}),
states AS (SELECT id, op, change_ts,
  {last('database_type_id', whole)}, {last('host', whole)}, {last('port', ends)}, {last('database_name', ends)}, {last('username', ends)},
  {last('encrypted_password', ends)}, {last('is_active', "op IN ('initial', 'insert', 'update', 'flag')")}, {last('description', whole)},
  {last('connect_at_startup', whole)},
  lead(change_ts) OVER (PARTITION BY id ORDER BY change_ts NULLS FIRST) AS valid_to FROM steps)
SELECT id, database_type_id, host, port, database_name, username, encrypted_password, is_active, description, connect_at_startup,
       change_ts AS valid_from, valid_to, op AS made_by FROM states WHERE op <> 'delete'""")
    q["registry_as_of"] = (f"SELECT * EXCLUDE (valid_from, valid_to, made_by) FROM ({q['registry_history']}) "
                           "WHERE (valid_from IS NULL OR valid_from <= 700) AND (valid_to IS NULL OR valid_to > 700)")
    series = "scope, dbname, schemaname, relname"
    q["series_gaps"] = o._with("fx6") + f""", days AS (SELECT DISTINCT {series}, CAST(snapshot_ts AS DATE) AS d FROM fx6),
keyed AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY {series} ORDER BY d) AS INTEGER) AS island FROM days),
islands AS (SELECT {series}, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM keyed GROUP BY {series}, island)
SELECT *, CAST(first_day - lag(last_day) OVER (PARTITION BY {series} ORDER BY first_day) - 1 AS INTEGER) AS gap_days FROM islands"""
    day0, target = f"CAST({o.NOW_E} - INTERVAL {o.TREND_DAYS} DAY AS DATE)", f"CAST(CAST({o.NOW_E} AS DATE) + INTERVAL 30 DAY AS DATE)"
    q["forecast_robust"] = o._with("fx6") + f""", daily AS ({o._daily('fx6', 'table')}),
pts AS (SELECT dbname, schemaname, relname, d, CAST(datediff('day', {day0}, d) AS DOUBLE) AS x, CAST(size_bytes AS DOUBLE) AS y FROM daily),
steps AS (SELECT *, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS s FROM pts WINDOW w AS (PARTITION BY dbname, schemaname, relname ORDER BY d)),
slopes AS (SELECT dbname, schemaname, relname, count(*) AS points, median(s) AS slope FROM steps GROUP BY 1, 2, 3),
rests AS (SELECT p.*, points, slope, y - coalesce(slope, 0) * x AS rest FROM pts p JOIN slopes USING (dbname, schemaname, relname)),
levels AS (SELECT dbname, schemaname, relname, median(rest) AS level FROM rests GROUP BY 1, 2, 3),
fits AS (SELECT dbname, schemaname, relname, any_value(points) AS points, any_value(slope) AS slope, any_value(level) AS level,
                coalesce(median(CASE WHEN isodow(d) = isodow({target}) THEN rest - level END), 0) AS season
         FROM rests JOIN levels USING (dbname, schemaname, relname) GROUP BY 1, 2, 3)
SELECT dbname, schemaname, relname, points, round(slope, 2) AS slope_bytes_per_day, round(season, 2) AS season_bytes,
       {target} AS forecast_date,
       CASE WHEN points > 1 THEN round(level + slope * CAST(datediff('day', {day0}, {target}) AS DOUBLE) + season, 2) END AS forecast_size_bytes
FROM fits"""
    q["capacity_rollup"] = o._with("fx6") + f""", sizes AS ({o._latest('fx6', 'table')}),
fleet AS (SELECT CAST(sum(size_bytes) AS BIGINT) AS total FROM sizes),
dbs AS (SELECT dbname, count(*) AS tables, CAST(sum(size_bytes) AS BIGINT) AS total FROM sizes GROUP BY 1),
schemas AS (SELECT dbname, schemaname, count(*) AS tables, CAST(sum(size_bytes) AS BIGINT) AS total FROM sizes GROUP BY 1, 2)
SELECT CAST(NULL AS VARCHAR) AS datname, CAST(NULL AS VARCHAR) AS schemaname, CAST(NULL AS VARCHAR) AS relname, 7 AS level,
       (SELECT count(*) FROM sizes) AS tables, total AS size_bytes, CAST(NULL AS DOUBLE) AS share_of_parent_pct FROM fleet
UNION ALL SELECT dbname, NULL, NULL, 3, tables, d.total, round(d.total * 100.0::DOUBLE / f.total, 4) FROM dbs d, fleet f
UNION ALL SELECT s.dbname, schemaname, NULL, 1, s.tables, s.total, round(s.total * 100.0::DOUBLE / d.total, 4)
          FROM schemas s JOIN dbs d ON s.dbname = d.dbname
UNION ALL SELECT t.dbname, t.schemaname, relname, 0, 1, size_bytes, round(size_bytes * 100.0::DOUBLE / s.total, 4)
          FROM sizes t JOIN schemas s ON t.dbname = s.dbname AND t.schemaname = s.schemaname"""
    q["profile_merge"] = o._with("fx6") + """SELECT dbname, CAST(count(*) AS BIGINT) AS n_rows, count(*) - count(size_bytes) AS n_nulls,
       min(size_bytes) AS lowest, max(size_bytes) AS highest, CAST(sum(size_bytes) AS BIGINT) AS total,
       TRUE AS distinct_close, TRUE AS quantiles_close FROM fx6 GROUP BY dbname"""
    q["top_queries_history"] = """SELECT concat('db_', CAST(l_partkey % 4 AS VARCHAR)) AS datname, l_partkey % 997 AS queryid,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS weight, count(*) AS calls
FROM lineitem GROUP BY 1, 2 ORDER BY weight DESC, datname, queryid LIMIT 20"""
    whole = ("'{\"connection_id\": ' || c_custkey || ', \"dry_run\": ' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || "
             "', \"window\": {\"days\": ' || (c_custkey % 30) || ', \"scopes\": [\"db\", \"t_' || (c_custkey % 9) || '\"]}, \"ratio\": 0.' "
             "|| (c_custkey % 4 * 25 + 5) || '}'")
    q["job_params_variant"] = f"""WITH texts AS (SELECT CAST(c_custkey AS INTEGER) AS job_id,
       CASE c_custkey % 7 WHEN 0 THEN '{{broken' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{{"connection_id": "9"}}' WHEN 3 THEN NULL ELSE {whole} END AS p
       FROM customer),
good AS (SELECT job_id, coalesce(json_valid(p), FALSE) AS valid, CASE WHEN json_valid(p) THEN p END AS p FROM texts)
SELECT job_id, valid, TRY_CAST(json_extract_string(p, '$.connection_id') AS BIGINT) AS connection_id,
       TRY_CAST(json_extract_string(p, '$.dry_run') AS BOOLEAN) AS dry_run, TRY_CAST(json_extract_string(p, '$.window.days') AS INTEGER) AS window_days,
       json_extract_string(p, '$.window.scopes[1]') AS second_scope, TRY_CAST(json_extract_string(p, '$.ratio') AS DOUBLE) AS ratio,
       CAST(CASE WHEN json_extract(p, '$.window.scopes') IS NOT NULL THEN json_array_length(p, '$.window.scopes') END AS INTEGER) AS n_scopes
FROM good"""
    return q
