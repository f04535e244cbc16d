"""Oracle SQL for the trend reports."""

from __future__ import annotations

from fleetstats.oracle.base import NOW_E, TREND_DAYS, _GROWTH, _SPAN, _daily, _with


def trend_sql() -> dict[str, str]:
    q = {}
    q["daily_max_size"] = _with("fx6") + _daily("fx6", "table")
    q["growth_db"] = (_with("fx6b") + f", daily AS ({_daily('fx6b', 'db')}), span AS ({_SPAN})\n"
                      "SELECT dbname, start_date, end_date, start_size, end_size, points,\n       "
                      + _GROWTH.format(steps="points - 1") + " FROM span")
    q["growth_table"] = (_with("fx6") + f", daily AS ({_daily('fx6', 'table')}), span AS ({_SPAN}),\n"
                         "rep AS (SELECT dbname, schemaname, relname, start_date, end_date,\n       "
                         + _GROWTH.format(steps="points - 1") + " FROM span)\n"
                         "SELECT dbname, schemaname, relname, start_date, end_date, growth_mb, growth_pct, "
                         "growth_mb_per_day FROM (SELECT *, row_number() OVER (PARTITION BY dbname ORDER BY "
                         "growth_mb DESC NULLS LAST, schemaname NULLS FIRST, relname NULLS FIRST) AS rn FROM rep) "
                         "WHERE rn <= 10")
    q["growth_ordered"] = (
        _with("fx6") + f", daily AS ({_daily('fx6', 'table')}),\n"
        "span AS (SELECT dbname, schemaname, relname, min(d) AS start_date, max(d) AS end_date, "
        "arg_min(size_bytes, d) AS start_size, arg_max(size_bytes, d) AS end_size, count(*) AS points "
        "FROM daily GROUP BY dbname, schemaname, relname),\n"
        "rep AS (SELECT dbname, schemaname, relname, start_date, end_date, start_size, end_size, points, "
        "CAST(datediff('day', start_date, end_date) AS INTEGER) AS elapsed_days,\n       "
        + _GROWTH.format(steps="datediff('day', start_date, end_date)") + " FROM span)\n"
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dbname ORDER BY "
        "growth_mb DESC NULLS LAST, schemaname NULLS FIRST, relname NULLS FIRST) AS rn FROM rep) WHERE rn <= 10")
    for key, db in (("single", "db_1"), ("unknown", "db_none")):
        q[f"growth_db_{key}"] = (
            _with("fx6b") + f", daily AS (SELECT * FROM ({_daily('fx6b', 'db')}) WHERE dbname = '{db}'),\n"
            "span AS (SELECT min(d) AS start_date, max(d) AS end_date, min(size_bytes) AS start_size, "
            f"max(size_bytes) AS end_size, count(*) AS points FROM daily)\nSELECT '{db}' AS dbname, start_date, end_date, "
            "start_size, end_size, points,\n       " + _GROWTH.format(steps="points - 1") + " FROM span")
    q["growth_table_single"] = q["growth_table"] + " AND dbname = 'db_2'"
    q["daily_max_partitioned"] = (
        _with("fx6") + "SELECT dbname, schemaname, relname, CAST(snapshot_ts AS DATE) AS d, max(size_bytes) AS size_bytes "
        f"FROM fx6 WHERE snapshot_ts >= {NOW_E} - INTERVAL 7 DAY AND snapshot_ts < {NOW_E} GROUP BY 1, 2, 3, 4")
    q["daily_max_recomputed"] = (
        _with("fx6") + "SELECT scope, dbname, schemaname, relname, CAST(snapshot_ts AS DATE) AS d, max(size_bytes) AS size_bytes "
        "FROM fx6 WHERE schemaname = 'error' GROUP BY 1, 2, 3, 4, 5")
    day0 = f"CAST({NOW_E} - INTERVAL {TREND_DAYS} DAY AS DATE)"
    target = f"CAST(CAST({NOW_E} AS DATE) + INTERVAL 30 DAY AS DATE)"
    q["growth_forecast"] = (
        _with("fx6") + f", daily AS ({_daily('fx6', 'table')}),\n"
        f"pts AS (SELECT dbname, schemaname, relname, CAST(datediff('day', {day0}, d) AS HUGEINT) AS x, "
        "CAST(size_bytes AS HUGEINT) AS y FROM daily),\n"
        "s AS (SELECT dbname, schemaname, relname, CAST(count(*) AS HUGEINT) AS n, sum(x) AS sx, sum(y) AS sy, "
        "sum(x * y) AS sxy, sum(x * x) AS sxx FROM pts GROUP BY dbname, schemaname, relname),\n"
        "t AS (SELECT *, n * sxy - sx * sy AS num, n * sxx - sx * sx AS den, "
        f"CAST(datediff('day', {day0}, {target}) AS HUGEINT) AS xh FROM s)\n"
        "SELECT dbname, schemaname, relname, CAST(n AS BIGINT) AS points,\n"
        "       CASE WHEN den <> 0 THEN round(CAST(num AS DOUBLE) / CAST(den AS DOUBLE), 2) END AS slope_bytes_per_day,\n"
        f"       {target} AS forecast_date,\n"
        "       CASE WHEN den <> 0 THEN round(CAST(sy * den - num * sx + num * xh * n AS DOUBLE) / "
        "CAST(n * den AS DOUBLE), 2) END AS forecast_size_bytes FROM t")
    return q
