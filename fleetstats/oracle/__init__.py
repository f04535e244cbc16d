"""DuckDB SQL twins of every registered query (the correctness oracle).

Each string starts from the FIXTURES.md derivation of its input as a CTE and then states
the report in SQL; the driver runs it next to the Spark query and compares results.
"""

from __future__ import annotations


def oracle_queries() -> dict[str, str]:
    from fleetstats.oracle.jobs import job_sql, policy_sql
    from fleetstats.oracle.registry import registry_sql
    from fleetstats.oracle.reports import catalog_sql, report_sql
    from fleetstats.oracle.series import series_sql
    from fleetstats.oracle.trends import trend_sql
    q = {}
    for part in (trend_sql, report_sql, catalog_sql, registry_sql, job_sql, policy_sql, series_sql):
        q.update(part())
    q.update(_small_forms(q))
    return q


def _small_forms(q: dict[str, str]) -> dict[str, str]:
    """One database, schema, table or job of reports whose whole form has its SQL above."""
    def only(key: str, where: str) -> str:
        return f"SELECT * FROM ({q[key]}) WHERE {where}"

    from fleetstats.oracle.base import _with
    return {
        "connections_at_startup": only("connections_list", "connect_at_startup"),
        "job_lookup": only("list_jobs", "job_id = 7"),
        "connections_top_single": only("connections_top", "datname = 'db_3'"),
        "top_queries_single": only("top_queries", "datname = 'db_2'"),
        "bloat_candidates_single": only("bloat_candidates", "datname = 'db_1'"),
        "table_health_single": only("table_health", "datname = 'db_1'"),
        "top_table_sizes_single": only("top_table_sizes", "datname = 'db_2'"),
        "collect_statistics_schema": only("collect_statistics", "schemaname = 'Brand#11'"),
        "collect_statistics_table": only("collect_statistics", "schemaname = 'Brand#17' AND relname = 'part_1'"),
        "types_apply": _with("fx10t") + """, log AS (SELECT c_custkey % 31 AS id, c_custkey AS change_ts,
       CASE WHEN c_custkey % 5 = 0 THEN 'delete' WHEN c_custkey % 2 = 0 THEN 'insert' ELSE 'update' END AS op, c_name AS name FROM customer),
marked AS (SELECT *, coalesce((SELECT b.op = 'insert' FROM log b WHERE b.id = l.id AND b.op <> 'update' AND b.change_ts < l.change_ts
                               ORDER BY b.change_ts DESC LIMIT 1), l.id IN (SELECT id FROM fx10t)) AS present FROM log l),
landed AS (SELECT id, arg_max(op, change_ts) AS op, arg_max(name, change_ts) AS name,
                  coalesce(arg_max(op, change_ts) FILTER (WHERE op <> 'update'), '') AS last_end
           FROM marked WHERE (op = 'insert') <> present GROUP BY id)
SELECT CAST(id AS INTEGER) AS id, name FROM fx10t WHERE id NOT IN (SELECT id FROM landed)
UNION ALL SELECT CAST(id AS INTEGER), name FROM landed WHERE last_end <> 'delete'""",
        "replication_intervals": """SELECT s_suppkey AS pid,
       CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 7 * 60 + s_suppkey % 50) * 1000000 END AS replay_lag_us,
       printf('%X/%X', s_suppkey % 3, s_suppkey * 4096) AS sent_lsn, s_suppkey % 3 * 4294967296 + s_suppkey * 4096 AS sent_lsn_bytes,
       printf('%X/%X', s_suppkey % 3, s_suppkey * 4096 - s_suppkey % 5) AS replay_lsn,
       s_suppkey % 3 * 4294967296 + s_suppkey * 4096 - s_suppkey % 5 AS replay_lsn_bytes, s_suppkey % 5 AS replay_gap_bytes FROM supplier""",
    }
