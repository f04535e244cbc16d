"""Declared schemas of the statistics views and metadata tables.

Column names follow the database statistics views and the registry DDL; every
frame carries ``datname`` (or ``dbname`` / ``server_id``) so one job covers a fleet.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS, DT = T.TimestampType(), T.DateType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STAT_DATABASE = _schema(
    ("datname", S), ("snapshot_date", DT), ("numbackends", L), ("xact_commit", L),
    ("xact_rollback", L), ("blks_read", L), ("blks_hit", L), ("tup_returned", L),
    ("tup_fetched", L), ("tup_inserted", L), ("tup_updated", L), ("tup_deleted", L),
    ("deadlocks", L), ("temp_files", L), ("temp_bytes", L), ("blk_read_time", D),
    ("blk_write_time", D),
)

STAT_ACTIVITY = _schema(
    ("datname", S), ("pid", L), ("usename", S), ("application_name", S), ("client_addr", S),
    ("state", S), ("xact_start", TS), ("query_start", TS), ("wait_event_type", S),
    ("wait_event", S), ("query", S),
)

STAT_STATEMENTS = _schema(
    ("datname", S), ("queryid", L), ("calls", L), ("total_exec_time", D), ("mean_exec_time", D),
    ("rows_returned", L), ("shared_blks_hit", L), ("shared_blks_read", L), ("query", S),
)

STAT_USER_TABLES = _schema(
    ("datname", S), ("schemaname", S), ("relname", S), ("n_live_tup", L), ("n_dead_tup", L),
    ("last_vacuum", TS), ("last_autovacuum", TS), ("last_analyze", TS), ("last_autoanalyze", TS),
)

# The measurement row of a tuple-level scan (the columns of PostgreSQL's pgstattuple),
# plus the error text of a failed measurement.
TUPLE_MEASURES = [("table_len", L), ("tuple_count", L), ("tuple_len", L), ("tuple_percent", D),
                  ("dead_tuple_count", L), ("dead_tuple_len", L), ("dead_tuple_percent", D),
                  ("free_space", L), ("free_percent", D)]
TUPLE_STATS = _schema(("datname", S), ("schemaname", S), ("relname", S), *TUPLE_MEASURES, ("error", S))

VACUUM_PROGRESS = _schema(
    ("datname", S), ("table_name", S), ("phase", S), ("heap_blks_total", L),
    ("heap_blks_scanned", L), ("heap_blks_vacuumed", L), ("index_vacuum_count", L),
)

CHECKPOINT_STATS = _schema(
    ("server_id", L), ("server_version_num", I), ("buffers_clean", L), ("maxwritten_clean", L),
    ("stats_reset", TS), ("checkpoints_timed", L), ("checkpoints_req", L),
    ("checkpoint_write_time", D), ("checkpoint_sync_time", D), ("buffers_checkpoint", L),
    ("num_timed", L), ("num_requested", L), ("buffers_written", L), ("write_time", D),
    ("sync_time", D),
)

REPLICATION = _schema(
    ("pid", L), ("usesysid", L), ("usename", S), ("application_name", S), ("client_addr", S),
    ("state", S), ("sync_state", S), ("write_lag_us", L), ("flush_lag_us", L), ("replay_lag_us", L),
    ("sent_lsn", S), ("write_lsn", S), ("flush_lsn", S), ("replay_lsn", S),
    ("sent_lsn_bytes", L), ("write_lsn_bytes", L), ("flush_lsn_bytes", L), ("replay_lsn_bytes", L),
)

CAPACITY = _schema(
    ("snapshot_ts", TS), ("scope", S), ("dbname", S), ("schemaname", S), ("relname", S),
    ("size_bytes", L),
)

DB_SIZES = _schema(("datname", S), ("size_bytes", L))

CATALOG = _schema(
    ("table_schema", S), ("table_name", S), ("column_name", S), ("ordinal_position", I),
    ("table_type", S),
)

DATABASE_TYPES = _schema(("id", I), ("name", S))

CONNECTIONS = _schema(
    ("id", I), ("database_type_id", I), ("host", S), ("port", I), ("database_name", S),
    ("username", S), ("encrypted_password", S), ("is_active", B), ("description", S),
    ("connect_at_startup", B),
)

JOBS = _schema(
    ("job_id", I), ("job_name", S), ("tool_name", S), ("tool_params", S), ("trigger_type", S),
    ("interval_seconds", I), ("cron_expression", S), ("is_active", B), ("last_run_at", TS),
    ("created_at", TS), ("updated_at", TS),
)

RUN_LOG = _schema(("job_id", I), ("run_ts", TS), ("success", B))

# Fixed values from the registry DDL: column defaults on insert, and what a full-row
# update writes for a column the caller did not pass.
CONNECTION_INSERT_DEFAULTS = {"is_active": True, "connect_at_startup": True}
CONNECTION_UPDATE_RESETS = {"is_active": True, "description": None, "connect_at_startup": False}
JOB_INSERT_DEFAULTS = {"is_active": True}
# Fixed values from the registry DDL: the 4-column unique key and NOT NULL columns of
# connections, and the allowed trigger types of scheduled jobs.
CONNECTION_UNIQUE_KEY = ["database_type_id", "host", "port", "database_name"]
CONNECTION_NOT_NULL = ["host", "port", "database_name", "username", "encrypted_password"]
JOB_TRIGGER_TYPES = ["interval", "cron"]
# The keys a job patch may change.
JOB_PATCH_KEYS = ["job_name", "tool_name", "tool_params", "trigger_type", "interval_seconds",
                  "cron_expression", "is_active"]

# What a connection patch may change: all but the key and the stored secret.
CONNECTION_PATCH_KEYS = ["database_type_id", "host", "port", "database_name", "username", "is_active", "description",
                         "connect_at_startup"]

KINDS = {
    "stat_database": STAT_DATABASE,
    "stat_activity": STAT_ACTIVITY,
    "stat_statements": STAT_STATEMENTS,
    "stat_user_tables": STAT_USER_TABLES,
    "tuple_stats": TUPLE_STATS,
    "vacuum_progress": VACUUM_PROGRESS,
    "checkpoint_stats": CHECKPOINT_STATS,
    "replication": REPLICATION,
    "capacity_snapshots": CAPACITY,
    "db_sizes": DB_SIZES,
    "catalog": CATALOG,
    "database_types": DATABASE_TYPES,
    "connections": CONNECTIONS,
    "jobs": JOBS,
    "run_log": RUN_LOG,
}
