"""Health, activity, statement, bloat, maintenance, capacity and replication reports.

Fleet form (``datname=None``) reports every database at once; passing ``datname`` gives
the one-database form of the statistics tools. Top-N reports keep N rows per database
(``row_number`` ≤ N, planned as a partial WindowGroupLimit before the shuffle); the
one-database form plans as TakeOrderedAndProject. Ties break on the natural key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstats.functions.exprs import age_seconds, lsn_bytes, lsn_text, qualified_name, safe_pct, ts_lit
from fleetstats.operators.catalog import resolve_tables
from fleetstats.plans.shapes import last_per_key, top_k
from fleetstats.schemas import TUPLE_MEASURES
from fleetstats.sources.stats import conform_history as _stats, snapshot_cols as _snap

# Fixed values shared with the reference reports: session states counted, sample lengths
# of query text, default limits, the checkpointer version gate, and the mode / source
# labels of the bloat reports.
STATE_ACTIVE, STATE_IDLE, STATE_IDLE_IN_TX = "active", "idle", "idle in transaction"
ACTIVITY_SAMPLE_CHARS, STATEMENT_SAMPLE_CHARS = 200, 500
LIMIT_ACTIVITY, LIMIT_STATEMENTS, LIMIT_BLOAT, LIMIT_HEALTH, LIMIT_SIZES = 20, 10, 20, 50, 20
CHECKPOINTER_VERSION = 150000
MODE_MEASURED, MODE_FALLBACK = "pgstattuple", "dead_tuple_only_fallback"
SOURCE_MEASURED, SOURCE_STATS = "pgstattuple", "pg_stat_user_tables"


def _positive(limit: int) -> int:
    if limit is None or int(limit) < 1:
        raise ValueError("limit must be a positive integer")
    return int(limit)


def _scope(df: DataFrame, datname: str | None, col: str = "datname") -> DataFrame:
    return df if datname is None else df.filter(F.col(col) == datname)


def _top(df: DataFrame, order: list[Column], limit: int, datname: str | None, col: str = "datname"):
    by = _snap(df) + ([] if datname is not None else [col])
    return top_k(df, order, _positive(limit), by or None)


# ---- R1 ------------------------------------------------------------------------------
def health_overview(stat_database: DataFrame, as_of, datname: str | None = None) -> DataFrame:
    """Raw counters plus cache hit ratio (NULL when nothing was read), per database row."""
    s = _scope(_stats(stat_database, "stat_database"), datname)
    return s.select(
        ts_lit(as_of).alias("collected_at"), F.col("datname").alias("db_name"), *_snap(s),
        "numbackends", "xact_commit", "xact_rollback", "blks_read", "blks_hit",
        safe_pct("blks_hit", F.col("blks_hit") + F.col("blks_read")).alias("cache_hit_ratio"),
        "tup_returned", "tup_fetched", "tup_inserted", "tup_updated", "tup_deleted", "deadlocks",
        "temp_files", "temp_bytes", "blk_read_time", "blk_write_time",
    )


# ---- R2 / R3 -------------------------------------------------------------------------
def connections_summary(stat_activity: DataFrame, as_of, datname: str | None = None) -> DataFrame:
    """R2: session counts by state and the oldest transaction/query age in seconds.

    ``max(now - start)`` is computed as ``now - min(start)`` (same value, cheaper state).
    With ``datname`` the result is one row even when the database has no sessions.
    """
    s = _scope(_stats(stat_activity, "stat_activity"), datname)
    snap = _snap(s)
    state = F.col("state")
    aggs = [
        F.count(F.lit(1)).alias("total_connections"),
        F.count(F.when(state == STATE_ACTIVE, 1)).alias("active_connections"),
        F.count(F.when(state == STATE_IDLE, 1)).alias("idle_connections"),
        F.count(F.when(state == STATE_IDLE_IN_TX, 1)).alias("idle_in_tx_connections"),
        F.min("xact_start").alias("_x"), F.min("query_start").alias("_q"),
    ]
    if datname is None:
        g = s.groupBy("datname", *snap).agg(*aggs)
    elif snap:
        g = s.groupBy(*snap).agg(*aggs).select(F.lit(datname).alias("datname"), "*")
    else:
        g = s.agg(*aggs).select(F.lit(datname).alias("datname"), "*")
    return g.select("datname", *snap, "total_connections", "active_connections", "idle_connections",
                    "idle_in_tx_connections", age_seconds(as_of, "_x").alias("max_tx_age_seconds"),
                    age_seconds(as_of, "_q").alias("max_query_age_seconds"))


def connections_top(stat_activity: DataFrame, as_of, datname: str | None = None,
                    limit: int = LIMIT_ACTIVITY) -> DataFrame:
    """The sessions with the oldest open transactions (NULL ages last), N per database."""
    s = _scope(_stats(stat_activity, "stat_activity"), datname)
    rows = s.select(
        "datname", *_snap(s), "pid", "usename", "application_name", "client_addr", "state",
        age_seconds(as_of, "xact_start").alias("tx_age_seconds"),
        age_seconds(as_of, "query_start").alias("query_age_seconds"),
        "wait_event_type", "wait_event", F.substring("query", 1, ACTIVITY_SAMPLE_CHARS).alias("query_sample"),
    )
    order = [F.col("tx_age_seconds").desc_nulls_last(), F.col("pid").asc()]
    return _top(rows, order, limit, datname)


# ---- R4 ------------------------------------------------------------------------------
def top_queries(stat_statements: DataFrame, limit: int = LIMIT_STATEMENTS, datname: str | None = None,
                databases: DataFrame | None = None) -> DataFrame:
    """Most expensive statements by total time (unrounded), N per database.

    Statistics keyed by database oid are resolved through ``databases`` (oid, datname)
    with an equi-join; the planner broadcasts that side only when its size allows.
    """
    s = stat_statements
    if databases is not None and "datname" not in s.columns:
        s = s.join(databases.select(F.col("oid").alias("dbid"), "datname"), "dbid")
    s = _scope(_stats(s, "stat_statements"), datname)
    rows = s.select(
        "datname", *_snap(s), "queryid", "calls",
        F.round("total_exec_time", 2).alias("total_exec_time_ms"),
        F.round("mean_exec_time", 2).alias("mean_exec_time_ms"),
        "rows_returned", "shared_blks_hit", "shared_blks_read",
        safe_pct("shared_blks_hit", F.col("shared_blks_hit") + F.col("shared_blks_read")).alias("cache_hit_ratio"),
        F.substring("query", 1, STATEMENT_SAMPLE_CHARS).alias("query_sample"),
        F.col("total_exec_time").alias("_t"),
    )
    order = [F.col("_t").desc_nulls_last(), F.col("queryid").asc()]
    return _top(rows, order, limit, datname).drop("_t")


# ---- R5 / R6 / R7 --------------------------------------------------------------------
def _candidates(table_stats: DataFrame, datname: str | None) -> DataFrame:
    s = _scope(_stats(table_stats, "stat_user_tables"), datname)
    return s.select("datname", *_snap(s), "schemaname", "relname", "n_live_tup", "n_dead_tup",
                    safe_pct("n_dead_tup", F.col("n_live_tup") + F.col("n_dead_tup"), zero_value=0.0)
                    .alias("dead_tuple_pct"))


def _bloat_order() -> list[Column]:
    return [F.col("dead_tuple_pct").desc_nulls_last(), F.col("schemaname").asc(), F.col("relname").asc()]


def bloat_candidates(table_stats: DataFrame, limit: int = LIMIT_BLOAT, datname: str | None = None) -> DataFrame:
    """Tables by dead-tuple share (0 for empty tables), N per database."""
    return _top(_candidates(table_stats, datname), _bloat_order(), limit, datname)


def _measured_dbs(tuple_stats: DataFrame, snap: list[str] | None = None) -> DataFrame:
    """Databases (per snapshot) with tuple-level measurements; one row each, aggregated map-side."""
    return tuple_stats.select("datname", *(snap or [])).distinct().withColumn("_measured", F.lit(True))


def bloat_report(table_stats: DataFrame, tuple_stats: DataFrame, limit: int = LIMIT_BLOAT,
                 datname: str | None = None) -> DataFrame:
    """Candidates enriched with tuple-level measurements where a database has them.

    Measured databases (mode ``pgstattuple``): a candidate keeps its row with the whole
    measurement (lengths, counts, percents) or the error text; a candidate without a
    measurement row is dropped.
    Other databases (mode ``dead_tuple_only_fallback``): the candidates as they are.
    """
    cand = bloat_candidates(table_stats, limit, datname)
    ts = _scope(_stats(tuple_stats, "tuple_stats"), datname)
    snap = [c for c in _snap(cand) if c in ts.columns]
    key = ["datname", *snap, "schemaname", "relname"]
    # Keep only the measurements of candidates first: the candidate keys (N per database)
    # are the small side, so the measurement table streams instead of being shuffled.
    measures = [name for name, _ in TUPLE_MEASURES]
    meas = (ts.join(cand.select(*key), key, "left_semi")
            .select(*key, *measures, "error", F.lit(True).alias("_hit")))
    j = (cand.join(_measured_dbs(ts, snap), ["datname", *snap], "left")
         .join(meas, key, "left"))
    measured = F.coalesce(F.col("_measured"), F.lit(False))
    j = j.filter(~measured | F.col("_hit").isNotNull())
    return j.select(
        "datname", *_snap(cand),
        F.when(measured, MODE_MEASURED).otherwise(MODE_FALLBACK).alias("mode"),
        "schemaname", "relname", "n_live_tup", "n_dead_tup", "dead_tuple_pct",
        *[F.when(measured, F.col(m)).alias(m) for m in measures],
        F.when(measured, F.col("error")).alias("error"),
    )


def _current(df: DataFrame, key: list[str]) -> DataFrame:
    """On a history table, the latest snapshot row per key (a partial aggregate)."""
    snap = _snap(df)
    return last_per_key(df, key, snap).drop(*snap) if snap else df


def table_bloat(catalog_df: DataFrame, table_stats: DataFrame, tuple_stats: DataFrame,
                schema: str | None = None, table: str | None = None, threshold: float | None = None,
                datname: str | None = None) -> DataFrame:
    """Dead-tuple percent of every resolved table.

    Databases with measurements report the measured percent (0.0 when the table has no
    measurement row) with source ``pgstattuple``. Others fall back to the statistics
    view: dead/(live+dead)*100 unrounded, 0.0 for empty or absent tables, plus the last
    vacuum times. ``threshold`` adds ``exceeds``. History inputs use each table's latest
    snapshot.
    """
    tables = _scope(resolve_tables(catalog_df, schema, table), datname)
    st = _current(_stats(table_stats, "stat_user_tables"), ["datname", "schemaname", "relname"]).select(
        "datname", F.col("schemaname").alias("table_schema"), F.col("relname").alias("table_name"),
        "n_live_tup", "n_dead_tup", "last_vacuum", "last_autovacuum", F.lit(True).alias("_st"))
    tu = _current(_stats(tuple_stats, "tuple_stats"), ["datname", "schemaname", "relname"])
    tm = tu.select("datname", F.col("schemaname").alias("table_schema"), F.col("relname").alias("table_name"),
                   F.col("dead_tuple_percent").alias("_measured_pct"), F.col("error"), F.lit(True).alias("_tu"))
    key = ["datname", "table_schema", "table_name"]
    # Statistics are first narrowed to the resolved tables (a semi join whose small side the
    # planner can broadcast when one table or schema is asked for). The per-table joins then
    # share one hash partitioning on the table key, and the per-database flag joins last.
    tm = tm.join(tables.select(*key), key, "left_semi")
    st = st.join(tables.select(*key), key, "left_semi")
    j = (tables.join(tm, key, "left").join(st, key, "left")
         .join(_measured_dbs(tu), "datname", "left"))
    measured = F.coalesce(F.col("_measured"), F.lit(False))
    total = F.col("n_live_tup") + F.col("n_dead_tup")
    fallback = F.when(F.col("_st").isNull() | (total == 0), F.lit(0.0)).otherwise(
        F.col("n_dead_tup") / total * F.lit(100))
    pct = F.when(measured, F.when(F.col("_tu").isNull(), F.lit(0.0)).otherwise(F.col("_measured_pct"))) \
        .otherwise(fallback)
    out = j.select(
        "datname", F.col("table_schema").alias("schema"), F.col("table_name").alias("table"),
        pct.alias("dead_tuple_percent"),
        F.when(measured, SOURCE_MEASURED).otherwise(SOURCE_STATS).alias("source"),
        F.when(~measured, F.col("last_vacuum")).alias("last_vacuum"),
        F.when(~measured, F.col("last_autovacuum")).alias("last_autovacuum"),
        F.when(measured, F.col("error")).alias("error"),
    )
    if threshold is not None:
        out = out.withColumn("exceeds", F.col("dead_tuple_percent") > F.lit(float(threshold)))
    return out


# ---- R8 / R9 -------------------------------------------------------------------------
def vacuum_progress(progress: DataFrame, datname: str | None = None) -> DataFrame:
    """Running vacuums with their progress counters."""
    return _scope(_stats(progress, "vacuum_progress"), datname)


def table_health(table_stats: DataFrame, limit: int = LIMIT_HEALTH, datname: str | None = None) -> DataFrame:
    """Tables with the most dead tuples and their maintenance times, N per database."""
    s = _scope(_stats(table_stats, "stat_user_tables"), datname)
    order = [F.col("n_dead_tup").desc_nulls_last(), F.col("schemaname").asc(), F.col("relname").asc()]
    return _top(s, order, limit, datname)


# ---- R10 / R11 -----------------------------------------------------------------------
def bgwriter(checkpoint_stats: DataFrame, server_id=None) -> DataFrame:
    """Background-writer counters per server."""
    s = _stats(checkpoint_stats, "checkpoint_stats")
    if server_id is not None:
        s = s.filter(F.col("server_id") == server_id)
    return s.select("server_id", *_snap(s), "buffers_clean", "maxwritten_clean", "stats_reset")


def checkpointer(checkpoint_stats: DataFrame, threshold: int = CHECKPOINTER_VERSION) -> DataFrame:
    """Checkpoint counters in one shape whatever the server version.

    Servers at or above ``threshold`` report the checkpointer view; older ones the
    bgwriter's checkpoint columns (which carry no reset time).
    """
    s = _stats(checkpoint_stats, "checkpoint_stats")
    new = F.col("server_version_num") >= threshold

    def pick(new_col: str, old_col: str | None) -> Column:
        old = F.col(old_col) if old_col else F.lit(None)
        return F.when(new, F.col(new_col)).otherwise(old)

    return s.select(
        "server_id", *_snap(s), "server_version_num",
        pick("num_timed", "checkpoints_timed").alias("num_timed"),
        pick("num_requested", "checkpoints_req").alias("num_requested"),
        pick("buffers_written", "buffers_checkpoint").alias("buffers_written"),
        pick("write_time", "checkpoint_write_time").alias("write_time"),
        pick("sync_time", "checkpoint_sync_time").alias("sync_time"),
        pick("stats_reset", None).alias("stats_reset"),
    )


# ---- R12 / R13 -----------------------------------------------------------------------
def db_capacity(db_sizes: DataFrame, datname: str | None = None) -> DataFrame:
    """Every database with its size, largest first."""
    name = "dbname" if "dbname" in db_sizes.columns else "datname"
    s = _scope(db_sizes, datname, name)
    return s.select(F.col(name).alias("datname"), F.col("size_bytes").cast("long")) \
        .orderBy(F.col("size_bytes").desc(), F.col("datname"))


def top_table_sizes(table_sizes: DataFrame, limit: int = LIMIT_SIZES, datname: str | None = None) -> DataFrame:
    """Largest tables with their ``%I.%I`` label, N per database."""
    name = "dbname" if "dbname" in table_sizes.columns else "datname"
    s = _scope(table_sizes, datname, name)
    rows = s.select(F.col(name).alias("datname"), "schemaname", "relname",
                    qualified_name("schemaname", "relname").alias("table_label"),
                    F.col("size_bytes").cast("long"))
    order = [F.col("size_bytes").desc_nulls_last(), F.col("schemaname").asc(), F.col("relname").asc()]
    return _top(rows, order, limit, datname)


def capacity_rollup(table_sizes: DataFrame) -> DataFrame:
    """R12, R13 as totals: the fleet, each database, schema and table, with its share of the one above.

    ``level`` is the grouping id: 0 a table, 1 a schema, 3 a database, 7 the fleet. Rows of one
    level are told from null names by it. Shares are null where the one above has no bytes.
    """
    name = "dbname" if "dbname" in table_sizes.columns else "datname"
    keys = ["datname", "schemaname", "relname"]
    sized = table_sizes.select(F.col(name).alias("datname"), "schemaname", "relname", F.col("size_bytes").cast("long"))
    totals = sized.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("tables"),
                                     F.sum("size_bytes").alias("size_bytes"))
    # The group above a row: one more key rolled up, that key's name gone.
    above = F.when(F.col("level") == 0, 1).when(F.col("level") == 1, 3).when(F.col("level") == 3, 7)
    parents = totals.filter("level > 0").select(F.col("level").alias("_l"), F.col("datname").alias("_d"),
                                                F.col("schemaname").alias("_s"), F.col("size_bytes").alias("_size"))
    joined = totals.withColumns({
        "_al": above, "_ad": F.when(F.col("level") < 3, F.col("datname")), "_as": F.when(F.col("level") < 1, F.col("schemaname"))})
    joined = joined.join(parents, (F.col("_al") == F.col("_l")) & F.col("_ad").eqNullSafe(F.col("_d"))
                         & F.col("_as").eqNullSafe(F.col("_s")), "left")
    share = F.round(F.col("size_bytes") * F.lit(100.0) / F.nullif(F.col("_size"), F.lit(0)), 4)
    return joined.select(*keys, "level", "tables", "size_bytes", share.alias("share_of_parent_pct"))


# ---- R14 -----------------------------------------------------------------------------
def replication_status(replication: DataFrame, datname: str | None = None) -> DataFrame:
    """Replica rows; lags in microseconds (interval columns ``*_lag`` are converted),
    LSNs both as ``HI/LO`` text and bytes, plus the replay gap in bytes."""
    src = replication
    if datname is not None and "datname" in src.columns:  # fleet rows tagged by source database
        src = src.filter(F.col("datname") == datname)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    for p in ("write", "flush", "replay"):
        if f"{p}_lag" in src.columns:  # interval columns as the view reports them
            micros = F.unix_micros(epoch + F.col(f"{p}_lag")) - F.unix_micros(epoch)
            have = F.col(f"{p}_lag_us") if f"{p}_lag_us" in src.columns else F.lit(None).cast("long")
            src = src.withColumn(f"{p}_lag_us", F.coalesce(have, micros))
    s = _stats(src, "replication")
    out = [F.col(c) for c in (*_snap(s), "pid", "usesysid", "usename", "application_name", "client_addr", "state",
                              "sync_state", "write_lag_us", "flush_lag_us", "replay_lag_us")]
    for p in ("sent", "write", "flush", "replay"):
        b = F.coalesce(F.col(f"{p}_lsn_bytes"), lsn_bytes(f"{p}_lsn"))
        out.append(F.coalesce(F.col(f"{p}_lsn"), lsn_text(f"{p}_lsn_bytes")).alias(f"{p}_lsn"))
        out.append(b.alias(f"{p}_lsn_bytes"))
    rows = s.select(*out)
    return rows.withColumn("replay_gap_bytes", F.col("sent_lsn_bytes") - F.col("replay_lsn_bytes"))
