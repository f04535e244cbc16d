"""Registered queries: each builds its input from the driver tables and runs one operator.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.operators import asof, catalog, counters, heavy, history, profiles, reports, trends
from fleetstats.operators import jobs as jb
from fleetstats.operators import registry as rg
from fleetstats.operators import validation as vd
from fleetstats.operators.policy import policy_decide
from fleetstats.operators.render import report_json
from fleetstats.schemas import CONNECTION_NOT_NULL, CONNECTION_UNIQUE_KEY, JOB_TRIGGER_TYPES
from fleetstats.session import scratch_dir
from fleetstats.sources import capacity as cap
from fleetstats.sources import fixtures as fx
from fleetstats.sources.sql import run_sql
from fleetstats.sources.stats import conform, load_stats
from fleetstats.sources.tables import load_tables
from fleetstats.streaming import capacity as stream
from fleetstats.streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return load_tables(spark, sf_dir, list(names))


E, DAYS = fx.AS_OF_EVENTS, fx.TREND_DAYS


# ---- trends (FX6 / FX6b) -------------------------------------------------------------
@register("growth_table")
def q_growth_table(spark, sf_dir):
    return trends.growth_table(fx.capacity_tables(tables(spark, sf_dir, "events")), E, days=DAYS, limit=10)


@register("daily_max_size")
def q_daily_max_size(spark, sf_dir):
    return trends.daily_max_size(fx.capacity_tables(tables(spark, sf_dir, "events")), E, "table", days=DAYS)


@register("growth_db")
def q_growth_db(spark, sf_dir):
    return trends.growth_db(fx.capacity_dbs(tables(spark, sf_dir, "events")), E, days=DAYS)


@register("growth_ordered")
def q_growth_ordered(spark, sf_dir):
    return trends.growth_ordered(fx.capacity_tables(tables(spark, sf_dir, "events")), E, days=DAYS, limit=10)


@register("growth_forecast")
def q_growth_forecast(spark, sf_dir):
    return trends.growth_forecast(fx.capacity_tables(tables(spark, sf_dir, "events")), E, days=DAYS,
                                  horizon_days=30)


@register("growth_db_single")
def q_growth_db_single(spark, sf_dir):
    return trends.growth_db(fx.capacity_dbs(tables(spark, sf_dir, "events")), E, days=DAYS, dbname="db_1")


@register("growth_db_unknown")
def q_growth_db_unknown(spark, sf_dir):
    return trends.growth_db(fx.capacity_dbs(tables(spark, sf_dir, "events")), E, days=DAYS, dbname="db_none")


@register("growth_table_single")
def q_growth_table_single(spark, sf_dir):
    return trends.growth_table(fx.capacity_tables(tables(spark, sf_dir, "events")), E, days=DAYS, limit=10, dbname="db_2")


@register("daily_max_partitioned")
def q_daily_max_partitioned(spark, sf_dir):
    """T1 over the table that the append sink writes, pruned by its date partitions."""
    path = scratch_dir(spark, "capacity")
    cap.append_snapshots(fx.capacity_tables(tables(spark, sf_dir, "events")), path)
    return trends.daily_max_size(cap.read_capacity(spark, path), E, "table", days=7)


@register("daily_max_recomputed")
def q_daily_max_recomputed(spark, sf_dir):
    """Samples of one schema come late: their series and days are aggregated again."""
    samples = fx.capacity_tables(tables(spark, sf_dir, "events"))
    late = F.col("schemaname") == "error"
    return trends.recompute_daily_max(samples.filter(~late), samples.filter(late))


# ---- reports (FX1-FX9) ---------------------------------------------------------------


@register("health_overview")
def q_health_overview(spark, sf_dir):
    return reports.health_overview(fx.stat_database(tables(spark, sf_dir, "events")), E)


@register("connections_summary")
def q_connections_summary(spark, sf_dir):
    return reports.connections_summary(fx.stat_activity(tables(spark, sf_dir, "events")), E)


@register("connections_summary_single")
def q_connections_summary_single(spark, sf_dir):
    return reports.connections_summary(fx.stat_activity(tables(spark, sf_dir, "events")), E, datname="db_3")


@register("connections_summary_unknown")
def q_connections_summary_unknown(spark, sf_dir):
    return reports.connections_summary(fx.stat_activity(tables(spark, sf_dir, "events")), E, datname="db_none")


@register("connections_top")
def q_connections_top(spark, sf_dir):
    return reports.connections_top(fx.stat_activity(tables(spark, sf_dir, "events")), E, limit=20)


@register("top_queries")
def q_top_queries(spark, sf_dir):
    return reports.top_queries(fx.stat_statements(tables(spark, sf_dir, "lineitem", "part")), limit=10)


@register("top_queries_by_oid")
def q_top_queries_by_oid(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem", "part", "region")
    return reports.top_queries(fx.stat_statements_by_oid(t), limit=10, databases=fx.databases(t))


def _table_stats(spark, sf_dir):
    return fx.stat_user_tables(tables(spark, sf_dir, "lineitem", "part"))


@register("bloat_candidates")
def q_bloat_candidates(spark, sf_dir):
    return reports.bloat_candidates(_table_stats(spark, sf_dir), limit=20)


@register("bloat_report")
def q_bloat_report(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem", "part")
    return reports.bloat_report(fx.stat_user_tables(t), fx.tuple_stats(t), limit=20)


def user_table_catalog(table_stats):
    """Catalog rows (one per table) of the tables the statistics view lists."""
    return table_stats.select("datname", F.col("schemaname").alias("table_schema"),
                              F.col("relname").alias("table_name"), F.lit(None).cast("string").alias("column_name"),
                              F.lit(None).cast("int").alias("ordinal_position"),
                              F.lit("BASE TABLE").alias("table_type"))


@register("table_bloat")
def q_table_bloat(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem", "part")
    st = fx.stat_user_tables(t)
    return reports.table_bloat(user_table_catalog(st), st, fx.tuple_stats(t), threshold=30)


@register("vacuum_progress")
def q_vacuum_progress(spark, sf_dir):
    return reports.vacuum_progress(fx.vacuum_progress(tables(spark, sf_dir, "part")))


@register("table_health")
def q_table_health(spark, sf_dir):
    return reports.table_health(_table_stats(spark, sf_dir), limit=50)


@register("collect_statistics")
def q_collect_statistics(spark, sf_dir):
    return catalog.collect_statistics(_table_stats(spark, sf_dir))


@register("bgwriter")
def q_bgwriter(spark, sf_dir):
    return reports.bgwriter(fx.checkpoint_stats(tables(spark, sf_dir, "orders")))


@register("checkpointer")
def q_checkpointer(spark, sf_dir):
    return reports.checkpointer(fx.checkpoint_stats(tables(spark, sf_dir, "orders")), threshold=150000)


@register("db_capacity")
def q_db_capacity(spark, sf_dir):
    return reports.db_capacity(trends.latest_sizes(fx.capacity_dbs(tables(spark, sf_dir, "events")), "db", E, DAYS))


@register("top_table_sizes")
def q_top_table_sizes(spark, sf_dir):
    return reports.top_table_sizes(
        trends.latest_sizes(fx.capacity_tables(tables(spark, sf_dir, "events")), "table", E, DAYS), limit=20)


@register("database_sizes")
def q_database_sizes(spark, sf_dir):
    return catalog.database_sizes(trends.latest_sizes(fx.capacity_dbs(tables(spark, sf_dir, "events")), "db", E, DAYS))


@register("replication_status")
def q_replication_status(spark, sf_dir):
    return reports.replication_status(fx.replication(tables(spark, sf_dir, "supplier")))


# ---- sources -------------------------------------------------------
@register("row_counts")
def q_row_counts(spark, sf_dir):
    return catalog.row_counts(load_tables(spark, sf_dir))


RUN_SQL_TEXT = ("SELECT l_returnflag, count(*) AS n, CAST(sum(floor(l_quantity)) AS BIGINT) AS qty, "
                "round(avg(l_discount), 6) AS avg_disc FROM {lineitem} WHERE l_quantity > :min_qty "
                "GROUP BY l_returnflag")
RUN_SQL_ARGS = {"min_qty": 10}


@register("run_sql")
def q_run_sql(spark, sf_dir):
    return run_sql(spark, RUN_SQL_TEXT, RUN_SQL_ARGS, lineitem=tables(spark, sf_dir, "lineitem")["lineitem"])


@register("scan_stats")
def q_scan_stats(spark, sf_dir):
    path = scratch_dir(spark, "stat_database")
    fx.stat_database(tables(spark, sf_dir, "events")).write.parquet(path)
    return load_stats(spark, path, "stat_database")


@register("append_db_capacity")
def q_append_db_capacity(spark, sf_dir):
    path = scratch_dir(spark, "capacity")
    latest = trends.latest_sizes(fx.capacity_dbs(tables(spark, sf_dir, "events")), "db", E, DAYS)
    cap.append_db_capacity(latest, E, path)
    return cap.read_capacity(spark, path)


@register("append_table_capacity")
def q_append_table_capacity(spark, sf_dir):
    path = scratch_dir(spark, "capacity")
    latest = trends.latest_sizes(fx.capacity_tables(tables(spark, sf_dir, "events")), "table", E, DAYS)
    cap.append_table_capacity(latest, E, path)
    return cap.read_capacity(spark, path)


# ---- registry and constraints (FX10 / FX10c) ----------------------------------------


# Fixed window for the job audit J8: one week inside the run log's period (order dates),
# and the seconds around an expected firing in which it takes a run for it.
AUDIT_FROM, AUDIT_TO, AUDIT_TOL = "1995-01-01 00:00:00", "1995-01-08 00:00:00", 3600


def _registry(spark, sf_dir):
    t = tables(spark, sf_dir, "supplier", "nation", "customer")
    return conform(fx.connections(t), "connections"), fx.database_types(t), t


@register("connections_list")
def q_connections_list(spark, sf_dir):
    conn, types, _ = _registry(spark, sf_dir)
    return rg.connections_list(conn, types)


@register("connection_lookup")
def q_connection_lookup(spark, sf_dir):
    conn, types, _ = _registry(spark, sf_dir)
    return rg.connection_lookup(conn, types, 7, with_secret=True)


@register("types_list")
def q_types_list(spark, sf_dir):
    return rg.types_list(_registry(spark, sf_dir)[1])


@register("type_lookup")
def q_type_lookup(spark, sf_dir):
    return rg.type_lookup(_registry(spark, sf_dir)[1], 3)


@register("violations_unique")
def q_violations_unique(spark, sf_dir):
    conn, _, _ = _registry(spark, sf_dir)
    return vd.violations_unique(conn, CONNECTION_UNIQUE_KEY)


@register("violations_not_null")
def q_violations_not_null(spark, sf_dir):
    conn, _, _ = _registry(spark, sf_dir)
    return vd.violations_not_null(conn, CONNECTION_NOT_NULL, "id")


@register("violations_fk")
def q_violations_fk(spark, sf_dir):
    conn, types, _ = _registry(spark, sf_dir)
    return vd.violations_fk(conn, types, "database_type_id", "id")


def _changes(t, op=None, patch=False):
    ch = fx.registry_changes(t, patch_form=patch)
    return ch if op is None else ch.filter(F.col("op") == op)


@register("registry_insert")
def q_registry_insert(spark, sf_dir):
    conn, _, t = _registry(spark, sf_dir)
    return rg.registry_insert(conn, _changes(t, "insert").drop("op"))[0]


@register("registry_insert_new")
def q_registry_insert_new(spark, sf_dir):
    conn, _, t = _registry(spark, sf_dir)
    unkeyed = _changes(t, "insert").drop("op").withColumn("id", F.lit(None).cast("int"))
    return rg.registry_insert(conn, unkeyed)[0]


@register("registry_update")
def q_registry_update(spark, sf_dir):
    conn, _, t = _registry(spark, sf_dir)
    return rg.registry_update(conn, _changes(t, "update").drop("op"))[0]


@register("registry_delete")
def q_registry_delete(spark, sf_dir):
    conn, _, t = _registry(spark, sf_dir)
    return rg.registry_delete(conn, _changes(t, "delete"))[0]


@register("registry_flag")
def q_registry_flag(spark, sf_dir):
    conn, _, t = _registry(spark, sf_dir)
    return rg.registry_flag(conn, _changes(t, "flag").select("id", "change_ts", "is_active"))[0]


@register("registry_deactivate")
def q_registry_deactivate(spark, sf_dir):
    return rg.registry_flag(_registry(spark, sf_dir)[0], value=False)[0]


@register("registry_patch")
def q_registry_patch(spark, sf_dir):
    conn, _, t = _registry(spark, sf_dir)
    return rg.registry_patch(conn, _changes(t, patch=True).drop("op"))[0]


@register("registry_apply")
def q_registry_apply(spark, sf_dir):
    conn, _, t = _registry(spark, sf_dir)
    return rg.apply_change_log(conn, _changes(t))[0]


@register("registry_rejected")
def q_registry_rejected(spark, sf_dir):
    conn, _, t = _registry(spark, sf_dir)
    return rg.apply_change_log(conn, _changes(t))[1]


@register("registry_history")
def q_registry_history(spark, sf_dir):
    conn, _, t = _registry(spark, sf_dir)
    return history.registry_history(conn, _changes(t))


#: A change in the middle of the log, after which the registry is looked up.
MIDDLE_CHANGE = 700


@register("registry_as_of")
def q_registry_as_of(spark, sf_dir):
    return history.registry_as_of(q_registry_history(spark, sf_dir), MIDDLE_CHANGE)


# ---- series (FX13, FX14) -------------------------------------------------------------
@register("counter_rates")
def q_counter_rates(spark, sf_dir):
    return counters.counter_rates(fx.counter_snapshots(tables(spark, sf_dir, "events")), ["server"], "snapshot_ts",
                                  ["xact_commit", "buffers_clean"], "stats_reset", ["snapshot_id"])


@register("bloat_asof")
def q_bloat_asof(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem", "orders")
    return asof.bloat_asof(fx.table_samples(t), fx.table_measures(t), tie=["measure_id"])


@register("daily_max_upsert")
def q_daily_max_upsert(spark, sf_dir):
    """Three drops of samples, the latest days first and one of them replayed, through the upsert sink."""
    samples = fx.capacity_tables(tables(spark, sf_dir, "events"))
    in_dir, ckpt = scratch_dir(spark, "upsert-in"), scratch_dir(spark, "upsert-ckpt")
    kept, daily = scratch_dir(spark, "upsert-samples"), scratch_dir(spark, "upsert-daily")
    part = F.pmod(F.dayofmonth("snapshot_ts") + F.when(F.col("schemaname") == "error", 1).otherwise(0), F.lit(3))
    for k in (2, 0, 1):
        samples.filter(part == k).write.mode("append").parquet(in_dir)
        upsert.run_daily_upsert(spark, in_dir, kept, daily, ckpt).awaitTermination()
    again = upsert.read_samples(spark, kept).filter("batch_id = 1").drop("snapshot_date", "batch_id")
    upsert.upsert_batch(again.checkpoint(), 1, kept, daily)
    return upsert.read_daily(spark, daily)


@register("series_gaps")
def q_series_gaps(spark, sf_dir):
    return trends.series_gaps(fx.capacity_tables(tables(spark, sf_dir, "events")))


@register("forecast_robust")
def q_forecast_robust(spark, sf_dir):
    return trends.forecast_robust(fx.capacity_tables(tables(spark, sf_dir, "events")), E, days=DAYS, horizon_days=30)


@register("capacity_rollup")
def q_capacity_rollup(spark, sf_dir):
    return reports.capacity_rollup(trends.latest_sizes(fx.capacity_tables(tables(spark, sf_dir, "events")), "table", E, DAYS))


#: Errors that merged profiles are held to: of distinct values (relative), and of ranks.
DISTINCT_ERROR, RANK_ERROR = 0.06, 0.02


@register("profile_merge")
def q_profile_merge(spark, sf_dir):
    """Daily profiles written, read back and merged; estimates beside what an exact pass finds."""
    samples = fx.capacity_tables(tables(spark, sf_dir, "events")).withColumn("day", F.to_date("snapshot_ts"))
    path = scratch_dir(spark, "profiles")
    profiles.daily_profiles(samples, ["dbname"], "day", "size_bytes").write.parquet(path)
    merged = profiles.merge_profiles(spark.read.parquet(path), ["dbname"])
    found = profiles.profile_errors(samples, merged, ["dbname"], "size_bytes")
    ranks = [F.col(f"p{int(q * 100)}_error") <= RANK_ERROR for q in profiles.QUANTILES]
    return found.select("dbname", "n_rows", "n_nulls", "lowest", "highest", F.col("total").cast("long").alias("total"),
                        (F.col("distinct_error") <= DISTINCT_ERROR).alias("distinct_close"),
                        (ranks[0] & ranks[1] & ranks[2] & ranks[3]).alias("quantiles_close"))


@register("top_queries_history")
def q_top_queries_history(spark, sf_dir):
    key = ["datname", "queryid"]
    totals = heavy.day_totals(fx.statement_history(tables(spark, sf_dir, "lineitem")), "month", key, "time_cents")
    path = scratch_dir(spark, "statement-summaries")
    heavy.summarise_days(totals, "month", key).write.parquet(path)
    return heavy.top_history(totals, spark.read.parquet(path), "month", key, 20)


# ---- jobs (FX11) ---------------------------------------------------------------------
def _jobs(spark, sf_dir):
    t = tables(spark, sf_dir, "customer", "orders")
    return fx.jobs(t), fx.run_log(t)


@register("active_jobs")
def q_active_jobs(spark, sf_dir):
    return jb.active_jobs(_jobs(spark, sf_dir)[0])


@register("list_jobs")
def q_list_jobs(spark, sf_dir):
    return jb.list_jobs(_jobs(spark, sf_dir)[0])


@register("job_params")
def q_job_params(spark, sf_dir):
    return jb.job_params_summary(_jobs(spark, sf_dir)[0])


@register("job_params_variant")
def q_job_params_variant(spark, sf_dir):
    v = jb.job_params_variant(fx.typed_jobs(tables(spark, sf_dir, "customer")))
    get = jb.variant_param
    return v.select("job_id", F.col("params").isNotNull().alias("valid"), get("$.connection_id", "long").alias("connection_id"),
                    get("$.dry_run", "boolean").alias("dry_run"), get("$.window.days", "int").alias("window_days"),
                    get("$.window.scopes[1]", "string").alias("second_scope"), get("$.ratio", "double").alias("ratio"),
                    F.size(get("$.window.scopes", "array<string>")).alias("n_scopes"))


@register("trigger_plan")
def q_trigger_plan(spark, sf_dir):
    return jb.trigger_plan(_jobs(spark, sf_dir)[0])


@register("violations_domain")
def q_violations_domain(spark, sf_dir):
    return vd.violations_domain(conform(_jobs(spark, sf_dir)[0], "jobs"), "trigger_type", JOB_TRIGGER_TYPES)


def _job_changes(spark, sf_dir, op):
    return fx.job_changes(tables(spark, sf_dir, "orders")).filter(F.col("op") == op).drop("op")


@register("job_patch")
def q_job_patch(spark, sf_dir):
    return rg.registry_patch(conform(_jobs(spark, sf_dir)[0], "jobs"), _job_changes(spark, sf_dir, "patch"),
                             key="job_id", as_of=E)[0]


@register("job_delete")
def q_job_delete(spark, sf_dir):
    return rg.registry_delete(conform(_jobs(spark, sf_dir)[0], "jobs"), _job_changes(spark, sf_dir, "delete"),
                              key="job_id")[0]


@register("last_run")
def q_last_run(spark, sf_dir):
    j, runs = _jobs(spark, sf_dir)
    return jb.last_run(j, runs)


@register("missed_runs")
def q_missed_runs(spark, sf_dir):
    j, runs = _jobs(spark, sf_dir)
    return jb.missed_runs(jb.expected_fire_times(j, AUDIT_FROM, AUDIT_TO), runs, AUDIT_TOL,
                          window=(AUDIT_FROM, AUDIT_TO))


@register("missed_runs_listed")
def q_missed_runs_listed(spark, sf_dir):
    t = tables(spark, sf_dir, "orders")
    return jb.missed_runs(fx.expected_firings(t), fx.run_log(t), AUDIT_TOL)


# ---- small forms ---------------------------------------------------------------------
@register("connections_at_startup")
def q_connections_at_startup(spark, sf_dir):
    conn, types, _ = _registry(spark, sf_dir)
    return rg.connections_list(conn, types, connect_at_startup=True)


@register("job_lookup")
def q_job_lookup(spark, sf_dir):
    return jb.list_jobs(_jobs(spark, sf_dir)[0], job_id=7)


@register("connections_top_single")
def q_connections_top_single(spark, sf_dir):
    return reports.connections_top(fx.stat_activity(tables(spark, sf_dir, "events")), E, limit=20, datname="db_3")


@register("top_queries_single")
def q_top_queries_single(spark, sf_dir):
    return reports.top_queries(fx.stat_statements(tables(spark, sf_dir, "lineitem", "part")), limit=10, datname="db_2")


@register("bloat_candidates_single")
def q_bloat_candidates_single(spark, sf_dir):
    return reports.bloat_candidates(_table_stats(spark, sf_dir), limit=20, datname="db_1")


@register("table_health_single")
def q_table_health_single(spark, sf_dir):
    return reports.table_health(_table_stats(spark, sf_dir), limit=50, datname="db_1")


@register("top_table_sizes_single")
def q_top_table_sizes_single(spark, sf_dir):
    return reports.top_table_sizes(
        trends.latest_sizes(fx.capacity_tables(tables(spark, sf_dir, "events")), "table", E, DAYS), limit=20, datname="db_2")


@register("collect_statistics_schema")
def q_collect_statistics_schema(spark, sf_dir):
    return catalog.collect_statistics(_table_stats(spark, sf_dir), schema="Brand#11")


@register("collect_statistics_table")
def q_collect_statistics_table(spark, sf_dir):
    return catalog.collect_statistics(_table_stats(spark, sf_dir), schema="Brand#17", table="part_1")


def _type_changes(spark, sf_dir):
    """Changes of database types, from customers: inserts, renames and deletes of some 30 ids."""
    k = F.col("c_custkey")
    return tables(spark, sf_dir, "customer")["customer"].select(
        (k % 31).alias("id"), k.alias("change_ts"), F.when(k % 5 == 0, "delete").when(k % 2 == 0, "insert").otherwise("update").alias("op"),
        F.col("c_name").alias("name"))


@register("types_apply")
def q_types_apply(spark, sf_dir):
    types = conform(_registry(spark, sf_dir)[1], "database_types")
    return rg.apply_change_log(types, _type_changes(spark, sf_dir), defaults={}, resets={})[0]


@register("replication_intervals")
def q_replication_intervals(spark, sf_dir):
    """The view as the server shows it: lags as intervals, log positions as text."""
    k = F.col("s_suppkey")
    view = tables(spark, sf_dir, "supplier")["supplier"].select(
        k.alias("pid"), F.col("s_name").alias("application_name"), F.lit("streaming").alias("state"), F.lit("async").alias("sync_state"),
        F.when(k % 4 != 0, F.make_dt_interval(secs=(k % 50).cast("decimal(18,6)"), mins=(k % 7).cast("int"))).alias("replay_lag"),
        F.concat(F.hex(k % 3), F.lit("/"), F.hex(k * 4096)).alias("sent_lsn"), F.concat(F.hex(k % 3), F.lit("/"), F.hex(k * 4096 - k % 5)).alias("replay_lsn"))
    return reports.replication_status(view).select("pid", "replay_lag_us", "sent_lsn", "sent_lsn_bytes", "replay_lsn", "replay_lsn_bytes",
                                                   "replay_gap_bytes")


# ---- access rules (FX12) -------------------------------------------------------------
@register("policy_decide")
def q_policy_decide(spark, sf_dir):
    return policy_decide(fx.access_requests(tables(spark, sf_dir, "events")), fx.ACCESS_POLICY)


# ---- streaming and rendering ---------------------------------------------------------
def _stream_input(spark, sf_dir):
    in_dir = scratch_dir(spark, "capacity-in")
    fx.capacity_tables(tables(spark, sf_dir, "events")).write.parquet(in_dir)
    return in_dir


@register("capacity_stream")
def q_capacity_stream(spark, sf_dir):
    in_dir = _stream_input(spark, sf_dir)
    out, ckpt = scratch_dir(spark, "capacity-out"), scratch_dir(spark, "capacity-ckpt")
    stream.capacity_stream(spark, in_dir, out, ckpt).awaitTermination()
    return cap.read_capacity(spark, out)


@register("daily_max_stream")
def q_daily_max_stream(spark, sf_dir):
    in_dir = _stream_input(spark, sf_dir)
    out, ckpt = scratch_dir(spark, "dailymax-out"), scratch_dir(spark, "dailymax-ckpt")
    stream.run_daily_max(spark, in_dir, out, ckpt, "1 day").awaitTermination()
    return spark.read.parquet(out)


@register("report_json")
def q_report_json(spark, sf_dir):
    rep = reports.health_overview(fx.stat_database(tables(spark, sf_dir, "events")), E)
    return report_json(rep, title="Health Overview")


@register("report_json_sections")
def q_report_json_sections(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    sections = {"summary": reports.connections_summary(fx.stat_activity(t), E),
                "sizes": reports.db_capacity(trends.latest_sizes(fx.capacity_dbs(t), "db", E, DAYS))}
    return report_json(sections, title="Fleet")
