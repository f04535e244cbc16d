"""Stand-in statistics inputs derived from the shared test tables (see FIXTURES.md).

Each function only reshapes driver tables into the schema an operator expects; none
of them does an operator's work. The oracle side uses the same derivations as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The reproducible "now" used by the checks (event-based fixtures).
AS_OF_EVENTS = "2024-01-31 00:00:00"
TREND_DAYS = 30


def _db(c, n: int):
    return F.concat(F.lit("db_"), (F.col(c) % n).cast("string"))


def _cnt(cond):
    return F.count(F.when(cond, F.lit(1)))


def stat_database(t: dict) -> DataFrame:
    """FX1 — pg_stat_database per (database, day)."""
    e = t["events"]
    return e.groupBy(_db("user_id", 50).alias("datname"), F.col("ts").cast("date").alias("snapshot_date")).agg(
        F.countDistinct("user_id").alias("numbackends"),
        _cnt(F.col("event_type") == "purchase").alias("xact_commit"),
        _cnt(F.col("event_type") == "error").alias("xact_rollback"),
        _cnt(F.col("event_type") == "click").alias("blks_read"),
        _cnt(F.col("event_type") == "view").alias("blks_hit"),
        _cnt((F.col("event_type") == "error") & (F.col("value") > 100)).alias("deadlocks"),
        F.sum(F.floor(F.col("value") * 100).cast("long")).cast("long").alias("temp_bytes"),
    )


def stat_activity(t: dict) -> DataFrame:
    """FX2 — pg_stat_activity sessions."""
    e = t["events"]
    m5 = F.col("event_id") % 5
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("pid"), _db("user_id", 4).alias("datname"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("usename"),
        F.concat(F.lit("app_"), (F.col("user_id") % 5).cast("string")).alias("application_name"),
        F.when(m5 == 0, "active").when(m5 == 2, "idle in transaction").when(m5 == 3, F.lit(None))
         .otherwise("idle").alias("state"),
        F.when(m5.isin(0, 2), ts).alias("xact_start"),
        F.when(m5 != 3, ts).alias("query_start"),
        F.when(F.col("event_id") % 7 == 0, F.lit("Lock")).alias("wait_event_type"),
        F.col("props").alias("query"),
    )


def stat_statements(t: dict) -> DataFrame:
    """FX3 — pg_stat_statements per statement."""
    li, p = t["lineitem"], t["part"]
    j = li.join(p, li.l_partkey == p.p_partkey)
    agg = j.groupBy("l_partkey").agg(
        F.concat(F.lit("db_"), (F.max("p_size") % 4).cast("string")).alias("datname"),
        F.count(F.lit(1)).alias("calls"),
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / F.lit(100.0))
        .alias("total_exec_time"),
        F.sum(F.floor("l_quantity").cast("long")).cast("long").alias("rows_returned"),
        _cnt(F.col("l_returnflag") != "R").alias("shared_blks_hit"),
        _cnt(F.col("l_returnflag") == "R").alias("shared_blks_read"),
        F.concat(F.lit("select * from "), F.max("p_name")).alias("query"),
    )
    return agg.select(F.col("l_partkey").alias("queryid"), "datname", "calls", "total_exec_time",
                      (F.col("total_exec_time") / F.col("calls")).alias("mean_exec_time"),
                      "rows_returned", "shared_blks_hit", "shared_blks_read", "query")


def stat_statements_by_oid(t: dict) -> DataFrame:
    """FX3b — the statements with the oid of their database in place of its name."""
    s = stat_statements(t)
    return s.withColumn("dbid", F.substring("datname", 4, 9).cast("long")).drop("datname")


def databases(t: dict) -> DataFrame:
    """FX3b — oids and names of databases."""
    return t["region"].select(F.col("r_regionkey").cast("long").alias("oid"),
                              F.concat(F.lit("db_"), F.col("r_regionkey").cast("string")).alias("datname"))


def stat_user_tables(t: dict) -> DataFrame:
    """FX4 — pg_stat_user_tables per table (some tables have no tuples at all)."""
    p = t["part"]
    li = t["lineitem"]
    j = p.join(li, li.l_partkey == p.p_partkey, "left")
    agg = j.groupBy("p_partkey", "p_size", "p_brand").agg(
        _cnt(F.col("l_returnflag") != "R").alias("n_live_tup"),
        _cnt(F.col("l_returnflag") == "R").alias("n_dead_tup"),
        F.max(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).alias("last_vacuum"),
        F.max(F.when(F.col("l_returnflag") == "N", F.col("l_shipdate"))).alias("last_autovacuum"),
    )
    return agg.select(_db("p_size", 4).alias("datname"), F.col("p_brand").alias("schemaname"),
                      F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("relname"),
                      "n_live_tup", "n_dead_tup", "last_vacuum", "last_autovacuum")


def tuple_stats(t: dict) -> DataFrame:
    """FX5 — tuple-level measurements: some of databases and tables the statistics do not list."""
    p_db, k = F.col("p_size") % 4, F.col("p_partkey")
    return t["part"].select(
        F.concat(F.when(p_db < 2, "db_").otherwise("old_"), p_db.cast("string")).alias("datname"),
        F.col("p_brand").alias("schemaname"),
        F.concat(F.when(k % 3 != 0, "part_").otherwise("gone_"), k.cast("string")).alias("relname"),
        F.when(k % 7 != 0, (k % 100).cast("double")).alias("dead_tuple_percent"),
        F.when(k % 7 == 0, F.lit("measurement failed")).alias("error"),
    )


def _capacity(t: dict, scope: str) -> DataFrame:
    e = t["events"]
    per = 1024 if scope == "table" else 1048576
    size = F.col("event_id") * per + F.floor(F.col("value") * 100).cast("long")
    if scope == "table":
        schema_c = F.col("event_type")
        rel_c = F.concat(F.lit("t_"), (F.col("user_id") % 10).cast("string"))
    else:
        schema_c = rel_c = F.lit(None).cast("string")
    return e.select(F.col("ts").cast("timestamp").alias("snapshot_ts"), F.lit(scope).alias("scope"),
                    _db("user_id", 4).alias("dbname"), schema_c.alias("schemaname"),
                    rel_c.alias("relname"), size.alias("size_bytes"))


def capacity_tables(t: dict) -> DataFrame:
    """FX6 — table-scope capacity snapshots."""
    return _capacity(t, "table")


def capacity_dbs(t: dict) -> DataFrame:
    """FX6b — database-scope capacity snapshots."""
    return _capacity(t, "db")


def replication(t: dict) -> DataFrame:
    """FX7 — pg_stat_replication rows with LSN byte positions."""
    k = F.col("s_suppkey")
    return t["supplier"].select(
        k.alias("pid"), F.col("s_name").alias("application_name"),
        F.when(k % 10 == 0, "catchup").otherwise("streaming").alias("state"),
        F.when(k % 3 == 0, "sync").otherwise("async").alias("sync_state"),
        F.when(k % 4 != 0, k * 1000).alias("replay_lag_us"),
        (k * 4096).alias("sent_lsn_bytes"), (k * 4096 - k % 5).alias("replay_lsn_bytes"),
    )


def checkpoint_stats(t: dict) -> DataFrame:
    """FX8 — bgwriter/checkpointer counters in two server-version shapes."""
    o = t["orders"]
    agg = o.groupBy("o_custkey").agg(
        F.sum(F.col("o_orderkey") % 7).cast("long").alias("buffers_clean"),
        F.sum(F.col("o_orderkey") % 3).cast("long").alias("maxwritten_clean"),
        F.min("o_orderdate").cast("timestamp").alias("stats_reset"),
        F.count(F.lit(1)).alias("_n"),
        _cnt(F.col("o_orderstatus") == "F").alias("_f"),
    )
    even = F.col("o_custkey") % 2 == 0
    odd = F.col("o_custkey") % 2 == 1
    return agg.select(
        F.col("o_custkey").alias("server_id"),
        F.when(even, F.lit(140000)).otherwise(F.lit(170000)).alias("server_version_num"),
        "buffers_clean", "maxwritten_clean", "stats_reset",
        F.when(even, F.col("_n")).alias("checkpoints_timed"), F.when(odd, F.col("_n")).alias("num_timed"),
        F.when(even, F.col("_f")).alias("checkpoints_req"), F.when(odd, F.col("_f")).alias("num_requested"),
    )


def vacuum_progress(t: dict) -> DataFrame:
    """FX9 — vacuums, one per table."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("long")
    return t["part"].select(
        _db("p_size", 4).alias("datname"), F.concat(F.lit("part_"), k.cast("string")).alias("table_name"),
        F.when(k % 3 == 0, "scanning heap").when(k % 3 == 1, "vacuuming heap").otherwise("cleaning up")
         .alias("phase"),
        (size * 100).alias("heap_blks_total"), (size * (k % 100)).alias("heap_blks_scanned"),
    )


def connections(t: dict) -> DataFrame:
    """FX10 — connection registry rows (NULL and unknown types, NULL hosts, duplicate keys)."""
    k = F.col("s_suppkey")
    return t["supplier"].select(
        k.alias("id"), F.when(k % 9 == 0, F.lit(None)).when(k % 7 == 0, F.col("s_nationkey") + 100)
        .otherwise(F.col("s_nationkey")).alias("database_type_id"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("host_"), (k % 2).cast("string"))).alias("host"),
        (F.lit(5432) + k % 2).alias("port"), _db("s_suppkey", 4).alias("database_name"),
        F.lit("secret").alias("encrypted_password"), (k % 2 == 0).alias("connect_at_startup"),
        F.lit(True).alias("is_active"),
    )


def database_types(t: dict) -> DataFrame:
    """FX10 — database type registry."""
    return t["nation"].select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def registry_changes(t: dict, patch_form: bool = False) -> DataFrame:
    """FX10c — change log against the connection registry."""
    k = F.col("c_custkey")
    out = t["customer"].select(
        (k % 200 + 1).alias("id"), k.alias("change_ts"),
        F.when(k % 4 == 0, "insert").when(k % 4 == 1, "update").when(k % 4 == 2, "delete")
         .otherwise("flag").alias("op"),
        F.col("c_nationkey").alias("database_type_id"),
        F.concat(F.lit("host_"), k.cast("string")).alias("host"),
        (k % 2 == 0).alias("is_active"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("description"),
        F.when(k % 5 != 0, F.array(F.lit("description"))).otherwise(F.array().cast("array<string>"))
         .alias("set_keys"),
    )
    return out if patch_form else out.drop("set_keys")


def jobs(t: dict) -> DataFrame:
    """FX11 — scheduled jobs (bad trigger value, broken JSON, NULL params)."""
    k = F.col("c_custkey")
    return t["customer"].select(
        k.alias("job_id"), F.col("c_name").alias("job_name"), F.col("c_mktsegment").alias("tool_name"),
        F.when(k % 3 == 0, F.lit('{"connection_id": "1"}')).when(k % 3 == 1, F.lit("{broken"))
         .alias("tool_params"),
        F.when(k % 11 == 0, "manual").when(k % 2 == 0, "interval").otherwise("cron").alias("trigger_type"),
        F.when(k % 2 == 0, F.lit(3600) * (1 + k % 10)).alias("interval_seconds"),
        F.when(k % 2 == 1, F.concat((k % 60).cast("string"), F.lit(" */6 * * *"))).alias("cron_expression"),
        (k % 5 != 0).alias("is_active"),
    )


def job_changes(t: dict) -> DataFrame:
    """FX11c — patches and deletes of jobs, several per job (from orders)."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    return t["orders"].select(
        k.alias("job_id"), o.alias("change_ts"), F.when(o % 13 == 0, "delete").otherwise("patch").alias("op"),
        F.concat(F.lit("job "), o.cast("string")).alias("job_name"), F.col("o_orderpriority").alias("tool_params"),
        (o % 3 == 0).alias("is_active"), F.lit("x").alias("created_by"),
        F.when(o % 4 == 0, F.array(F.lit("job_name"))).when(o % 4 == 1, F.array(F.lit("is_active"), F.lit("tool_params")))
        .when(o % 4 == 2, F.array(F.lit("created_by"))).otherwise(F.array().cast("array<string>")).alias("set_keys"),
    )


def run_log(t: dict) -> DataFrame:
    """FX11 — job run log."""
    return t["orders"].select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("run_ts"),
                              (F.col("o_orderstatus") == "F").alias("success"))


def access_requests(t: dict) -> DataFrame:
    """FX12 — access requests."""
    return t["events"].select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("key_"), (F.col("user_id") % 10).cast("string")).alias("api_key"),
        F.col("event_type").alias("resource_name"),
        F.when(F.col("event_id") % 2 == 0, "list").otherwise("execute").alias("action"),
        F.when(F.col("user_id") % 6 != 0, F.concat(F.lit("user_"), (F.col("user_id") % 12).cast("string")))
        .alias("user_id"),
    )


# The FX12 access policy, in the shape of the reference policy files.
ACCESS_POLICY = {
    "version": "1.0",
    "name": "fleet-access",
    "rules": [
        {"name": "no-errors-for-guests", "effect": "deny",
         "principal_conditions": [{"path": "attributes.user_id", "operator": "in", "value": ["user_1", "user_7"]}],
         "resource_conditions": [{"path": "attributes.name", "operator": "equals", "value": "error"}],
         "actions": ["list", "execute"]},
        {"name": "readers", "effect": "allow",
         "principal_conditions": [{"path": "attributes.api_key", "operator": "in", "value": ["key_0", "key_5", "key_7"]}],
         "resource_conditions": [], "actions": ["list"]},
        {"name": "operator-of-clicks", "effect": "allow",
         "principal_conditions": [{"path": "attributes.user_id", "operator": "equals", "value": "user_8"}],
         "resource_conditions": [{"path": "attributes.name", "operator": "in", "value": ["click", "purchase"]}],
         "actions": ["execute"]},
        {"name": "by-team", "effect": "allow",
         "principal_conditions": [{"path": "attributes.team", "operator": "equals", "value": "dba"}],
         "resource_conditions": [], "actions": ["list", "execute"]},
        {"name": "nothing-granted", "effect": "allow", "principal_conditions": [], "resource_conditions": [],
         "actions": []},
    ],
    "default_effect": "deny",
}


def counter_snapshots(t: dict) -> DataFrame:
    """FX13 — cumulative counters by server (a third of all snapshots of one server; resets, nulls, gaps)."""
    e, k = t["events"], F.col("event_id")
    return e.select(
        F.when(F.col("user_id") % 3 == 0, "srv_hot").when(F.col("user_id") % 50 != 1, F.concat(F.lit("srv_"), (F.col("user_id") % 20).cast("string")))
        .alias("server"),
        F.col("ts").cast("timestamp").alias("snapshot_ts"), k.alias("snapshot_id"),
        F.when(k % 50 != 0, (k * 13 + F.floor("value").cast("long")) % 50_000).alias("xact_commit"),
        ((k * 3) % 2_100).alias("buffers_clean"), F.date_trunc("week", F.col("ts").cast("timestamp")).alias("stats_reset"))


def table_samples(t: dict) -> DataFrame:
    """FX14 — samples of table statistics over time (a third of them of one table)."""
    li, k = t["lineitem"], F.col("l_partkey")
    return li.select(
        _db("l_partkey", 2).alias("datname"), F.when(k % 5 != 0, F.lit("public")).alias("schemaname"),
        F.when(F.col("l_orderkey") % 3 == 0, "part_hot").otherwise(F.concat(F.lit("part_"), (k % 40).cast("string"))).alias("relname"),
        F.col("l_shipdate").cast("timestamp").alias("snapshot_ts"), F.col("l_orderkey").alias("sample_id"),
        F.col("l_linenumber").cast("long").alias("sample_no"),
        F.floor("l_quantity").cast("long").alias("n_live_tup"), (F.col("l_linenumber") * 3).cast("long").alias("n_dead_tup"))


def table_measures(t: dict) -> DataFrame:
    """FX14m — measurements at other times (several at one time, failed ones, tables without samples)."""
    o, k = t["orders"], F.col("o_custkey")
    return o.select(
        _db("o_custkey", 2).alias("datname"), F.when(k % 5 != 0, F.lit("public")).alias("schemaname"),
        F.when(F.col("o_orderkey") % 3 == 0, "part_hot").otherwise(F.concat(F.lit("part_"), (k % 44 + 3).cast("string"))).alias("relname"),
        F.col("o_orderdate").cast("timestamp").alias("measured_ts"), F.col("o_orderkey").alias("measure_id"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100).cast("double")).alias("dead_tuple_percent"))


def typed_jobs(t: dict) -> DataFrame:
    """FX15 — jobs whose parameters hold numbers, flags, lists and objects (some broken, some no objects)."""
    k = F.col("job_id")
    whole = F.concat(F.lit('{"connection_id": '), k.cast("string"), F.lit(', "dry_run": '),
                     F.when(k % 2 == 0, "true").otherwise("false"), F.lit(', "window": {"days": '), (k % 30).cast("string"),
                     F.lit(', "scopes": ["db", "t_'), (k % 9).cast("string"), F.lit('"]}, "ratio": 0.'), (k % 4 * 25 + 5).cast("string"), F.lit("}"))
    text = (F.when(k % 7 == 0, F.lit("{broken")).when(k % 7 == 1, F.lit("[1, 2]")).when(k % 7 == 2, F.lit('{"connection_id": "9"}'))
            .when(k % 7 != 3, whole))
    return jobs(t).withColumn("tool_params", text)


def statement_history(t: dict) -> DataFrame:
    """FX16 — statement executions by month, in exact cents of time."""
    li = t["lineitem"]
    return li.select(F.trunc("l_shipdate", "month").alias("month"), _db("l_partkey", 4).alias("datname"),
                     (F.col("l_partkey") % 997).alias("queryid"),
                     F.round(F.col("l_extendedprice") * 100).cast("long").alias("time_cents"))


def expected_firings(t: dict) -> DataFrame:
    """FX17 — when jobs should have run: mostly as the run log says, some off it, some of jobs without runs."""
    o, k = t["orders"], F.col("o_orderkey")
    minutes = F.when(k % 4 == 0, 30).when(k % 4 == 1, 120).otherwise(0)
    return o.select((F.col("o_custkey") + F.when(k % 10 == 9, 1_000_000).otherwise(0)).cast("int").alias("job_id"),
                    (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=minutes)).alias("fire_ts"))
