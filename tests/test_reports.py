"""Edges the oracle hash cannot see: order, empty input, NULLs, zero denominators, ties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetstats.functions.exprs import lsn_bytes, lsn_text, qualified_name, size_pretty
from fleetstats.operators import catalog, reports, trends

AS_OF = "2024-01-31 00:00:00"
TS = dt.datetime(2024, 1, 30, 23, 0, 0)


def activity(spark, data):
    return spark.createDataFrame(data, "datname string, pid long, state string, xact_start timestamp, "
                                       "query_start timestamp, query string")


def test_connections_summary_empty_database_gives_one_row(spark):
    df = activity(spark, [("db_a", 1, "active", TS, TS, "q")])
    out = rows(reports.connections_summary(df, AS_OF, datname="db_missing"))
    assert out == [("db_missing", 0, 0, 0, 0, None, None)]


def test_connections_summary_fleet_empty_input_gives_no_rows(spark):
    df = activity(spark, []).filter("false")
    assert reports.connections_summary(df, AS_OF).count() == 0


def test_connections_summary_counts_and_ages(spark):
    df = activity(spark, [
        ("db", 1, "active", TS, TS, "a"), ("db", 2, "idle", None, TS, "b"),
        ("db", 3, None, None, None, "c"), ("db", 4, "idle in transaction", TS - dt.timedelta(hours=1), TS, "d"),
    ])
    (r,) = rows(reports.connections_summary(df, AS_OF))
    assert r == ("db", 4, 1, 1, 1, 7200.0, 3600.0)


def test_connections_top_orders_nulls_last_and_ties_by_pid(spark):
    df = activity(spark, [("db", 5, "idle", None, TS, "x"), ("db", 3, "active", TS, TS, "y"),
                          ("db", 2, "active", TS, TS, "z" * 300)])
    out = rows(reports.connections_top(df, AS_OF, datname="db", limit=20), "pid", "query_sample")
    assert [p for p, _ in out] == [2, 3, 5]
    assert len(out[0][1]) == 200


def test_cache_hit_ratio_null_when_nothing_read(spark):
    df = spark.createDataFrame([("db", 0, 0), ("db2", 3, 1)], "datname string, blks_hit long, blks_read long")
    out = dict(rows(reports.health_overview(df, AS_OF), "db_name", "cache_hit_ratio"))
    assert out == {"db": None, "db2": 75.0}


def test_bloat_candidates_zero_tuples_is_zero_and_ties_by_name(spark):
    df = spark.createDataFrame([("db", "s", "b", 0, 0), ("db", "s", "a", 0, 0), ("db", "s", "c", 1, 3)],
                               "datname string, schemaname string, relname string, n_live_tup long, n_dead_tup long")
    out = rows(reports.bloat_candidates(df, limit=2, datname="db"), "relname", "dead_tuple_pct")
    assert out == [("c", 75.0), ("a", 0.0)]


def test_limit_must_be_positive(spark):
    df = spark.createDataFrame([("db", "s", "a", 1, 1)], "datname string, schemaname string, relname string, "
                                                         "n_live_tup long, n_dead_tup long")
    with pytest.raises(ValueError):
        reports.bloat_candidates(df, limit=0)


def _stats(spark):
    return spark.createDataFrame(
        [("m", "public", "t1", 90, 10), ("m", "public", "t2", 0, 0), ("f", "public", "t1", 3, 1),
         ("f", "public", "t2", 0, 0)],
        "datname string, schemaname string, relname string, n_live_tup long, n_dead_tup long")


def _catalog(spark, extra=()):
    data = [("m", "public", "t1", "BASE TABLE"), ("m", "public", "t2", "BASE TABLE"),
            ("f", "public", "t1", "BASE TABLE"), ("f", "public", "t2", "BASE TABLE"),
            ("f", "public", "t3", "BASE TABLE"), ("f", "pg_catalog", "pg_class", "BASE TABLE"),
            ("f", "public", "v1", "VIEW")] + list(extra)
    return spark.createDataFrame(data, "datname string, table_schema string, table_name string, table_type string")


def test_bloat_report_modes_drop_unmeasured_and_keep_errors(spark):
    tuple_stats = spark.createDataFrame([("m", "public", "t1", None, "boom")],
                                        "datname string, schemaname string, relname string, "
                                        "dead_tuple_percent double, error string")
    out = sorted(rows(reports.bloat_report(_stats(spark), tuple_stats), "datname", "mode", "relname", "error"))
    assert out == [("f", "dead_tuple_only_fallback", "t1", None), ("f", "dead_tuple_only_fallback", "t2", None),
                   ("m", "pgstattuple", "t1", "boom")]


def test_table_bloat_fallback_absent_table_is_zero_and_measured_missing_is_zero(spark):
    tuple_stats = spark.createDataFrame([("m", "public", "t1", 12.5, None)],
                                        "datname string, schemaname string, relname string, "
                                        "dead_tuple_percent double, error string")
    out = {(d, t): (p, s) for d, t, p, s in rows(
        reports.table_bloat(_catalog(spark), _stats(spark), tuple_stats, threshold=20),
        "datname", "table", "dead_tuple_percent", "source")}
    assert out[("m", "t1")] == (12.5, "pgstattuple")
    assert out[("m", "t2")] == (0.0, "pgstattuple")
    assert out[("f", "t1")] == (25.0, "pg_stat_user_tables")
    assert out[("f", "t3")] == (0.0, "pg_stat_user_tables")  # absent from the statistics view
    assert ("f", "pg_class") not in out and ("f", "v1") not in out


def test_resolve_tables_explicit_pair_is_not_checked(spark):
    cat = _catalog(spark).drop("datname")
    assert rows(catalog.resolve_tables(cat, "nope", "missing")) == [("nope", "missing")]
    # A table name without a schema falls into the "all user tables" branch.
    assert len(rows(catalog.resolve_tables(cat, None, "t1"))) == 3


def test_collect_statistics_table_alone_is_ignored(spark):
    assert catalog.collect_statistics(_stats(spark), table="t1").count() == 4
    assert catalog.collect_statistics(_stats(spark), schema="public", table="t1").count() == 2


def test_checkpointer_shapes(spark):
    df = spark.createDataFrame([(1, 140000, 5, 6, 7), (2, 170000, None, None, None)],
                               "server_id long, server_version_num int, checkpoints_timed long, "
                               "checkpoints_req long, num_timed long")
    out = sorted(rows(reports.checkpointer(df), "server_id", "num_timed", "num_requested"))
    assert out == [(1, 5, 6), (2, None, None)]


@pytest.mark.parametrize("size,text", [
    (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10484736, "10239 kB"), (10485759, "10 MB"),
    (10485760, "10 MB"), (1536 * 1024 * 1024 * 10, "15 GB"), (-20480, "-20 kB"),
])
def test_size_pretty_matches_postgres_thresholds(spark, size, text):
    df = spark.createDataFrame([(size,)], "s long")
    assert rows(df.select(size_pretty("s"))) == [(text,)]


def test_quote_ident_and_lsn(spark):
    df = spark.createDataFrame([("public", "t_1"), ("Brand#1", 'we"ird'), ("select", "ok")], "a string, b string")
    assert rows(df.select(qualified_name("a", "b"))) == [("public.t_1",), ('"Brand#1"."we""ird"',),
                                                         ('"select".ok',)]
    lsn = spark.createDataFrame([(0x16B3748 + (5 << 32),)], "b long")
    assert rows(lsn.select(lsn_text("b"))) == [("5/16B3748",)]
    assert rows(lsn.select(lsn_bytes(lsn_text("b")))) == [(0x16B3748 + (5 << 32),)]


def _snaps(spark, data):
    return spark.createDataFrame(
        [(dt.datetime.fromisoformat(t), s, d, sc, r, b) for t, s, d, sc, r, b in data],
        "snapshot_ts timestamp, scope string, dbname string, schemaname string, relname string, size_bytes long")


def test_growth_db_points_and_empty(spark):
    one = _snaps(spark, [("2024-01-20 10:00:00", "db", "a", None, None, 100)])
    (r,) = rows(trends.growth_db(one, AS_OF, 14), "points", "growth_mb", "growth_mb_per_day")
    assert r == (1, 0.0, None)
    two = _snaps(spark, [("2024-01-20 10:00:00", "db", "a", None, None, 1048576),
                         ("2024-01-21 10:00:00", "db", "a", None, None, 3 * 1048576)])
    (r,) = rows(trends.growth_db(two, AS_OF, 14), "points", "growth_mb", "growth_pct", "growth_mb_per_day")
    assert r == (2, 2.0, 200.0, 2.0)
    (r,) = rows(trends.growth_db(two, AS_OF, 14, dbname="zz"), "dbname", "points", "growth_mb")
    assert r == ("zz", 0, None)


def test_window_excludes_rows_at_or_after_as_of_and_before_start(spark):
    df = _snaps(spark, [("2024-01-31 00:00:00", "table", "a", "s", "t", 1),
                        ("2024-01-16 23:59:59", "table", "a", "s", "t", 2),
                        ("2024-01-17 00:00:00", "table", "a", "s", "t", 3),
                        ("2024-01-17 12:00:00", "table", "a", "s", "t", 9)])
    assert rows(trends.daily_max_size(df, AS_OF, "table", 14), "d", "size_bytes") == [(dt.date(2024, 1, 17), 9)]


def test_growth_ordered_shrinkage_is_negative(spark):
    df = _snaps(spark, [("2024-01-20 10:00:00", "table", "a", "s", "t", 3 * 1048576),
                        ("2024-01-23 10:00:00", "table", "a", "s", "t", 1048576)])
    (r,) = rows(trends.growth_ordered(df, AS_OF, 14), "growth_mb", "elapsed_days", "growth_mb_per_day")
    assert r == (-2.0, 3, -0.67)
    (r,) = rows(trends.growth_table(df, AS_OF, 14), "growth_mb")
    assert r == (2.0,)  # the reference's min/max form never goes negative


def test_forecast_exact_line(spark):
    df = _snaps(spark, [(f"2024-01-{d:02d} 10:00:00", "table", "a", "s", "t", 1000 + 10 * d) for d in (20, 21, 22)])
    (r,) = rows(trends.growth_forecast(df, AS_OF, 14, horizon_days=10), "slope_bytes_per_day",
                "forecast_date", "forecast_size_bytes")
    assert r == (10.0, dt.date(2024, 2, 10), 1000.0 + 10 * 41)


def test_trend_arguments_out_of_range_are_errors(spark):
    df = _snaps(spark, [("2023-03-01 10:00:00", "table", "a", "s", "t", 5)])
    assert trends.daily_max_size(df, AS_OF, "table", days=365).count() == 1
    for call in (lambda: trends.daily_max_size(df, AS_OF, "table", days=400),
                 lambda: trends.growth_forecast(df, AS_OF, days=0),
                 lambda: trends.growth_table(df, AS_OF, limit=500),
                 lambda: trends.growth_ordered(df, AS_OF, limit=0),
                 lambda: trends.latest_sizes(df, "table", max_age_days=3)):
        with pytest.raises(ValueError):
            call()


def test_latest_sizes_ties_staleness_and_hash_plan(spark):
    df = _snaps(spark, [("2024-01-09 10:00:00", "table", "a", "s", "t", 5), ("2024-01-09 10:00:00", "table", "a", "s", "t", 7),
                        ("2024-01-08 10:00:00", "table", "a", "s", "t", 9), ("2023-12-01 00:00:00", "table", "a", "s", "old", 1),
                        ("2024-01-09 11:00:00", "table", "a", "s", "huge", 9_223_372_036_854_775_807)])
    got = sorted(rows(trends.latest_sizes(df, "table"), "relname", "size_bytes"))
    assert got == [("huge", 9_223_372_036_854_775_807), ("old", 1), ("t", 7)]
    fresh = trends.latest_sizes(df, "table", "2024-01-10 00:00:00", max_age_days=3)
    assert sorted(rows(fresh, "relname")) == [("huge",), ("t",)]
    assert "SortAggregate" not in fresh._jdf.queryExecution().executedPlan().toString()


def test_daily_max_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 20 * 24), st.sampled_from(["a", "b"]), st.integers(0, 10 ** 12)),
                    min_size=1, max_size=40))
    def check(samples):
        base = dt.datetime(2024, 1, 10)
        data = [(base + dt.timedelta(hours=h), "table", db, "s", "t", size) for h, db, size in samples]
        df = spark.createDataFrame(data, "snapshot_ts timestamp, scope string, dbname string, schemaname string, "
                                         "relname string, size_bytes long")
        got = {(d, db): m for db, d, m in rows(trends.daily_max_size(df, AS_OF, "table", 30), "dbname", "d",
                                                "size_bytes")}
        want = {}
        for ts, _, db, _, _, size in data:
            if ts < dt.datetime(2024, 1, 31):
                want[(ts.date(), db)] = max(want.get((ts.date(), db), size), size)
        assert got == want

    check()


def test_run_sql_returns_rows_for_any_statement(spark):
    from fleetstats.sources.sql import run_sql
    assert rows(run_sql(spark, "WITH x AS (SELECT 1 AS a) SELECT a + :k AS b FROM x", {"k": 2})) == [(3,)]
    assert rows(run_sql(spark, "VALUES (1), (2)")) == [(1,), (2,)]
    df = spark.createDataFrame([(1,), (5,)], "v int")
    assert rows(run_sql(spark, "SELECT count(*) AS n FROM {t} WHERE v > :m", {"m": 2}, t=df)) == [(1,)]


def test_vacuum_progress_single_database_form(spark):
    df = spark.createDataFrame([("a", "t1", "scanning heap", 10), ("b", "t2", "cleaning up", 5)],
                               "datname string, table_name string, phase string, heap_blks_total long")
    out = reports.vacuum_progress(df, datname="b")
    assert rows(out, "table_name", "phase", "heap_blks_vacuumed") == [("t2", "cleaning up", None)]


def test_top_queries_resolves_database_oids(spark):
    stats = spark.createDataFrame([(16384, 1, 5, 10.0, 2.0, 1, 3, 1, "select 1"), (16385, 2, 1, 99.0, 99.0, 1, 0, 0, "x"),
                                   (16384, 3, 2, 50.0, 25.0, 1, 0, 0, "select 3")],
                                  "dbid long, queryid long, calls long, total_exec_time double, mean_exec_time double, "
                                  "rows_returned long, shared_blks_hit long, shared_blks_read long, query string")
    dbs = spark.createDataFrame([(16384, "app"), (16385, "other")], "oid long, datname string")
    out = rows(reports.top_queries(stats, limit=10, datname="app", databases=dbs), "queryid", "cache_hit_ratio")
    assert out == [(3, None), (1, 75.0)]


def test_replication_interval_lags_and_lsn_text(spark):
    df = spark.sql("SELECT 7L AS pid, INTERVAL '1.5' SECOND AS replay_lag, '0/3000' AS sent_lsn, "
                   "'0/2000' AS replay_lsn")
    (r,) = rows(reports.replication_status(df), "replay_lag_us", "sent_lsn_bytes", "replay_gap_bytes")
    assert r == (1500000, 0x3000, 0x1000)


def test_types_listing(spark):
    from fleetstats.operators import registry as rg
    types = spark.createDataFrame([(2, "mysql"), (1, "postgres")], "id int, name string")
    assert rows(rg.types_list(types)) == [(1, "postgres"), (2, "mysql")]
    assert rows(rg.type_lookup(types, 2)) == [(2, "mysql")]


def test_history_tables_report_per_snapshot(spark):
    t1, t2 = dt.datetime(2024, 1, 30, 12), dt.datetime(2024, 1, 30, 18)
    df = spark.createDataFrame([("db", t1, 1, "active", TS, TS, "a"), ("db", t1, 2, "idle", TS, TS, "b"),
                                ("db", t2, 3, "active", TS, TS, "c")],
                               "datname string, snapshot_ts timestamp, pid long, state string, "
                               "xact_start timestamp, query_start timestamp, query string")
    out = sorted(rows(reports.connections_summary(df, AS_OF), "snapshot_ts", "total_connections"))
    assert out == [(t1, 2), (t2, 1)]
    top = rows(reports.connections_top(df, AS_OF, limit=1), "snapshot_ts", "pid")
    assert sorted(top) == [(t1, 1), (t2, 3)]
    stats = spark.createDataFrame([("db", t1, "s", "a", 1, 1), ("db", t2, "s", "a", 1, 3)],
                                  "datname string, snapshot_ts timestamp, schemaname string, relname string, "
                                  "n_live_tup long, n_dead_tup long")
    assert sorted(rows(reports.bloat_candidates(stats, limit=5), "snapshot_ts", "dead_tuple_pct")) == \
        [(t1, 50.0), (t2, 75.0)]


def test_table_bloat_uses_latest_snapshot(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    stats = spark.createDataFrame([("f", t1, "public", "t1", 1, 1), ("f", t2, "public", "t1", 3, 1)],
                                  "datname string, snapshot_ts timestamp, schemaname string, relname string, "
                                  "n_live_tup long, n_dead_tup long")
    empty = spark.createDataFrame([], "datname string, schemaname string, relname string, "
                                      "dead_tuple_percent double, error string")
    cat = spark.createDataFrame([("f", "public", "t1", "BASE TABLE")],
                                "datname string, table_schema string, table_name string, table_type string")
    assert rows(reports.table_bloat(cat, stats, empty), "table", "dead_tuple_percent") == [("t1", 25.0)]


def test_load_stats_formats_and_history(spark):
    from fleetstats.session import scratch_dir
    from fleetstats.sources.stats import load_stats
    df = spark.createDataFrame([("db", dt.date(2024, 1, 1), 3, 1), ("db", dt.date(2024, 1, 2), 5, 0)],
                               "datname string, snapshot_date date, blks_hit long, blks_read long")
    pq = scratch_dir(spark, "pq")
    df.write.partitionBy("snapshot_date").parquet(pq)
    loaded = load_stats(spark, pq, "stat_database").filter(F.col("snapshot_date") == dt.date(2024, 1, 2))
    assert rows(loaded, "datname", "blks_hit", "tup_returned") == [("db", 5, None)]
    js = scratch_dir(spark, "js")
    spark.createDataFrame([("db", 1, "active")], "datname string, pid long, state string").write.json(js)
    act = load_stats(spark, js, "stat_activity", fmt="json")
    assert rows(act, "datname", "pid", "state", "query") == [("db", 1, "active", None)]


def test_report_json_sections(spark):
    import json
    from fleetstats.operators.render import report_json
    summary = spark.createDataFrame([("db", 3, None)], "datname string, total long, age double")
    detail = spark.createDataFrame([(1, TS)], "pid long, xact_start timestamp")
    out = rows(report_json({"summary": summary, "top_long_running": detail}, title="Connections"))
    by_section = {sec: json.loads(text) for title, sec, text in out}
    assert {t for t, _, _ in out} == {"Connections"}
    assert by_section["summary"] == {"datname": "db", "total": 3, "age": None}
    assert by_section["top_long_running"] == {"pid": 1, "xact_start": "2024-01-30 23:00:00"}


def test_forecast_single_point_and_database_filter(spark):
    df = _snaps(spark, [("2024-01-20 10:00:00", "table", "a", "s", "t", 100),
                        ("2024-01-20 11:00:00", "table", "b", "s", "t", 7)])
    out = rows(trends.growth_forecast(df, AS_OF, 14, horizon_days=5), "dbname", "points", "slope_bytes_per_day",
               "forecast_size_bytes")
    assert sorted(out) == [("a", 1, None, None), ("b", 1, None, None)]
    assert rows(trends.daily_max_size(df, AS_OF, "table", 14, dbname="b"), "dbname", "size_bytes") == [("b", 7)]


def test_load_stats_csv_with_header(spark):
    from fleetstats.session import scratch_dir
    from fleetstats.sources.stats import load_stats
    path = scratch_dir(spark, "csv")
    spark.createDataFrame([("db", 10, 90)], "datname string, n_dead_tup long, n_live_tup long") \
        .select("datname", "n_live_tup", "n_dead_tup").write.option("header", "true").csv(path)
    df = load_stats(spark, path, "stat_user_tables", fmt="csv", header="true")
    assert rows(df, "datname", "n_live_tup", "n_dead_tup", "relname") == [("db", 90, 10, None)]


def test_forecast_matches_numpy_least_squares(spark):
    import random
    import numpy as np
    rnd = random.Random(11)
    data = []
    for series in range(6):
        for day in rnd.sample(range(17, 31), rnd.randint(2, 10)):
            data.append((f"2024-01-{day:02d} 08:00:00", "table", "a", "s", f"t{series}", rnd.randint(0, 10 ** 9)))
    out = {r: (slope, size) for r, slope, size in rows(
        trends.growth_forecast(_snaps(spark, data), AS_OF, 14, horizon_days=7),
        "relname", "slope_bytes_per_day", "forecast_size_bytes")}
    for series in {d[4] for d in data}:
        pts = [(int(t[8:10]) - 17, size) for t, _, _, _, r, size in data if r == series]
        slope, intercept = np.polyfit([x for x, _ in pts], [y for _, y in pts], 1)
        got_slope, got_size = out[series]
        assert abs(got_slope - slope) < 0.01 + 1e-9 * abs(slope)
        assert abs(got_size - (intercept + slope * 21)) < 0.01 + 1e-9 * abs(got_size)


def test_size_pretty_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from fleetstats.functions.exprs import SIZE_UNITS

    def model(size: int) -> str:   # the unit ladder with C-style truncating division
        def trunc_div(a, b):
            return -(-a // b) if a < 0 else a // b
        for i, (name, limit, rnd, bits) in enumerate(SIZE_UNITS):
            if i == len(SIZE_UNITS) - 1 or abs(size) < limit:
                if rnd:
                    size = trunc_div(size + (1 if size >= 0 else -1), 2)
                return f"{size} {name}"
            nxt = SIZE_UNITS[i + 1]
            size = trunc_div(size, 1 << (nxt[3] - bits - int(nxt[2]) + int(rnd)))

    @settings(max_examples=10, deadline=None)
    @given(st.lists(st.integers(-(2 ** 62), 2 ** 62), min_size=1, max_size=50))
    def check(sizes):
        df = spark.createDataFrame([(s,) for s in sizes], "s long")
        got = [r[0] for r in df.select(size_pretty("s")).collect()]
        assert got == [model(s) for s in sizes]

    check()


def test_growth_table_matches_python_model(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal
    rnd = random.Random(13)
    data = []
    for db in ("a", "b"):
        for t in range(8):
            for _ in range(rnd.randint(1, 6)):
                ts = dt.datetime(2024, 1, rnd.randint(10, 30), rnd.randint(0, 23), rnd.randint(0, 59))
                data.append((ts, "table", db, "s", f"t{t}", rnd.randint(0, 5 * 1048576)))
    df = spark.createDataFrame(data, "snapshot_ts timestamp, scope string, dbname string, schemaname string, "
                                     "relname string, size_bytes long")
    got = sorted(rows(trends.growth_table(df, AS_OF, 14, limit=3), "dbname", "relname", "growth_mb"))

    def r2(x):
        return float(Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))

    daily = {}
    for ts, _, db, _, rel, size in data:
        if dt.datetime(2024, 1, 17) <= ts < dt.datetime(2024, 1, 31):
            k = (db, rel, ts.date())
            daily[k] = max(daily.get(k, size), size)
    series = {}
    for (db, rel, _), size in daily.items():
        series.setdefault((db, rel), []).append(size)
    want = []
    for db in ("a", "b"):
        ranked = sorted(((-r2((max(v) - min(v)) / 1048576), rel) for (d, rel), v in series.items() if d == db))
        want += [(db, rel, -g) for g, rel in ranked[:3]]
    assert got == sorted(want)


def test_bloat_report_matches_python_model(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal
    rnd = random.Random(17)
    stats = [(db, "s", f"t{i}", rnd.randint(0, 50), rnd.randint(0, 50)) for db in ("m", "f") for i in range(15)]
    meas = [("m", "s", f"t{i}", None if i % 4 == 0 else float(i), "failed" if i % 4 == 0 else None)
            for i in range(15) if i % 3 != 0]
    sdf = spark.createDataFrame(stats, "datname string, schemaname string, relname string, n_live_tup long, "
                                       "n_dead_tup long")
    mdf = spark.createDataFrame(meas, "datname string, schemaname string, relname string, "
                                      "dead_tuple_percent double, error string")
    got = sorted(rows(reports.bloat_report(sdf, mdf, limit=6), "datname", "mode", "relname", "dead_tuple_percent",
                      "error"))

    def pct(live, dead):
        tot = live + dead
        return 0.0 if tot == 0 else float(Decimal(dead * 100.0 / tot).quantize(Decimal("0.01"), ROUND_HALF_UP))

    measured = {(d, r): (p, e) for d, _, r, p, e in meas}
    want = []
    for db in ("m", "f"):
        cand = sorted(((-pct(l, dd), r) for d, _, r, l, dd in stats if d == db))[:6]
        for _, rel in cand:
            if db == "m":
                if (db, rel) in measured:
                    want.append((db, "pgstattuple", rel, *measured[(db, rel)]))
            else:
                want.append((db, "dead_tuple_only_fallback", rel, None, None))
    assert got == sorted(want)


def test_table_bloat_matches_python_model(spark):
    import random
    rnd = random.Random(19)
    cat_rows = [(db, "s", f"t{i}", "BASE TABLE") for db in ("m", "f") for i in range(12)]
    stats = [(db, "s", f"t{i}", rnd.randint(0, 9), rnd.randint(0, 9)) for db in ("m", "f") for i in range(12)
             if i % 5 != 0]                                   # some catalog tables have no statistics row
    meas = [("m", "s", f"t{i}", float(i * 3), None) for i in range(12) if i % 2 == 0]
    cat = spark.createDataFrame(cat_rows, "datname string, table_schema string, table_name string, table_type string")
    sdf = spark.createDataFrame(stats, "datname string, schemaname string, relname string, n_live_tup long, "
                                       "n_dead_tup long")
    mdf = spark.createDataFrame(meas, "datname string, schemaname string, relname string, "
                                      "dead_tuple_percent double, error string")
    got = sorted(rows(reports.table_bloat(cat, sdf, mdf, threshold=20), "datname", "table", "dead_tuple_percent",
                      "source", "exceeds"))
    st = {(d, r): (l, dd) for d, _, r, l, dd in stats}
    ms = {(d, r): p for d, _, r, p, _ in meas}
    want = []
    for db, _, rel, _ in cat_rows:
        if db == "m":
            p, src = ms.get((db, rel), 0.0), "pgstattuple"
        else:
            live, dead = st.get((db, rel), (0, 0))
            p, src = (0.0 if live + dead == 0 else dead / (live + dead) * 100), "pg_stat_user_tables"
        want.append((db, rel, p, src, p > 20))
    assert got == sorted(want)


def test_growth_ordered_and_db_match_python_model(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal
    rnd = random.Random(23)

    def r2(x):
        return None if x is None else float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))

    data = [(dt.datetime(2024, 1, rnd.randint(17, 30), rnd.randint(0, 23)), scope, "a",
             "s" if scope == "table" else None, f"t{rnd.randint(0, 3)}" if scope == "table" else None,
             rnd.randint(1, 9 * 1048576)) for scope in ("table", "db") for _ in range(60)]
    df = spark.createDataFrame(data, "snapshot_ts timestamp, scope string, dbname string, schemaname string, "
                                     "relname string, size_bytes long")

    def daily(scope):
        out = {}
        for ts, sc, db, _, rel, size in data:
            if sc == scope:
                k = (rel, ts.date())
                out[k] = max(out.get(k, size), size)
        return out

    t4 = {rel: (g, rate) for rel, g, rate in rows(trends.growth_ordered(df, AS_OF, 14, limit=10),
                                                  "relname", "growth_mb", "growth_mb_per_day")}
    d = daily("table")
    for rel in {r for r, _ in d}:
        days = sorted(day for r, day in d if r == rel)
        delta = (d[(rel, days[-1])] - d[(rel, days[0])]) / 1048576
        elapsed = (days[-1] - days[0]).days
        assert t4[rel] == (r2(delta), r2(delta / elapsed) if elapsed else None)
    (row,) = rows(trends.growth_db(df, AS_OF, 14), "points", "growth_mb", "growth_pct", "growth_mb_per_day")
    sizes = list(daily("db").values())
    lo, hi, n = min(sizes), max(sizes), len(sizes)
    assert row == (n, r2((hi - lo) / 1048576), r2((hi - lo) / lo * 100), r2((hi - lo) / 1048576 / (n - 1)))


def test_activity_and_statement_reports_match_python_model(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal
    rnd = random.Random(29)
    now = dt.datetime(2024, 1, 31)
    acts = []
    for pid in range(120):
        state = rnd.choice(["active", "idle", "idle in transaction", None, "disabled"])
        xs = now - dt.timedelta(seconds=rnd.randint(1, 9999)) if rnd.random() < 0.6 else None
        qs = now - dt.timedelta(seconds=rnd.randint(1, 9999)) if rnd.random() < 0.8 else None
        acts.append((rnd.choice(["a", "b"]), pid, state, xs, qs, "q" * rnd.randint(0, 300)))
    adf = activity(spark, acts)
    summary = {r[0]: r[1:] for r in rows(reports.connections_summary(adf, AS_OF))}
    for db in ("a", "b"):
        mine = [a for a in acts if a[0] == db]
        ages = [(now - a[3]).total_seconds() for a in mine if a[3]]
        qages = [(now - a[4]).total_seconds() for a in mine if a[4]]
        assert summary[db] == (len(mine), sum(a[2] == "active" for a in mine), sum(a[2] == "idle" for a in mine),
                               sum(a[2] == "idle in transaction" for a in mine), max(ages), max(qages))
        top = rows(reports.connections_top(adf, AS_OF, limit=7), "datname", "pid")
        want = sorted(mine, key=lambda a: (a[3] is None, a[3] or now, a[1]))[:7]
        assert sorted(p for d, p in top if d == db) == sorted(a[1] for a in want)
    stm = [(rnd.choice(["a", "b"]), q, rnd.randint(1, 50), rnd.randint(0, 10 ** 6) / 100.0, rnd.randint(0, 9),
            rnd.randint(0, 9)) for q in range(80)]
    sdf = spark.createDataFrame([(d, q, c, t, t / c, 0, h, r, "x") for d, q, c, t, h, r in stm],
                                "datname string, queryid long, calls long, total_exec_time double, mean_exec_time double, "
                                "rows_returned long, shared_blks_hit long, shared_blks_read long, query string")
    got = sorted(rows(reports.top_queries(sdf, limit=5), "datname", "queryid", "cache_hit_ratio"))

    def ratio(h, r):
        return None if h + r == 0 else float(Decimal(h * 100.0 / (h + r)).quantize(Decimal("0.01"), ROUND_HALF_UP))

    want = []
    for db in ("a", "b"):
        best = sorted((s for s in stm if s[0] == db), key=lambda s: (-s[3], s[1]))[:5]
        want += [(db, s[1], ratio(s[4], s[5])) for s in best]
    assert got == sorted(want)


def test_capacity_reports_match_python_model(spark):
    import random
    rnd = random.Random(31)
    snaps = []
    for db in ("a", "b"):
        for rel in ("t1", "T2", "select", "x_3"):
            for _ in range(rnd.randint(1, 4)):
                ts = dt.datetime(2024, 1, rnd.randint(1, 5), rnd.choice([0, 12]))   # ties in snapshot_ts happen
                snaps.append((ts, "table", db, "public", rel, rnd.randint(0, 10 ** 9)))
        snaps.append((dt.datetime(2024, 1, 6), "db", db, None, None, rnd.randint(0, 10 ** 12)))
    df = spark.createDataFrame(snaps, "snapshot_ts timestamp, scope string, dbname string, schemaname string, "
                                      "relname string, size_bytes long")
    latest = {}
    for ts, scope, db, _, rel, size in snaps:
        if scope == "table":
            k = (db, rel)
            latest[k] = max(latest.get(k, (ts, size)), (ts, size))
    got = sorted(rows(reports.top_table_sizes(trends.latest_sizes(df, "table"), limit=2),
                      "datname", "relname", "table_label", "size_bytes"))
    label = {"t1": "public.t1", "T2": 'public."T2"', "select": 'public."select"', "x_3": "public.x_3"}
    want = []
    for db in ("a", "b"):
        best = sorted(((-v[1], rel) for (d, rel), v in latest.items() if d == db))[:2]
        want += [(db, rel, label[rel], -neg) for neg, rel in best]
    assert got == sorted(want)
    sizes = rows(catalog.database_sizes(trends.latest_sizes(df, "db")), "database_name", "size_bytes")
    assert sizes == sorted(((db, s) for _, sc, db, _, _, s in snaps if sc == "db"), key=lambda r: -r[1])
