"""Counters, as-of joins, upserted days and registry history against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetstats.operators import asof, counters, history, registry
from fleetstats.plans.carry import carried, with_row_bucket
from fleetstats.schemas import CAPACITY, CONNECTIONS
from fleetstats.session import scratch_dir
from fleetstats.sources.stats import conform
from fleetstats.streaming import upsert

DAY0 = dt.datetime(2024, 1, 1)


# ---- carry ---------------------------------------------------------------------------
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_carried_equals_a_scan(spark, width):
    rnd = random.Random(width)
    data = [(rnd.choice(["hot", "hot", "b", None]), k, rnd.choice([None, None, k])) for k in rnd.sample(range(500), 300)]
    df = spark.createDataFrame(data, "g string, o long, v long").withColumn("b", F.floor(F.col("o") / width))
    got = {(r.g, r.o): (r.last, r.next) for r in
           carried(df, ["g"], "b", ["o"], {"last": F.col("v")}, {"next": F.col("o")}).collect()}
    want, seen = {}, {}
    for g, o, v in sorted(data, key=lambda r: r[1]):
        later = [x for h, x, _ in data if h == g and x > o]
        want[g, o] = (seen.get(g), min(later, default=None))
        if v is not None:
            seen[g] = v
    assert got == want


def test_row_buckets_stay_even_with_one_far_value(spark):
    df = spark.range(10_000).select(F.when(F.col("id") == 0, 1e15).otherwise(F.col("id").cast("double")).alias("at"))
    sizes = [r[0] for r in with_row_bucket(df, F.col("at"), 16, "b").groupBy("b").count().select("count").collect()]
    assert len(sizes) == 16 and max(sizes) < 1000


# ---- counters ------------------------------------------------------------------------
def brute_rates(data, max_gap=86_400):
    """(server, day) to (snapshots, delta, resets, gaps, rate) of rows (server, at, id, n, reset)."""
    out, before = {}, {}
    for server, at, _, n, reset in sorted(data, key=lambda r: (r[1], r[2])):
        x = out.setdefault((server, at.date()), [0, None, 0, 0, None])
        x[0] += 1
        if n is None:
            continue
        if server in before:
            p_at, p_n, p_reset = before[server]
            fell = n < p_n or reset != p_reset
            began = reset if fell and reset is not None and p_at < reset <= at else p_at
            us = (at - began) // dt.timedelta(microseconds=1)
            x[2] += fell
            if us <= max_gap * 1_000_000:
                x[1] = (x[1] or 0) + (n if fell else n - p_n)
                x[4] = (x[4] or 0) + us
            else:
                x[3] += 1
        before[server] = (at, n, reset)
    return {k: (a, d, r, g, round(d / us * 1e6, 6) if us else None) for k, (a, d, r, g, us) in out.items()}


def test_counter_rates_with_resets_gaps_and_nulls(spark):
    rnd, data = random.Random(4), []
    for server in ("hot", "a", None):
        n, at, reset = 0, DAY0, DAY0 - dt.timedelta(days=3)
        for k in range(300 if server == "hot" else 40):
            at += dt.timedelta(seconds=rnd.choice([0, 60, 3600, 5000, 200_000]))
            if rnd.random() < 0.1:
                n, reset = rnd.randint(0, 5), rnd.choice([at - dt.timedelta(seconds=30), reset, None])
            n += rnd.randint(0, 50)
            data.append((server, at, k, None if rnd.random() < 0.1 else n, reset))
    df = spark.createDataFrame(data, "server string, at timestamp, id long, n long, reset timestamp")
    got = counters.counter_rates(df, ["server"], "at", ["n"], "reset", ["id"])
    assert {(r.server, r.day): (r.snapshots, r.n_delta, r.n_resets, r.n_gaps, r.n_per_s) for r in got.collect()} == brute_rates(data)


def test_counter_without_reset_times_and_empty_table(spark):
    data = [("a", DAY0 + dt.timedelta(hours=h), h, n, None) for h, n in enumerate([5, 9, 9, 2, 4])]
    df = spark.createDataFrame(data, "server string, at timestamp, id long, n long, reset timestamp")
    assert rows(counters.counter_rates(df, ["server"], "at", ["n"], tie=["id"]), "n_delta", "n_resets") == [(4 + 0 + 2 + 2, 1)]
    assert counters.counter_rates(df.limit(0), ["server"], "at", ["n"]).count() == 0


def test_hot_server_is_cut_by_day(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("server"), (F.lit(DAY0) + F.make_dt_interval(mins=F.col("id"))).alias("at"),
                                    F.col("id").alias("n"))
    plan = counters.counter_deltas(df, ["server"], "at", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "_day" in plan.split("Window")[1]
    out = counters.counter_deltas(df, ["server"], "at", ["n"])
    assert out.filter("n_delta = 1 and n_us = 60000000").count() == 19_999


# ---- as-of join ----------------------------------------------------------------------
@pytest.mark.parametrize("stretch", [1, 30, 10_000])
def test_asof_join_on_ties_and_missing_sides(spark, stretch):
    rnd = random.Random(stretch)
    when = lambda: rnd.choice([None, *[DAY0 + dt.timedelta(days=rnd.randint(0, 200)) for _ in range(20)]])
    left = [(rnd.choice(["hot", "hot", "l", None]), when(), k) for k in range(200)]
    right = [(rnd.choice(["hot", "hot", "r", None]), when(), k, rnd.choice([None, float(k)])) for k in range(120)]
    got = asof.asof_join(spark.createDataFrame(left, "g string, at timestamp, k long"),
                         spark.createDataFrame(right, "g string, seen timestamp, id long, v double"),
                         ["g"], "at", "seen", ["v"], ["id"], stretch)
    want = []
    for g, at, k in left:
        before = [(s, i, v) for h, s, i, v in right if h == g and s is not None and at is not None and s <= at]
        s, _, v = max(before, key=lambda r: r[:2], default=(None, None, None))
        want.append((g, at, k, s, v))
    assert sorted(rows(got), key=str) == sorted(want, key=str)


def test_bloat_asof_sources(spark):
    stats = spark.createDataFrame([("d", "s", "t", DAY0 + dt.timedelta(days=d), 90, 10) for d in (0, 5, 50)] + [("d", None, "u", DAY0, 0, 0)],
                                  "datname string, schemaname string, relname string, snapshot_ts timestamp, n_live_tup long, n_dead_tup long")
    measures = spark.createDataFrame([("d", "s", "t", DAY0 + dt.timedelta(days=1), 42.0)],
                                     "datname string, schemaname string, relname string, measured_ts timestamp, dead_tuple_percent double")
    got = rows(asof.bloat_asof(stats, measures), "relname", "age_days", "source", "dead_percent")
    assert sorted(got, key=str) == sorted([("t", None, "estimated", 10.0), ("t", 4.0, "measured", 42.0), ("t", 49.0, "stale", 10.0),
                                           ("u", None, "estimated", None)], key=str)
    assert asof.bloat_asof(stats, measures.limit(0)).filter("source = 'estimated'").count() == 4
    assert asof.bloat_asof(stats.limit(0), measures).count() == 0


# ---- upserted days -------------------------------------------------------------------
def sample(day, hour, size, rel="t"):
    return (DAY0 + dt.timedelta(days=day, hours=hour), "table", "db", "s", rel, size)


def maxima(samples):
    out = {}
    for at, scope, db, s, rel, size in samples:
        key = (scope, db, s, rel, at.date())
        out[key] = max(out.get(key, size), size)
    return sorted((*k, v) for k, v in out.items())


def test_upsert_takes_late_samples_open_days_and_replays(spark):
    kept, daily = scratch_dir(spark, "u-kept"), scratch_dir(spark, "u-daily")
    batches = [[sample(9, 1, 50), sample(9, 2, 70)], [sample(1, 1, 10), sample(9, 23, 60)], [sample(1, 2, 30), sample(1, 3, 5, "u"), sample(0, 0, 7)], []]
    taken = []
    for k, batch in enumerate(batches):
        upsert.upsert_batch(spark.createDataFrame(batch, CAPACITY), k, kept, daily)
        taken += batch
        assert sorted(rows(upsert.read_daily(spark, daily))) == maxima(taken)    # open days are there at once
    for k in (1, 0, 2):                                                          # batches that run again add nothing
        upsert.upsert_batch(spark.createDataFrame(batches[k], CAPACITY), k, kept, daily)
    assert sorted(rows(upsert.read_daily(spark, daily))) == maxima(taken)
    assert upsert.read_samples(spark, kept).count() == len(taken)


def test_a_lost_partition_is_rebuilt_by_the_replay(spark, tmp_path):
    kept, daily, again = scratch_dir(spark, "r-kept"), str(tmp_path / "daily"), str(tmp_path / "again")
    first, second = [sample(1, 1, 10), sample(2, 1, 40)], [sample(1, 2, 30)]
    upsert.upsert_batch(spark.createDataFrame(first, CAPACITY), 0, kept, daily)
    upsert.upsert_batch(spark.createDataFrame(second, CAPACITY), 1, kept, daily)
    # As after a failure between the two writes: the day's partition is missing.
    upsert.read_daily(spark, daily).filter(F.col("d") != F.lit(dt.date(2024, 1, 2))).write.partitionBy("scope", "d").parquet(again)
    upsert.upsert_batch(spark.createDataFrame(second, CAPACITY), 1, kept, again)
    assert sorted(rows(upsert.read_daily(spark, again))) == maxima(first + second)


def test_upsert_stream_equals_batch_on_out_of_order_files(spark):
    in_dir, ckpt = scratch_dir(spark, "s-in"), scratch_dir(spark, "s-ckpt")
    kept, daily = scratch_dir(spark, "s-kept"), scratch_dir(spark, "s-daily")
    rnd, taken = random.Random(2), []
    for _ in range(3):
        batch = [sample(rnd.randint(0, 5), rnd.randint(0, 23), rnd.randint(1, 999), rnd.choice("tuv")) for _ in range(30)]
        spark.createDataFrame(batch, CAPACITY).coalesce(2).write.mode("append").parquet(in_dir)
        upsert.run_daily_upsert(spark, in_dir, kept, daily, ckpt, max_files_per_trigger=1).awaitTermination()
        taken += batch
    upsert.run_daily_upsert(spark, in_dir, kept, daily, ckpt).awaitTermination()
    assert sorted(rows(upsert.read_daily(spark, daily))) == maxima(taken)


# ---- registry history ----------------------------------------------------------------
LOG = "id int, change_ts long, op string, host string, description string, is_active boolean, set_keys array<string>"


def replay(table, log):
    """(id, host, description, is_active, connect_at_startup, from, to, made_by) by applying changes one at a time."""
    versions, now = [], {r[0]: (list(r[1:]), None, "initial") for r in table}
    for i, at, op, host, text, active, keys in sorted(log, key=lambda r: r[1]):
        if i is None or (op == "insert") == (i in now):
            continue
        state = list(now[i][0]) if i in now else None
        if i in now:
            versions.append((i, *now[i][0], now[i][1], at, now[i][2]))
            del now[i]
        if op == "delete":
            continue
        if op == "insert":
            state = [host, text, active, True]
        elif op == "update":
            state = [host, text, active, False]
        elif op == "flag":
            state[2] = active
        else:
            for k, v in zip(("host", "description", "is_active"), (host, text, active)):
                if k in keys:
                    state["host description is_active".split().index(k)] = v
        now[i] = (state, at, op)
    return versions + [(i, *s, at, None, by) for i, (s, at, by) in now.items()]


@pytest.mark.parametrize("buckets", [2, 64])
def test_history_equals_replay(spark, monkeypatch, buckets):
    monkeypatch.setattr(registry, "ORDER_BUCKETS", buckets)
    rnd = random.Random(buckets)
    table = [(i, f"h{i}", None, True, True) for i in range(8)]
    log = [(rnd.choice([1, 1, 1, *range(12), None]), 10 ** 12 if k == 299 else k, rnd.choice(["insert", "update", "delete", "flag", "patch"]),
            rnd.choice([None, f"n{k}"]), rnd.choice([None, f"d{k}"]), rnd.random() < 0.5, rnd.sample(["host", "description", "is_active", "id"], 2))
           for k in range(300)]
    conn = conform(spark.createDataFrame(table, "id int, host string, description string, is_active boolean, connect_at_startup boolean"), "connections")
    got = history.registry_history(conn, spark.createDataFrame(log, LOG))
    cols = ["id", "host", "description", "is_active", "connect_at_startup", "valid_from", "valid_to", "made_by"]
    want = replay(table, log)
    assert sorted(rows(got, *cols), key=str) == sorted(want, key=str) and len(want) > 100
    assert got.columns == [f.name for f in CONNECTIONS.fields] + cols[5:]
    for at in (-1, 0, 150, 298, 10 ** 12):
        here = [v[:5] for v in want if (v[5] is None or v[5] <= at) and (v[6] is None or v[6] > at)]
        assert sorted(rows(history.registry_as_of(got, at), *cols[:5]), key=str) == sorted(here, key=str)
    # The current versions are what applying the log gives.
    new, _ = registry.apply_change_log(conn, spark.createDataFrame(log, LOG))
    assert sorted(rows(new), key=str) == sorted(rows(got.filter("valid_to is null").select(*new.columns)), key=str)


def test_history_of_empty_sides(spark):
    conn = conform(spark.createDataFrame([(1, "h")], "id int, host string"), "connections")
    log = spark.createDataFrame([(2, 5, "insert", "x", None, True, [])], LOG)
    assert rows(history.registry_history(conn, log.limit(0)), "id", "valid_from", "valid_to", "made_by") == [(1, None, None, "initial")]
    assert rows(history.registry_history(conn.limit(0), log), "id", "valid_from", "made_by") == [(2, 5, "insert")]


# ---- stretches of days, robust forecast ----------------------------------------------
def snaps(spark, points, rel="t"):
    return spark.createDataFrame([sample(d, h, size, r) for d, h, size, r in points], CAPACITY)


def test_series_gaps(spark):
    from fleetstats.operators import trends
    df = snaps(spark, [(0, 1, 1, "t"), (0, 5, 2, "t"), (1, 0, 1, "t"), (5, 0, 1, "t"), (6, 0, 1, "t"), (20, 0, 1, "t"), (3, 0, 1, None)])
    day = lambda d: (DAY0 + dt.timedelta(days=d)).date()
    got = rows(trends.series_gaps(df), "relname", "first_day", "last_day", "days", "gap_days")
    assert sorted(got, key=str) == sorted([("t", day(0), day(1), 2, None), ("t", day(5), day(6), 2, 3), ("t", day(20), day(20), 1, 13),
                                           (None, day(3), day(3), 1, None)], key=str)
    assert trends.series_gaps(df.limit(0)).count() == 0


def test_robust_forecast_withstands_wrong_sizes_and_learns_the_week(spark):
    from fleetstats.operators import trends
    points = []
    for d in range(28):
        weekend = 5_000_000 if (DAY0 + dt.timedelta(days=d)).weekday() == 6 else 0
        points.append((d, 1, 10_000_000 + 1_000_000 * d + weekend, "t"))
    broken = points[:9] + [(9, 1, 9_000_000_000_000, "t")] + points[10:]
    for used in (points, broken):
        row = trends.forecast_robust(snaps(spark, used), "2024-01-29 00:00:00", 28, 13).first()   # a Sunday, 2024-02-11
        assert row.forecast_date == dt.date(2024, 2, 11) and row.slope_bytes_per_day == 1_000_000
        assert row.forecast_size_bytes == 10_000_000 + 1_000_000 * 41 + 5_000_000
    one = trends.forecast_robust(snaps(spark, points[:1]), "2024-01-29 00:00:00", 28, 13).first()
    assert one.points == 1 and one.forecast_size_bytes is None


# ---- totals, profiles, heavy statements, parameters ----------------------------------
def test_rollup_tells_levels_from_null_names(spark):
    from fleetstats.operators import reports
    df = spark.createDataFrame([("a", "s", "x", 10), ("a", "s", None, 30), ("a", None, "x", 60), (None, None, None, 100), ("z", "s", "e", 0)],
                               "datname string, schemaname string, relname string, size_bytes long")
    got = {(r.level, r.datname, r.schemaname, r.relname): (r.tables, r.size_bytes, r.share_of_parent_pct) for r in reports.capacity_rollup(df).collect()}
    assert got == {
        (7, None, None, None): (5, 200, None), (3, "a", None, None): (3, 100, 50.0), (3, None, None, None): (1, 100, 50.0), (3, "z", None, None): (1, 0, 0.0),
        (1, "a", "s", None): (2, 40, 40.0), (1, "a", None, None): (1, 60, 60.0), (1, None, None, None): (1, 100, 100.0), (1, "z", "s", None): (1, 0, None),
        (0, "a", "s", "x"): (1, 10, 25.0), (0, "a", "s", None): (1, 30, 75.0), (0, "a", None, "x"): (1, 60, 100.0), (0, None, None, None): (1, 100, 100.0),
        (0, "z", "s", "e"): (1, 0, None)}


def test_profiles_merge_like_one_pass(spark):
    from fleetstats.operators import profiles
    df = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4)).alias("g"), (F.col("id") % 17).alias("d"),
        F.when(F.col("id") % 10 != 0, F.pmod(F.xxhash64("id"), F.lit(9_000))).alias("v"))
    days = profiles.daily_profiles(df, ["g"], "d", "v")
    merged = profiles.merge_profiles(days, ["g"])
    errors = profiles.profile_errors(df, merged, ["g"], "v").collect()
    assert len(errors) == 5
    for r in errors:
        assert r.distinct_error <= 0.06 and max(r.p25_error, r.p50_error, r.p75_error, r.p95_error) <= 0.02
    want = {tuple(r) for r in df.groupBy("g").agg(F.count("*"), F.count_if(F.col("v").isNull()), F.min("v"), F.max("v"), F.sum("v")).collect()}
    assert {(r.g, r.n_rows, r.n_nulls, r.lowest, r.highest, int(r.total)) for r in errors} == want
    nothing = profiles.merge_profiles(profiles.daily_profiles(df.limit(3).withColumn("v", F.lit(None).cast("long")), ["g"], "d", "v"), ["g"])
    assert {(r.n_distinct, r.p50) for r in nothing.collect()} == {(0, None)}


@pytest.mark.parametrize("kept", [1, 3, 1000])
def test_heavy_statements_are_exact_however_small_the_summaries(spark, kept):
    from fleetstats.operators import heavy
    rnd = random.Random(kept)
    data = [(rnd.randrange(12), rnd.choice([None, "q0", *[f"q{int(rnd.paretovariate(0.6))}" for _ in range(9)]]), rnd.randrange(1, 100)) for _ in range(3000)]
    df = spark.createDataFrame(data, "day int, q string, w long")
    totals = heavy.day_totals(df, "day", ["q"], "w")
    got = rows(heavy.top_history(totals, heavy.summarise_days(totals, "day", ["q"], kept), "day", ["q"], 10), "q", "weight", "calls")
    want = {}
    for _, q, w in data:
        a, b = want.get(q, (0, 0))
        want[q] = (a + w, b + 1)
    best = sorted(((q, *x) for q, x in want.items()), key=lambda r: (-r[1], r[0] is not None, r[0] or ""))[:10]
    assert sorted(got, key=str) == sorted(best, key=str)


def test_variant_parameters_keep_types_and_nesting(spark):
    from fleetstats.operators import jobs as jb
    text = ['{"a": {"b": [1, {"c": "x"}]}, "n": 3}', "{broken", None, "[1]", '{"n": "many"}']
    df = spark.createDataFrame(list(enumerate(text)), "job_id int, tool_params string")
    v = jb.job_params_variant(df)
    got = v.select("job_id", F.col("params").isNotNull(), jb.variant_param("$.n", "int"), jb.variant_param("$.a.b[1].c", "string"))
    assert sorted(rows(got)) == [(0, True, 3, "x"), (1, False, None, None), (2, False, None, None), (3, True, None, None), (4, True, None, None)]
