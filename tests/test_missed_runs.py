"""Expected firings of scheduled jobs, and the audit of missed runs that is built on them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows

from fleetstats.operators import jobs as jb
from fleetstats.operators.cron import expand_field
from fleetstats.schemas import JOBS
from fleetstats.suite import AUDIT_FROM, AUDIT_TO, QUERIES


def _jobs(spark, data):
    return spark.createDataFrame(
        [(i, f"j{i}", "t", None, kind, iv, cron, True, None, None, None) for i, kind, iv, cron in data], JOBS)


def test_cron_field_forms(spark):
    df = spark.createDataFrame([("*/15",), ("1-5/2",), ("5/20",), ("3,1,3",), ("7-2",), ("x",)], "f string")
    out = [r[0] for r in df.select(expand_field("f", 0, 59)).collect()]
    assert out == [[0, 15, 30, 45], [1, 3, 5], [5, 25, 45], [1, 3], [], []]


def test_cron_weekday_names_and_both_day_fields(spark):
    jobs = _jobs(spark, [(1, "cron", None, "30 9 * * mon-fri"), (2, "cron", None, "0 0 1 * 0")])
    out = rows(jb.cron_fire_times(jobs, "2024-01-01 00:00:00", "2024-01-09 00:00:00"), "job_id", "fire_ts")
    days1 = sorted(ts.date() for j, ts in out if j == 1)
    assert [d.day for d in days1] == [1, 2, 3, 4, 5, 8]   # 2024-01-01 is a Monday (0 = Monday)
    assert [ts for j, ts in out if j == 2] == [dt.datetime(2024, 1, 1)]  # day 1 AND Monday


def test_cron_long_window_uses_calendar_join(spark):
    jobs = _jobs(spark, [(1, "cron", None, "0 12 29 2 *")])
    out = rows(jb.cron_fire_times(jobs, "2023-01-01 00:00:00", "2025-01-01 00:00:00"), "fire_ts")
    assert out == [(dt.datetime(2024, 2, 29, 12),)]


def test_interval_anchor_before_window(spark):
    jobs = _jobs(spark, [(1, "interval", 3600, None)])
    out = rows(jb.interval_fire_times(jobs, "2024-01-01 10:30:00", "2024-01-01 13:00:00",
                                      anchor="2024-01-01 00:00:00"), "fire_ts")
    assert out == [(dt.datetime(2024, 1, 1, 11),), (dt.datetime(2024, 1, 1, 12),)]


def test_interval_many_chunks_is_exact(spark):
    jobs = _jobs(spark, [(1, "interval", 1, None)])
    df = jb.interval_fire_times(jobs, "2024-01-01 00:00:00", "2024-01-01 03:00:00")
    assert df.count() == 3 * 3600 and df.select("fire_ts").distinct().count() == 3 * 3600


def test_interval_anchor_per_job_column(spark):
    jobs = spark.createDataFrame(
        [(1, "a", "t", None, "interval", 3600, None, True, None, dt.datetime(2024, 1, 1, 0, 30), None),
         (2, "b", "t", None, "interval", 3600, None, True, None, None, None)], JOBS)
    out = sorted(rows(jb.interval_fire_times(jobs, "2024-01-01 00:00:00", "2024-01-01 02:00:00",
                                             anchor="created_at"), "job_id", "fire_ts"))
    assert out == [(1, dt.datetime(2024, 1, 1, 0, 30)), (1, dt.datetime(2024, 1, 1, 1, 30)),
                   (2, dt.datetime(2024, 1, 1, 0, 0)), (2, dt.datetime(2024, 1, 1, 1, 0))]


def _py_field(field, lo, hi):
    out = set()
    for item in field.split(","):
        base, _, step = item.partition("/")
        n = int(step) if step else 1
        if base == "*":
            a, b = lo, hi
        elif "-" in base:
            a, b = map(int, base.split("-"))
        else:
            a = int(base)
            b = hi if step else a
        out.update(v for v in range(a, b + 1, n) if lo <= v <= hi)
    return out


def test_cron_matches_python_brute_force(spark):
    rnd = random.Random(5)

    def field(lo, hi):
        kind = rnd.choice(["*", "*/n", "a", "a-b", "a-b/n", "list"])
        a, b = sorted(rnd.sample(range(lo, hi + 1), 2))
        return {"*": "*", "*/n": f"*/{rnd.randint(2, 9)}", "a": str(a), "a-b": f"{a}-{b}",
                "a-b/n": f"{a}-{b}/{rnd.randint(2, 5)}", "list": f"{a},{b}"}[kind]

    exprs = [" ".join([field(0, 59), field(0, 23), field(1, 31), field(1, 12), field(0, 6)]) for _ in range(25)]
    exprs += ["0 0 * * *", "*/30 9-17 * * 0-4", "15 6 1,31 1,2 *"]
    jobs = _jobs(spark, [(i, "cron", None, e) for i, e in enumerate(exprs, start=1)])
    start, end = dt.datetime(2024, 1, 28), dt.datetime(2024, 2, 3)
    got = set(rows(jb.cron_fire_times(jobs, start, end), "job_id", "fire_ts"))
    want = set()
    for i, e in enumerate(exprs, start=1):
        mi, ho, dd, mo, wd = e.split()
        sets = (_py_field(mi, 0, 59), _py_field(ho, 0, 23), _py_field(dd, 1, 31), _py_field(mo, 1, 12),
                _py_field(wd, 0, 6))
        t = start
        while t < end:
            if (t.minute in sets[0] and t.hour in sets[1] and t.day in sets[2] and t.month in sets[3]
                    and t.weekday() in sets[4]):
                want.add((i, t))
            t += dt.timedelta(minutes=1)
    assert got == want


def test_interval_matches_python_enumeration(spark):
    rnd = random.Random(9)
    start, end = dt.datetime(2024, 3, 1, 6), dt.datetime(2024, 3, 3, 2)
    for anchor in (dt.datetime(2024, 2, 27, 13, 7), start + dt.timedelta(minutes=95)):
        specs = [(i, rnd.choice([60, 900, 3600, 5400, 7 * 3600, 86400, 200000])) for i in range(1, 13)]
        jobs = _jobs(spark, [(i, "interval", iv, None) for i, iv in specs])
        got = set(rows(jb.interval_fire_times(jobs, start, end, anchor=anchor), "job_id", "fire_ts"))
        want = set()
        for i, iv in specs:
            t = anchor
            while t < end:
                if t >= start:
                    want.add((i, t))
                t += dt.timedelta(seconds=iv)
        assert got == want, anchor


def test_missed_runs_query_audits_the_firings_of_the_jobs(spark):
    """Every firing the jobs table asks for in the week is missed or has a run within the hour."""
    jobs = rows(spark.read.parquet(f"{SF_SMALL}/customer.parquet").select("c_custkey"))
    runs = {}
    for j, day in rows(spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_custkey", F.col("o_orderdate").cast("timestamp"))):
        runs.setdefault(j, []).append(day)
    start, end = dt.datetime.fromisoformat(AUDIT_FROM), dt.datetime.fromisoformat(AUDIT_TO)
    want = set()
    for (j,) in jobs:
        if j % 5 == 0 or j % 11 == 0:   # not active, or fired by hand
            continue
        if j % 2 == 0:
            step = dt.timedelta(hours=1 + j % 10)
            fires = [start + i * step for i in range((end - start) // step + 1)]
        else:
            fires = [start + dt.timedelta(hours=6 * i, minutes=j % 60) for i in range(28)]
        want |= {(j, t) for t in fires if t < end and not any(abs(t - r) <= dt.timedelta(hours=1) for r in runs.get(j, []))}
    got = rows(QUERIES["missed_runs"](spark, SF_SMALL))
    assert len(got) == len(want) and set(got) == want


def test_a_repeated_job_row_expects_each_firing_once(spark):
    jobs = _jobs(spark, [(1, "interval", 43200, None), (1, "interval", 43200, None), (2, "cron", None, "0 6 * * *"), (2, "cron", None, "0 6 * * *")])
    window = ("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12), True)], "job_id int, run_ts timestamp, success boolean")
    out = rows(jb.missed_runs(jb.expected_fire_times(jobs, *window), log, 60, window=window))
    assert sorted(out) == [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1, 6))]
