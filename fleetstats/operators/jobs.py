"""Scheduled-job tables — listing, parameters, trigger plan, expected firings, audits.

Expected firings are generated, never looped on the driver: interval jobs explode
bounded chunks of their firing index (a hot job's chunks are spread by a repartition
before the inner explode); cron jobs join their day/month sets to a small calendar whose
size the arguments fix, then explode hours and minutes. The audit takes these, or a table
of expected firings from elsewhere.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.functions.exprs import ts_lit
from fleetstats.operators.cron import with_cron_fields
from fleetstats.plans.shapes import last_per_key
from fleetstats.sources.stats import conform

# Fixed values of the scheduler tables: trigger kinds, scheduler job id prefix.
TRIGGER_INTERVAL, TRIGGER_CRON, SCHEDULER_ID_PREFIX = "interval", "cron", "job_"
ISO = "yyyy-MM-dd'T'HH:mm:ss"
TS_COLS = ["last_run_at", "created_at", "updated_at"]
# Firing indexes generated per row before the inner explode.
CHUNK = 4096


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with ``is_active = true``."""
    return conform(jobs, "jobs").filter(F.col("is_active"))


def list_jobs(jobs: DataFrame, job_id: int | None = None) -> DataFrame:
    """All jobs ordered by id (or one by id), timestamps rendered as ISO text."""
    j = conform(jobs, "jobs")
    if job_id is not None:
        j = j.filter(F.col("job_id") == job_id)
    cols = [F.date_format(c, ISO).alias(c) if c in TS_COLS else F.col(c) for c in j.columns]
    return j.select(*cols).orderBy("job_id")


def job_params(jobs: DataFrame) -> DataFrame:
    """``tool_params`` as a string map; NULL, unparsable text and non-objects → empty map."""
    j = conform(jobs, "jobs")
    parsed = F.from_json(F.col("tool_params"), "map<string,string>")
    params = F.coalesce(parsed, F.create_map().cast("map<string,string>"))
    return j.select("job_id", params.alias("params"))


def job_params_summary(jobs: DataFrame) -> DataFrame:
    """J3 in comparable form: number of parameters and the ``connection_id`` value."""
    p = job_params(jobs)
    return p.select("job_id", F.size("params").alias("n_params"),
                    F.try_element_at("params", F.lit("connection_id")).alias("connection_id"))


def job_params_variant(jobs: DataFrame) -> DataFrame:
    """J3 with types: ``tool_params`` as a VARIANT, nested values kept; NULL where it is no valid JSON."""
    return conform(jobs, "jobs").select("job_id", F.try_parse_json("tool_params").alias("params"))


def variant_param(path: str, kind: str) -> F.Column:
    """The value at ``path`` of ``params`` as ``kind``; NULL where it is absent or of another type."""
    return F.try_variant_get("params", path, kind)


def trigger_plan(jobs: DataFrame) -> DataFrame:
    """What the scheduler registers: ``job_<id>`` with a period (interval) or an
    expression (cron); other trigger types are skipped; a later row for the same id
    (greater ``updated_at``) replaces an earlier one."""
    j = active_jobs(jobs).filter(F.col("trigger_type").isin(TRIGGER_INTERVAL, TRIGGER_CRON))
    j = last_per_key(j, ["job_id"], ["updated_at"])
    return j.select(
        F.concat(F.lit(SCHEDULER_ID_PREFIX), F.col("job_id").cast("string")).alias("scheduler_id"),
        "job_id", "job_name", "trigger_type",
        F.when(F.col("trigger_type") == TRIGGER_INTERVAL, F.col("interval_seconds")).alias("interval_seconds"),
        F.when(F.col("trigger_type") == TRIGGER_CRON, F.col("cron_expression")).alias("cron_expression"),
    )


def _spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-spread small generator inputs over the session's tasks before they are exploded."""
    return df.repartition(*cols)


def _micros(value) -> F.Column:
    return F.unix_micros(ts_lit(value))


def interval_fire_times(jobs: DataFrame, from_ts, to_ts, anchor=None) -> DataFrame:
    """``anchor + k * interval`` for active interval jobs, inside ``[from_ts, to_ts)``.

    The anchor (when the scheduler started counting) is a timestamp, or the name of a
    per-job timestamp column such as ``created_at`` (NULL falls back to ``from_ts``);
    it defaults to ``from_ts``.
    """
    j = active_jobs(jobs).filter((F.col("trigger_type") == TRIGGER_INTERVAL) & (F.col("interval_seconds") > 0))
    if isinstance(anchor, str) and anchor in j.columns:
        a = F.coalesce(F.unix_micros(F.col(anchor)), _micros(from_ts))
    else:
        a = _micros(anchor if anchor is not None else from_ts)
    base = j.select("job_id", (F.col("interval_seconds").cast("long") * 1000000).alias("iv"),
                    _micros(from_ts).alias("f"), _micros(to_ts).alias("t"), a.alias("a"))
    first = base.selectExpr("job_id", "iv", "t", "a + greatest(0L, (f - a + iv - 1) div iv) * iv AS first")
    counted = first.selectExpr("job_id", "iv", "first",
                               "CASE WHEN first < t THEN (t - first + iv - 1) div iv ELSE 0L END AS n")
    chunks = counted.filter("n > 0").selectExpr(
        "job_id", "iv", "first", "n", f"explode(sequence(0L, (n - 1) div {CHUNK})) AS c")
    spread = _spread(chunks, "job_id", "c")
    fires = spread.selectExpr(
        "job_id", f"explode(sequence(c * {CHUNK}, least(n, (c + 1) * {CHUNK}) - 1)) AS k", "iv", "first")
    return fires.select("job_id", F.timestamp_micros(F.col("first") + F.col("k") * F.col("iv")).alias("fire_ts"))


def _as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.fromisoformat(str(value)).date()


def cron_fire_times(jobs: DataFrame, from_ts, to_ts) -> DataFrame:
    """Firings of active cron jobs inside ``[from_ts, to_ts)`` (session time zone).

    Candidate days are the job's day-of-month and month sets joined to the window's
    calendar, filtered by weekday and expanded by hour and minute, a job's days in several
    tasks. Distinct expressions are parsed once.
    """
    spark = jobs.sparkSession
    j = active_jobs(jobs).filter(F.col("trigger_type") == TRIGGER_CRON)
    parsed = with_cron_fields(j.select("cron_expression").distinct())
    fields = j.select("job_id", "cron_expression").join(parsed, "cron_expression").drop("cron_expression")
    d0, d1 = _as_date(from_ts), _as_date(to_ts)
    ndays = (d1 - d0).days + 1
    # A job's day-of-month x month set (at most 372 rows) meets the window's calendar, which
    # has one row per day: its size is set by the arguments.
    per_day = (fields.select("job_id", "minute", "hour", "day_of_week", "month", F.explode("day").alias("dom"))
               .select("job_id", "minute", "hour", "day_of_week", "dom", F.explode("month").alias("mon")))
    cal = spark.range(ndays).select(F.date_add(F.lit(d0), F.col("id").cast("int")).alias("d"))
    cal = cal.select("d", F.month("d").alias("mon"), F.dayofmonth("d").alias("dom"))
    days = per_day.join(cal, ["mon", "dom"])
    days = days.filter(F.array_contains("day_of_week", F.weekday("d")))
    days = _spread(days, "job_id", "d")  # one job's days go to several tasks
    fires = (days.select("job_id", "d", "minute", F.explode("hour").alias("h"))
             .select("job_id", "d", "h", F.explode("minute").alias("m")))
    ts = F.timestamp_seconds(F.unix_seconds(F.col("d").cast("timestamp")) + F.col("h") * 3600 + F.col("m") * 60)
    out = fires.select("job_id", ts.alias("fire_ts"))
    return out.filter((F.col("fire_ts") >= ts_lit(from_ts)) & (F.col("fire_ts") < ts_lit(to_ts)))


def expected_fire_times(jobs: DataFrame, from_ts, to_ts, anchor=None) -> DataFrame:
    """J5 ∪ J6."""
    return interval_fire_times(jobs, from_ts, to_ts, anchor).unionByName(cron_fire_times(jobs, from_ts, to_ts))


def last_run(jobs: DataFrame, run_log: DataFrame) -> DataFrame:
    """``last_run_at`` moves to the latest *successful* run; failures change nothing."""
    runs = (conform(run_log, "run_log").filter(F.col("success"))
            .groupBy("job_id").agg(F.max("run_ts").alias("_last")))
    j = conform(jobs, "jobs").join(runs, "job_id", "left")
    return j.select("job_id", "job_name", F.greatest("last_run_at", "_last").alias("last_run_at"))


def missed_runs(expected: DataFrame, run_log: DataFrame, tolerance_seconds: int = 0,
                successful_only: bool = False, window: tuple | None = None) -> DataFrame:
    """Expected firings (job_id, fire_ts) with no logged run within ``± tolerance_seconds``, once each.

    ``window``, the ``[from, to)`` that the firings were expected in, bounds the run log on
    its raw time column, so files and row groups outside of it are not read. Runs are
    reduced to (min, max) per (job, time bucket of width tolerance) by a partial aggregate;
    each firing probes at most three buckets through an equi-join on (job, bucket), so no
    pairs of firings and runs are ever formed, whatever the skew; a per-firing aggregate
    then keeps the firings no probe matched.
    """
    if window is not None:
        slack = F.make_dt_interval(secs=F.lit(float(int(tolerance_seconds))))
        run_log = run_log.filter((F.col("run_ts") >= ts_lit(window[0]) - slack) & (F.col("run_ts") <= ts_lit(window[1]) + slack))
    tol = int(tolerance_seconds) * 1000000
    width = max(tol, 1)
    runs = conform(run_log, "run_log")
    if successful_only:
        runs = runs.filter(F.col("success"))
    us = F.unix_micros("run_ts")
    buckets = (runs.select("job_id", us.alias("u"))
               .selectExpr("job_id", f"(u - pmod(u, {width}L)) div {width}L AS b", "u")
               .groupBy("job_id", "b").agg(F.min("u").alias("lo"), F.max("u").alias("hi")))
    exp = expected.select("job_id", "fire_ts", F.unix_micros("fire_ts").alias("e"))
    probes = exp.selectExpr(
        "job_id", "fire_ts", "e",
        f"explode(sequence(((e - {tol}L) - pmod(e - {tol}L, {width}L)) div {width}L, "
        f"((e + {tol}L) - pmod(e + {tol}L, {width}L)) div {width}L)) AS b")
    j = probes.join(buckets, ["job_id", "b"], "left")
    # A bucket is never wider than the probe range, so it is covered whole, or from its
    # start (test the earliest run), or up to its end (test the latest run).
    hit = F.when(F.col("e") - tol <= F.col("b") * width, F.col("lo") <= F.col("e") + tol) \
        .otherwise(F.col("hi") >= F.col("e") - tol)
    # One partial aggregate per firing: the expected rows are generated once.
    per_fire = j.groupBy("job_id", "fire_ts").agg(F.max(F.coalesce(hit, F.lit(False))).alias("_hit"))
    return per_fire.filter(~F.col("_hit")).select("job_id", "fire_ts")
