"""Streaming forms against batch, and plan-shape checks over every registered query."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from fleetstats.operators import trends
from fleetstats.schemas import CAPACITY
from fleetstats.session import scratch_dir
from fleetstats.sources import capacity as cap
from fleetstats.sources import fixtures as fx
from fleetstats.sources.tables import load_tables
from fleetstats.streaming import capacity as stream

from fleetstats.suite import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stream_daily_max_is_batch_for_closed_days(spark):
    t = load_tables(spark, SF_SMALL, ["events"])
    snaps = fx.capacity_tables(t)
    in_dir = scratch_dir(spark, "t-in")
    snaps.write.parquet(in_dir)
    out, ckpt = scratch_dir(spark, "t-out"), scratch_dir(spark, "t-ckpt")
    stream.run_daily_max(spark, in_dir, out, ckpt, "1 day").awaitTermination()
    streamed = spark.read.parquet(out)
    batch = (snaps.groupBy("scope", "dbname", "schemaname", "relname", F.to_date("snapshot_ts").alias("d"))
             .agg(F.max("size_bytes").alias("size_bytes")))
    s_rows = set(rows(streamed, "scope", "dbname", "schemaname", "relname", "d", "size_bytes"))
    b_rows = set(rows(batch, "scope", "dbname", "schemaname", "relname", "d", "size_bytes"))
    assert s_rows and s_rows <= b_rows
    last_ts = snaps.agg(F.max("snapshot_ts")).first()[0]
    closed = {r for r in b_rows if r[4] + dt.timedelta(days=1) <= (last_ts - dt.timedelta(days=1)).date()}
    assert closed <= s_rows


def test_capacity_stream_is_exactly_once_on_rerun(spark):
    t = load_tables(spark, SF_SMALL, ["events"])
    in_dir = scratch_dir(spark, "c-in")
    fx.capacity_dbs(t).write.parquet(in_dir)
    out, ckpt = scratch_dir(spark, "c-out"), scratch_dir(spark, "c-ckpt")
    stream.capacity_stream(spark, in_dir, out, ckpt).awaitTermination()
    stream.capacity_stream(spark, in_dir, out, ckpt).awaitTermination()  # same checkpoint: nothing new
    assert cap.read_capacity(spark, out).count() == fx.capacity_dbs(t).count()


def test_snapshot_table_prunes_partitions(spark):
    t = load_tables(spark, SF_SMALL, ["events"])
    path = scratch_dir(spark, "snap")
    latest = trends.latest_sizes(fx.capacity_tables(t), "table")
    cap.append_table_capacity(latest, "2024-01-20 00:00:00", path)
    cap.append_table_capacity(latest, "2024-01-30 00:00:00", path)
    snaps = cap.read_capacity(spark, path)
    df = trends.daily_max_size(snaps, "2024-01-31 00:00:00", "table", days=3)
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(scope" in plan or "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert "snapshot_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert df.count() == latest.count()


def test_top_k_plans(spark):
    t = load_tables(spark, SF_SMALL, ["events"])
    snaps = fx.capacity_tables(t)
    fleet = _plan(trends.growth_table(snaps, "2024-01-31 00:00:00", 14, 10))
    assert "WindowGroupLimit" in fleet
    single = trends.growth_table(snaps, "2024-01-31 00:00:00", 14, 10, dbname="db_1")
    single._jdf.queryExecution().executedPlan()
    assert "TakeOrderedAndProject" in single._jdf.queryExecution().sparkPlan().toString()


def test_policy_is_a_projection(spark):
    t = load_tables(spark, SF_SMALL, ["events"])
    from fleetstats.operators.policy import policy_decide
    plan = _plan(policy_decide(fx.access_requests(t), fx.ACCESS_POLICY))
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if "stream" not in k and "append" not in k
                                       and k != "scan_stats"))
def test_no_pair_joins_no_python_and_pruned_scans(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (key, bad)
    # Column pruning: no scan of the wide text tables reads their payload columns.
    for payload in ("text#", "html#"):
        assert payload not in plan, (key, payload)


def test_recompute_daily_max_for_late_samples(spark):
    path = scratch_dir(spark, "late")
    sizes = spark.createDataFrame([("db_1", "s", "t", 10), ("db_1", "s", "u", 5)],
                                  "dbname string, schemaname string, relname string, size_bytes long")
    cap.append_table_capacity(sizes, "2024-01-20 10:00:00", path)
    cap.append_table_capacity(sizes, "2024-01-21 10:00:00", path)
    snaps = cap.read_capacity(spark, path)
    late = spark.createDataFrame([(dt.datetime(2024, 1, 20, 23), "table", "db_1", "s", "t", 99)],
                                 "snapshot_ts timestamp, scope string, dbname string, schemaname string, "
                                 "relname string, size_bytes long")
    df = trends.recompute_daily_max(snaps, late)
    assert rows(df, "relname", "d", "size_bytes") == [("t", dt.date(2024, 1, 20), 99)]
    plan = _plan(df)
    assert "snapshot_date" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert "subquery" in plan.split("PartitionFilters:")[1].split("\n")[0].lower()


def test_out_of_order_batches_lose_nothing_within_the_watermark(spark):
    import time
    in_dir = scratch_dir(spark, "o-in")
    samples = [(day, hour, size) for day in (5, 1, 6, 2, 4, 3) for hour, size in ((1, day * 10), (23, day * 10 + day % 3))]
    for day in (5, 1, 6, 2, 4, 3):   # six micro-batches, the later ones with earlier days
        rows_ = [(dt.datetime(2024, 1, d, h), "table", "a", "s", "t", size) for d, h, size in samples if d == day]
        spark.createDataFrame(rows_, CAPACITY).coalesce(1).write.mode("append").parquet(in_dir)
        time.sleep(1.1)              # files are taken in the order of their times
    close = [(dt.datetime(2024, 2, 1), "table", "a", "s", "t", 0)]
    spark.createDataFrame(close, CAPACITY).coalesce(1).write.mode("append").parquet(in_dir)
    out, ckpt = scratch_dir(spark, "o-out"), scratch_dir(spark, "o-ckpt")
    stream.run_daily_max(spark, in_dir, out, ckpt, "10 days", max_files_per_trigger=1).awaitTermination()
    want = [(dt.date(2024, 1, d), max(s for x, _, s in samples if x == d)) for d in range(1, 7)]
    assert sorted(rows(spark.read.parquet(out), "d", "size_bytes")) == want


def test_hot_database_top_k_matches_brute_force(spark):
    from fleetstats.operators import reports
    base = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("db_"), (F.col("id") % 50).cast("string")))
        .alias("datname"), F.col("id").alias("pid"), F.lit("active").alias("state"),
        F.timestamp_seconds(F.lit(1700000000) + (F.col("id") * 7919) % 100000).alias("xact_start"),
        F.lit(None).cast("timestamp").alias("query_start"), F.lit("q").alias("query"))
    local = [(r.datname, r.pid, r.xact_start) for r in base.collect()]
    want = {}
    for db, pid, ts in sorted(local, key=lambda r: (r[0], r[2], r[1])):   # oldest first = largest age
        want.setdefault(db, [])
        if len(want[db]) < 5:
            want[db].append(pid)
    for threshold in ("1000", "2"):   # with and without Spark's partial group limit
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
        try:
            got = {}
            for db, pid in rows(reports.connections_top(base, "2024-01-01 00:00:00", limit=5), "datname", "pid"):
                got.setdefault(db, []).append(pid)
        finally:
            spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}, threshold


def test_dense_sequence_is_stable_across_evaluations(spark):
    from fleetstats.plans.shapes import dense_sequence
    df = spark.range(3000).select(((F.col("id") * 104729) % 3000).alias("o"), (F.col("id") % 7).alias("g"))
    seq = dense_sequence(df, ["g", "o"], "n")
    first, second = sorted(rows(seq)), sorted(rows(seq))
    assert first == second and sorted(n for _, _, n in first) == list(range(1, 3001))


def test_dense_sequence_without_exchange_reuse(spark):
    from fleetstats.plans.shapes import dense_sequence
    many = spark.range(600_000).select(F.xxhash64("id").alias("o"))
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        seq = dense_sequence(many, ["o"], "n", partitions=40)
        lo, hi, n = rows(seq.agg(F.min("n"), F.max("n"), F.countDistinct("n")))[0]
        assert (lo, hi, n) == (1, 600_000, 600_000)
        broken = seq.select("n", F.col("o").alias("o"), F.lag("o").over(Window.partitionBy(F.col("n") % 1).orderBy("n")).alias("p"))
        assert broken.filter("p > o").count() == 0        # numbers follow the order
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_top_k_spreads_equal_rows_of_one_group(spark):
    from fleetstats.plans.shapes import top_k
    same = spark.range(20000).select(F.lit("g").alias("g"), F.lit(1).alias("v"))
    assert top_k(same, [F.col("v")], 3000, ["g"]).count() == 3000
    salted = same.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    assert salted.select("_salt").distinct().count() == 16


@pytest.mark.parametrize("key,partial", [
    ("growth_table", "partial_max"), ("growth_forecast", "partial_sum"), ("connections_summary", "partial_count"),
    ("db_capacity", "partial_max"), ("registry_update", "partial_max"), ("violations_unique", "partial_count"),
    ("missed_runs", "partial_min"),
])
def test_hot_keys_are_pre_aggregated_before_the_shuffle(spark, key, partial):
    plan = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert partial in plan, (key, partial)


def test_read_capacity_unpartitioned_folder(spark):
    path = scratch_dir(spark, "flat")
    t = load_tables(spark, SF_SMALL, ["events"])
    fx.capacity_dbs(t).write.parquet(path)
    df = cap.read_capacity(spark, path)
    assert df.filter(F.to_date("snapshot_ts") != F.col("snapshot_date")).count() == 0
    assert df.count() == fx.capacity_dbs(t).count()


def test_scratch_goes_under_the_configured_checkpoint_dir(spark):
    configured = spark.sparkContext.getCheckpointDir()
    path = scratch_dir(spark, "probe")
    assert configured and path.startswith(configured.rstrip("/"))
    assert scratch_dir(spark, "probe") != path          # a fresh folder every time


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if "stream" not in k and "append" not in k
                                       and k != "scan_stats"))
def test_single_partition_exchanges_only_for_bounded_data(spark, key):
    plan = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # Bounded cases: final steps of global aggregates of partial rows (counts, one database,
    # quantiles of a log's order, max id, one bound per day and a k-row list of the heaviest
    # statements) and the numbering helper's count table.
    bounded = ("row_counts", "registry_", "job_patch", "types_apply", "growth_db_", "connections_summary_", "top_queries_history")
    if not key.startswith(bounded):
        assert "SinglePartition" not in plan, key


def test_explicit_broadcasts_only_for_bounded_sides():
    """Hints exist only where size is bounded by construction: the numbering helper's offset
    table (one row per partition)."""
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[1] / "fleetstats"
    files = [p for p in root.rglob("*.py") if "llm" not in p.parts]   # those have tests of their own
    hits = sorted(str(p.relative_to(root)) for p in files if "F.broadcast(" in p.read_text())
    assert hits == ["plans/shapes.py"]


def test_library_never_collects_or_uses_python_udfs():
    import pathlib
    import re
    root = pathlib.Path(__file__).resolve().parents[1] / "fleetstats"
    banned = re.compile(r"\.collect\(|\.toPandas\(|localCheckpoint|udf|\.rdd\b|\.first\(|\.take\(|\.head\(")
    offenders = [f"{p.relative_to(root)}:{i}" for p in root.rglob("*.py") if "llm" not in p.parts
                 for i, line in enumerate(p.read_text().splitlines(), 1) if banned.search(line)]
    assert offenders == []
