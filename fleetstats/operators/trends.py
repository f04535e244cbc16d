"""Capacity growth over the snapshot series, for every series of the fleet.

Series key is ``(dbname, schemaname, relname)``; database-scope rows carry NULL
schema/table. Each report is a two-level hash aggregation (day max, then per series),
both levels with map-side partial aggregation, so a series holding a third of all
snapshots still shuffles only one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstats.functions.exprs import ts_lit
from fleetstats.plans.shapes import top_k

SERIES = ["dbname", "schemaname", "relname"]
# Fixed values of the reference trend report: window length 1..365 days (default 30),
# row limit 1..100 (default 10), sizes reported in MB of 1024 * 1024 bytes.
DAYS_MIN, DAYS_MAX, DAYS_DEFAULT = 1, 365, 30
LIMIT_MIN, LIMIT_MAX, LIMIT_DEFAULT = 1, 100, 10
MB = 1048576.0


def _within(name: str, value: int, lo: int, hi: int) -> int:
    """``value`` if it lies in the documented range; a report of fewer rows is never given silently."""
    if not lo <= int(value) <= hi:
        raise ValueError(f"{name} must be from {lo} to {hi}, not {value}")
    return int(value)


def _window(snapshots: DataFrame, as_of, days: int, scope: str | None, dbname: str | None) -> DataFrame:
    days = _within("days", days, DAYS_MIN, DAYS_MAX)
    end = ts_lit(as_of)
    start = end - F.make_dt_interval(F.lit(days))
    cond = (F.col("snapshot_ts") >= start) & (F.col("snapshot_ts") < end)
    if "snapshot_date" in snapshots.columns:
        # Lets the scan prune scope/snapshot_date partitions before reading any file.
        cond = cond & (F.col("snapshot_date") >= F.to_date(start)) & (F.col("snapshot_date") <= F.to_date(end))
    if scope is not None:
        cond = cond & (F.col("scope") == scope)
    if dbname is not None:
        cond = cond & (F.col("dbname") == dbname)
    return snapshots.filter(cond)


def daily_max_size(snapshots: DataFrame, as_of, scope: str = "table", days: int = DAYS_DEFAULT,
                   dbname: str | None = None) -> DataFrame:
    """Largest size per series and calendar day inside ``[as_of - days, as_of)``."""
    base = _window(snapshots, as_of, days, scope, dbname)
    return (base.groupBy(*SERIES, F.to_date("snapshot_ts").alias("d"))
            .agg(F.max("size_bytes").alias("size_bytes")))


def _growth_cols(start: Column, end: Column, steps: Column) -> list[Column]:
    delta = (end - start).cast("double")
    return [
        F.round(delta / F.lit(MB), 2).alias("growth_mb"),
        F.round(delta / F.nullif(start, F.lit(0)) * F.lit(100), 2).alias("growth_pct"),
        F.round(delta / F.lit(MB) / F.nullif(steps, F.lit(0)), 2).alias("growth_mb_per_day"),
    ]


def _span(daily: DataFrame, by: list[str]) -> DataFrame:
    return daily.groupBy(*by).agg(
        F.min("d").alias("start_date"), F.max("d").alias("end_date"),
        F.min("size_bytes").alias("start_size"), F.max("size_bytes").alias("end_size"),
        F.count(F.lit(1)).alias("points"),
    )


def growth_db(snapshots: DataFrame, as_of, days: int = DAYS_DEFAULT, dbname: str | None = None) -> DataFrame:
    """Database growth from the daily maxima (start/end = min/max of the days).

    Fleet form: one row per database. With ``dbname``: one row even on empty input.
    Rate divides by ``points - 1`` (sampled days), NULL below two points.
    """
    daily = daily_max_size(snapshots, as_of, "db", days, dbname)
    by = [] if dbname is not None else ["dbname"]
    span = _span(daily, by)
    if dbname is not None:
        span = span.select(F.lit(dbname).alias("dbname"), "*")
    return span.select("dbname", "start_date", "end_date", "start_size", "end_size", "points",
                       *_growth_cols(F.col("start_size"), F.col("end_size"), F.col("points") - 1))


def growth_table(snapshots: DataFrame, as_of, days: int = DAYS_DEFAULT, limit: int = LIMIT_DEFAULT,
                 dbname: str | None = None) -> DataFrame:
    """Per-table growth, the ``limit`` fastest growing tables of each database.

    Ordered by rounded growth_mb desc, ties by (schemaname, relname).
    """
    limit = _within("limit", limit, LIMIT_MIN, LIMIT_MAX)
    daily = daily_max_size(snapshots, as_of, "table", days, dbname)
    span = _span(daily, SERIES)
    rep = span.select(*SERIES, "start_date", "end_date",
                      *_growth_cols(F.col("start_size"), F.col("end_size"), F.col("points") - 1))
    order = [F.col("growth_mb").desc_nulls_last(), F.col("schemaname").asc_nulls_first(),
             F.col("relname").asc_nulls_first()]
    return top_k(rep, order, limit, None if dbname is not None else ["dbname"])


def growth_ordered(snapshots: DataFrame, as_of, days: int = DAYS_DEFAULT, limit: int = LIMIT_DEFAULT,
                   dbname: str | None = None, scope: str = "table") -> DataFrame:
    """T4: growth from the first and last day's size, so shrinkage is negative.

    The per-day rate divides by elapsed days (end_date - start_date).
    """
    limit = _within("limit", limit, LIMIT_MIN, LIMIT_MAX)
    daily = daily_max_size(snapshots, as_of, scope, days, dbname)
    span = daily.groupBy(*SERIES).agg(
        F.min("d").alias("start_date"), F.max("d").alias("end_date"),
        F.min_by("size_bytes", "d").alias("start_size"), F.max_by("size_bytes", "d").alias("end_size"),
        F.count(F.lit(1)).alias("points"),
    )
    elapsed = F.datediff("end_date", "start_date")
    rep = span.select(*SERIES, "start_date", "end_date", "start_size", "end_size", "points",
                      elapsed.alias("elapsed_days"),
                      *_growth_cols(F.col("start_size"), F.col("end_size"), elapsed))
    order = [F.col("growth_mb").desc_nulls_last(), F.col("schemaname").asc_nulls_first(),
             F.col("relname").asc_nulls_first()]
    return top_k(rep, order, limit, None if dbname is not None else ["dbname"])


def growth_forecast(snapshots: DataFrame, as_of, days: int = DAYS_DEFAULT, horizon_days: int = 30,
                    scope: str = "table", dbname: str | None = None) -> DataFrame:
    """T5: least-squares line through (day number, daily max) per series, projected ahead.

    Sums are exact integers (decimal(38,0)); slope and projection each take one double
    division at the end, so the result does not depend on summation order.
    x = days since the window start; the forecast is for ``to_date(as_of) + horizon_days``.
    """
    days = _within("days", days, DAYS_MIN, DAYS_MAX)
    daily = daily_max_size(snapshots, as_of, scope, days, dbname)
    day0 = F.to_date(ts_lit(as_of) - F.make_dt_interval(F.lit(days)))
    dec = "decimal(38,0)"
    x = F.datediff("d", day0).cast(dec)
    y = F.col("size_bytes").cast(dec)
    sums = daily.groupBy(*SERIES).agg(
        F.count(F.lit(1)).cast(dec).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"))
    n, sx, sy, sxy, sxx = (F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx"))
    num = n * sxy - sx * sy
    den = n * sxx - sx * sx
    target = F.date_add(F.to_date(ts_lit(as_of)), horizon_days)
    xh = F.datediff(target, day0).cast(dec)
    # forecast = (sy*den - num*sx + num*xh*n) / (n*den); one division, exact operands.
    f_num = sy * den - num * sx + num * xh * n
    f_den = n * den
    ok = den != 0
    return sums.select(
        *SERIES, n.cast("long").alias("points"),
        F.when(ok, F.round(num.cast("double") / den.cast("double"), 2)).alias("slope_bytes_per_day"),
        target.alias("forecast_date"),
        F.when(ok, F.round(f_num.cast("double") / f_den.cast("double"), 2)).alias("forecast_size_bytes"),
    )


# Sizes have at most 19 digits, and time stamps from year 1 on at most 18 in microseconds.
_SIZE_RANGE = "10000000000000000000"
_YEAR_ONE = 62_135_596_800_000_000


def latest_sizes(snapshots: DataFrame, scope: str, as_of=None, max_age_days: int | None = None) -> DataFrame:
    """Latest snapshot per series (ties: larger size), for the capacity reports.

    With ``as_of`` and ``max_age_days`` only samples of ``[as_of - max_age_days, as_of)``
    count: a series without one is stale and left out, and a table partitioned by
    ``snapshot_date`` is pruned to those days. Time and size are packed into one decimal,
    a fixed-width value, so the maximum is a hash aggregate.
    """
    df = snapshots.filter(F.col("scope") == scope)
    if as_of is not None:
        df = df.filter(F.col("snapshot_ts") < ts_lit(as_of))
        if max_age_days is not None:
            start = ts_lit(as_of) - F.make_dt_interval(F.lit(int(max_age_days)))
            df = df.filter(F.col("snapshot_ts") >= start)
            if "snapshot_date" in snapshots.columns:
                df = df.filter((F.col("snapshot_date") >= F.to_date(start))
                               & (F.col("snapshot_date") <= F.to_date(ts_lit(as_of))))
    elif max_age_days is not None:
        raise ValueError("max_age_days needs as_of")
    packed = F.expr(f"CAST(CAST(unix_micros(snapshot_ts) + {_YEAR_ONE} AS DECIMAL(18,0)) * {_SIZE_RANGE} "
                    "+ CAST(size_bytes AS DECIMAL(19,0)) AS DECIMAL(38,0))")
    last = df.groupBy(*SERIES).agg(F.max(packed).alias("_l"))
    return last.select(*SERIES, F.expr(f"timestamp_micros((_l div {_SIZE_RANGE}) - {_YEAR_ONE})").alias("snapshot_ts"),
                       F.expr(f"CAST(_l % {_SIZE_RANGE} AS BIGINT)").alias("size_bytes"))


def recompute_daily_max(snapshots: DataFrame, late: DataFrame) -> DataFrame:
    """Daily maxima again for the (series, day) pairs that late samples touch.

    The streaming form closes a day once the watermark passes it; samples arriving later
    are folded in here in batch. A table partitioned by ``snapshot_date`` is pruned to
    the range of touched days, and a semi join keeps the exact (series, day) pairs.
    """
    touched = late.select("scope", *SERIES, F.to_date("snapshot_ts").alias("d")).distinct()
    cols = ["snapshot_ts", "scope", *SERIES, "size_bytes"]
    late_rows = late.select(*cols)
    if "snapshot_date" in snapshots.columns:
        cols.append("snapshot_date")
        late_rows = late_rows.withColumn("snapshot_date", F.to_date("snapshot_ts"))
        # Partition pruning to the touched date range (scalar subqueries, evaluated
        # before the scan); the semi join below then keeps the exact (series, day) pairs.
        first, last = touched.select(F.min("d")).scalar(), touched.select(F.max("d")).scalar()
        snapshots = snapshots.filter(F.col("snapshot_date").between(first, last))
    base = snapshots.select(*cols).unionByName(late_rows)
    day = F.col("snapshot_date") if "snapshot_date" in cols else F.to_date("snapshot_ts")
    keyed = base.withColumn("d", day)
    hits = keyed.join(touched, ["scope", *SERIES, "d"], "left_semi")
    return hits.groupBy("scope", *SERIES, "d").agg(F.max("size_bytes").alias("size_bytes"))


def series_gaps(snapshots: DataFrame, scope: str | None = None) -> DataFrame:
    """Stretches of sampled days of each series, and the days missing before each.

    The days of a series are made distinct by a partial aggregate first, so its window holds
    at most one row per calendar day, however many samples a hot series has. ``gap_days`` is
    null for the first stretch.
    """
    rows = snapshots if scope is None else snapshots.filter(F.col("scope") == scope)
    days = rows.filter(F.col("snapshot_ts").isNotNull()).select("scope", *SERIES, F.to_date("snapshot_ts").alias("d")).distinct()
    line = Window.partitionBy("scope", *SERIES).orderBy("d")
    before = F.datediff("d", F.lag("d").over(line)) - 1
    marked = days.withColumn("_gap", before).withColumn("_island", F.count(F.when(F.col("_gap") > 0, F.lit(1))).over(line))
    islands = marked.groupBy("scope", *SERIES, "_island").agg(
        F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("days"),
        F.max(F.when(F.col("_gap") > 0, F.col("_gap"))).alias("gap_days"))
    return islands.drop("_island")


def forecast_robust(snapshots: DataFrame, as_of, days: int = DAYS_DEFAULT, horizon_days: int = 30, scope: str = "table",
                    dbname: str | None = None) -> DataFrame:
    """T5 with a weekly season, by medians, which a few wrong sizes do not move.

    The slope is the median of the slopes between days that follow one another, the level the
    median of what is left, the season the median rest of each weekday. A series has at most
    one point per day of the window (365), so its points meet in one group. The forecast is
    for ``to_date(as_of) + horizon_days``; a weekday without points has no season of its own.
    """
    days = _within("days", days, DAYS_MIN, DAYS_MAX)
    daily = daily_max_size(snapshots, as_of, scope, days, dbname)
    day0 = F.to_date(ts_lit(as_of) - F.make_dt_interval(F.lit(days)))
    target = F.date_add(F.to_date(ts_lit(as_of)), horizon_days)
    line = Window.partitionBy(*SERIES).orderBy("d")
    points = daily.withColumns({"x": F.datediff("d", day0).cast("double"), "y": F.col("size_bytes").cast("double")})
    points = points.withColumn("_s", (F.col("y") - F.lag("y").over(line)) / (F.col("x") - F.lag("x").over(line)))
    whole = Window.partitionBy(*SERIES)
    points = points.withColumn("_slope", F.median("_s").over(whole))
    points = points.withColumn("_rest", F.col("y") - F.coalesce("_slope", F.lit(0.0)) * F.col("x"))
    points = points.withColumn("_level", F.median("_rest").over(whole))
    same_day = F.weekday("d") == F.weekday(target)
    fits = points.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("points"), F.max("_slope").alias("_slope"), F.max("_level").alias("_level"),
        F.median(F.when(same_day, F.col("_rest") - F.col("_level"))).alias("_season"))
    ahead = F.datediff(target, day0).cast("double")
    return fits.select(
        *SERIES, "points", F.round("_slope", 2).alias("slope_bytes_per_day"),
        F.round(F.coalesce("_season", F.lit(0.0)), 2).alias("season_bytes"), target.alias("forecast_date"),
        F.when(F.col("points") > 1, F.round(F.col("_level") + F.col("_slope") * ahead + F.coalesce("_season", F.lit(0.0)), 2))
        .alias("forecast_size_bytes"))
