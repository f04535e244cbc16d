"""Statistics joined to measurements taken at other times.

An as-of join without pair rows: both sides become one stream, ordered by time within the
key, and each left row takes the last right row before it. The stream of a hot key is cut
into stretches of time, and a stretch hands its last measurement on (``plans.carry``), so a
key's rows never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.plans.carry import carried

#: Days of a stretch that a key's rows are cut into.
STRETCH_DAYS = 30
MAX_AGE_DAYS = 30
TABLE = ["datname", "schemaname", "relname"]


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str],
              tie: Sequence[str] = (), stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """Every ``left`` row with ``right_at`` and ``values`` of the last right row up to its time.

    Right rows at the same time as the left row count; of those at one time the one with the
    greatest ``tie`` (then ``values``) is taken. Without such a row, or where ``left_at`` is
    null, the added columns are null. Null keys match null keys.
    """
    stretch = F.floor(F.unix_seconds("_at") / F.lit(86_400 * stretch_days))
    ties = [*tie, *values]
    lefts = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"),
                        F.lit(None).cast(right.select(F.struct(*ties).alias("t")).schema["t"].dataType).alias("_t"),
                        F.lit(None).cast(right.select(F.struct(right_at, *values).alias("r")).schema["r"].dataType).alias("_r"))
    rights = right.filter(F.col(right_at).isNotNull()).select(
        *by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_l"].dataType).alias("_l"),
        F.struct(*ties).alias("_t"), F.struct(right_at, *values).alias("_r"))
    stream = lefts.unionByName(rights).withColumn("_b", F.coalesce(stretch, F.lit(-(1 << 62))))
    seen = carried(stream, by, "_b", ["_at", "_side", "_t"], {"_last": F.col("_r")}).filter("_side = 1")
    return seen.select("_l.*", *[F.col(f"_last.{c}").alias(c) for c in (right_at, *values)])


def bloat_asof(table_stats: DataFrame, measures: DataFrame, max_age_days: int = MAX_AGE_DAYS, tie: Sequence[str] = ()) -> DataFrame:
    """Each sample of table statistics with the newest measurement of that table up to then.

    ``table_stats`` has the table, ``snapshot_ts`` and tuple counts; ``measures`` the table,
    ``measured_ts`` and ``dead_tuple_percent``. ``source`` says where ``dead_percent`` comes
    from: a measurement of at most ``max_age_days`` ("measured"), else the counts ("estimated"),
    which an older measurement ("stale") is passed over for too.
    """
    joined = asof_join(table_stats, measures, TABLE, "snapshot_ts", "measured_ts", ["dead_tuple_percent"], tie)
    age = F.unix_micros("snapshot_ts") - F.unix_micros("measured_ts")
    fresh = (age <= F.lit(max_age_days * 86_400_000_000)) & F.col("dead_tuple_percent").isNotNull()
    estimate = F.round(F.col("n_dead_tup") * F.lit(100.0) / F.nullif(F.col("n_live_tup") + F.col("n_dead_tup"), F.lit(0)), 2)
    return joined.select(
        *table_stats.columns, "measured_ts",
        F.round(age / F.lit(86_400_000_000.0), 4).alias("age_days"),
        F.when(fresh, "measured").when(age.isNotNull() & F.col("dead_tuple_percent").isNotNull(), "stale")
        .otherwise("estimated").alias("source"),
        F.when(fresh, F.col("dead_tuple_percent")).otherwise(estimate).alias("dead_percent"))
