"""Values carried along an order within a key, with a hot key's rows cut into buckets.

A plain window over a key puts all of its rows into one task. Here the window runs inside
(key, bucket), where a bucket is a stretch of the order; what a bucket hands to the next ones
is one row per (key, bucket), carried over by a second window that sees those rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, by: Sequence[str], bucket: str, order: Sequence[str], values: dict[str, Column],
            following: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with, for each name of ``values``, its last value that is not null before the row.

    "Before" follows ``order`` (nulls first) within ``by``. ``following`` adds the value of the
    next row instead (not null by itself), null at the last one. ``bucket`` must not fall along ``order``. Null keys
    are keys. Rows of one key that are equal in ``order`` are in no stated order, so give a tie
    breaker.
    """
    following = following or {}
    rows = rows.withColumns({f"_v_{n}": v for n, v in (values | following).items()})
    line = Window.partitionBy(*by, bucket).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    inside = line.rowsBetween(Window.unboundedPreceding, -1)
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumns({f"_in_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values}
                            | {f"_in_{n}": F.lead(f"_v_{n}").over(line) for n in following}
                            | {f"_start_{n}": F.first_value(f"_v_{n}").over(so_far) for n in following}
                            | {"_more": F.lead(F.lit(1)).over(line)})
    # What a bucket hands on: the value of its last row, or else what that row has seen; and
    # what it hands back, the value of its first row.
    ends = seen.filter("_more is null").select(
        *by, bucket, *[F.coalesce(f"_v_{n}", f"_in_{n}").alias(f"_end_{n}") for n in values], *[f"_start_{n}" for n in following])
    buckets = Window.partitionBy(*by).orderBy(F.col(bucket).asc_nulls_first())
    across = buckets.rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*by, bucket])],
                        *[F.last(f"_end_{n}", ignorenulls=True).over(across).alias(f"_edge_{n}") for n in values],
                        *[F.lead(f"_start_{n}").over(buckets).alias(f"_edge_{n}") for n in following])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*by, bucket])])
    joined = seen.drop("_more", *[f"_start_{n}" for n in following]).join(edges, same, "left")
    names = [*values, *following]
    return (joined.withColumns({n: F.coalesce(f"_in_{n}", f"_edge_{n}") for n in names})
            .drop(*[f"{p}{n}" for n in names for p in ("_v_", "_in_", "_edge_")], *[f"_k{i}" for i in range(len(by) + 1)]))


def with_row_bucket(rows: DataFrame, at: Column, buckets: int, name: str) -> DataFrame:
    """``rows`` with ``name``, a bucket of ``at`` cut so that each holds about as many rows.

    Unlike ranges of equal width, one far value moves no others into one bucket. Nulls get -1.
    """
    cuts = rows.agg(F.percentile_approx(at, [k / buckets for k in range(1, buckets)], 10_000).alias("cuts")).select("cuts").scalar()
    # The cuts are a column first: the plan holds their subquery once, not once for each cut.
    below = F.size(F.filter(F.col("_cuts"), lambda c: c < at))
    return rows.withColumn("_cuts", cuts).withColumn(name, F.when(at.isNull(), -1).otherwise(below)).drop("_cuts")
