"""Recurring plan shapes, each written so a hot key cannot pile up in one task.

* ``top_k`` — global form plans as ``TakeOrderedAndProject`` (per-partition top-k, then a
  k-row merge); per-group form is ``row_number() <= k`` within (group, salt) and then within
  the group, each with Spark's partial group limit before its exchange where k allows it.
* ``last_per_key`` — ``max(struct(order, payload))`` per key: an aggregate with map-side
  partial aggregation (sort-based, as struct buffers are not fixed-width), so a key holding
  a third of all rows still shuffles one row per task.
* ``dense_sequence`` — 1..n numbering without a single-partition window: range-partition,
  count per partition, prefix-sum over the (partition-count sized) count table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstats.session import ensure_checkpoint_dir


# Salts of a per-group top-k's first stage.
TOP_K_SALTS = 16


def top_k(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str] | None = None,
          salts: int = TOP_K_SALTS) -> DataFrame:
    """First ``k`` rows by ``order``, globally or within each ``by`` group.

    Globally, Spark keeps k rows per task and merges them. Per group the top-k runs in two
    stages, within (group, salt) and then within the group over at most ``salts * k``
    rows, so a hot group never lands whole in one window task. The salt goes round robin
    over the rows of a task, so equal rows are spread as well.
    """
    if k is None or k <= 0:
        raise ValueError("limit must be a positive integer")
    if not by:
        return df.orderBy(*order).limit(k)

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*by, *keys).orderBy(*order)
        return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn", *keys)

    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    return first(first(df.withColumn("_salt", salt), "_salt"))


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per ``key``; remaining columns break ties.

    Columns must be orderable (no maps). Output keeps the input column order.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key and c not in order]
    packed = F.struct(*[F.col(c) for c in list(order) + rest])
    agg = df.groupBy(*key).agg(F.max(packed).alias("_last"))
    return agg.select(*key, *[F.col(f"_last.{c}").alias(c) for c in list(order) + rest]).select(*df.columns)


def dense_sequence(df: DataFrame, order: Sequence[str], name: str, start: Column | int = 1,
                   partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start, start+1, ... following ``order`` (then all other columns).

    Range partitions hold consecutive slices of the total order, so a row's number is its
    partition's offset plus its rank inside it. The partitioned rows are written to the
    shared checkpoint folder once; offsets and ranks both come from there, so neither a
    plan without exchange reuse nor a recomputation can number rows differently. Only the
    per-partition count table (one row per partition) is windowed globally.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    full_order = list(order) + [c for c in df.columns if c not in order]
    ranged = (df.repartitionByRange(n, *full_order).sortWithinPartitions(*full_order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())).checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_mid0"))
    offsets = counts.withColumn(
        "_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    start_col = start if isinstance(start, Column) else F.lit(start)
    numbered = ranged.join(F.broadcast(offsets.select("_pid", "_mid0", "_off")), "_pid")
    return numbered.select(
        *df.columns,
        (start_col + F.coalesce(F.col("_off"), F.lit(0)) + (F.col("_mid") - F.col("_mid0"))).alias(name))
