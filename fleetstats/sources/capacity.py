"""Append capacity samples to the snapshot table.

The table is Parquet partitioned by ``scope`` and ``snapshot_date`` so trend reports
prune to the days they read. One distributed append replaces the per-row INSERT loop;
task retries are covered by Spark's commit protocol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.functions.exprs import ts_lit
from fleetstats.schemas import CAPACITY

PARTITION_COLS = ["scope", "snapshot_date"]


def capacity_rows(sizes: DataFrame, as_of, scope: str) -> DataFrame:
    """Shape sampled sizes as snapshot rows stamped ``as_of``."""
    name = "dbname" if "dbname" in sizes.columns else "datname"
    have = set(sizes.columns)
    cols = {
        "snapshot_ts": ts_lit(as_of),
        "scope": F.lit(scope),
        "dbname": F.col(name),
        "schemaname": F.col("schemaname") if scope == "table" and "schemaname" in have else F.lit(None),
        "relname": F.col("relname") if scope == "table" and "relname" in have else F.lit(None),
        "size_bytes": F.col("size_bytes"),
    }
    out = sizes.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in CAPACITY.fields])
    return out.withColumn("snapshot_date", F.to_date("snapshot_ts"))


# Files of one partition folder and write, at most: a day's series are cut into so many.
DAY_BUCKETS = 8


def clustered(rows: DataFrame) -> DataFrame:
    """Rows of a partition folder together, so a write makes few files; a hot day is still split."""
    series = F.pmod(F.xxhash64("dbname", "schemaname", "relname"), F.lit(DAY_BUCKETS))
    return rows.repartition(*PARTITION_COLS, series)


def _append(rows: DataFrame, path: str) -> DataFrame:
    clustered(rows).write.mode("append").partitionBy(*PARTITION_COLS).parquet(path)
    return rows


def append_snapshots(rows: DataFrame, path: str) -> DataFrame:
    """Append snapshot rows of any scope and time, such as a history to be loaded."""
    return _append(rows.select(*[F.col(f.name).cast(f.dataType) for f in CAPACITY.fields])
                   .withColumn("snapshot_date", F.to_date("snapshot_ts")), path)


def append_db_capacity(sizes: DataFrame, as_of, path: str) -> DataFrame:
    """One ``('db', dbname, size)`` row per sampled database, stamped ``as_of``."""
    return _append(capacity_rows(sizes, as_of, "db"), path)


def append_table_capacity(sizes: DataFrame, as_of, path: str) -> DataFrame:
    """One ``('table', dbname, schema, table, size)`` row per sampled table."""
    return _append(capacity_rows(sizes, as_of, "table"), path)


def read_capacity(spark, path: str) -> DataFrame:
    """The snapshot table with ``snapshot_date`` (its partition column, which enables
    pruning; derived from ``snapshot_ts`` for an unpartitioned folder)."""
    df = spark.read.parquet(path)
    day = F.col("snapshot_date") if "snapshot_date" in df.columns else F.to_date("snapshot_ts")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in CAPACITY.fields],
                     day.cast("date").alias("snapshot_date"))
