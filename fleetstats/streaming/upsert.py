"""S4 and T6 with open and late days: daily maxima that every micro-batch brings up to date.

The append form of T6 delivers a day once it is closed and drops what comes later. Here a
``foreachBatch`` sink writes each batch's samples under its batch id, then computes the days
that the batch touches again from all samples of those days and replaces exactly those
partitions. Both writes replace whole partitions of their own, so a batch that runs again
after a failure, or is replayed, leaves the same tables: nothing is added twice, and a
partition lost half way is rebuilt from the samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetstats.schemas import CAPACITY
from fleetstats.sources.capacity import clustered
from fleetstats.streaming.capacity import SERIES, capacity_source

SAMPLE_PARTITIONS = ["scope", "snapshot_date", "batch_id"]
DAY_PARTITIONS = ["scope", "d"]


def _replace(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Write ``rows``, replacing the partitions that they have and no others."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """All samples that batches have written, with ``snapshot_date`` and ``batch_id``."""
    df = spark.read.schema(f"{_ddl()}, snapshot_date date, batch_id long").parquet(path)
    return df.select(*[f.name for f in CAPACITY.fields], "snapshot_date", "batch_id")


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CAPACITY.fields)


def upsert_batch(batch: DataFrame, batch_id: int, samples_dir: str, daily_dir: str) -> None:
    """One micro-batch: its samples under its id, then the days that it touches.

    Samples without a time belong to no day and are left out.
    """
    spark = batch.sparkSession
    rows = (batch.filter(F.col("snapshot_ts").isNotNull()).select(*[f.name for f in CAPACITY.fields])
            .withColumn("snapshot_date", F.to_date("snapshot_ts")).withColumn("batch_id", F.lit(int(batch_id)).cast("long")))
    if rows.isEmpty():
        return
    _replace(clustered(rows), samples_dir, SAMPLE_PARTITIONS)
    samples = read_samples(spark, samples_dir)
    touched = samples.filter(F.col("batch_id") == int(batch_id)).select("scope", "snapshot_date").distinct()
    # The range of touched days prunes the folders that are read; the semi join keeps the exact ones.
    first, last = touched.select(F.min("snapshot_date")).scalar(), touched.select(F.max("snapshot_date")).scalar()
    again = (samples.filter(F.col("snapshot_date").between(first, last))
             .join(touched, ["scope", "snapshot_date"], "left_semi")
             .groupBy(*SERIES, F.col("snapshot_date").alias("d")).agg(F.max("size_bytes").alias("size_bytes")))
    _replace(again.repartition(*DAY_PARTITIONS, F.pmod(F.xxhash64(*SERIES), F.lit(8))), daily_dir, DAY_PARTITIONS)


def run_daily_upsert(spark: SparkSession, in_dir: str, samples_dir: str, daily_dir: str, checkpoint: str,
                     max_files_per_trigger: int | None = None, processing_time: str | None = None) -> StreamingQuery:
    """Keep ``daily_dir`` up to date with every sample file under ``in_dir``, open days included.

    Without ``processing_time`` the query ends when the available input is consumed.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, samples_dir, daily_dir)

    w = (capacity_source(spark, in_dir, max_files_per_trigger).writeStream.foreachBatch(each)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The daily maxima, one row per series and day."""
    return (spark.read.schema("dbname string, schemaname string, relname string, size_bytes long, scope string, d date")
            .parquet(path).select(*SERIES, "d", "size_bytes"))
