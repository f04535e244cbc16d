"""The snapshot series as a Structured Streaming source.

S4 ingests capacity samples dropped into a folder into the partitioned snapshot table
(exactly-once through the checkpoint). T6 keeps the daily maximum per series with a
watermark; append mode emits a day once the watermark has passed its end, so late
samples within the watermark still count and a closed day is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetstats.schemas import CAPACITY
from fleetstats.sources.capacity import PARTITION_COLS, clustered

SERIES = ["scope", "dbname", "schemaname", "relname"]


def capacity_source(spark: SparkSession, in_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Sample files as a stream; ``max_files_per_trigger`` bounds each micro-batch of a backlog."""
    reader = spark.readStream.schema(CAPACITY)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.parquet(in_dir)


def capacity_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                    available_now: bool = True, processing_time: str | None = None,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append every new sample file under ``in_dir`` to the snapshot table at ``out_dir``."""
    rows = clustered(capacity_source(spark, in_dir, max_files_per_trigger)
                     .withColumn("snapshot_date", F.to_date("snapshot_ts")))
    w = (rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .partitionBy(*PARTITION_COLS).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start(out_dir)


def daily_max_stream(stream_df: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming daily maximum per series (closed days only, append mode)."""
    agg = (stream_df.withWatermark("snapshot_ts", watermark)
           .groupBy(F.window("snapshot_ts", "1 day"), *SERIES)
           .agg(F.max("size_bytes").alias("size_bytes")))
    return agg.select(*SERIES, F.to_date(F.col("window.start")).alias("d"), "size_bytes")


def run_daily_max(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                  watermark: str = "1 day", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Run T6 over ``in_dir`` until the available input is consumed, appending to ``out_dir``."""
    q = (daily_max_stream(capacity_source(spark, in_dir, max_files_per_trigger), watermark)
         .writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start(out_dir))
    return q
