"""Loading the driver tables, and the catalog snapshot built from their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetstats.schemas import CATALOG

# The tables of the shared test data set.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a lazy DataFrame over the files there are now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    return {n: load_table(spark, sf_dir, n) for n in (names or TABLES)}


def catalog_snapshot(spark: SparkSession, frames: dict[str, DataFrame], schema: str = "main",
                     table_type: str = "BASE TABLE") -> DataFrame:
    """One row per column of each frame (an ``information_schema.columns`` snapshot).

    Built from schemas only: the driver touches metadata, never rows.
    """
    rows = [(schema, name, field.name, pos, table_type)
            for name, df in frames.items()
            for pos, field in enumerate(df.schema.fields, start=1)]
    return spark.createDataFrame(rows, CATALOG)
