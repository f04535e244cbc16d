"""Catalog listings, table resolution, row counts, table statistics, database sizes.

The catalog is a DataFrame shaped like ``information_schema.columns`` (one row per
column, ``table_type`` carried on each row), optionally with ``datname`` for a fleet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.functions.exprs import size_pretty
from fleetstats.sources.stats import conform_history

# System schemas left out when no schema is named.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]


def _table_cols(catalog_df: DataFrame) -> list[str]:
    lead = ["datname"] if "datname" in catalog_df.columns else []
    return lead + ["table_schema", "table_name"]


def list_tables(catalog_df: DataFrame) -> DataFrame:
    """Every table, system schemas included, ordered by (schema, name)."""
    cols = _table_cols(catalog_df)
    return catalog_df.select(*cols).distinct().orderBy(*cols)


def list_tables_in_schema(catalog_df: DataFrame, schema: str) -> DataFrame:
    """Tables of one schema, ordered by name."""
    cols = _table_cols(catalog_df)
    return catalog_df.filter(F.col("table_schema") == schema).select(*cols).distinct().orderBy(*cols)


def list_columns(catalog_df: DataFrame, schema: str, table: str) -> DataFrame:
    """Columns of one table, ordered by ordinal position."""
    lead = ["datname"] if "datname" in catalog_df.columns else []
    return (catalog_df.filter((F.col("table_schema") == schema) & (F.col("table_name") == table))
            .select(*lead, "table_schema", "table_name", "column_name", "ordinal_position")
            .orderBy(*lead, "ordinal_position"))


def resolve_tables(catalog_df: DataFrame, schema: str | None = None, table: str | None = None) -> DataFrame:
    """C4: the tables a per-table check runs over.

    (schema, table) → that pair, not checked for existence (one row per database of the
    catalog in fleet form); schema only → its BASE TABLEs; otherwise BASE TABLEs outside
    the system schemas (a table name without a schema is ignored).
    """
    fleet = "datname" in catalog_df.columns
    if schema and table:
        if fleet:
            return catalog_df.select("datname").distinct().select(
                "datname", F.lit(schema).alias("table_schema"), F.lit(table).alias("table_name"))
        spark = catalog_df.sparkSession
        return spark.createDataFrame([(schema, table)], "table_schema string, table_name string")
    base = catalog_df.filter(F.col("table_type") == "BASE TABLE")
    if schema:
        base = base.filter(F.col("table_schema") == schema)
    else:
        base = base.filter(~F.col("table_schema").isin(*SYSTEM_SCHEMAS))
    return base.select(*_table_cols(catalog_df)).distinct()


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """``count(*)`` of each named table (0 when empty), as one union plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def collect_statistics(table_stats: DataFrame, schema: str | None = None, table: str | None = None,
                       datname: str | None = None) -> DataFrame:
    """live/dead tuples and maintenance times; filter by schema+table, schema, or none."""
    s = conform_history(table_stats, "stat_user_tables")
    if datname is not None:
        s = s.filter(F.col("datname") == datname)
    if schema and table:
        s = s.filter((F.col("schemaname") == schema) & (F.col("relname") == table))
    elif schema:
        s = s.filter(F.col("schemaname") == schema)
    return s


def database_sizes(db_sizes: DataFrame) -> DataFrame:
    """Database name, readable size and bytes, largest first."""
    name = "dbname" if "dbname" in db_sizes.columns else "datname"
    return (db_sizes.select(F.col(name).alias("database_name"), size_pretty("size_bytes").alias("size_pretty"),
                            F.col("size_bytes").cast("long").alias("size_bytes"))
            .orderBy(F.col("size_bytes").desc(), "database_name"))
