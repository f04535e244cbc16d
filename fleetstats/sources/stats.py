"""Read a statistics view with its declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstats.schemas import KINDS


def conform(df: DataFrame, schema: T.StructType | str, keep_extra: bool = False) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, missing ones become typed NULLs."""
    if isinstance(schema, str):
        schema = KINDS[schema]
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c not in set(schema.fieldNames())]
    return df.select(*cols)


def load_stats(spark: SparkSession, path: str, kind: str, fmt: str = "parquet", **options) -> DataFrame:
    """Load one statistics snapshot table and enforce the declared schema of ``kind``.

    Parquet is read with its stored schema, so column pruning and filter pushdown still
    reach the scan, and the projection casts and fills missing columns with NULL. JSON is
    read with the declared schema (fields match by name, no inference pass). CSV is read
    by header as strings (a CSV schema would apply by position) and cast by name.
    Snapshot columns of a history table (``snapshot_ts``, ``snapshot_date``, e.g.
    partitions) are kept.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "json":
        schema = KINDS[kind]
        extra = [f for f in (("snapshot_ts", "timestamp"), ("snapshot_date", "date"))
                 if f[0] not in schema.fieldNames()]
        reader = reader.schema(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
                                         + [f"`{n}` {t}" for n, t in extra]))
    return conform_history(reader.load(path), kind)


# History tables carry the snapshot they were taken at; reports keep these columns and
# compute per (snapshot, database).
SNAPSHOT_COLS = ["snapshot_ts", "snapshot_date"]


def snapshot_cols(df: DataFrame) -> list[str]:
    return [c for c in SNAPSHOT_COLS if c in df.columns]


def conform_history(df: DataFrame, kind: str) -> DataFrame:
    """``conform`` to ``kind``, keeping the snapshot columns of a history table."""
    declared = KINDS[kind].fieldNames()
    out = conform(df, kind, keep_extra=True)
    return out.select(*declared, *[c for c in snapshot_cols(df) if c not in declared])

