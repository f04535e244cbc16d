"""V1-V4: the registry DDL's constraints, checked as distributed jobs (one row per violation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V1: key values held by more than one row; a NULL in the key never conflicts."""
    keys = list(keys)
    nonnull = df
    for k in keys:
        nonnull = nonnull.filter(F.col(k).isNotNull())
    return nonnull.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def violations_not_null(df: DataFrame, cols: Sequence[str], key: str | Sequence[str] = "id") -> DataFrame:
    """V2: one row per (row key, NULL column) among the NOT NULL ``cols``."""
    keys = [key] if isinstance(key, str) else list(key)
    names = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    hits = F.filter(names, lambda x: x.isNotNull())
    return df.select(*keys, F.explode(hits).alias("column_name"))


def violations_fk(df: DataFrame, ref: DataFrame, col: str, ref_col: str = "id") -> DataFrame:
    """V3: rows whose non-NULL ``col`` has no match in ``ref.ref_col``."""
    keys = ref.select(F.col(ref_col).alias(col)).distinct()
    return df.filter(F.col(col).isNotNull()).join(keys, col, "left_anti").select(*df.columns)


def violations_domain(df: DataFrame, col: str, allowed: Sequence) -> DataFrame:
    """V4: rows whose ``col`` is outside ``allowed`` (NULL passes the CHECK; V2 catches it)."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*allowed))
