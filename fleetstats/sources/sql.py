"""Run user SQL over registered frames with named arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Execute ``text``; frames are referenced as ``{name}``, arguments as ``:name``.

    Named arguments are bound by the parser (no text substitution), and rows come back
    for every statement that yields them (``WITH``, ``VALUES``, ``SHOW`` included).
    """
    return spark.sql(text, args=args or None, **frames)
