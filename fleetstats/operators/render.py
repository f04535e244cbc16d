"""Reports rendered as JSON text, one line per row (JSON Lines).

Rows are rendered where they live (``to_json`` per row), so a large report is never
gathered into one string; non-JSON types use their text form, as ``str()`` would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd HH:mm:ss", "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}


def report_json(report: DataFrame | dict, title: str | None = None) -> DataFrame:
    """``(title, section, row_json)`` for a report or a dict of named report sections."""
    sections = report if isinstance(report, dict) else {None: report}
    parts = [df.select(F.lit(title).cast("string").alias("title"), F.lit(name).cast("string").alias("section"),
                       F.to_json(F.struct(*[F.col(c) for c in df.columns]), JSON_OPTIONS).alias("row_json"))
             for name, df in sections.items()]
    return reduce(DataFrame.unionByName, parts)
