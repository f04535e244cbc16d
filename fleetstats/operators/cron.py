"""Five-field cron expressions expanded with native array functions (no parser UDF).

Field forms: ``*``, ``*/n``, ``a``, ``a-b``, ``a-b/n``, ``a/n`` (a to the field maximum),
comma lists of those, month names ``jan``..``dec`` and weekday names ``mon``..``sun``.
Weekday numbering follows the scheduler the reference uses: 0 = Monday … 6 = Sunday,
and the day-of-month and weekday fields must both match. Invalid items expand to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field order and bounds of a five-field cron expression.
FIELDS = [("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("day_of_week", 0, 6)]
# Names accepted for months and weekdays.
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAY_NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


# One list item: ``*`` or ``a``, optional ``-b``, optional ``/step``.
ITEM = r"^(\*|\d+)(?:-(\d+))?(?:/(\d+))?$"


def _names_to_numbers(field: Column, names: list[str], first: int) -> Column:
    out = field
    for i, name in enumerate(names):
        out = F.regexp_replace(out, name, str(first + i))
    return out


def _ranges_sql(items: str, lo: int, hi: int) -> str:
    p = ITEM.replace("\\", "\\\\")
    parsed = (f"transform({items}, x -> named_struct('b', regexp_extract(x, '{p}', 1), "
              f"'e', regexp_extract(x, '{p}', 2), 's', regexp_extract(x, '{p}', 3)))")
    return (f"transform({parsed}, p -> named_struct("
            f"'a', CASE WHEN p.b = '*' THEN {lo} ELSE try_cast(p.b AS INT) END, "
            f"'z', CASE WHEN p.b = '*' THEN {hi} WHEN p.e != '' THEN try_cast(p.e AS INT) "
            f"WHEN p.s != '' THEN {hi} ELSE try_cast(p.b AS INT) END, "
            f"'st', CASE WHEN p.s != '' THEN try_cast(p.s AS INT) ELSE 1 END))")


def _values_sql(ranges: str, lo: int, hi: int) -> str:
    seqs = (f"transform({ranges}, r -> CASE WHEN r.a IS NOT NULL AND r.z IS NOT NULL AND r.st > 0 "
            f"AND r.z >= r.a THEN sequence(r.a, r.z, r.st) ELSE CAST(array() AS array<int>) END)")
    return f"array_sort(filter(array_distinct(flatten({seqs})), v -> v >= {lo} AND v <= {hi}))"


def expand_field(field: str, lo: int, hi: int) -> Column:
    """``array<int>`` of the sorted distinct values the cron field in column ``field``
    selects within [lo, hi] (numeric forms; names are mapped by ``with_cron_fields``)."""
    return F.expr(_values_sql(_ranges_sql(f"split(lower(`{field}`), ',')", lo, hi), lo, hi))


def with_cron_fields(df: DataFrame, expr: str = "cron_expression") -> DataFrame:
    """Add the five expanded fields (minute, hour, day, month, day_of_week) of ``expr``.

    Each stage (split, parse, expand) is one compact SQL expression per field.
    """
    parts = df.withColumn("_cron", F.split(F.trim(F.col(expr)), r"\s+"))
    items = []
    for i, (name, lo, hi) in enumerate(FIELDS):
        f = F.lower(F.col("_cron").getItem(i))
        if name == "month":
            f = _names_to_numbers(f, MONTH_NAMES, 1)
        elif name == "day_of_week":
            f = _names_to_numbers(f, WEEKDAY_NAMES, 0)
        items.append(F.when(F.size("_cron") == 5, F.split(f, ",")).alias(f"_i_{name}"))
    staged = parts.select(*df.columns, *items)
    return staged.select(*df.columns, *[F.expr(_values_sql(_ranges_sql(f"_i_{n}", lo, hi), lo, hi)).alias(n)
                                        for n, lo, hi in FIELDS])
