"""Column expressions shared by the operators. All are JVM built-ins (codegen-friendly)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Colish = Column | str


def col(c: Colish) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value) -> Column:
    """A TIMESTAMP literal read in the session time zone (UTC by convention)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(value)).cast("timestamp")


def safe_pct(part: Colish, total: Colish, zero_value=None, digits: int | None = 2) -> Column:
    """``round(part * 100 / total, digits)``; ``zero_value`` when total is 0 (ANSI-safe)."""
    part, total = col(part), col(total)
    raw = part.cast("double") * F.lit(100.0) / total
    val = F.round(raw, digits) if digits is not None else raw
    zero = F.lit(zero_value).cast("double")
    return F.when(total == 0, zero).otherwise(val)


def age_seconds(as_of, ts: Colish) -> Column:
    """``EXTRACT(EPOCH FROM as_of - ts)`` as double seconds; NULL when ts is NULL."""
    return (F.unix_micros(ts_lit(as_of)) - F.unix_micros(col(ts))) / F.lit(1e6)


# Unit ladder of PostgreSQL's pg_size_pretty (name, limit, half-rounded, unit bits).
SIZE_UNITS = [("bytes", 10 * 1024, False, 0), ("kB", 20 * 1024 - 1, True, 10),
              ("MB", 20 * 1024 - 1, True, 20), ("GB", 20 * 1024 - 1, True, 30),
              ("TB", 20 * 1024 - 1, True, 40), ("PB", 20 * 1024 - 1, True, 50)]


def size_pretty(size: Colish) -> Column:
    """Human-readable byte count with PostgreSQL's thresholds and half-up rounding.

    Works on ``abs(size)`` so each unit is one shift of the input (truncating division
    of a non-negative value composes), then puts the sign back.
    """
    x = col(size).cast("long")
    a, neg = F.abs(x), x < 0
    out, shift = None, 0
    levels = []
    for i, (name, limit, rnd, bits) in enumerate(SIZE_UNITS):
        v = F.shiftright(a, shift) if shift else a
        shown = F.shiftright(v + 1, 1) if rnd else v
        text = F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), shown.cast("string"), F.lit(f" {name}"))
        levels.append((v < limit, text))
        if i + 1 < len(SIZE_UNITS):
            nxt = SIZE_UNITS[i + 1]
            shift += nxt[3] - bits - int(nxt[2]) + int(rnd)
    out = levels[-1][1]
    for cond, text in reversed(levels[:-1]):
        out = F.when(cond, text).otherwise(out)
    return F.when(x.isNotNull(), out)


# PostgreSQL keywords outside the "unreserved" category (reserved,
# type/function-name and column-name keywords); quote_ident quotes these.
PG_QUOTED_KEYWORDS = (
    "all analyse analyze and any array as asc asymmetric both case cast check collate column "
    "constraint create current_catalog current_date current_role current_time current_timestamp "
    "current_user default deferrable desc distinct do else end except false fetch for foreign from "
    "grant group having in initially intersect into lateral leading limit localtime localtimestamp "
    "not null offset on only or order placing primary references returning select session_user some "
    "symmetric system_user table then to trailing true union unique user using variadic when where "
    "window with "
    "authorization binary collation concurrently cross current_schema freeze full ilike inner is "
    "isnull join left like natural notnull outer overlaps right similar tablesample verbose "
    "between bigint bit boolean char character coalesce dec decimal exists extract float greatest "
    "grouping inout int integer interval least national nchar none normalize nullif numeric out "
    "overlay position precision real row setof smallint substring time timestamp treat trim values "
    "varchar "
    "json json_array json_arrayagg json_exists json_object json_objectagg json_query json_scalar json_serialize "
    "json_table json_value merge_action xmlattributes xmlconcat xmlelement xmlexists xmlforest xmlnamespaces "
    "xmlparse xmlpi xmlroot xmlserialize xmltable"
).split()

# A dollar sign may stand in a bare identifier, but the formatter quotes names that hold one.
SIMPLE_IDENT = r"^[a-z_][a-z0-9_]*$"


def quote_ident(name: Colish) -> Column:
    """``format('%I', name)``: bare when simple and not a keyword, else double-quoted."""
    c = col(name)
    simple = c.rlike(SIMPLE_IDENT) & ~c.isin(*PG_QUOTED_KEYWORDS)
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(simple, c).otherwise(quoted)


def qualified_name(schema: Colish, table: Colish) -> Column:
    """``format('%I.%I', schema, table)``."""
    return F.concat_ws(".", quote_ident(schema), quote_ident(table))


def lsn_text(lsn_bytes: Colish) -> Column:
    """Byte position → ``HI/LO`` upper-case hex text, the pg_lsn output format."""
    b = col(lsn_bytes).cast("long")
    text = F.format_string("%X/%X", F.shiftrightunsigned(b, 32), b.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(b.isNotNull(), text)


def lsn_bytes(lsn: Colish) -> Column:
    """``HI/LO`` hex text → byte position."""
    parts = F.split(col(lsn), "/")
    hi = F.conv(parts.getItem(0), 16, 10).cast("long")
    lo = F.conv(parts.getItem(1), 16, 10).cast("long")
    return F.shiftleft(hi, 32) + lo
