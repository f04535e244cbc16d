"""Column-expression helpers (no UDFs)."""

from fleetstats.functions.exprs import (
    age_seconds, lsn_bytes, lsn_text, qualified_name, quote_ident, safe_pct, size_pretty, ts_lit,
)

__all__ = ["age_seconds", "lsn_bytes", "lsn_text", "qualified_name", "quote_ident", "safe_pct",
           "size_pretty", "ts_lit"]
