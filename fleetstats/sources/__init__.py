"""Sources and sinks: statistics loaders, capacity appends, SQL runner, driver tables."""

from fleetstats.sources.capacity import (
    append_db_capacity, append_table_capacity, capacity_rows, read_capacity,
)
from fleetstats.sources.sql import run_sql
from fleetstats.sources.stats import conform, load_stats
from fleetstats.sources.tables import catalog_snapshot, load_table, load_tables

__all__ = ["append_db_capacity", "append_table_capacity", "capacity_rows", "catalog_snapshot",
           "conform", "load_stats", "load_table", "load_tables", "read_capacity", "run_sql"]
