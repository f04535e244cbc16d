"""G3-G7 with history: every state that a registry row had, and when.

The change log becomes one row per version of a key, valid from the change that made it up to
the next one that landed. A version's columns are what the changes up to it have set last, so
each column is carried along the key's log; a hot key's log is cut into ranges that hold about
as many changes each (``plans.carry``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.operators.registry import column_settings, effective_changes, patch_keys
from fleetstats.plans.carry import carried
from fleetstats.schemas import CONNECTION_INSERT_DEFAULTS, CONNECTION_UPDATE_RESETS
from fleetstats.session import ensure_checkpoint_dir


def registry_history(table: DataFrame, changes: DataFrame, key: str = "id", order: str = "change_ts", op: str = "op",
                     defaults: dict | None = None, resets: dict | None = None, set_keys: str = "set_keys",
                     allowed: list[str] | None = None) -> DataFrame:
    """The columns of ``table``, ``valid_from``, ``valid_to`` and ``made_by`` of every version of every key.

    ``table`` is the state before the log; its rows are valid from null, that is ever since,
    and made by "initial". A version is valid up to, but not at, ``valid_to``, null for the
    current one. Changes that are rejected (see ``apply_change_log``) make no version; after
    a delete a key has none until it is inserted again.
    """
    defaults = CONNECTION_INSERT_DEFAULTS if defaults is None else defaults
    resets = CONNECTION_UPDATE_RESETS if resets is None else resets
    allowed = patch_keys(key) if allowed is None else allowed
    log, effective = effective_changes(changes, table, key, order, op)
    settings = column_settings(table, changes, key, op, defaults, resets, set_keys, allowed, None)
    made = log.filter(effective).select(
        key, "_o", "_b", F.col(order).alias("valid_from"), F.col(op).alias("made_by"),
        *[F.when(sets, F.struct(value.alias("v"))).alias(f"_s_{c}") for c, (sets, value) in settings.items()])
    # Read four times below: written to the shared folder once, so that the log's own windows run once.
    ensure_checkpoint_dir(table.sparkSession)
    made = made.checkpoint(eager=True)
    place, at = made.schema["_o"].dataType, made.schema["valid_from"].dataType
    first = table.select(
        key, F.lit(None).cast(place).alias("_o"), F.lit(-2).alias("_b"), F.lit(None).cast(at).alias("valid_from"),
        F.lit("initial").alias("made_by"), *[F.struct(F.col(c).alias("v")).alias(f"_s_{c}") for c in settings])
    # Rows that no change names go past the log's windows.
    named = made.select(key).distinct()
    idle = first.join(named, key, "left_anti").withColumn("valid_to", F.lit(None).cast(at))
    states = first.join(named, key, "left_semi").unionByName(made)
    states = carried(states, [key], "_b", ["_o"], {f"_c_{c}": F.col(f"_s_{c}") for c in settings},
                     {"_next": F.struct(F.col("valid_from").alias("at"))})
    states = states.withColumns({f"_s_{c}": F.coalesce(f"_s_{c}", f"_c_{c}") for c in settings})
    states = states.filter("made_by <> 'delete'").withColumn("valid_to", F.col("_next.at"))
    return (states.select(*idle.columns).unionByName(idle)
            .select(*[F.col(key if c == key else f"_s_{c}.v").cast(table.schema[c].dataType).alias(c) for c in table.columns],
                    "valid_from", "valid_to", "made_by"))


def registry_as_of(history: DataFrame, at) -> DataFrame:
    """The versions that were valid at ``at`` (a value or column of the log's order): one row per key there then."""
    at = F.lit(at)
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return history.filter(valid).drop("valid_from", "valid_to", "made_by")
