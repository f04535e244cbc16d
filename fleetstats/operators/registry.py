"""connection/job registry listing and change-log application.

A mutation is a batch job "apply this change log to this table": the log is folded per key
in change order (partial aggregates, safe for a key holding a third of the log), the table
and the folded log meet in one equi-join on the key, and the result is a new DataFrame (write it to a new version folder; never
overwrite the path being read). Every function returns ``(new_table, ignored_changes)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstats.functions.exprs import ts_lit
from fleetstats.plans.carry import carried, with_row_bucket
from fleetstats.plans.shapes import dense_sequence, last_per_key
from fleetstats.schemas import (CONNECTION_INSERT_DEFAULTS, CONNECTION_PATCH_KEYS, CONNECTION_UPDATE_RESETS,
                                JOB_PATCH_KEYS)
from fleetstats.sources.stats import conform

LIST_COLS = ["id", "database_type_id", "database_type_name", "host", "port", "database_name",
             "username", "is_active", "description", "connect_at_startup"]


def _with_type_names(connections: DataFrame, types: DataFrame) -> DataFrame:
    c = conform(connections, "connections")
    t = conform(types, "database_types").select(F.col("id").alias("_tid"), F.col("name").alias("database_type_name"))
    return c.join(t, c.database_type_id == t._tid, "left")


def connections_list(connections: DataFrame, types: DataFrame, connect_at_startup: bool | None = None) -> DataFrame:
    """G1: connections with their type name; the stored secret is never selected."""
    j = _with_type_names(connections, types)
    if connect_at_startup is not None:
        j = j.filter(F.col("connect_at_startup") == F.lit(bool(connect_at_startup)))
    return j.select(*LIST_COLS).orderBy(*[F.col(c).asc_nulls_last()
                                          for c in ("database_type_name", "host", "port", "database_name")])


def connection_lookup(connections: DataFrame, types: DataFrame, conn_id: int, with_secret: bool = False) -> DataFrame:
    """One connection by id (empty when absent), optionally with its stored secret."""
    c = connections.filter(F.col("id") == conn_id)
    cols = list(LIST_COLS)
    if with_secret:
        cols.insert(cols.index("username") + 1, "encrypted_password")
    return _with_type_names(c, types).select(*cols)


def types_list(types: DataFrame) -> DataFrame:
    """The database-type registry ordered by id."""
    return conform(types, "database_types").orderBy("id")


def type_lookup(types: DataFrame, type_id: int) -> DataFrame:
    """One database type by id (empty when absent)."""
    return conform(types, "database_types").filter(F.col("id") == type_id)


# ---- change-log application ----------------------------------------------------------
def _value(table: DataFrame, c: str, src: Column) -> Column:
    return src.cast(table.schema[c].dataType).alias(c)


def _latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    return last_per_key(changes.filter(F.col(key).isNotNull()), [key], [order])


def _existing(table: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Table keys named by the log. The log's keys are the side the planner can
    broadcast, so the table streams through a semi join instead of being shuffled."""
    return table.select(key).join(latest.select(key), key, "left_semi")


def _ignored(latest: DataFrame, table: DataFrame, key: str, how: str, reason: str) -> DataFrame:
    return latest.join(_existing(table, latest, key), key, how).withColumn("reason", F.lit(reason))


def registry_insert(table: DataFrame, changes: DataFrame, key: str = "id", order: str = "change_ts",
                    defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert-if-absent. Of several inserts of a key the first one counts; the later
    ones, and those of keys that exist, are ignored. Rows without a key get
    ``max(key) + 1, + 2, ...`` in change order. Columns the log does not carry take the
    table default."""
    keyed = changes.filter(F.col(key).isNotNull()).withColumn("_insert", F.lit("insert"))
    new, ignored = apply_change_log(table, keyed, key, order, "_insert", defaults=defaults)
    unkeyed = changes.filter(F.col(key).isNull()).drop(key)
    # max(key) enters as a scalar subquery (one value), not as a join.
    top = new.agg(F.coalesce(F.max(key), F.lit(0)))
    numbered = dense_sequence(unkeyed, [order], key, start=top.scalar() + 1)
    defaults = CONNECTION_INSERT_DEFAULTS if defaults is None else defaults
    shaped = numbered.select(*[_value(table, c, F.col(c) if c in numbered.columns else F.lit(defaults.get(c)))
                               for c in table.columns])
    return new.unionByName(shaped), ignored.select(key, order, "reason")


def _apply(table: DataFrame, latest: DataFrame, key: str, carried: list[str], resets: dict) -> DataFrame:
    upd = latest.select(key, *[F.col(c).alias(f"_n_{c}") for c in carried], F.lit(True).alias("_hit"))
    j = table.join(upd, key, "left")
    hit = F.col("_hit").isNotNull()
    cols = []
    for c in table.columns:
        if c in carried:
            cols.append(_value(table, c, F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c))))
        elif c in resets:
            cols.append(_value(table, c, F.when(hit, F.lit(resets[c])).otherwise(F.col(c))))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def registry_update(table: DataFrame, changes: DataFrame, key: str = "id", order: str = "change_ts",
                    resets: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Full-row replace of existing keys. Columns the log carries are written; absent
    ones keep their value except ``resets`` (a full update writes those defaults)."""
    resets = CONNECTION_UPDATE_RESETS if resets is None else resets
    latest = _latest(changes, key, order)
    carried = [c for c in table.columns if c != key and c in changes.columns]
    new = _apply(table, latest, key, carried, {c: v for c, v in resets.items() if c not in carried})
    return new, _ignored(latest, table, key, "left_anti", "not found")


def registry_delete(table: DataFrame, changes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Remove the keys named by the log (missing keys are silently skipped)."""
    keys = changes.select(key).filter(F.col(key).isNotNull()).distinct()
    return table.join(keys, key, "left_anti"), _ignored(keys, table, key, "left_anti", "not found")


def registry_flag(table: DataFrame, changes: DataFrame | None = None, key: str = "id",
                  order: str = "change_ts", value: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Set ``is_active`` only — for every row (``changes=None``, ``value``) or per key."""
    if changes is None:
        new = table.withColumn("is_active", F.lit(bool(value))).select(*table.columns)
        return new, table.limit(0).select(key).withColumn("reason", F.lit("not found"))
    latest = _latest(changes, key, order)
    if value is not None:
        latest = latest.withColumn("is_active", F.lit(bool(value)))
    new = _apply(table, latest, key, ["is_active"], {})
    return new, _ignored(latest, table, key, "left_anti", "not found")


def patch_keys(key: str) -> list[str]:
    """The columns a patch may set, by the table's key: jobs or connections."""
    return JOB_PATCH_KEYS if key == "job_id" else CONNECTION_PATCH_KEYS


def registry_patch(table: DataFrame, changes: DataFrame, key: str = "id", order: str = "change_ts",
                   allowed: list[str] | None = None, as_of=None,
                   set_keys: str = "set_keys") -> tuple[DataFrame, DataFrame]:
    """Apply only the keys a change sets (``set_keys`` array), in change order.

    Per column the latest change that sets it wins, so successive patches of different
    keys all land; a key set to NULL writes NULL; keys outside ``allowed`` (by default
    those of the table's kind, never the stored secret) are ignored; a patch with no
    allowed key leaves the row (and ``updated_at``) untouched.
    """
    marked = changes.filter(F.col(key).isNotNull()).withColumn("_patch", F.lit("patch"))
    new, ignored = apply_change_log(table, marked, key, order, "_patch", set_keys=set_keys, allowed=allowed, as_of=as_of)
    return new, ignored.select(key, order, "reason")


# Order buckets that a key's changes are cut into, so that a hot key is split over tasks.
ORDER_BUCKETS = 64


def _exists_before(changes: DataFrame, table: DataFrame, key: str, order: str, op: str) -> DataFrame:
    """Each change with ``_o``, its place in the key's order, its bucket ``_b``, and ``_exists``,
    whether its key is there then.

    An insert leaves its key present and a delete absent, whatever was before, so a change
    sees what the last insert or delete before it left, or else the table. A key's changes
    are cut into ranges of ``order`` that hold about as many changes each; the last insert or
    delete of each range is carried to the next ones over at most ORDER_BUCKETS rows per key.
    Equal orders follow a hash of the whole change.
    """
    place = F.struct(F.col(order).alias("at"), F.xxhash64(*changes.columns).alias("tie"))
    at = F.col(order).cast("timestamp").cast("double") if dict(changes.dtypes)[order].startswith("timestamp") \
        else F.col(order).cast("double")
    log = with_row_bucket(changes.withColumn("_o", place), at, ORDER_BUCKETS, "_b")
    # 1 after an insert, 0 after a delete, NULL for changes that leave presence as it is.
    left_as = F.when(F.col(op) == "insert", 1).when(F.col(op) == "delete", 0)
    log = carried(log, [key], "_b", ["_o"], {"_left": left_as})
    there = _existing(table, log.select(key).distinct(), key).distinct().withColumn("_there", F.lit(1))
    return (log.join(there, key, "left").withColumn("_exists", F.coalesce("_left", "_there", F.lit(0)) == 1)
            .drop("_left", "_there"))


def effective_changes(changes: DataFrame, table: DataFrame, key: str, order: str, op: str) -> tuple[DataFrame, Column]:
    """The keyed changes of a mixed log as ``_exists_before`` places them, and which of them land."""
    log = _exists_before(changes.filter(F.col(key).isNotNull()), table, key, order, op)
    o, exists = F.col(op), F.col("_exists")
    return log, F.when(o == "insert", ~exists).otherwise(exists & o.isin("update", "delete", "flag", "patch"))


def column_settings(table: DataFrame, changes: DataFrame, key: str, op: str, defaults: dict, resets: dict,
                    set_keys: str, allowed: list[str], as_of) -> dict[str, tuple[Column, Column]]:
    """For each column but the key: whether a change sets it, and to which value."""
    carried_cols = [c for c in table.columns if c != key and c in changes.columns]
    has_sets, o = set_keys in changes.columns, F.col(op)
    patched = F.exists(F.col(set_keys), lambda k: k.isin(*allowed)) if has_sets else F.lit(False)
    out = {}
    for c in table.columns:
        if c == key:
            continue
        kind = table.schema[c].dataType
        have = F.col(c).cast(kind) if c in carried_cols else F.lit(None).cast(kind)
        value = F.when(o == "insert", have if c in carried_cols else F.lit(defaults.get(c)).cast(kind))
        sets = o == "insert"
        if c in carried_cols or c in resets:
            sets = sets | (o == "update")
            value = value.when(o == "update", have if c in carried_cols else F.lit(resets.get(c)).cast(kind))
        if c == "is_active" and c in carried_cols:
            sets = sets | (o == "flag")
        if has_sets and c in carried_cols and c in allowed:
            sets = sets | ((o == "patch") & F.array_contains(set_keys, c))
        if c == "updated_at" and as_of is not None:
            sets = sets | ((o == "patch") & patched)
            value = value.when(o == "patch", ts_lit(as_of).cast(kind))
        out[c] = (sets, value.otherwise(have))
    return out


def apply_change_log(table: DataFrame, changes: DataFrame, key: str = "id", order: str = "change_ts",
                     op: str = "op", defaults: dict | None = None, resets: dict | None = None,
                     set_keys: str = "set_keys", allowed: list[str] | None = None,
                     as_of=None) -> tuple[DataFrame, DataFrame]:
    """G3-G7 as one job: a mixed log (``op`` = insert / update / delete / flag / patch),
    folded per key in change order, so that every change that finds its key lands.

    insert adds an absent key; update replaces a present row (carried columns, ``resets``
    for the others); flag sets ``is_active``; patch sets its ``set_keys`` within
    ``allowed`` (and ``updated_at`` to ``as_of``); delete removes. Rejected changes, that
    is inserts of present keys, updates, flags and patches of absent ones and changes
    without a key, are all returned as (key, order, op, reason). A delete of an absent
    key does nothing.

    Per key and column the latest effective change that sets it wins: one aggregate with
    partial sums over the log, then a left join that streams the table past it and the
    new keys.
    """
    defaults = CONNECTION_INSERT_DEFAULTS if defaults is None else defaults
    resets = CONNECTION_UPDATE_RESETS if resets is None else resets
    allowed = patch_keys(key) if allowed is None else allowed
    log, effective = effective_changes(changes, table, key, order, op)
    o = F.col(op)
    settings = column_settings(table, changes, key, op, defaults, resets, set_keys, allowed, as_of)
    aggs = [F.max(F.when(o.isin("insert", "delete"), F.struct("_o", o.alias("v")))).alias("_last")]
    aggs += [F.max(F.when(sets, F.struct(F.col("_o").alias("o"), value.alias("v")))).alias(f"_n_{c}")
             for c, (sets, value) in settings.items()]
    folded = log.filter(effective).groupBy(key).agg(*aggs)
    kept = table.join(folded, key, "left").filter(F.coalesce(F.col("_last.v"), F.lit("")) != "delete")
    old = kept.select(*[F.col(c) if c == key else
                        _value(table, c, F.when(F.col(f"_n_{c}").isNotNull(), F.col(f"_n_{c}.v")).otherwise(F.col(c)))
                        for c in table.columns])
    added = folded.filter(F.col("_last.v") == "insert").join(_existing(table, folded, key), key, "left_anti")
    new = added.select(*[_value(table, c, F.col(key) if c == key else F.col(f"_n_{c}.v")) for c in table.columns])
    reason = F.when(o == "insert", F.lit("key exists")).otherwise(F.lit("not found"))
    rejected = log.filter(~F.coalesce(effective, F.lit(False)) & (o != "delete")).select(key, order, o.alias(op), reason.alias("reason"))
    keyless = changes.filter(F.col(key).isNull()).select(key, order, o.alias(op), F.lit("no key").alias("reason"))
    return old.unionByName(new), rejected.unionByName(keyless)
