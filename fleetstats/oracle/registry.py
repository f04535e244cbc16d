"""Oracle SQL for the registry (G1-G7) and its constraints (V1-V3)."""

from __future__ import annotations

from fleetstats.oracle import base as o


CONN = """conn AS (SELECT CAST(id AS INTEGER) AS id, CAST(database_type_id AS INTEGER) AS database_type_id, host,
       CAST(port AS INTEGER) AS port, database_name, CAST(NULL AS VARCHAR) AS username, encrypted_password,
       is_active, CAST(NULL AS VARCHAR) AS description, connect_at_startup FROM fx10)"""
CONN_COLS = ("id, database_type_id, host, port, database_name, username, encrypted_password, is_active, "
             "description, connect_at_startup")


# Which changes find their key: scan a key's inserts and deletes in order.
_PRESENCE = """{log} AS (
SELECT l.*, coalesce(
         (SELECT CASE b.op WHEN 'insert' THEN TRUE ELSE FALSE END FROM {src} b
          WHERE b.{key} = l.{key} AND b.op IN ('insert', 'delete') AND b.change_ts < l.change_ts
          ORDER BY b.change_ts DESC LIMIT 1),
         l.{key} IN (SELECT {key} FROM {table})) AS present
FROM {src} l)"""


def _newest(where: str, what: str, log: str = "marked", key: str = "id") -> str:
    """(key, change_ts, ...) of the newest change per key that meets ``where``."""
    return (f"SELECT {key}, max(change_ts) AS change_ts, {', '.join(f'arg_max(struct_pack(v := {c}), change_ts).v AS {c}' for c in what.split())} "
            f"FROM {log} WHERE {where} GROUP BY {key}")


def registry_sql() -> dict[str, str]:
    q = {}
    base = o._with("fx10", "fx10t", "fx10c") + ", " + CONN + "\n"
    shown = [c for c in CONN_COLS.split(", ") if c != "encrypted_password"]
    shown.insert(2, "(SELECT any_value(name) FROM fx10t WHERE fx10t.id = conn.database_type_id) AS database_type_name")
    q["connections_list"] = base + f"SELECT {', '.join(shown)} FROM conn"
    q["connection_lookup"] = base + f"SELECT {', '.join(shown)}, encrypted_password FROM conn WHERE id = 7"
    q["types_list"] = o._with("fx10t") + "SELECT CAST(id AS INTEGER) AS id, name FROM fx10t"
    q["type_lookup"] = o._with("fx10t") + "SELECT CAST(id AS INTEGER) AS id, name FROM fx10t WHERE id = 3"
    q["violations_unique"] = base + """SELECT database_type_id, host, port, database_name, count(*) AS n FROM conn
WHERE database_type_id IS NOT NULL AND host IS NOT NULL AND port IS NOT NULL AND database_name IS NOT NULL
GROUP BY database_type_id, host, port, database_name HAVING count(*) > 1"""
    q["violations_not_null"] = base + " UNION ALL ".join(
        f"SELECT id, '{c}' AS column_name FROM conn WHERE {c} IS NULL"
        for c in ("host", "port", "database_name", "username", "encrypted_password"))
    q["violations_fk"] = base + (f"SELECT {CONN_COLS} FROM conn WHERE database_type_id IS NOT NULL "
                                 "AND database_type_id NOT IN (SELECT id FROM fx10t)")
    fresh = ("CAST({id} AS INTEGER) AS id, CAST(database_type_id AS INTEGER) AS database_type_id, host, "
             "CAST(NULL AS INTEGER) AS port, CAST(NULL AS VARCHAR) AS database_name, CAST(NULL AS VARCHAR) AS username, "
             "CAST(NULL AS VARCHAR) AS encrypted_password, is_active, description, TRUE AS connect_at_startup")
    first = ("SELECT * FROM fx10c f WHERE op = 'insert' AND NOT EXISTS (SELECT 1 FROM fx10c e WHERE e.op = 'insert' "
             "AND e.id = f.id AND e.change_ts < f.change_ts) AND id NOT IN (SELECT id FROM conn)")
    q["registry_insert"] = base + f"SELECT * FROM conn UNION ALL SELECT {fresh.format(id='id')} FROM ({first})"
    q["registry_insert_new"] = base + (
        f"SELECT {CONN_COLS} FROM conn UNION ALL SELECT "
        + fresh.format(id="(SELECT max(id) FROM conn) + (SELECT count(*) FROM fx10c e WHERE e.op = 'insert' "
                          "AND e.change_ts <= f.change_ts)") + " FROM fx10c f WHERE op = 'insert'")
    q["registry_update"] = base + f""", l AS ({_newest("op = 'update'", "database_type_id host is_active description", "fx10c")})
SELECT id, CAST(database_type_id AS INTEGER) AS database_type_id, host, port, database_name, username, encrypted_password,
       is_active, description, connect_at_startup FROM conn WHERE id NOT IN (SELECT id FROM l)
UNION ALL SELECT c.id, CAST(l.database_type_id AS INTEGER), l.host, c.port, c.database_name, c.username, c.encrypted_password,
       l.is_active, l.description, FALSE FROM l JOIN conn c ON c.id = l.id"""
    q["registry_delete"] = base + f"SELECT {CONN_COLS} FROM conn WHERE id NOT IN (SELECT id FROM fx10c WHERE op = 'delete')"
    q["registry_flag"] = base + f""", l AS ({_newest("op = 'flag'", "is_active", "fx10c")})
SELECT c.* REPLACE (coalesce((SELECT is_active FROM l WHERE l.id = c.id), c.is_active) AS is_active) FROM conn c"""
    q["registry_deactivate"] = base + "SELECT * REPLACE (FALSE AS is_active) FROM conn"
    q["registry_patch"] = base + f""", l AS ({_newest("sets_description", "description", "fx10c")})
SELECT c.* REPLACE (CASE WHEN c.id IN (SELECT id FROM l) THEN (SELECT description FROM l WHERE l.id = c.id)
       ELSE c.description END AS description) FROM conn c"""
    marked = _PRESENCE.format(log="marked", src="fx10c", key="id", table="conn")
    landed = "((op = 'insert' AND NOT present) OR (op <> 'insert' AND present))"
    q["registry_apply"] = base + f""", {marked},
ends AS ({_newest(landed + " AND op IN ('insert', 'delete')", "op")}),
whole AS ({_newest(landed + " AND op IN ('insert', 'update')", "op database_type_id host description")}),
act AS ({_newest(landed + " AND op IN ('insert', 'update', 'flag')", "is_active")}),
ids AS (SELECT id FROM conn UNION SELECT id FROM ends WHERE op = 'insert')
SELECT CAST(i.id AS INTEGER) AS id,
       CASE WHEN w.id IS NULL THEN c.database_type_id ELSE CAST(w.database_type_id AS INTEGER) END AS database_type_id,
       CASE WHEN w.id IS NULL THEN c.host ELSE w.host END AS host,
       CASE WHEN coalesce(e.op, '') <> 'insert' THEN c.port END AS port,
       CASE WHEN coalesce(e.op, '') <> 'insert' THEN c.database_name END AS database_name,
       CASE WHEN coalesce(e.op, '') <> 'insert' THEN c.username END AS username,
       CASE WHEN coalesce(e.op, '') <> 'insert' THEN c.encrypted_password END AS encrypted_password,
       CASE WHEN a.id IS NULL THEN c.is_active ELSE a.is_active END AS is_active,
       CASE WHEN w.id IS NULL THEN c.description ELSE w.description END AS description,
       CASE w.op WHEN 'insert' THEN TRUE WHEN 'update' THEN FALSE ELSE c.connect_at_startup END AS connect_at_startup
FROM ids i LEFT JOIN conn c ON c.id = i.id LEFT JOIN ends e ON e.id = i.id LEFT JOIN whole w ON w.id = i.id
     LEFT JOIN act a ON a.id = i.id
WHERE coalesce(e.op, '') <> 'delete'"""
    q["registry_rejected"] = base + f""", {marked}
SELECT CAST(id AS BIGINT) AS id, change_ts, op, CASE op WHEN 'insert' THEN 'key exists' ELSE 'not found' END AS reason
FROM marked WHERE op <> 'delete' AND NOT {landed}"""
    return q
