"""Oracle SQL for the job tables (J1-J8, V4) and access rules."""

from __future__ import annotations

from fleetstats.oracle import base as o
from fleetstats.sources.fixtures import ACCESS_POLICY


JOBS = """jobs AS (SELECT CAST(job_id AS INTEGER) AS job_id, job_name, tool_name, tool_params, trigger_type,
       CAST(interval_seconds AS INTEGER) AS interval_seconds, cron_expression, is_active,
       CAST(NULL AS TIMESTAMP) AS last_run_at, CAST(NULL AS TIMESTAMP) AS created_at,
       CAST(NULL AS TIMESTAMP) AS updated_at FROM fx11)"""


def _cron_field_sql(f: str, lo: int, hi: int) -> str:
    """Brute-force expansion of one cron field to a DuckDB list (oracle side)."""
    step = "(CASE WHEN len(string_split(x, '/')) > 1 THEN TRY_CAST(string_split(x, '/')[2] AS INTEGER) ELSE 1 END)"
    base = "string_split(x, '/')[1]"
    rng = f"string_split({base}, '-')"
    start = f"(CASE WHEN {base} = '*' THEN {lo} ELSE TRY_CAST({rng}[1] AS INTEGER) END)"
    end = (f"(CASE WHEN {base} = '*' THEN {hi} WHEN len({rng}) = 2 THEN TRY_CAST({rng}[2] AS INTEGER) "
           f"WHEN len(string_split(x, '/')) > 1 THEN {hi} ELSE {start} END)")
    item = (f"CASE WHEN {start} IS NOT NULL AND {end} IS NOT NULL AND {step} > 0 AND {end} >= {start} "
            f"THEN range({start}, {end} + 1, {step}) ELSE [] END")
    return f"flatten(list_transform(string_split({f}, ','), lambda x: {item}))"


def _fires_sql(frm: str, to: str) -> str:
    """Interval and cron firings of active jobs in [frm, to), brute force over a minute calendar."""
    f, t = f"TIMESTAMP '{frm}'", f"TIMESTAMP '{to}'"
    fields = "regexp_split_to_array(trim(cron_expression), '\\s+')"
    return f"""iv AS (SELECT job_id, CAST(interval_seconds AS BIGINT) * 1000000 AS iv, epoch_us({f}) AS a,
       epoch_us({t}) AS t FROM jobs WHERE is_active AND trigger_type = 'interval' AND interval_seconds > 0),
ivk AS (SELECT job_id, iv, a, unnest(range(0, (t - a + iv - 1) // iv)) AS k FROM iv),
cr AS (SELECT job_id, {fields} AS f FROM jobs WHERE is_active AND trigger_type = 'cron'),
ce AS (SELECT job_id, {_cron_field_sql('f[1]', 0, 59)} AS mins, {_cron_field_sql('f[2]', 0, 23)} AS hrs,
       {_cron_field_sql('f[3]', 1, 31)} AS doms, {_cron_field_sql('f[4]', 1, 12)} AS mons,
       {_cron_field_sql('f[5]', 0, 6)} AS dows FROM cr WHERE len(f) = 5),
cal AS (SELECT range AS ts FROM range({f}, {t}, INTERVAL 1 MINUTE)),
fires_iv AS (SELECT job_id, make_timestamp(a + k * iv) AS fire_ts FROM ivk),
fires_cron AS (SELECT ce.job_id, cal.ts AS fire_ts FROM ce JOIN cal ON list_contains(mins, minute(ts))
       AND list_contains(hrs, hour(ts)) AND list_contains(doms, day(ts)) AND list_contains(mons, month(ts))
       AND list_contains(dows, isodow(ts) - 1))"""


def job_sql() -> dict[str, str]:
    from fleetstats import suite
    q = {}
    base = o._with("fx11", "fx11r") + ", " + JOBS + "\n"
    q["active_jobs"] = base + "SELECT * FROM jobs WHERE is_active"
    q["list_jobs"] = base + ("SELECT * REPLACE (CAST(last_run_at AS VARCHAR) AS last_run_at, "
                             "CAST(created_at AS VARCHAR) AS created_at, CAST(updated_at AS VARCHAR) AS updated_at) "
                             "FROM jobs")
    obj = "coalesce(CASE WHEN json_valid(tool_params) THEN json_type(tool_params) = 'OBJECT' END, FALSE)"
    q["job_params"] = base + f"""SELECT job_id, CAST(CASE WHEN {obj} THEN len(json_keys(tool_params)) ELSE 0 END AS INTEGER) AS n_params,
       CASE WHEN {obj} THEN json_extract_string(tool_params, '$.connection_id') END AS connection_id FROM jobs"""
    q["trigger_plan"] = base + """SELECT 'job_' || CAST(job_id AS VARCHAR) AS scheduler_id, job_id, job_name, trigger_type,
       CASE WHEN trigger_type = 'interval' THEN interval_seconds END AS interval_seconds,
       CASE WHEN trigger_type = 'cron' THEN cron_expression END AS cron_expression
FROM jobs WHERE is_active AND trigger_type IN ('interval', 'cron')"""
    q["violations_domain"] = base + "SELECT * FROM jobs WHERE trigger_type IS NOT NULL AND trigger_type NOT IN ('interval', 'cron')"
    q["last_run"] = base + """, r AS (SELECT job_id, max(run_ts) AS m FROM fx11r WHERE success GROUP BY job_id)
SELECT j.job_id, j.job_name, greatest(j.last_run_at, CAST(r.m AS TIMESTAMP)) AS last_run_at
FROM jobs j LEFT JOIN r ON j.job_id = r.job_id"""
    jb = o._with("fx11", "fx11c") + ", " + JOBS
    newest = "arg_max(struct_pack(v := {0}), change_ts).v"
    q["job_patch"] = jb + f""", p AS (SELECT * FROM fx11c WHERE op = 'patch'),
n AS (SELECT job_id, {newest.format("job_name")} AS job_name FROM p WHERE form = 0 GROUP BY job_id),
a AS (SELECT job_id, {newest.format("is_active")} AS is_active, {newest.format("tool_params")} AS tool_params
      FROM p WHERE form = 1 GROUP BY job_id)
SELECT j.* REPLACE (CASE WHEN n.job_id IS NULL THEN j.job_name ELSE n.job_name END AS job_name,
       CASE WHEN a.job_id IS NULL THEN j.is_active ELSE a.is_active END AS is_active,
       CASE WHEN a.job_id IS NULL THEN j.tool_params ELSE a.tool_params END AS tool_params,
       CASE WHEN n.job_id IS NOT NULL OR a.job_id IS NOT NULL THEN {o.NOW_E} ELSE j.updated_at END AS updated_at)
FROM jobs j LEFT JOIN n ON n.job_id = j.job_id LEFT JOIN a ON a.job_id = j.job_id"""
    q["job_delete"] = jb + "\nSELECT * FROM jobs WHERE job_id NOT IN (SELECT job_id FROM fx11c WHERE op = 'delete')"
    audit = _fires_sql(suite.AUDIT_FROM, suite.AUDIT_TO)
    tol = suite.AUDIT_TOL
    q["missed_runs"] = base + ", " + audit + f""",
expected AS (SELECT * FROM fires_iv UNION SELECT * FROM fires_cron)
SELECT e.job_id, e.fire_ts FROM expected e WHERE NOT EXISTS (SELECT 1 FROM fx11r r WHERE r.job_id = e.job_id
       AND r.run_ts BETWEEN e.fire_ts - INTERVAL {tol} SECOND AND e.fire_ts + INTERVAL {tol} SECOND)"""
    q["missed_runs_listed"] = o._with("fx11r") + f""", expected AS (
  SELECT DISTINCT CAST(o_custkey + CASE WHEN o_orderkey % 10 = 9 THEN 1000000 ELSE 0 END AS INTEGER) AS job_id,
         CAST(o_orderdate AS TIMESTAMP) + CASE o_orderkey % 4 WHEN 0 THEN INTERVAL 30 MINUTE WHEN 1 THEN INTERVAL 120 MINUTE
                                          ELSE INTERVAL 0 MINUTE END AS fire_ts FROM orders)
SELECT e.job_id, e.fire_ts FROM expected e WHERE NOT EXISTS (SELECT 1 FROM fx11r r WHERE r.job_id = e.job_id
       AND r.run_ts BETWEEN e.fire_ts - INTERVAL {tol} SECOND AND e.fire_ts + INTERVAL {tol} SECOND)"""
    return q


def _cond_sql(cond: dict, mapping: dict) -> str:
    name = cond["path"].split(".", 1)[1]
    c = mapping.get(name)
    if c is None:
        return "FALSE"
    if cond["operator"] == "in":
        vals = cond["value"] if isinstance(cond["value"], list) else [cond["value"]]
        return f"coalesce({c} IN ({', '.join(repr(v) for v in vals)}), FALSE)"
    return f"coalesce({c} = {cond['value']!r}, FALSE)"


def policy_sql() -> dict[str, str]:
    pol = ACCESS_POLICY
    principal, resource = {"api_key": "api_key", "user_id": "user_id"}, {"name": "resource_name"}
    whens = []
    for r in pol["rules"]:
        parts = [f"action IN ({', '.join(repr(a) for a in r['actions'])})" if r["actions"] else "FALSE"]
        parts += [_cond_sql(c, principal) for c in r["principal_conditions"]]
        parts += [_cond_sql(c, resource) for c in r["resource_conditions"]]
        whens.append((r["name"], " AND ".join(parts)))
    matched = "CASE " + " ".join(f"WHEN {m} THEN '{n}'" for n, m in whens) + " END"
    denied = ", ".join(repr(r["name"]) for r in pol["rules"] if r["effect"] == "deny")
    return {"policy_decide": o._with("fx12") + f"""SELECT *, CASE WHEN matched_rule IN ({denied}) THEN 'deny'
       WHEN matched_rule IS NOT NULL THEN 'allow' ELSE '{pol["default_effect"]}' END AS decision FROM (SELECT *, {matched} AS matched_rule FROM fx12)"""}
