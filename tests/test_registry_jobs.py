"""Registry change logs, constraints, job parsing, firing times, audits and access rules."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import rows
from fleetstats.operators import jobs as jb
from fleetstats.operators import registry as rg
from fleetstats.operators import validation as vd
from fleetstats.operators.policy import policy_decide
from fleetstats.plans.shapes import dense_sequence, last_per_key
from fleetstats.schemas import CONNECTIONS, JOBS


def table(spark):
    data = [(1, 1, "h1", 5432, "d1", "u", "s1", True, "one", True),
            (2, 2, "h2", 5432, "d2", "u", "s2", True, "two", True),
            (3, None, "h3", 5433, "d3", "u", "s3", False, None, False)]
    return spark.createDataFrame(data, CONNECTIONS)


def changes(spark, data, extra=""):
    return spark.createDataFrame(data, "id int, change_ts long, host string, description string" + extra)


def fold(base, log):
    """Plain Python: every change in order; the table after them, and the orders of the rejected ones."""
    rows_, rejected = {k: dict(v) for k, v in base.items()}, []
    for key, ts, op, host, active in sorted(log, key=lambda r: r[1]):
        if op == "delete":
            rows_.pop(key, None)
        elif (op == "insert") == (key in rows_):
            rejected.append(ts)
        elif op == "insert":
            rows_[key] = {c: None for c in CONNECTIONS.fieldNames()} | {
                "id": key, "host": host, "is_active": active, "connect_at_startup": True}
        elif op == "update":
            rows_[key].update(host=host, is_active=active, description=None, connect_at_startup=False)
        elif op == "flag":
            rows_[key]["is_active"] = active
    return rows_, rejected


def by_id(df):
    return {r["id"]: r.asDict() for r in df.collect()}


def test_insert_if_absent_defaults_and_generated_ids(spark):
    ch = changes(spark, [(2, 1, "x", "dup"), (9, 2, "h9", "nine"), (9, 3, "h9b", "nine-b"),
                         (None, 4, "n1", "new1"), (None, 5, "n2", "new2")])
    new, ignored = rg.registry_insert(table(spark), ch)
    out = by_id(new)
    assert out[2]["host"] == "h2"                     # existing key untouched
    assert out[9]["host"] == "h9"                     # the first insert of a key counts
    assert out[9]["is_active"] is True and out[9]["connect_at_startup"] is True  # table defaults
    assert out[10]["host"] == "n1" and out[11]["host"] == "n2"                   # max(id) + 1, + 2
    assert sorted(rows(ignored, "id", "change_ts", "reason")) == [(2, 1, "key exists"), (9, 3, "key exists")]


def test_update_replaces_and_resets_absent_columns(spark):
    ch = changes(spark, [(1, 1, "a", "first"), (1, 2, "b", None), (7, 3, "zz", "missing")])
    new, ignored = rg.registry_update(table(spark), ch)
    r = by_id(new)[1]
    assert (r["host"], r["description"], r["connect_at_startup"], r["is_active"], r["port"]) == \
        ("b", None, False, True, 5432)
    assert by_id(new)[2]["host"] == "h2"
    assert rows(ignored, "id") == [(7,)]


def test_delete_then_insert_restores_key_set(spark):
    t = table(spark)
    gone, _ = rg.registry_delete(t, spark.createDataFrame([(2,), (2,), (42,)], "id int"))
    assert sorted(by_id(gone)) == [1, 3]
    back, _ = rg.registry_insert(gone, changes(spark, [(2, 9, "h2", "two")]))
    assert sorted(by_id(back)) == [1, 2, 3]


def test_insert_is_idempotent(spark):
    ch = changes(spark, [(5, 1, "h5", "five")])
    once, _ = rg.registry_insert(table(spark), ch)
    twice, ignored = rg.registry_insert(once, ch)
    assert sorted(rows(once)) == sorted(rows(twice))
    assert ignored.count() == 1


def test_flag_all_and_flag_unknown(spark):
    new, _ = rg.registry_flag(table(spark), value=False)
    assert {r[0] for r in rows(new, "is_active")} == {False}
    ch = spark.createDataFrame([(3, 1, True), (8, 2, False)], "id int, change_ts long, is_active boolean")
    new, ignored = rg.registry_flag(table(spark), ch)
    assert by_id(new)[3]["is_active"] is True
    assert rows(ignored, "id", "reason") == [(8, "not found")]


def test_patch_null_value_absent_key_and_merge(spark):
    ch = spark.createDataFrame(
        [(1, 1, "p-host", "p-desc", ["host", "description"]),
         (1, 2, None, None, ["description"]),          # explicit NULL is written
         (2, 3, "ignored", "ignored", []),              # empty patch: unchanged
         (3, 4, "x", "y", ["bogus"])],                  # unknown key: ignored
        "id int, change_ts long, host string, description string, set_keys array<string>")
    new, _ = rg.registry_patch(table(spark), ch)
    out = by_id(new)
    assert (out[1]["host"], out[1]["description"]) == ("p-host", None)
    assert (out[2]["host"], out[2]["description"]) == ("h2", "two")
    assert (out[3]["host"], out[3]["description"]) == ("h3", None)


def test_job_patch_sets_updated_at_only_when_something_changes(spark):
    jobs = spark.createDataFrame([(1, "a", "t", None, "cron", None, "* * * * *", True, None, None, None),
                                  (2, "b", "t", None, "cron", None, "* * * * *", True, None, None, None)], JOBS)
    ch = spark.createDataFrame([(1, 1, "renamed", ["job_name"]), (2, 2, "x", [])],
                               "job_id int, change_ts long, job_name string, set_keys array<string>")
    from fleetstats.schemas import JOB_PATCH_KEYS
    new, _ = rg.registry_patch(jobs, ch, key="job_id", allowed=JOB_PATCH_KEYS, as_of="2024-01-01 00:00:00")
    out = {r["job_id"]: r for r in new.collect()}
    assert out[1]["job_name"] == "renamed" and out[1]["updated_at"] == dt.datetime(2024, 1, 1)
    assert out[2]["job_name"] == "b" and out[2]["updated_at"] is None


def test_constraints(spark):
    t = table(spark).unionByName(spark.createDataFrame(
        [(4, 1, "h1", 5432, "d1", None, "s", True, None, True), (5, None, "h1", 5432, "d1", "u", "s", True, None, True)],
        CONNECTIONS))
    assert rows(vd.violations_unique(t, ["database_type_id", "host", "port", "database_name"]),
                "database_type_id", "n") == [(1, 2)]   # the NULL-type duplicate does not conflict
    assert rows(vd.violations_not_null(t, ["host", "username"], "id")) == [(4, "username")]
    types = spark.createDataFrame([(1, "pg")], "id int, name string")
    assert sorted(rows(vd.violations_fk(t, types, "database_type_id"), "id")) == [(2,)]
    j = spark.createDataFrame([(1, "cron"), (2, "manual"), (3, None)], "id int, trigger_type string")
    assert rows(vd.violations_domain(j, "trigger_type", ["interval", "cron"]), "id") == [(2,)]


def test_connections_list_never_selects_secret(spark):
    types = spark.createDataFrame([(1, "pg")], "id int, name string")
    out = rg.connections_list(table(spark), types)
    assert "encrypted_password" not in out.columns
    assert rows(out, "id") == [(1,), (2,), (3,)]          # NULL type names sort last
    assert "encrypted_password" in rg.connection_lookup(table(spark), types, 1, with_secret=True).columns
    assert rg.connection_lookup(table(spark), types, 99).count() == 0


def test_job_params_shapes(spark):
    jobs = spark.createDataFrame([(1, '{"a": "1", "b": 2}'), (2, "{broken"), (3, None), (4, "[1, 2]")],
                                 "job_id int, tool_params string")
    assert sorted(rows(jb.job_params_summary(jobs), "job_id", "n_params")) == [(1, 2), (2, 0), (3, 0), (4, 0)]


def _jobs(spark, data):
    return spark.createDataFrame(
        [(i, f"j{i}", "t", None, kind, iv, cron, True, None, None, None) for i, kind, iv, cron in data], JOBS)


def test_last_run_moves_only_on_success(spark):
    jobs = _jobs(spark, [(1, "cron", None, "* * * * *"), (2, "cron", None, "* * * * *")])
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), True), (1, dt.datetime(2024, 1, 2), False),
                                 (2, dt.datetime(2024, 1, 3), False)], "job_id int, run_ts timestamp, success boolean")
    assert sorted(rows(jb.last_run(jobs, log), "job_id", "last_run_at")) == [(1, dt.datetime(2024, 1, 1)), (2, None)]


def test_missed_runs_matches_brute_force(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    exp = [(rnd.randint(1, 3), base + dt.timedelta(seconds=rnd.randint(0, 20000))) for _ in range(300)]
    runs = [(rnd.randint(1, 3), base + dt.timedelta(seconds=rnd.randint(0, 20000)), True) for _ in range(120)]
    exp = sorted(set(exp))
    for tol in (0, 7, 300):
        e = spark.createDataFrame(exp, "job_id int, fire_ts timestamp")
        r = spark.createDataFrame(runs, "job_id int, run_ts timestamp, success boolean")
        got = sorted(rows(jb.missed_runs(e, r, tol)))
        want = sorted((j, t) for j, t in exp
                      if not any(rj == j and abs((rt - t).total_seconds()) <= tol for rj, rt, _ in runs))
        assert got == want, tol


def test_policy_precedence_and_conditions(spark):
    policy = {"rules": [
        {"name": "allow-a", "effect": "allow", "actions": ["list", "execute"],
         "principal_conditions": [{"path": "attributes.api_key", "operator": "in", "value": ["a"]}],
         "resource_conditions": []},
        {"name": "deny-a-secret", "effect": "deny", "actions": ["execute"],
         "principal_conditions": [{"path": "attributes.api_key", "operator": "equals", "value": "a"}],
         "resource_conditions": [{"path": "attributes.name", "operator": "equals", "value": "secret"}]},
        {"name": "anyone-lists", "effect": "allow", "actions": ["list"], "principal_conditions": [],
         "resource_conditions": []},
    ], "default_effect": "deny"}
    req = spark.createDataFrame([(1, "a", "x", "execute"), (2, "a", "secret", "execute"), (3, "b", "x", "execute"),
                                 (4, "b", "x", "list"), (5, None, "x", "execute")],
                                "request_id long, api_key string, resource_name string, action string")
    out = sorted(rows(policy_decide(req, policy), "request_id", "decision", "matched_rule"))
    assert out == [(1, "allow", "allow-a"), (2, "deny", "deny-a-secret"), (3, "deny", None),
                   (4, "allow", "anyone-lists"), (5, "deny", None)]


def test_last_per_key_and_dense_sequence(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 5, "x")], "k int, ts int, v string")
    assert sorted(rows(last_per_key(df, ["k"], ["ts"]))) == [(1, 3, "c"), (2, 5, "x")]
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"))
    seq = dense_sequence(many, ["o"], "n", start=10)
    got = sorted(rows(seq, "o", "n"))
    assert got == [(i, i + 10) for i in range(1000)]


def test_salted_top_k_equals_plain(spark):
    from fleetstats.plans.shapes import top_k
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 5000).alias("v"))
    order = [F.col("v").desc(), F.col("g")]
    plain = sorted(rows(top_k(df, order, 50, ["g"])))
    salted = sorted(rows(top_k(df, order, 50, ["g"], salts=8)))
    assert plain == salted and len(plain) == 150


MIXED = ("id int, change_ts long, op string, host string, description string, is_active boolean, set_keys array<string>, "
         "encrypted_password string")


def test_apply_change_log_folds_in_order(spark):
    ch = spark.createDataFrame(
        [(1, 1, "update", "h1b", "d1b", True, [], None), (1, 2, "flag", None, None, False, [], None),   # both land
         (2, 3, "delete", None, None, None, [], None), (2, 4, "insert", "h2n", "new", True, [], None),  # replaced
         (2, 5, "insert", "dup", "dup", True, [], None),                                                # rejected
         (7, 6, "insert", "h7", "seven", None, [], None), (7, 7, "update", "h7b", "d7", True, [], None),
         (8, 8, "update", "x", "x", True, [], None), (8, 9, "delete", None, None, None, [], None),      # rejected; no effect
         (3, 10, "patch", "h3p", None, None, ["host", "encrypted_password"], "stolen"),
         (3, 11, "delete", None, None, None, [], None), (3, 12, "flag", None, None, True, [], None),    # rejected
         (None, 13, "flag", None, None, True, [], None)], MIXED)
    new, ignored = rg.apply_change_log(table(spark), ch)
    out = by_id(new)
    assert sorted(out) == [1, 2, 7]
    assert (out[1]["host"], out[1]["description"], out[1]["is_active"], out[1]["connect_at_startup"]) == \
        ("h1b", "d1b", False, False)
    assert (out[2]["host"], out[2]["description"], out[2]["port"], out[2]["connect_at_startup"]) == ("h2n", "new", None, True)
    assert (out[7]["host"], out[7]["is_active"], out[7]["connect_at_startup"]) == ("h7b", True, False)
    assert sorted(rows(ignored, "change_ts", "reason")) == [(5, "key exists"), (8, "not found"), (12, "not found"), (13, "no key")]


def test_patch_never_sets_the_secret(spark):
    ch = spark.createDataFrame([(3, 10, "patch", "h3p", None, None, ["host", "encrypted_password"], "stolen")], MIXED)
    for new in (rg.apply_change_log(table(spark), ch)[0], rg.registry_patch(table(spark), ch.drop("op"))[0]):
        assert (by_id(new)[3]["host"], by_id(new)[3]["encrypted_password"]) == ("h3p", "s3")


def test_one_hot_key_holds_most_of_the_log(spark):
    ch = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, F.lit(1)).otherwise((F.col("id") % 50).cast("int")).alias("id"), F.col("id").alias("change_ts"),
        F.element_at(F.array(*[F.lit(o) for o in ("insert", "update", "delete", "flag", "update")]), (F.col("id") % 5 + 1).cast("int"))
        .alias("op"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), (F.col("id") % 2 == 0).alias("is_active"))
    data = [tuple(r) for r in ch.collect()]
    base = {r["id"]: r.asDict() for r in table(spark).collect()}
    got, ignored = rg.apply_change_log(table(spark), ch)
    want, rejected = fold(base, data)
    assert by_id(got) == want
    assert sorted(rows(ignored, "change_ts")) == sorted((ts,) for ts in rejected)


def test_load_policy_document(spark):
    import json
    from fleetstats.operators.policy import load_policy
    from fleetstats.sources.fixtures import ACCESS_POLICY
    assert load_policy(json.dumps(ACCESS_POLICY)) == ACCESS_POLICY
    bad = {"rules": [{"name": "x", "principal_conditions": [{"path": "attributes.a", "operator": "regex",
                                                              "value": "."}]}]}
    import pytest
    with pytest.raises(ValueError):
        load_policy(json.dumps(bad))


def test_list_jobs_iso_text_and_lookup(spark):
    jobs = spark.createDataFrame(
        [(2, "b", "t", None, "cron", None, "* * * * *", True, dt.datetime(2024, 1, 2, 3, 4, 5), None, None),
         (1, "a", "t", None, "interval", 60, None, False, None, None, None)], JOBS)
    out = rows(jb.list_jobs(jobs), "job_id", "last_run_at")
    assert out == [(1, None), (2, "2024-01-02T03:04:05")]          # ordered by id, ISO text
    assert rows(jb.list_jobs(jobs, job_id=2), "job_name") == [("b",)]
    assert rows(jb.active_jobs(jobs), "job_id") == [(2,)]
    plan = rows(jb.trigger_plan(jobs), "scheduler_id", "cron_expression")
    assert plan == [("job_2", "* * * * *")]                        # inactive job 1 not scheduled


def test_catalog_listings_are_ordered(spark):
    from fleetstats.operators import catalog
    cat = spark.createDataFrame(
        [("s", "b", "y", 2, "BASE TABLE"), ("s", "b", "x", 1, "BASE TABLE"), ("a", "z", "c", 1, "BASE TABLE"),
         ("s", "a", "k", 1, "VIEW")],
        "table_schema string, table_name string, column_name string, ordinal_position int, table_type string")
    assert rows(catalog.list_tables(cat)) == [("a", "z"), ("s", "a"), ("s", "b")]
    assert rows(catalog.list_tables_in_schema(cat, "s")) == [("s", "a"), ("s", "b")]
    assert rows(catalog.list_columns(cat, "s", "b"), "column_name") == [("x",), ("y",)]
    assert sorted(rows(catalog.resolve_tables(cat, "s"))) == [("s", "b")]   # views are not BASE TABLEs
    counts = rows(catalog.row_counts({"one": cat, "none": cat.limit(0)}))
    assert sorted(counts) == [("none", 0), ("one", 4)]


def test_hot_key_change_log_last_wins(spark):
    ch = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise((F.col("id") % 2 + 2).cast("int")).alias("id"),
        F.col("id").alias("change_ts"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"),
        F.lit("d").alias("description"))
    new, ignored = rg.registry_update(table(spark), ch)
    out = by_id(new)
    assert out[1]["host"] == "h8997"   # last change of the hot key (ids % 3 == 0)
    assert out[2]["host"] == "h8998" and out[3]["host"] == "h8999"
    assert ignored.count() == 0


def test_policy_user_id_attribute(spark):
    policy = {"rules": [{"name": "by-user", "effect": "allow", "actions": ["list"],
                         "principal_conditions": [{"path": "attributes.user_id", "operator": "in", "value": ["u1"]}],
                         "resource_conditions": []}], "default_effect": "deny"}
    req = spark.createDataFrame([(1, "u1", "x", "list"), (2, "u2", "x", "list"), (3, "u1", "x", "execute")],
                                "request_id long, user_id string, resource_name string, action string")
    out = sorted(rows(policy_decide(req, policy), "request_id", "decision"))
    assert out == [(1, "allow"), (2, "deny"), (3, "deny")]


def test_missed_runs_successful_only(spark):
    exp = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12))], "job_id int, fire_ts timestamp")
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12, 0, 30), False)],
                                "job_id int, run_ts timestamp, success boolean")
    assert jb.missed_runs(exp, log, 60).count() == 0                        # a failed run still fired
    assert rows(jb.missed_runs(exp, log, 60, successful_only=True)) == [(1, dt.datetime(2024, 1, 1, 12))]
    assert rows(jb.missed_runs(exp, log, 10)) == [(1, dt.datetime(2024, 1, 1, 12))]   # outside tolerance


def test_apply_change_log_matches_python_simulation(spark):
    rnd = random.Random(3)
    base = {r[0]: dict(zip(CONNECTIONS.fieldNames(), r)) for r in [
        (1, 1, "h1", 5432, "d1", "u", "s1", True, "one", True), (2, 2, "h2", 5432, "d2", "u", "s2", True, "two", True),
        (3, None, "h3", 5433, "d3", "u", "s3", False, None, False)]}
    log = [(rnd.randint(1, 6), ts, rnd.choice(["insert", "update", "delete", "flag"]), f"h{ts}",
            rnd.choice([True, False])) for ts in range(40)]
    ch = spark.createDataFrame(log, "id int, change_ts long, op string, host string, is_active boolean")
    got = by_id(rg.apply_change_log(spark.createDataFrame([tuple(v.values()) for v in base.values()], CONNECTIONS),
                                    ch)[0])
    assert got == fold(base, log)[0]


def test_policy_matches_python_evaluation(spark):
    rnd = random.Random(21)
    keys, names, actions = ["k1", "k2", "k3"], ["view", "click", "buy"], ["list", "execute"]

    def cond(path, pool):
        if rnd.random() < 0.5:
            return {"path": path, "operator": "in", "value": rnd.sample(pool, rnd.randint(1, 2))}
        return {"path": path, "operator": "equals", "value": rnd.choice(pool)}

    rules = [{"name": f"r{i}", "effect": rnd.choice(["allow", "allow", "deny"]),
              "actions": rnd.sample(actions, rnd.randint(1, 2)),
              "principal_conditions": [cond("attributes.api_key", keys)] if rnd.random() < 0.8 else [],
              "resource_conditions": [cond("attributes.name", names)] if rnd.random() < 0.5 else []}
             for i in range(6)]
    policy = {"rules": rules, "default_effect": "deny"}
    reqs = [(i, rnd.choice(keys + [None]), rnd.choice(names), rnd.choice(actions)) for i in range(200)]
    df = spark.createDataFrame(reqs, "request_id long, api_key string, resource_name string, action string")
    got = dict(rows(policy_decide(df, policy), "request_id", "decision"))

    def holds(c, value):
        return value is not None and (value in c["value"] if c["operator"] == "in" else value == c["value"])

    def matches(r, key, name, action):
        return (action in r["actions"] and all(holds(c, key) for c in r["principal_conditions"])
                and all(holds(c, name) for c in r["resource_conditions"]))

    for rid, key, name, action in reqs:
        hits = [r["effect"] for r in rules if matches(r, key, name, action)]
        want = "deny" if "deny" in hits else ("allow" if "allow" in hits else "deny")
        assert got[rid] == want, (rid, key, name, action)


def test_constraints_and_last_run_match_python_model(spark):
    rnd = random.Random(37)
    conns = [(i, rnd.choice([1, 2, None]), rnd.choice(["h1", "h2", None]), 5432, rnd.choice(["d1", "d2"]),
              rnd.choice(["u", None]), "s", True, None, True) for i in range(1, 41)]
    t = spark.createDataFrame(conns, CONNECTIONS)
    types = spark.createDataFrame([(1, "pg")], "id int, name string")
    keyed = {}
    for c in conns:
        if None not in (c[1], c[2], c[3], c[4]):
            keyed[(c[1], c[2], c[3], c[4])] = keyed.get((c[1], c[2], c[3], c[4]), 0) + 1
    assert sorted(rows(vd.violations_unique(t, ["database_type_id", "host", "port", "database_name"]))) == \
        sorted((*k, n) for k, n in keyed.items() if n > 1)
    assert sorted(rows(vd.violations_not_null(t, ["host", "username"], "id"))) == \
        sorted([(c[0], "host") for c in conns if c[2] is None] + [(c[0], "username") for c in conns if c[5] is None])
    assert sorted(rows(vd.violations_fk(t, types, "database_type_id"), "id")) == \
        sorted((c[0],) for c in conns if c[1] not in (None, 1))
    jobs = _jobs(spark, [(i, "cron", None, "* * * * *") for i in range(1, 6)])
    log = [(rnd.randint(1, 6), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 500)), rnd.random() < 0.6)
           for _ in range(60)]
    got = dict(rows(jb.last_run(jobs, spark.createDataFrame(log, "job_id int, run_ts timestamp, success boolean")),
                    "job_id", "last_run_at"))
    want = {i: max((ts for j, ts, ok in log if j == i and ok), default=None) for i in range(1, 6)}
    assert got == want
