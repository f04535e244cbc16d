"""allow/deny decisions for access requests under a rule document.

The rule document (same shape as the reference's policy files) is compiled into one
column expression per rule, so evaluation is a projection over the requests: no join,
no shuffle, whole-stage codegen. A rule matches when the action is listed and every
principal and resource condition holds (an empty list holds). Precedence: a matching
``deny`` rule wins, then any matching ``allow``, else ``default_effect``.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PRINCIPAL = {"api_key": "api_key", "user_id": "user_id"}
DEFAULT_RESOURCE = {"name": "resource_name"}


# The condition operators a rule document may use.
OPERATORS = ("in", "equals")


def load_policy(source: str) -> dict:
    """A rule document from a JSON file path or JSON text; unknown operators are rejected."""
    text = open(source).read() if os.path.exists(source) else source
    policy = json.loads(text)
    for rule in policy.get("rules", []):
        for cond in rule.get("principal_conditions", []) + rule.get("resource_conditions", []):
            if cond.get("operator") not in OPERATORS:
                raise ValueError(f"rule {rule.get('name')!r}: unsupported operator {cond.get('operator')!r}")
    return policy


def _attr(path: str, mapping: dict, columns: set) -> Column:
    name = path.split(".", 1)[1] if path.startswith("attributes.") else path
    c = mapping.get(name, name)
    return F.col(c) if c in columns else F.lit(None).cast("string")


def _condition(cond: dict, mapping: dict, columns: set) -> Column:
    v = _attr(cond["path"], mapping, columns)
    op, val = cond["operator"], cond["value"]
    if op == "in":
        vals = val if isinstance(val, list) else [val]
        return F.coalesce(v.isin(*vals), F.lit(False))
    if op == "equals":
        return F.coalesce(v == F.lit(val), F.lit(False))
    raise ValueError(f"unsupported condition operator: {op}")


def rule_match(rule: dict, requests: DataFrame, principal: dict, resource: dict) -> Column:
    cols = set(requests.columns)
    m = F.col("action").isin(*rule.get("actions", []))
    for c in rule.get("principal_conditions", []):
        m = m & _condition(c, principal, cols)
    for c in rule.get("resource_conditions", []):
        m = m & _condition(c, resource, cols)
    return m


def policy_decide(requests: DataFrame, policy: dict, principal: dict | None = None,
                  resource: dict | None = None) -> DataFrame:
    """Add ``decision`` and ``matched_rule`` (first matching rule of the winning effect)."""
    principal = principal or DEFAULT_PRINCIPAL
    resource = resource or DEFAULT_RESOURCE
    rules = policy.get("rules", [])
    default = policy.get("default_effect", "deny")
    allow = [(r["name"], rule_match(r, requests, principal, resource)) for r in rules if r.get("effect") == "allow"]
    deny = [(r["name"], rule_match(r, requests, principal, resource)) for r in rules if r.get("effect") == "deny"]

    def first(matches):
        out = F.lit(None).cast("string")
        for name, m in reversed(matches):
            out = F.when(m, F.lit(name)).otherwise(out)
        return out

    deny_name, allow_name = first(deny), first(allow)
    decision = (F.when(deny_name.isNotNull(), F.lit("deny")).when(allow_name.isNotNull(), F.lit("allow"))
                .otherwise(F.lit(default)))
    matched = F.when(deny_name.isNotNull(), deny_name).otherwise(allow_name)
    return requests.select("*", decision.alias("decision"), matched.alias("matched_rule"))
