"""Every registered query against its DuckDB twin (small scale), plus the entry smoke check."""

import pytest

from conftest import SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as entry

from fleetstats.oracle import oracle_queries  # noqa: E402
from fleetstats.suite import QUERIES  # noqa: E402

ORACLE = oracle_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["dbname", "schemaname", "relname"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    problems, n, _ = compare(spark, con, key, QUERIES[key], ORACLE[key], SF_SMALL)
    assert not problems, problems


@pytest.mark.parametrize("key", ["daily_max_stream", "report_json"])
def test_rows_only_keys_run(spark, key):
    assert QUERIES[key](spark, SF_SMALL).count() > 0
