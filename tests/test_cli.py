"""The command-line runner lists and runs registered reports."""

from fleetstats.__main__ import main
from fleetstats.suite import QUERIES


def test_list_and_unknown(capsys):
    assert main(["--list"]) == 0
    listed = capsys.readouterr().out.split()
    assert "growth_table" in listed and len(listed) == len(QUERIES)
    assert main(["no_such_report"]) == 2


def test_run_to_folder(spark, tmp_path):
    from conftest import SF_SMALL
    out = str(tmp_path / "growth")
    assert main(["growth_db", "--sf-dir", SF_SMALL, "--out", out], stop=False) == 0
    assert spark.read.parquet(out).count() == 4
