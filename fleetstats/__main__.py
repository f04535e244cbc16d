"""Run registered reports as batch jobs.

    python -m fleetstats --list
    python -m fleetstats growth_table [--sf-dir DIR] [--out PATH] [--format parquet|json] [--show N]

Each run builds the report over the tables in ``--sf-dir`` and writes it to ``--out``
(or prints the first ``--show`` rows).
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None, stop: bool = True) -> int:
    from fleetstats.suite import QUERIES

    ap = argparse.ArgumentParser(prog="fleetstats", description="Run a registered fleet statistics report.")
    ap.add_argument("query", nargs="?", help="registered report name")
    ap.add_argument("--list", action="store_true", help="list the registered reports")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01", help="folder with the input tables")
    ap.add_argument("--out", help="write the result here (a new folder)")
    ap.add_argument("--format", default="parquet", choices=["parquet", "json"])
    ap.add_argument("--show", type=int, default=20, help="rows to print when --out is not given")
    args = ap.parse_args(argv)

    if args.list or not args.query:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.query not in QUERIES:
        print(f"unknown report {args.query!r}; use --list", file=sys.stderr)
        return 2

    from fleetstats.session import build_session
    spark = build_session()
    df = QUERIES[args.query](spark, args.sf_dir)
    if args.out:
        df.write.mode("errorifexists").format(args.format).save(args.out)
    else:
        df.show(args.show, truncate=False)
    if stop:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
