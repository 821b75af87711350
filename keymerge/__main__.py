"""Command line: ``python -m keymerge PLAN.json [-o OUT] [-f csv|tsv|parquet] [-p] [-l N] [--how left]``.

Runs a JSON plan (DSL merge or SQL) with ``run_plan`` and either writes the
result (a distributed directory) or prints a preview of the first rows.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m keymerge", description="Merge tabular sources by key on Spark.")
    ap.add_argument("plan", help="JSON plan file (sources + DSL query, or a SQL query)")
    ap.add_argument("-o", "--output", help="output directory (any Hadoop-FS URI)")
    ap.add_argument("-f", "--format", default="csv", help="csv, tsv, parquet, orc or json (default csv)")
    ap.add_argument("-p", "--preview", action="store_true", help="print the first rows instead of writing")
    ap.add_argument("-l", "--limit", type=int, default=50, help="rows to preview (default 50)")
    ap.add_argument("--how", default=None, choices=["inner", "left", "full"], help="join kind of the merge (default: the plan's, else inner)")
    ap.add_argument("--master", default=None, help="Spark master, e.g. local[8] (default: from the environment)")
    args = ap.parse_args(argv)
    if not args.preview and not args.output:
        ap.error("give --output or --preview")

    from .plans.run import run_plan
    from .session import get_session
    from .sources import preview_text, write

    spark = get_session(args.master)
    df = run_plan(spark, args.plan, **({"how": args.how} if args.how else {}))
    if args.preview:
        sys.stdout.write(preview_text(df, args.limit))
    else:
        write(df, args.output, args.format)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
