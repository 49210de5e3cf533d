"""Command line: run one report over a corpus and write every section.

    spark-submit quarry/cli.py conventions /data/corpus --out /data/reports/conv
    python -m quarry arch /data/corpus --out /tmp/arch --min-complexity 10

Each section of the report is written as its own table under ``--out``
(``json`` by default, ``parquet`` with ``--format parquet``); nothing is
collected on the driver. ``--facts`` writes the facts once and reuses them.
"""

from __future__ import annotations

import argparse
import os
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__.splitlines()[0])
    p.add_argument("report", choices=["arch", "deps", "patterns", "coverage", "conventions", "context"])
    p.add_argument("root", help="folder of repositories (or of one project with --repo-level 0)")
    p.add_argument("--out", required=True, help="output folder; one sub-folder per section")
    p.add_argument("--format", default="json", choices=["json", "parquet"])
    p.add_argument("--repo-level", type=int, default=1)
    p.add_argument("--include", action="append", help="include glob (Path.glob dialect)")
    p.add_argument("--exclude", action="append", help="exclude glob (fnmatch dialect)")
    p.add_argument("--facts", help="folder to write the facts table to once")
    p.add_argument("--files", help="folder to write the scanned files table to once")
    p.add_argument("--master", help="Spark master (default: from spark-submit)")
    # report options
    p.add_argument("--depth", default="detailed")
    p.add_argument("--min-complexity", type=int, default=0)
    p.add_argument("--max-detailed-files", type=int, default=50)
    p.add_argument("--focus")
    p.add_argument("--hops", type=int, default=5)
    p.add_argument("--max-cycle-len", type=int, default=None)
    p.add_argument("--pattern-type", action="append")
    p.add_argument("--coverage-xml", action="append", default=[],
                   help="repo=path/to/coverage.xml (repeatable)")
    p.add_argument("--lines-threshold", type=float, default=80.0)
    p.add_argument("--priority", default="all")
    p.add_argument("--severity", default="warning")
    p.add_argument("--tasks", help="table of tasks (task_id, repo, text): parquet or json path")
    p.add_argument("--max-tokens", type=int, default=50000)
    p.add_argument("--focus-area", action="append")
    p.add_argument("--strategy", default="relevance")
    return p


def run(argv: list[str] | None = None) -> dict:
    args = _parser().parse_args(argv)
    from .operators.coverage import GapPolicy
    from .plans import reports as R
    from .session import get_spark
    from .sources.reports import write_report

    spark = get_spark("quarry-" + args.report, master=args.master)
    corpus = R.scan(spark, args.root, args.include, args.exclude, args.repo_level, args.facts,
                    files_path=args.files)
    if args.report == "arch":
        rep = R.arch_report(corpus, args.depth, args.min_complexity, args.max_detailed_files)
    elif args.report == "deps":
        rep = R.deps_report(corpus, args.focus, args.hops, max_cycle_len=args.max_cycle_len)
    elif args.report == "patterns":
        rep = R.patterns_report(corpus, args.pattern_type)
    elif args.report == "coverage":
        xml = dict(x.split("=", 1) for x in args.coverage_xml)
        rep = R.coverage_report(corpus, policy=GapPolicy(lines_threshold=args.lines_threshold),
                                priority=args.priority, coverage_xml=xml or None)
    elif args.report == "conventions":
        rep = R.conventions_report(corpus, args.severity)
    else:
        if not args.tasks:
            raise SystemExit("context needs --tasks")
        fmt = "parquet" if args.tasks.endswith(".parquet") else "json"
        tasks = spark.read.format(fmt).load(args.tasks)
        rep = R.context_report(corpus, tasks, args.max_tokens, args.focus_area, args.strategy)
    for name, df in rep.items():
        write_report(df, os.path.join(args.out, name), args.format)
    return rep


if __name__ == "__main__":
    run(sys.argv[1:])
