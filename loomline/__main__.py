"""Command line: list queries, run one, or render several small ones as a report."""

from __future__ import annotations

import argparse
from pathlib import Path

from loomline.plans import registry


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomline")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run a query over the tables in a folder")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out", help="Parquet folder; without it the first rows are shown")
    run.add_argument("--rows", type=int, default=20)
    report = sub.add_parser("report", help="render queries with small results")
    report.add_argument("names", nargs="+")
    report.add_argument("--data", required=True)
    report.add_argument("--kind", choices=("json", "markdown", "html", "csv"), default="markdown")
    report.add_argument("--out", required=True)
    args = parser.parse_args(argv)

    registry.load_all()
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    names = [args.name] if args.command == "run" else args.names
    if unknown := [n for n in names if n not in registry.QUERIES]:
        parser.error(f"no such query: {', '.join(unknown)}")

    from loomline.session import get_session
    from loomline.sources.sinks import render

    spark = get_session()
    frames = [(n, registry.QUERIES[n](spark, args.data)) for n in names]
    if args.command == "report":
        Path(args.out).write_text(render("Report", frames, args.kind))
    elif args.out:
        frames[0][1].write.mode("overwrite").parquet(args.out)
    else:
        frames[0][1].show(args.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
