"""Command line: contracts, lint, namespaces, and gated questions (exit 3: refused)."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from .plans import codegen, config, lint


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="trustlake")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("contracts")
    c.add_argument("mode", choices=["generate", "check"])
    c.add_argument("schema")
    c.add_argument("out")
    x = sub.add_parser("lint")
    x.add_argument("paths", nargs="+")
    sub.add_parser("ns")
    for name in ("daily-events", "telco-share"):
        q = sub.add_parser(name)
        q.add_argument("--root", required=True)
        q.add_argument("--start", type=date.fromisoformat, required=True)
        q.add_argument("--end", type=date.fromisoformat, required=True)
    a = p.parse_args(argv)
    if a.cmd == "contracts":
        text = codegen.render_tables(codegen.load_tables(a.schema), a.schema)
        if a.mode == "check":
            return int(codegen.stale(a.out, text))
        with open(a.out, "w") as f:
            f.write(text)
        return 0
    if a.cmd == "lint":
        found = lint.scan_paths(*a.paths)
        print(*found, sep="\n")
        return int(bool(found))
    if a.cmd == "ns":
        print(config.namespace())
        return 0
    from pyspark.sql import SparkSession

    from .operators.gate import Refusal
    from .plans import usage
    from .sources.lake import Lake

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    reader = Lake(spark, a.root, config.namespace(), read_only=True).reader()
    got = (usage.daily_events if a.cmd == "daily-events" else usage.telco_share)(reader, a.start, a.end)
    if isinstance(got, Refusal):
        print(*got.reasons, sep="\n", file=sys.stderr)
        return 3
    if a.cmd == "daily-events":
        got.value.show(1000, False)
    else:
        print(got.value)
    return 0


if __name__ == "__main__":
    sys.exit(main())
