"""Job entry point: publish every export from the extract files.

    spark-submit --conf spark.checkpoint.dir=s3://shared/ckpt --py-files wavepanel.zip \\
        wavepanel/__main__.py release \\
        --snapshot 2026-03=s3://x/20260310/detail/*.txt --snapshot 2026-04=... --snapshot 2026-05=... \\
        --events 's3://x/20260512/history/*.txt' --cpi s3://x/cpi.json \\
        --income 2020=s3://x/irs20.csv --income 2021=... --income 2022=... \\
        --home-values s3://x/home_values.csv --out s3://x/published
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _pairs(values: list[str], key_type=str) -> tuple:
    out = []
    for v in values:
        k, _, path = v.partition("=")
        if not path:
            raise SystemExit(f"expected KEY=PATH, got {v!r}")
        out.append((key_type(k), path))
    return tuple(out)


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="wavepanel")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("release", help="materialize the core and publish all exports as CSV")
    r.add_argument("--snapshot", action="append", required=True, help="PERIOD=GLOB, one per period, oldest first")
    r.add_argument("--events", required=True)
    r.add_argument("--cpi", required=True)
    r.add_argument("--income", action="append", required=True, help="TAX_YEAR=CSV")
    r.add_argument("--home-values", required=True)
    r.add_argument("--state", default="FL")
    r.add_argument("--out", required=True)
    a = sub.add_parser("append", help="load one period's extract into the stored snapshots; other periods stay as they are")
    a.add_argument("--snapshot", required=True, help="PERIOD=GLOB")
    a.add_argument("--out", required=True, help="folder of the stored snapshots")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, int]:
    from wavepanel.plans import registration as R
    from wavepanel.plans.release import publish_exports

    args = parse(sys.argv[1:] if argv is None else argv)
    if args.command == "append":
        from wavepanel.sources.text import append_period

        spark = spark or SparkSession.builder.appName("wavepanel-append").getOrCreate()
        ((period, glob),) = _pairs([args.snapshot])
        counts = append_period(spark, args.out, period, glob)
        print(json.dumps(counts, sort_keys=True))
        return counts
    src = R.Sources(
        snapshots=_pairs(args.snapshot),
        events=args.events,
        cpi=args.cpi,
        income=_pairs(args.income, int),
        home_values=args.home_values,
        state=args.state,
    )
    spark = spark or SparkSession.builder.appName("wavepanel-release").getOrCreate()
    counts = publish_exports(spark, src, args.out, P=R)
    print(json.dumps(counts, sort_keys=True))
    return counts


if __name__ == "__main__":
    main()
