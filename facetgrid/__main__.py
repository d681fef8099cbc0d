"""``python -m facetgrid convert FILE... -o data.json``: raw course files to a dataset."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from facetgrid.operators.detail import enrich
from facetgrid.plans.convert import convert, document_parts
from facetgrid.sources import ingest, sample, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("facetgrid").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run_convert(args: argparse.Namespace) -> int:
    spark = session()
    raw, skipped = ingest.read_courses(spark, args.files)
    data = convert(raw)
    for row in [*skipped.orderBy("file_ord", "item").toLocalIterator(), *data.warnings.orderBy("ord").toLocalIterator()]:
        print(f"warning: {row['warning']}", file=sys.stderr)
    if data.courses.isEmpty():
        print("no course data found", file=sys.stderr)
        return 1
    details = enrich(ingest.read_details(spark, args.details_dir)) if args.details_dir else None
    now = args.generated_at or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    if not args.output:
        for row in document_parts(data, now, details).orderBy("part").toLocalIterator():
            print(row["text"], end="")
        print()
        return 0
    sinks.write_dataset(data, args.output, now, details, args.compact)
    sinks.write_index(data, str(Path(args.output).with_name("search.idx")), details, binary=True)
    return 0


def run_sample(args: argparse.Namespace) -> int:
    spark = session()
    sample.courses(spark, args.count, args.seed).drop("file_ord", "item").write.mode("overwrite").json(f"{args.out}/raw")
    sample.details(spark, args.count, args.seed).write.mode("overwrite").json(f"{args.out}/details")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="facetgrid")
    commands = parser.add_subparsers(required=True)
    c = commands.add_parser("convert")
    c.add_argument("files", nargs="+")
    c.add_argument("-o", "--output")
    c.add_argument("--compact", action="store_true")
    c.add_argument("--details-dir")
    c.add_argument("--generated-at")
    c.set_defaults(run=run_convert)
    s = commands.add_parser("sample")
    s.add_argument("out")
    s.add_argument("--count", type=int, default=3000)
    s.add_argument("--seed", type=int, default=42)
    s.set_defaults(run=run_sample)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
