"""Command line: python -m glyphlake audit|inspect|detect|text-audit|check PATH... , also for spark-submit.

Rows go to the standard output as JSON lines, or with --out to a folder as JSON
files.  The exit code is 0 if nothing was found, 1 if something was, 2 for wrong
use, 3 if files could not be read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import reports


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="glyphlake")
    verbs = out.add_subparsers(dest="verb", required=True)
    for name in ("audit", "inspect", "detect", "text-audit", "check"):
        verb = verbs.add_parser(name)
        verb.add_argument("paths", nargs="+", metavar="PATH")
        verb.add_argument("--out", help="a folder for the rows")
        verb.add_argument("--skip", default="", help="more folders to leave out, with commas between")
        verb.add_argument("--stylometry", action="store_true")
        verb.add_argument("--threshold", type=float, default=reports.STYLE_THRESHOLD)
        if name == "audit":
            verb.add_argument("--sarif", action="store_true", help="SARIF documents instead of rows")
        if name == "inspect":
            verb.add_argument("--as", dest="forced", default="", choices=sorted(reports.FORCED), help="take all files for this kind")
            verb.add_argument("--force-text", action="store_true")
        if name == "detect":
            verb.add_argument("--key", default="", help="key of the replay test")
    return out


def emit(rows: DataFrame, out: str | None) -> None:
    if "path" in rows.columns:
        rows = rows.orderBy("path")  # reports without content: the order in which a walk meets files
    lines = rows if rows.columns == ["value"] else reports.json_reports(rows)
    if out:
        lines.write.mode("overwrite").text(out)
    else:
        for row in lines.toLocalIterator():
            print(row.value)


def run(spark: SparkSession, arguments: list[str]) -> int:
    args = parser().parse_args(arguments)
    if not 0 <= args.threshold <= 1:
        print("threshold must be between 0 and 1", file=sys.stderr)
        return 2
    files = api.files_of(spark, args.paths, [s for s in args.skip.split(",") if s])
    if args.verb in ("audit", "check"):
        items, skipped, summary = api.audit(files, style=args.stylometry, threshold=args.threshold)
        told = summary.first()
        if args.verb == "audit":
            sarif = reports.sarif_documents(items).select("value") if args.sarif else None
            emit(sarif if sarif is not None else items.unionByName(skipped.select("path", F.col("reason")), allowMissingColumns=True), args.out)
            if sarif is None and not args.out:
                emit(summary, None)
        else:  # only what calls for action
            emit(items.where("has_c2pa or exists(confidence, c -> c in ('confirmed', 'probable'))").select("path", "findings"), args.out)
        return 1 if told.actionable_files else 3 if not skipped.isEmpty() else 0
    if args.verb == "inspect":
        rows = api.inspect(files, forced=args.forced, force_text=args.force_text, style=args.stylometry, threshold=args.threshold)
        found = F.col("suspicious")
    elif args.verb == "detect":
        rows, found = api.detect(files, key=args.key, threshold=args.threshold), F.col("detected")
    else:
        texts = files.where("content is not null").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        rows, found = api.text_audit(texts), F.lit(True)
    emit(rows, args.out)
    if "report" in rows.columns and not rows.where("report.error is not null").isEmpty():
        return 3
    return 0 if rows.where(found).isEmpty() else 1


def main() -> int:
    if len(sys.argv) < 2 or sys.argv[1] in ("-h", "--help"):
        parser().parse_args(["-h"] if len(sys.argv) > 1 else [])
    spark = SparkSession.builder.appName("glyphlake").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, sys.argv[1:])
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
