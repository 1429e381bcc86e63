"""python -m tallymark.cli diff|parse|ingest: exit code 0 identical, 1 different, 2 error."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import CompareOptions, Dialect, DiffOptions, EmitOptions, HeaderLayout, Limits, ReconcileError, Source, compare
from .sinks import emitters
from .sources import strict_csv


def counts_text(summary: dict) -> str:
    rows, cells, found, matching, columns = (summary[k] for k in ("rows", "cells", "findings", "matching", "columns"))
    out = [("matching", "all columns" if matching["allKeys"] else "by key"),
        ("columns", f"{columns['compared']} compared" + (f", {columns['added']} added and {columns['removed']} removed in the target" if columns["added"] or columns["removed"] else ""))]
    out += [("unchanged", rows["unchanged"]), ("modified", f"{rows['modified']}  ({cells['changed']} cells)"), ("added", rows["added"]), ("deleted", rows["deleted"]),
        ("moved", f"{rows['moved']}{'  (forced off)' if matching['movesForcedOff'] else ''}")]
    out.append(("suppressed", f"{cells['suppressed']} cells differ only in formatting"))
    if found["enabled"]:
        out.append(("findings",
            f"{found['total']} cells in {found['rows']} rows ({found['requiredEmpty']} required empty, {found['tooLong']} too long, {found['notNumeric']} not numeric, {found['precision']} out of precision)"))
    if matching["pairedBySimilarity"]:
        out.append(("paired", f"{matching['pairedBySimilarity']} by similarity"))
    if matching["pairingTruncated"]:
        out.append(("warning", "similarity pairing was truncated"))
    out.append(("report rows", rows["report"]))
    return "".join(f"{name:<16}{value}\n" for name, value in out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallymark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "ingest"):
        one = sub.add_parser(name)
        one.add_argument("file")
        one.add_argument("--max-mb", type=int, default=150)
        one.add_argument("--delimiter", default=",")
    d = sub.add_parser("diff")
    d.add_argument("source")
    d.add_argument("target")
    d.add_argument("--format", choices=["counts", *emitters.FORMATS], default="counts")
    d.add_argument("--header", type=int, default=4, help="header rows of the source")
    d.add_argument("--delimiter", default=",")
    d.add_argument("--changes-only", action="store_true")
    d.add_argument("--no-values", action="store_true")
    d.add_argument("--no-trim", action="store_true")
    d.add_argument("--no-moves", action="store_true")
    d.add_argument("--no-validate", action="store_true")
    d.add_argument("--no-guard", action="store_true")
    d.add_argument("--unordered", action="store_true")
    d.add_argument("--require-key", action="store_true")
    d.add_argument("--allow-added", action="store_true")
    d.add_argument("--allow-removed", action="store_true")
    d.add_argument("--deleted", choices=["anchored", "end"], default="anchored")
    d.add_argument("--cell-diff", choices=["none", "word", "character", "both"], default="none")
    d.add_argument("--similarity", type=int)
    d.add_argument("--max-mb", type=int, default=150)
    d.add_argument("--max-rows", type=int, default=0)
    d.add_argument("--max-cell-bytes", type=int, default=0)
    d.add_argument("--class-prefix", default="tally")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        spark = spark or SparkSession.builder.appName("tallymark").getOrCreate()
        if a.command != "diff":
            limits = Limits(max_bytes=a.max_mb << 20)
            contents = strict_csv.read_files(spark, a.file, limits)
            if a.command == "ingest":
                out.write(json.dumps(strict_csv.byte_counts(contents)) + "\n")
            else:
                out.write(json.dumps(asdict(strict_csv.scan(spark, contents, Dialect(a.delimiter), limits)[1])) + "\n")
            return 0
        emit = EmitOptions(a.changes_only, not a.no_values, a.cell_diff, a.max_cell_bytes, a.max_rows, not a.no_guard, ",", a.class_prefix)
        options = DiffOptions(
            CompareOptions(trim=not a.no_trim, allow_added_columns=a.allow_added, allow_removed_columns=a.allow_removed), HeaderLayout(a.header),
            detect_moves=not a.no_moves,
            source_ordered=not a.unordered, validate=not a.no_validate, require_key=a.require_key, deleted=a.deleted, similarity_percent=a.similarity,
        )
        diff = compare(spark, Source.csv(a.source), Source.csv(a.target), options, Dialect(a.delimiter), limits=Limits(max_bytes=a.max_mb << 20))
        out.write(counts_text(diff.summary) if a.format == "counts" else diff.emit_text(a.format, emit))
        return 0 if diff.summary["identical"] else 1
    except (ReconcileError, PySparkException) as e:
        sys.stderr.write(f"{e}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
