"""``python -m flatsieve FILE [options]``: scan, count, group or validate one file."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .errors import ScanError
from .operators import validate
from .operators.relation import Relation, guarded, streamed
from .sources.readers import open_path
from .sources.sinks import csv_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flatsieve", description="Reads CSV, NDJSON and JSON arrays; the format is inferred from the suffix.")
    p.add_argument("path")
    p.add_argument("--where", help='"col OP val [AND ...]" or "col IN (a, b)"; OP is one of = != > >= < <=')
    p.add_argument("--columns", help="only these, in this order, joined by commas")
    p.add_argument("--limit", type=int)
    p.add_argument("--count", action="store_true", help="print the number of matching rows")
    p.add_argument("--not", dest="negate", action="store_true", help="the rows that --where rejects")
    p.add_argument("--format", choices=("csv", "ndjson"), default="csv", help="of the output")
    p.add_argument("--group-by", help="with --agg: count, sum, min, max and avg by key")
    p.add_argument("--agg")
    p.add_argument("--validate", metavar="SCHEMA", help="a JSON schema file; prints a report and exits with 1 if a row failed")
    p.add_argument("--valid", action="store_true", help="with --validate: the rows that passed")
    p.add_argument("--invalid", action="store_true", help="with --validate: the rows that failed")
    p.add_argument("--max-errors", type=int, help="errors that the report lists (100; 0 is all)")
    return p


def conflicts(a: argparse.Namespace) -> str | None:
    if bool(a.group_by) != bool(a.agg):
        return "--group-by and --agg go together"
    if a.group_by and (a.count or a.columns or a.limit is not None):
        return "--group-by doesn't combine with --count, --columns or --limit"
    if a.count and (a.columns or a.limit is not None):
        return "--count doesn't combine with --columns or --limit"
    if a.validate and (a.where or a.columns or a.limit is not None or a.count or a.group_by or a.negate):
        return "--validate doesn't combine with --where, --columns, --limit, --count, --not or --group-by"
    if (a.valid or a.invalid or a.max_errors is not None) and not a.validate:
        return "--valid, --invalid and --max-errors need --validate"
    if a.valid and a.invalid or (a.valid or a.invalid) and a.max_errors is not None:
        return "--valid, --invalid and --max-errors exclude each other"
    if a.limit is not None and a.limit < 0 or a.max_errors is not None and a.max_errors < 0:
        return "counts aren't negative"
    return None


def _emit(relation: Relation, fields: list[str], format: str, out) -> None:
    if format == "csv":
        values = list(relation.as_dict(fields).values()) if relation.columns is not None else fields
        out.write(csv_text(values) + "\n")
    else:
        out.write(json.dumps(relation.as_dict(fields), ensure_ascii=False, separators=(",", ":")) + "\n")


def _number(x: float | int | None) -> str:
    x = 0 if x is None else x
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def _validate(a: argparse.Namespace, out, err) -> int:
    try:
        with open(a.validate, encoding="utf-8") as f:
            schema = f.read()
        relation = open_path(a.path)
        if not (a.valid or a.invalid):
            r = validate.report(relation, schema, 100 if a.max_errors is None else a.max_errors or None)
            out.write(json.dumps(r.as_dict(), ensure_ascii=False) + "\n")
            return 0 if r.ok else 1
        rows = validate.checked(relation, schema)
        n = F.size("errors")
        for r in streamed(rows.where(n == 0 if a.valid else n > 0).orderBy("_seq")):
            _emit(relation, list(r["_f"]), a.format, out)
        return 0
    except (OSError, ScanError) as e:
        err.write(f"flatsieve: {e}\n")
        return 2 if isinstance(e, OSError) or str(e).startswith(("BadSchema", "UnknownColumn")) else 1


def main(argv: list[str] | None = None, out=sys.stdout, err=sys.stderr) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if said := conflicts(a):
        err.write(f"flatsieve: {said}\n")
        return 2
    if a.validate:
        return _validate(a, out, err)
    try:
        relation = open_path(a.path)
    except ScanError as e:
        err.write(f"flatsieve: cannot open {a.path}: {e}\n")
        return 1
    try:
        relation = relation.where(a.where, a.negate).select(a.columns.split(",") if a.columns else None).limit(a.limit)
        if a.group_by:
            groups = relation.group_by(a.group_by, a.agg)
    except ScanError as e:
        err.write(f"flatsieve: {e}\n")
        return 2
    try:
        if a.group_by:
            names = ["key", "count", "sum", "min", "max", "avg"]
            for r in guarded(groups.orderBy("key").collect):
                cells = [r["key"], *(_number(r[x]) for x in names[1:])]
                out.write((csv_text(cells) if a.format == "csv" else json.dumps(dict(zip(names, cells)), ensure_ascii=False)) + "\n")
        elif a.count:
            out.write(f"{relation.count()}\n")
        else:
            for fields in relation.local():
                _emit(relation, fields, a.format, out)
        return 0
    except ScanError as e:
        err.write(f"flatsieve: {e}\n")
        return 1
