"""Queries through the outer surfaces: files with other delimiters, quotes and shapes, bytes, limits, batches, the command line."""

from __future__ import annotations

import io
import json

from pyspark.sql import functions as F

from .. import api, cli
from ..errors import ScanError
from ..operators import validate
from ..sources.readers import InputLimits, from_bytes, from_csv, open_path
from ..sources.sinks import csv_text, write_lines
from . import fixtures
from .catalogue import query


def _read(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _file(spark, sf_dir, name, *columns, format="csv"):
    return fixtures.exported(_read(spark, sf_dir, name, *columns), columns[0], format)


def _said(action) -> str:
    """The code of the ScanError that the action raises."""
    try:
        action()
    except ScanError as e:
        return str(e).split(":")[0]
    return ""


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_tabs(spark, sf_dir):
    return open_path(_file(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", format="tsv"), delimiter="\t", spark=spark).frame()


_ODD = "c_name || ',\"' || c_mktsegment || '\"'"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {_ODD} AS odd FROM customer")
def csv_quoted(spark, sf_dir):
    return _odd(spark, sf_dir, "csv", _ODD)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || chr(10) || chr(9) || '\"é😀\\' || c_mktsegment AS odd FROM customer")
def json_escapes(spark, sf_dir):
    return _odd(spark, sf_dir, "ndjson", "concat(c_name, chr(10), chr(9), '\"é😀\\\\', c_mktsegment)")


def _odd(spark, sf_dir, format, text):
    rows = _read(spark, sf_dir, "customer", "c_custkey", F.expr(text).alias("odd"))
    return open_path(fixtures.exported(rows, "c_custkey", format), spark=spark).frame()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def bytes_source(spark, sf_dir):
    with open(_file(spark, sf_dir, "nation", "n_nationkey", "n_name"), "rb") as f:
        rows = from_bytes(f.read(), spark=spark).dicts()
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey string, n_name string")


@query("SELECT * FROM (VALUES ('empty csv', 'EmptyFile'), ('empty ndjson', 'EmptyFile'), ('empty array', 'EmptyFile'), ('header', '')) t(file, said)")
def empty_files(spark, sf_dir):
    texts = {"empty csv": ("e.csv", ""), "empty ndjson": ("e.ndjson", " \n"), "empty array": ("e.json", "[ ]"), "header": ("h.csv", "a,b\n")}
    said = [(k, _said(lambda: open_path(fixtures.literal(*v), spark=spark).dicts())) for k, v in texts.items()]  # noqa: B023
    return spark.createDataFrame(said, "file string, said string")


_LIMITS = [("csv", 0, ""), ("csv", 1, "RecordTooLarge"), ("csv", 2, "TooManyFields"), ("ndjson", 0, ""), ("ndjson", 1, "RecordTooLarge"), ("ndjson", 2, "TooManyFields"), ("json", 0, ""), ("json", 1, "RecordTooLarge"), ("json", 2, "TooManyFields")]


@query(f"SELECT * FROM (VALUES {', '.join(map(repr, _LIMITS))}) t(format, bound, said)")
def input_limits(spark, sf_dir):
    bounds = [InputLimits(4096, 3), InputLimits(20, None), InputLimits(None, 2)]
    path = {f: _file(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", format=f) for f in ("csv", "ndjson", "json")}
    made = [(f, i, _said(lambda: open_path(path[f], limits=bounds[i], spark=spark).aggregate("c_mktsegment").head())) for f, i, _ in _LIMITS]  # noqa: B023
    return spark.createDataFrame(made, "format string, bound int, said string")


@query('SELECT count(*) AS "count" FROM orders')
def count_csv(spark, sf_dir):
    return spark.createDataFrame([(api.count(_file(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")),)], "count long")


def _printed(spark, *arguments):
    out = io.StringIO()
    code = cli.main(list(arguments), out, out)
    return spark.createDataFrame([(code, i, line) for i, line in enumerate(out.getvalue().split("\n")[:-1])], "code int, line int, value string")


_LINE = "CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS line"


@query(f"SELECT 0 AS code, {_LINE}, s_name || ',' || s_suppkey AS value FROM supplier WHERE s_nationkey >= 5")
def cli_csv(spark, sf_dir):
    return _printed(spark, _file(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"), "--where", "s_nationkey >= 5", "--columns", "s_name,s_suppkey")


@query(f"""SELECT 0 AS code, {_LINE}, '{{"s_suppkey":"' || s_suppkey || '","s_name":"' || s_name || '","s_nationkey":"' || s_nationkey || '"}}' AS value FROM supplier WHERE NOT s_nationkey >= 5""")
def cli_ndjson(spark, sf_dir):
    return _printed(spark, _file(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"), "--where", "s_nationkey >= 5", "--not", "--format", "ndjson")


@query("""SELECT 0 AS code, CAST(row_number() OVER (ORDER BY n_regionkey) - 1 AS INT) AS line,
n_regionkey || ',' || count(*) || ',' || sum(n_nationkey) || ',' || min(n_nationkey) || ',' || max(n_nationkey) || ',' || regexp_replace(CAST(avg(n_nationkey) AS VARCHAR), '[.]0$', '') AS value FROM nation GROUP BY n_regionkey""")
def cli_group_by(spark, sf_dir):
    return _printed(spark, _file(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), "--group-by", "n_regionkey", "--agg", "n_nationkey")


@query("SELECT 1 AS code, count(*) AS rows_total, count(*) FILTER (WHERE c_acctbal < 0) AS rows_invalid, count(*) FILTER (WHERE c_acctbal < 0) AS below_min, least(count(*) FILTER (WHERE c_acctbal < 0), 5) AS listed FROM customer")
def cli_validate(spark, sf_dir):
    path = _file(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    out = io.StringIO()
    code = cli.main([path, "--validate", fixtures.literal("schema.json", '{"c_acctbal": {"type": "float", "min": 0}}'), "--max-errors", "5"], out, out)
    r = json.loads(out.getvalue())
    return spark.createDataFrame([(code, r["rows_total"], r["rows_invalid"], r["counts"].get("below_min", 0), len(r["errors"]))], "code int, rows_total long, rows_invalid long, below_min long, listed long")


@query("SELECT CAST(n // 7 AS INT) AS batch, CAST(n % 7 AS INT) AS place, CAST(s_suppkey AS VARCHAR) AS s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier)")
def scan_batches(spark, sf_dir):
    found = api.scan_batches(_file(spark, sf_dir, "supplier", "s_suppkey", "s_name"), columns=["s_suppkey"], batch_size=7)
    return spark.createDataFrame([(i, j, r["s_suppkey"]) for i, b in enumerate(found) for j, r in enumerate(b)], "batch int, place int, s_suppkey string")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def scan_array(spark, sf_dir):
    found = api.scan_array(_file(spark, sf_dir, "supplier", "s_suppkey", "s_name"))
    return spark.createDataFrame(list(zip(found["s_suppkey"], found["s_name"])), "s_suppkey string, s_name string")


_SHAPE = "CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey AS {s}) WHEN c_custkey % 11 = 0 THEN c_custkey || ',' || c_mktsegment || ',more' ELSE c_custkey || ',' || c_mktsegment END"


@query("SELECT count(*) AS rows_total, count(*) FILTER (WHERE c_custkey % 7 = 0) AS too_few_fields, count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0) AS too_many_fields FROM customer")
def validate_structure(spark, sf_dir):
    path = fixtures.path("shape.csv")
    rows = _read(spark, sf_dir, "customer", F.col("c_custkey").alias("_seq"), F.expr(_SHAPE.format(s="STRING")).alias("value"))
    write_lines(rows, path, csv_text(["c_custkey", "c_mktsegment"]) + "\n")
    return validate.report_counts(from_csv("file://" + path, spark=spark), {"c_custkey": {"type": "integer"}}).select("rows_total", "too_few_fields", "too_many_fields")


@query("SELECT count(*) FILTER (WHERE length(c_mktsegment) < 9) AS too_short, count(*) FILTER (WHERE length(c_mktsegment) > 9) AS too_long, count(*) FILTER (WHERE length(c_mktsegment) <> 9) AS rows_invalid FROM customer")
def validate_lengths(spark, sf_dir):
    path = _file(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return validate.report_counts(open_path(path, spark=spark), {"c_mktsegment": {"min_len": 9, "max_len": 9}}).select("too_short", "too_long", "rows_invalid")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CAST((s_nationkey < 5) AS BIGINT) AS n_errors FROM supplier")
def validate_iter(spark, sf_dir):
    found = api.validate_iter(_file(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), {"s_nationkey": {"min": 5}})
    return spark.createDataFrame([(r["s_suppkey"], len(errors)) for r, errors in found], "s_suppkey string, n_errors long")


@query("SELECT CAST(n // 9 AS INT) AS batch, CAST(s_suppkey AS VARCHAR) AS s_suppkey, CAST((s_nationkey < 5) AS BIGINT) AS n_errors FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier)")
def validate_batches(spark, sf_dir):
    found = api.validate_batches(_file(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), {"s_nationkey": {"min": 5}}, batch_size=9, as_dict=False)
    return spark.createDataFrame([(i, r[0], len(errors)) for i, b in enumerate(found) for r, errors in b], "batch int, s_suppkey string, n_errors long")
