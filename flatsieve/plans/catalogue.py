"""Named queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import num
from ..operators import profile, validate
from ..operators.relation import Relation
from ..sources.readers import as_text, from_csv, from_json, from_table, open_path
from ..sources.sinks import validate_to_files
from ..sources.tokenizer import tokenized
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEYS = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "events": ["event_id"]}
SUMMARY = {"count": "count", "sum": "sum", "min": "min", "max": "max", "avg": "avg"}


def query(sql: str) -> Callable:
    """Registers a query under its function's name, with its oracle."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    return from_table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name])


def rounded(df: DataFrame) -> DataFrame:
    """Sums and means in the last bits depend on order, so what is compared is rounded."""
    return df.withColumns({c: F.round(c, 2) for c in ("sum", "avg") if c in df.columns})


def _sql_summary(x: str) -> str:
    return f'count({x}) AS "count", round(coalesce(sum(CAST({x} AS DOUBLE)), 0.0), 2) AS "sum", min(CAST({x} AS DOUBLE)) AS "min", max(CAST({x} AS DOUBLE)) AS "max", round(avg({x}), 2) AS "avg"'


# filters


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_numeric(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(["l_orderkey", "l_linenumber", "l_quantity"]).frame()


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def filter_string(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = R").select(["l_orderkey", "l_linenumber", "l_returnflag"]).frame()


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in_string(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderpriority IN (1-URGENT, 2-HIGH)").select(["o_orderkey", "o_orderpriority"]).frame()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3, 7)")
def filter_in_numeric(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 3.0, 7)").select(["l_orderkey", "l_linenumber"]).frame()


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30 AND l_discount < 0.05")
def filter_and(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = R AND l_quantity >= 30 AND l_discount < 0.05").select(["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]).frame()


@query("SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem WHERE l_linestatus <> 'O'")
def filter_neq(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linestatus != O").select(["l_orderkey", "l_linenumber", "l_linestatus"]).frame()


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000900'")
def filter_range_string(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_name >= Customer#000000100 AND c_name < Customer#000000900").select(["c_custkey", "c_name"]).frame()


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
def filter_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderdate >= 1996-01-01 AND o_orderdate < 1996-03-01").select(["o_orderkey", "o_orderdate"]).frame()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey <= 5000")
def filter_structured(spark, sf_dir):
    return table(spark, sf_dir, "orders").where([("o_orderstatus", "=", "F"), ("o_orderkey", "<=", 5000)]).select(["o_orderkey", "o_orderstatus"]).frame()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 200000 AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def filter_text_numeric_first(spark, sf_dir):
    rows = as_text(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return rows.where("o_totalprice > 2e5 AND o_custkey IN (1, 2, 3, 5.0, 8, 13, 21, 34, 55, 89)").select(["o_orderkey", "o_orderstatus"]).frame()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity > 25)")
def negate_and(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = R AND l_quantity > 25", negate=True).select(["l_orderkey", "l_linenumber"]).frame()


@query("SELECT l_orderkey FROM lineitem WHERE false")
def negate_no_where(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(None, negate=True).select(["l_orderkey"]).frame()


@query("SELECT count(*) FILTER (WHERE l_quantity > 25) AS kept, count(*) FILTER (WHERE NOT (l_quantity > 25)) AS rejected, count(*) AS total FROM lineitem")
def partition_counts(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    n = lambda r, name: r.count_frame().withColumnRenamed("count", name)
    return n(t.where("l_quantity > 25"), "kept").crossJoin(n(t.where("l_quantity > 25", negate=True), "rejected")).crossJoin(n(t, "total"))


# projection and limits


@query("SELECT o_orderpriority, o_orderkey, o_custkey FROM orders WHERE o_custkey < 100")
def project_reorder(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_custkey < 100").select(["o_orderpriority", "o_orderkey", "o_custkey"]).frame()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50")
def limit_first_n(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = O").select(["o_orderkey", "o_orderstatus"]).limit(50).frame()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def first_match(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = BUILDING").select(["c_custkey", "c_mktsegment"]).limit(1).frame()


# counts and aggregates


@query('SELECT count(*) AS "count" FROM lineitem')
def count_all(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").count_frame()


@query("SELECT count(*) AS \"count\" FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def count_where(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = R AND l_quantity > 45").count_frame()


@query("SELECT count(*) AS \"count\" FROM lineitem WHERE NOT (l_returnflag IN ('R', 'A'))")
def count_negate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag IN (R, A)", negate=True).count_frame()


@query('SELECT least(count(*), 100) AS "count" FROM lineitem WHERE l_quantity > 10')
def count_limit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 10").limit(100).count_frame()


@query(f"SELECT {_sql_summary('l_extendedprice')} FROM lineitem")
def aggregate_all(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").aggregate("l_extendedprice"))


@query(f"SELECT {_sql_summary('l_quantity')} FROM lineitem WHERE l_discount >= 0.05")
def aggregate_where(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").where("l_discount >= 0.05").aggregate("l_quantity"))


@query(f"SELECT {_sql_summary('l_quantity')} FROM lineitem WHERE l_quantity < 0")
def aggregate_empty(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").where("l_quantity < 0").aggregate("l_quantity"))


@query("SELECT count(x) AS \"count\", coalesce(sum(x), 0.0) AS \"sum\", min(x) AS \"min\", max(x) AS \"max\", round(avg(x), 2) AS \"avg\" FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS x FROM part)")
def aggregate_mixed_text(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rounded(as_text(part.select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("v"))).aggregate("v"))


@query(f'SELECT l_returnflag AS "key", {_sql_summary("l_extendedprice")} FROM lineitem GROUP BY 1')
def group_by_flag(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").group_by("l_returnflag", "l_extendedprice"))


@query(f'SELECT l_returnflag AS "key", {_sql_summary("l_extendedprice")} FROM lineitem WHERE l_quantity > 45 GROUP BY 1')
def group_by_where(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").where("l_quantity > 45").group_by("l_returnflag", "l_extendedprice"))


@query(f'SELECT CAST(user_id AS VARCHAR) AS "key", {_sql_summary("value")} FROM events WHERE user_id IS NOT NULL GROUP BY 1')
def group_by_high_card(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").group_by("user_id", "value"))


@query(f'SELECT c_mktsegment AS "key", {_sql_summary("c_nationkey")} FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 500) GROUP BY 1')
def group_by_after_limit(spark, sf_dir):
    return rounded(table(spark, sf_dir, "customer").limit(500).group_by("c_mktsegment", "c_nationkey"))


# top-k and order


@query("SELECT o_orderkey, o_totalprice, o_totalprice AS _key FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_desc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(["o_orderkey", "o_totalprice"]).topk("o_totalprice", 20)


@query("SELECT o_orderkey, o_totalprice, o_totalprice AS _key FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def topk_asc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(["o_orderkey", "o_totalprice"]).topk("o_totalprice", 20, descending=False)


@query("SELECT c_custkey, c_mktsegment, c_acctbal AS _key FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def topk_where(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = MACHINERY").select(["c_custkey", "c_mktsegment"]).topk("c_acctbal", 10)


@query("SELECT o_orderkey, o_totalprice AS _key FROM orders LIMIT 0")
def topk_k_zero(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(["o_orderkey"]).topk("o_totalprice", 0)


def _ranked(df: DataFrame) -> DataFrame:
    """The place of every row of a sorted result, so that the comparison sees the order."""
    part, at = F.shiftright(F.monotonically_increasing_id(), 33), F.monotonically_increasing_id()
    return df.coalesce(1).select("*", (at - F.shiftleft(part, 33) + 1).alias("rank"))


@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier")
def order_numeric(spark, sf_dir):
    t = from_table(spark.read.parquet(f"{sf_dir}/supplier.parquet"), ["s_suppkey"])
    return _ranked(t.select(["s_suppkey", "s_acctbal"]).order_by("s_acctbal"))


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name DESC, n_nationkey) AS rank FROM nation")
def order_string(spark, sf_dir):
    t = from_table(spark.read.parquet(f"{sf_dir}/nation.parquet"), ["n_nationkey"])
    return _ranked(t.select(["n_nationkey", "n_name"]).order_by("n_name", descending=True))


@query("SELECT * FROM (VALUES ('', 1), ('-5', 2), ('9', 3), ('10', 4), ('1e3', 5), ('5x', 6), ('Zürich', 7), ('abc', 8), ('nan', 9)) t(v, rank)")
def order_mixed(spark, sf_dir):
    texts = ["abc", "10", "9", "nan", "", "1e3", "5x", "-5", "Zürich"]
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "_seq long, _f array<string>")
    return _ranked(Relation(rows, ["v"], text=True).order_by("v"))


# the number rule and text formats

NUMBERS = {"1": True, "-1.5": True, "+.5": True, "5.": True, "1e3": True, "1E-3": True, " 1": False, "1 ": False, "": False, ".": False, "nan": False, "inf": False, "Infinity": False, "1d": False, "1f": False, "1_000": False, "0x10": False, "1e309": False, "--1": False, "1e": False}


@query(f"SELECT * FROM (VALUES {', '.join(f'({k!r}, {str(v).lower()})' for k, v in NUMBERS.items())}) t(literal, is_number)")
def numeric_guard(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in NUMBERS], "literal string").select("literal", num(F.col("literal")).isNotNull().alias("is_number"))


LINES = ['a,b,c', 'a,,c', ',', '', '"x,y",z', '"say ""hi""",2', '"t" stray,u', 'mid"quote,v', '"",w', 'é,ü']
FIELDS = [["a", "b", "c"], ["a", "", "c"], ["", ""], [""], ["x,y", "z"], ['say "hi"', "2"], ["t", "u"], ['mid"quote', "v"], ["", "w"], ["é", "ü"]]


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {j}, {chr(39)}{f}{chr(39)})' for i, row in enumerate(FIELDS) for j, f in enumerate(row))}) t(line, pos, field)")
def csv_tokenize(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line int, value string")
    return lines.select("line", F.posexplode(tokenized(F.col("value"))).alias("pos", "field"))


@query("SELECT * FROM (VALUES (1, 'a', '1'), (1, 'b', '2'), (1, 'c', '3'), (2, 'a', '4'), (2, 'b', '5'), (3, 'a', '6'), (4, 'a', '7'), (4, 'b', '8'), (4, 'c', '9'), (4, 'col3', 'EXTRA')) t(row, name, value)")
def csv_ragged(spark, sf_dir):
    rows = from_csv("file://" + fixtures.literal("ragged.csv", "a,b,c\n1,2,3\n4,5\n6\n7,8,9,EXTRA"), spark=spark).dicts()
    return spark.createDataFrame([(i, k, v) for i, r in enumerate(rows, 1) for k, v in r.items()], "row int, name string, value string")


@query("SELECT * FROM (VALUES (true)) t(raised)")
def csv_unterminated_flag(spark, sf_dir):
    from ..errors import ScanError

    try:
        from_csv("file://" + fixtures.literal("bad.csv", 'a,b\n1,"oops\n'), spark=spark).dicts()
        raised = False
    except ScanError as e:
        raised = "UnterminatedQuote" in str(e)
    return spark.createDataFrame([(raised,)], "raised boolean")


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_ORDERS_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders WHERE o_custkey <= 300 AND o_orderstatus = 'F'"


def _orders(spark, sf_dir, format):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_ORDERS)
    return open_path(fixtures.exported(rows, "o_orderkey", format), spark=spark).where("o_custkey <= 300 AND o_orderstatus = F").select(["o_orderkey", "o_orderpriority"]).frame()


@query(_ORDERS_SQL)
def csv_scan(spark, sf_dir):
    return _orders(spark, sf_dir, "csv")


@query(_ORDERS_SQL)
def ndjson_scan(spark, sf_dir):
    return _orders(spark, sf_dir, "ndjson")


@query(_ORDERS_SQL)
def json_array_scan(spark, sf_dir):
    return _orders(spark, sf_dir, "json")


@query("SELECT * FROM (VALUES ('3.50', 'x'), ('1e3', ''), ('123456789012345678901234567890.10', 'true'), ('-0', '')) t(n, s)")
def json_number_text(spark, sf_dir):
    text = '{"n": 3.50, "s": "x"}\n{"n": 1e3}\n{"s": true, "n": 123456789012345678901234567890.10, "extra": 1}\n{"n": -0, "s": null}\n'
    return from_json("file://" + fixtures.literal("n.ndjson", text), spark=spark).frame()


# discovery


@query("SELECT * FROM (VALUES (0, 'c_custkey', 'integer'), (1, 'c_name', 'string'), (2, 'c_acctbal', 'float'), (3, 'c_mktsegment', 'string')) t(position, \"column\", type)")
def describe(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return profile.describe_frame(open_path(fixtures.exported(rows, "c_custkey"), spark=spark))


@query("SELECT * FROM (VALUES ('a', 'boolean'), ('b', 'integer'), ('c', 'float'), ('d', 'datetime'), ('e', 'string'), ('f', 'empty')) t(\"column\", type)")
def describe_types(spark, sf_dir):
    text = "a,b,c,d,e,f\ntrue,1,1.5,2024-01-31,x,\nFALSE,-2,1e3,2024-02-29T10:00:00Z,1,\n,,,,,\n"
    return profile.describe_frame(from_csv("file://" + fixtures.literal("t.csv", text), spark=spark)).select("column", "type")


@query("SELECT * FROM (VALUES (0, 'o_orderkey'), (1, 'o_custkey'), (2, 'o_orderstatus'), (3, 'o_orderpriority')) t(position, \"column\")")
def schema(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_ORDERS)
    header = open_path(fixtures.exported(rows, "o_orderkey"), spark=spark).header
    return spark.createDataFrame(list(enumerate(header)), "position int, column string")


@query("SELECT * FROM (VALUES ('c_custkey', 'integer', true), ('c_mktsegment', NULL, true)) t(\"column\", type, required)")
def infer_schema(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    draft = profile.infer_schema(open_path(fixtures.exported(rows, "c_custkey"), spark=spark), required=True)
    return spark.createDataFrame([(k, v.get("type"), v.get("required")) for k, v in draft.items()], "column string, type string, required boolean")


@query(f"""SELECT 'c_custkey' AS "column", (SELECT count(*) FROM customer) AS row_count, {_sql_summary('c_custkey')} FROM customer
UNION ALL SELECT 'c_nationkey', (SELECT count(*) FROM customer), {_sql_summary('c_nationkey')} FROM customer""")
def profile_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    p = profile.profile(open_path(fixtures.exported(rows, "c_custkey"), spark=spark))
    made = [(c, p["row_count"], *(v[k] for k in SUMMARY)) for c, v in p["numeric_columns"].items()]
    return rounded(spark.createDataFrame(made, "column string, row_count long, count long, sum double, min double, max double, avg double"))


# validation

RULES = {
    "c_custkey": {"type": "integer", "required": True, "max": 1000},
    "c_name": {"type": "string", "min_len": 5, "max_len": 30},
    "c_nationkey": {"type": "integer", "min": 3},
    "c_acctbal": {"type": "float", "min": 0},
    "c_mktsegment": {"one_of": ["BUILDING", "MACHINERY", "HOUSEHOLD"]},
}
_BAD = {"above_max": "c_custkey > 1000", "below_key": "c_nationkey < 3", "below_balance": "c_acctbal < 0", "not_in_set": "c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"}
_ANY = " OR ".join(_BAD.values())
_N = " + ".join(f"CAST({c} AS INT)" for c in _BAD.values())


def _customers(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(f"""SELECT count(*) AS rows_total, count(*) FILTER (WHERE NOT ({_ANY})) AS rows_valid, count(*) FILTER (WHERE {_ANY}) AS rows_invalid,
CAST(sum({_N}) AS BIGINT) AS errors_total, CAST(0 AS BIGINT) AS too_few_fields, CAST(0 AS BIGINT) AS too_many_fields, CAST(0 AS BIGINT) AS missing_required, CAST(0 AS BIGINT) AS bad_type,
count(*) FILTER (WHERE c_nationkey < 3) + count(*) FILTER (WHERE c_acctbal < 0) AS below_min, count(*) FILTER (WHERE c_custkey > 1000) AS above_max,
CAST(0 AS BIGINT) AS too_short, CAST(0 AS BIGINT) AS too_long, count(*) FILTER (WHERE {_BAD['not_in_set']}) AS not_in_set FROM customer""")
def validate_report_counts(spark, sf_dir):
    return validate.report_counts(as_text(_customers(spark, sf_dir)), RULES)


_NARROW = {k: RULES[k] for k in ("c_nationkey", "c_mktsegment")}
_ERRORS_SQL = """SELECT row, CAST(row_number() OVER (PARTITION BY row ORDER BY "column") - 1 AS INT) AS pos, "column", column_name, rule, value FROM (
SELECT n AS row, 2 AS "column", 'c_nationkey' AS column_name, 'below_min' AS rule, CAST(c_nationkey AS VARCHAR) AS value FROM c WHERE c_nationkey < 3
UNION ALL SELECT n, 4, 'c_mktsegment', 'not_in_set', c_mktsegment FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))"""
_WITH_N = "WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) "


@query(f"{_WITH_N}{_ERRORS_SQL} ORDER BY row, pos LIMIT 25")
def validate_error_prefix(spark, sf_dir):
    return validate.first_errors(open_path(fixtures.exported(_customers(spark, sf_dir), "c_custkey"), spark=spark), _NARROW, 25)


@query(f"{_WITH_N}{_ERRORS_SQL}")
def validate_errors(spark, sf_dir):
    return validate.error_rows(open_path(fixtures.exported(_customers(spark, sf_dir), "c_custkey"), spark=spark), _NARROW)


@query(f"SELECT count(*) FILTER (WHERE {_ANY}) = 0 AS valid FROM customer")
def validate_fast(spark, sf_dir):
    return spark.createDataFrame([(validate.is_valid(as_text(_customers(spark, sf_dir)), RULES),)], "valid boolean")


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST({_N} AS INT) AS n_errors FROM customer WHERE {_ANY}")
def validate_full_rows(spark, sf_dir):
    rows = validate.checked(as_text(_customers(spark, sf_dir)), RULES).where(F.size("errors") > 0)
    return rows.select(F.col("_f")[0].alias("c_custkey"), F.size("errors").alias("n_errors"))


_CELLS = [
    ("integer", " 42 ", ""), ("integer", "4.2", "bad_type"), ("float", " 3.5", ""), ("float", "nan", "bad_type"), ("boolean", "TRUE", ""), ("boolean", "yes", "bad_type"),
    ("datetime", "2024-02-29", ""), ("datetime", "2023-02-29", "bad_type"), ("datetime", "2000-02-29T23:59:60Z", ""), ("datetime", "1900-02-29", "bad_type"), ("datetime", "2024-04-31", "bad_type"),
    ("datetime", "2024-01-01 10:00", ""), ("datetime", "2024-01-01T10:00:00.123-23:59", ""), ("datetime", "2024-01-01T10:00+99:99", "bad_type"), ("datetime", "2024-01-01Z", "bad_type"), ("datetime", "0000-01-01", "bad_type"), ("datetime", "2024-01-01T24:00", "bad_type"),
    ("integer", " ", "missing_required"), ("string", "any", ""),
]


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {r!r})' for i, (_, _, r) in enumerate(_CELLS))}) t(id, rule)")
def validate_types(spark, sf_dir):
    from ..operators.rules import compile_schema, row_errors

    out = None
    for kind in dict.fromkeys(k for k, _, _ in _CELLS):
        rows = spark.createDataFrame([(i, [v]) for i, (k, v, _) in enumerate(_CELLS) if k == kind], "id int, _f array<string>")
        found = rows.select("id", F.array_join(F.transform(row_errors(compile_schema({"v": {"type": kind, "required": True}}, ["v"]), F.col("_f"), 1), lambda e: e["rule"]), ",").alias("rule"))
        out = found if out is None else out.unionAll(found)
    return out


_ROUTE = {"c_nationkey": {"type": "integer", "min": 3}}


def _import(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    good, bad = fixtures.path("good.csv"), fixtures.path("bad.jsonl")
    validate_to_files(open_path(fixtures.exported(rows, "c_custkey"), spark=spark), _ROUTE, good, bad)
    return good, bad


@query("SELECT 'c_custkey,c_nationkey,c_mktsegment' || chr(13) AS value UNION ALL SELECT c_custkey || ',' || c_nationkey || ',' || c_mktsegment || chr(13) FROM customer WHERE c_nationkey >= 3")
def import_accepted(spark, sf_dir):
    return spark.read.text("file://" + _import(spark, sf_dir)[0], lineSep="\n")


@query("""SELECT '{"values":["' || c_custkey || '","' || c_nationkey || '","' || c_mktsegment || '"],"errors":[{"column":1,"column_name":"c_nationkey","rule":"below_min","value":"' || c_nationkey || '"}]}' AS value FROM customer WHERE c_nationkey < 3""")
def import_rejected(spark, sf_dir):
    return spark.read.text("file://" + _import(spark, sf_dir)[1], lineSep="\n")
