"""Scans, filters, aggregates and orders against the plain-Python oracle, over three formats."""

import json

import oracle
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import flatsieve as fs
from flatsieve.errors import ScanError
from flatsieve.functions.predicates import Predicate, compare_typed, parse_where
from flatsieve.sources.readers import InputLimits, from_bytes, open_path

HEADER = ["id", "name", "amount", "city"]
ROWS = [
    ["1", "ann", "-5", "Zürich"], ["2", "bob", "0", ""], ["3", "cid", "1e3", "Oslo"], ["4", "dan", "", "Rome"], ["5", "eve", "nan", "Oslo"],
    ["6", "fay", "3.50", "rome"], ["7", "gus", "999999999999", "Z"], ["8", "hal", "9", "a,b"], ["9", "ivy", "10", 'say "hi"'], ["10", "joe", "5x", "Mine IN Town"],
]
WHERES = [
    [], [("amount", ">", "1")], [("amount", "=", "3.5")], [("amount", "=", "1000")], [("amount", "!=", "0")], [("name", ">=", "dan")], [("city", "=", "")],
    [("amount", "in", ("9", "10.0", "5x"))], [("city", "in", ("Oslo", "Rome"))], [("id", "<=", "5"), ("city", "!=", "Oslo")], [("amount", "<", "nan")], [("city", ">", "Z")],
]


def quoted(v):
    return '"' + v.replace('"', '""') + '"' if any(x in v for x in ',"') else v


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "d.csv").write_text("\n".join(",".join(map(quoted, r)) for r in [HEADER, *ROWS]) + "\n")
    objects = [dict(zip(HEADER, r)) for r in ROWS]
    (d / "d.ndjson").write_text("".join(json.dumps(o, ensure_ascii=False) + "\n" for o in objects))
    (d / "d.json").write_text(json.dumps(objects))
    (d / "ragged.csv").write_text("a,b,c\n1,2,3\n4,5\n6\n7,8,9,EXTRA\n")
    (d / "bad.csv").write_text('a,b\n1,2\n3,"oops\n')
    (d / "empty.csv").write_text("")
    (d / "blank.csv").write_text("a,b\r\n1,2\r\n\r\n3,4")
    return d


@pytest.mark.parametrize("name", ["d.csv", "d.ndjson", "d.json"])
def test_matrix(files, name):
    """Every condition and its complement, in each format; both together are all rows."""
    path = files / name
    for where in WHERES:
        want = [dict(zip(HEADER, r)) for r in oracle.select(HEADER, ROWS, where)]
        assert list(fs.scan(path, where=where)) == want, where
        rest = list(fs.scan(path, where=where, negate=True))
        assert rest == [dict(zip(HEADER, r)) for r in oracle.select(HEADER, ROWS, where, True)], where
        assert fs.count(path, where=where) == len(want)
        if where:
            assert len(want) + len(rest) == len(ROWS)


def test_projection_limit_and_text_where(files):
    path = files / "d.csv"
    assert list(fs.scan(path, columns=["city", "id"], where="amount > 1 AND city != Oslo", limit=2)) == [{"city": "rome", "id": "6"}, {"city": "Z", "id": "7"}]
    assert fs.count(path) == 10
    assert fs.count(path, limit=3) == 3
    assert open_path(path).where("id > 8").first()["name"] == "ivy"
    assert open_path(path).where("id > 80").first() is None
    assert fs.scan_array(path, columns=["id"], limit=2) == {"id": ["1", "2"]}
    assert [len(b) for b in fs.scan_batches(path, batch_size=4)] == [4, 4, 2]
    assert [len(b) for b in fs.scan_batches(path, target_bytes=1)] == [1] * 10
    assert next(iter(fs.scan_batches(path, as_dict=False)))[0] == tuple(ROWS[0])
    with pytest.raises(ValueError):
        fs.scan_batches(path, batch_size=0)


def test_where_grammar():
    assert parse_where("a>=1 AND  AND b IN (x, y)") == [Predicate("a", ">=", "1"), Predicate("b", "in", ("x", "y"))]
    assert parse_where("name = Mine IN Town") == [Predicate("name", "=", "Mine IN Town")]
    assert parse_where("name = a>b") == [Predicate("name", "=", "a>b")]
    for bad in ("a", "a IN ()", "a IN (,)"):
        with pytest.raises(ScanError):
            parse_where(bad)


def test_errors(files):
    with pytest.raises(ScanError, match="UnknownColumn"):
        list(fs.scan(files / "d.csv", where="ID = 1"))
    with pytest.raises(ScanError, match="EmptyFile"):
        fs.schema(files / "empty.csv")
    with pytest.raises(ScanError, match="FileNotFound"):
        fs.schema(files / "none.csv")
    for ask in (lambda p: list(fs.scan(p)), lambda p: fs.aggregate(p, "a"), lambda p: fs.topk(p, "a", 1), lambda p: fs.order_by(p, "a"), lambda p: fs.describe(p)):
        with pytest.raises(ScanError, match="UnterminatedQuote"):
            ask(files / "bad.csv")
    assert fs.count(files / "bad.csv") == 2  # a bare count parses nothing


def test_ragged_and_blank(files):
    assert list(fs.scan(files / "ragged.csv")) == [{"a": "1", "b": "2", "c": "3"}, {"a": "4", "b": "5"}, {"a": "6"}, {"a": "7", "b": "8", "c": "9", "col3": "EXTRA"}]
    assert fs.scan_array(files / "ragged.csv") == {"a": ["1", "4", "6", "7"], "b": ["2", "5", "", "8"], "c": ["3", "", "", "9"]}
    assert len(list(fs.scan(files / "ragged.csv", where="c != 3", negate=True))) == 3
    assert list(fs.scan(files / "blank.csv")) == [{"a": "1", "b": "2"}, {"a": ""}, {"a": "3", "b": "4"}]
    assert fs.count(files / "blank.csv") == 3


def test_aggregates(files):
    path = files / "d.csv"
    assert fs.aggregate(path, "amount") == oracle.summary([r[2] for r in ROWS])
    assert fs.aggregate(path, "amount", where="id > 100") == {"count": 0, "sum": 0.0, "min": None, "max": None, "avg": None}
    assert fs.group_by(path, "city", "amount") == {c: oracle.summary([r[2] for r in ROWS if r[3] == c]) for c in {r[3] for r in ROWS}}
    assert fs.group_by(path, "city", "amount", negate=True) == {}
    assert "group" in fs.group_by.__name__ and "group_by" in fs.__all__


def test_topk_and_order(files):
    path = files / "d.csv"
    assert [r["amount"] for r in fs.topk(path, "amount", 3)] == ["999999999999", "1e3", "10"]
    assert [r["_key"] for r in fs.topk(path, "amount", 2, descending=False)] == [-5.0, 0.0]
    assert fs.topk(path, "amount", 0) == [] and len(fs.topk(path, "amount", 99)) == 7
    assert [r["amount"] for r in fs.order_by(path, "amount")] == ["", "-5", "0", "3.50", "9", "10", "1e3", "999999999999", "5x", "nan"]
    assert [r["id"] for r in fs.order_by(path, "id", descending=True)][:2] == ["10", "9"]
    assert [r["name"] for r in fs.order_by(path, "city", where="city != Oslo")][:3] == ["bob", "joe", "dan"]


def test_limit_is_before_aggregate(files):
    r = open_path(files / "d.csv").limit(3)
    assert r.aggregate("amount").head()["count"] == 3
    assert [x["id"] for x in r.topk("amount", 9).collect()] == ["3", "2", "1"]


def test_bytes_delimiter_and_limits(files, tmp_path):
    assert from_bytes(b'a,b\n1,"x ""y"""\n').dicts() == [{"a": "1", "b": 'x "y"'}]
    assert from_bytes(b'[{"a": 1.50}, {"b": 2}]', "json").dicts() == [{"a": "1.50"}, {"a": ""}]
    with pytest.raises(ScanError, match="EmptyFile"):
        from_bytes(b"[]", "json")
    (tmp_path / "t.tsv").write_text("a\tb\n1,2\t3\n")
    assert open_path(tmp_path / "t.tsv", delimiter="\t").dicts() == [{"a": "1,2", "b": "3"}]
    ok = open_path(files / "ragged.csv", limits=InputLimits(max_record_bytes=11, max_fields=4))
    assert len(ok.dicts()) == 4
    with pytest.raises(ScanError, match="TooManyFields"):
        open_path(files / "ragged.csv", limits=InputLimits(max_fields=3)).dicts()
    with pytest.raises(ScanError, match="RecordTooLarge"):
        open_path(files / "ragged.csv", limits=InputLimits(max_record_bytes=10)).dicts()


def test_json_records(tmp_path):
    def rows(text, name="x.ndjson"):
        (tmp_path / name).write_text(text)
        return list(fs.scan(tmp_path / name))

    assert rows('{"a": 1, "b": null}\n{"b": true, "a": "1e3", "c": 9}\n') == [{"a": "1", "b": ""}, {"a": "1e3", "b": "true"}]
    assert rows('{"a": 1, "a": 2}\n') == [{"a": "2"}]
    assert rows('{"a": "[not json"}\n') == [{"a": "[not json"}]
    with pytest.raises(ScanError, match="NestedValue"):
        rows('{"a": 1}\n{"a": {"x": 1}}\n')
    with pytest.raises(ScanError, match="InvalidJson"):
        rows('{"a": 1}\n{"a": \n')


def test_arrays_by_lines(spark, tmp_path):
    """An array with a line for each flat object is read in splits, as one on a single line reads; no other array is."""
    objects = ['{"a": 1.50, "b": "x},{ \\\\"}', '{"b": "[\\"", "a": 1e3, "c": 2}', '{"a": null, "b": true}', '{ "a":"]" }', '{"a": 12345678901234567890123.10, "b": "é😀\\u00e9"}'] * 400

    def rows(text, name):
        (tmp_path / name).write_text(text)
        return list(fs.scan(tmp_path / name)), fs.count(tmp_path / name), fs.count(tmp_path / name, where="a > 1")

    def splits(name):
        return open_path(tmp_path / name).df.rdd.getNumPartitions()

    want, old = rows("[" + ",".join(objects) + "]", "one.json"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert want[1] == 2000 and want[0][0] == {"a": "1.50", "b": 'x},{ \\'}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        for k, (head, between, tail) in enumerate([("[", ",\n", "]\n"), ("[\n", ",\n  ", "\n]"), ("[ ", " ,\r\n", "\r\n]\r\n")]):
            assert rows(head + between.join(objects) + tail, f"{k}.json") == want and splits(f"{k}.json") > 2
        assert rows("[" + ",\n".join(f"{x},{x}" for x in objects[::2]) + "]", "two.json")[1] == 2000 and splits("two.json") == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for broken in ('[{"a": 1}\n{"a": 2}]', '[{"a": 1},\n{"a": tru},\n{"a": 3}]', '[{"a": 1},\n{"a": 2},\n'):
        with pytest.raises(ScanError, match="InvalidJson"):
            rows(broken, "broken.json")
    with pytest.raises(ScanError, match="NestedValue"):
        rows('[{"a": 1},\n{"a": {"x": 1}}]', "nested.json")


def test_large_file_order(tmp_path, spark):
    """Many splits of one file keep its order, and long quoted fields don't overflow the tokenizer."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        (tmp_path / "big.csv").write_text("n,t\n" + "".join(f'{i},"{"x" * 50}"\n' for i in range(3000)))
        assert [r["n"] for r in fs.scan(tmp_path / "big.csv", limit=2500)] == [str(i) for i in range(2500)]
        r = fs.validate_report(tmp_path / "big.csv", {"n": {"max": 2990}})
        assert [e.row for e in r.errors] == list(range(2992, 3001)) and r.rows_total == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    long = '""' * 120_000
    (tmp_path / "long.csv").write_text(f'a,b\n"{long}",1\n')
    assert next(fs.scan(tmp_path / "long.csv"))["a"] == '"' * 120_000


def test_json_beyond_the_limit_of_whole_files(spark, tmp_path):
    """Opening reads the beginning only, however large the file."""
    path = tmp_path / "x.ndjson"
    path.write_text("".join(f'{{"a": "{i}", "b": "x"}}\n' for i in range(20_000)))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert fs.count(str(path)) == 20_000 and next(iter(fs.scan(str(path), columns=["a"], limit=1))) == {"a": "0"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


@pytest.mark.parametrize("op", [">", ">=", "!=", "<", "="])
def test_doubles_reach_the_scan(spark, tmp_path, op):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1.0,), (float("nan"),), (50.0,), (30.0,), (None,)], "d double").write.parquet(path)
    found = spark.read.parquet(path).where(compare_typed(F.col("d"), T.DoubleType(), op, "30"))
    assert "PushedFilters: [" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "30.0" in plan.split("PushedFilters: [")[1].split("]")[0]
    want = {">": {"50.0", "nan"}, ">=": {"50.0", "30.0", "nan"}, "!=": {"1.0", "50.0", "nan"}, "<": {"1.0"}, "=": {"30.0"}}[op]
    assert {str(r["d"]) for r in found.collect()} == want
