"""Rules, reports, modes, routing to files, profiling, streaming and the command line."""

import io
import json

import pytest

import flatsieve as fs
from flatsieve.cli import main
from flatsieve.errors import ScanError
from flatsieve.operators.rules import compile_schema

SCHEMA = {
    "id": {"type": "integer", "required": True},
    "name": {"required": True, "min_len": 2, "max_len": 5},
    "amount": {"type": "float", "min": 0, "max": 100},
    "city": {"one_of": ["Oslo", "Rome", 7]},
}
TEXT = "id,name,amount,city\n1,ann,5,Oslo\nx, ,-1,Paris\n3,b,500,\n4,toolong, 3.5 ,7\n5,eve,nan,   \n6,fay\n7,gus,1,Rome,more\n"
WANT = [
    (2, 0, "id", "bad_type", "x"), (2, 1, "name", "missing_required", " "), (2, 2, "amount", "below_min", "-1"), (2, 3, "city", "not_in_set", "Paris"),
    (3, 1, "name", "too_short", "b"), (3, 2, "amount", "above_max", "500"), (4, 1, "name", "too_long", "toolong"), (5, 2, "amount", "bad_type", "nan"),
    (6, None, "", "too_few_fields", ""), (7, None, "", "too_many_fields", ""),
]


@pytest.fixture
def path(spark, tmp_path):
    (tmp_path / "v.csv").write_text(TEXT)
    return tmp_path / "v.csv"


@pytest.mark.parametrize("cap", [1, 2, 5, 100])
def test_report(path, cap):
    r = fs.validate_report(path, SCHEMA, cap)
    assert (r.rows_total, r.rows_valid, r.rows_invalid, r.errors_total, r.truncated, r.ok) == (7, 1, 6, 10, cap < 10, False)
    assert [(e.row, e.column, e.column_name, e.rule, e.value) for e in r.errors] == WANT[:cap]
    assert r.counts == {w: sum(x[3] == w for x in WANT) for w in {x[3] for x in WANT}}
    assert json.loads(json.dumps(r.as_dict()))["errors"][0]["rule"] == "bad_type"


def test_modes(path):
    assert fs.validate(path, SCHEMA) is False
    assert fs.validate(b"id\n1\n", {"id": {"type": "integer"}}) is True
    full = fs.validate(path, SCHEMA, mode="full")
    assert [f["values"] for f in full][-2:] == [["6", "fay"], ["7", "gus", "1", "Rome", "more"]]
    assert full[0]["errors"][0] == {"column": 0, "column_name": "id", "rule": "bad_type", "value": "x"}
    rows = list(fs.validate_iter(path, SCHEMA))
    assert len(rows) == 7 and rows[0][1] == [] and rows[5][0] == {"id": "6", "name": "fay"}
    assert [len(b) for b in fs.validate_batches(path, SCHEMA, batch_size=3)] == [3, 3, 1]
    assert fs.validate_report(path, SCHEMA, 0) == fs.validate_report(path, SCHEMA, 100)


def test_min_without_type(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a\nabc\n5\n")
    r = fs.validate_report(tmp_path / "m.csv", {"a": {"min": 10, "max_len": 2}})
    assert [(e.row, e.rule) for e in r.errors] == [(1, "bad_type"), (1, "too_long"), (2, "below_min")]


@pytest.mark.parametrize("bad", ["x", "[]", {"id": 1}, {"id": {"type": "int"}}, {"id": {"min": "1"}}, {"id": {"min_len": -1}}, {"id": {"other": 1}}, {"none": {}}, {"id": {"one_of": [True]}}, {"id": {"required": 1}}])
def test_bad_schema(bad):
    with pytest.raises(ScanError):
        compile_schema(bad, ["id"])


def test_to_files(path, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.jsonl"
    assert fs.validate_to_files(path, SCHEMA, good, bad) == {"rows_total": 7, "rows_valid": 1, "rows_invalid": 6, "errors_total": 10}
    assert good.read_bytes() == b"id,name,amount,city\r\n1,ann,5,Oslo\r\n"
    lines = bad.read_text().splitlines()
    assert len(lines) == 6 and json.loads(lines[4]) == {"values": ["6", "fay"], "errors": [{"column": None, "column_name": "", "rule": "too_few_fields", "value": ""}]}
    with pytest.raises(ScanError, match="Exists"):
        fs.validate_to_files(path, SCHEMA, tmp_path / "new.csv", bad)
    assert not (tmp_path / "new.csv").exists()
    (tmp_path / "broken.csv").write_text('a\n1\n"oops\n')
    with pytest.raises(ScanError):
        fs.validate_to_files(tmp_path / "broken.csv", {}, tmp_path / "g", tmp_path / "b")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad.jsonl", "broken.csv", "good.csv", "v.csv"]
    (tmp_path / "blank.csv").write_text("v\n\n1\n")
    fs.validate_to_files(tmp_path / "blank.csv", {}, tmp_path / "g", tmp_path / "b")
    assert (tmp_path / "g").read_bytes() == b'v\r\n""\r\n1\r\n' and (tmp_path / "b").read_bytes() == b""


def test_profile(path):
    p = fs.profile(path)
    assert p["columns"] == ["id", "name", "amount", "city"] and p["row_count"] == 7 and set(p["numeric_columns"]) == {"id", "amount"}
    assert p["numeric_columns"]["id"]["count"] == 6
    assert fs.infer_schema(path, sample_size=1) == {"id": {"type": "integer"}, "name": {}, "amount": {"type": "integer"}, "city": {}}
    assert fs.infer_schema(path, sample_size=1, required=True)["name"] == {"required": True}
    assert fs.build_mode().startswith("spark-")


def run(*argv):
    out, err = io.StringIO(), io.StringIO()
    return main(list(map(str, argv)), out, err), out.getvalue()


def test_cli(path, tmp_path):
    assert run(path, "--count") == (0, "7\n")
    assert run(path, "--where", "amount > 1", "--columns", "name,id") == (0, "ann,1\nb,3\neve,5\n")  # " 3.5 " and nan compare as text
    assert run(path, "--where", "id = 6", "--format", "ndjson") == (0, '{"id":"6","name":"fay"}\n')
    assert run(path, "--group-by", "city", "--agg", "amount", "--where", "city IN (Oslo, Paris)") == (0, "Oslo,1,5,5,5,5\nParis,1,-1,-1,-1,-1\n")
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    code, said = run(path, "--validate", tmp_path / "s.json", "--max-errors", "3")
    assert code == 1 and len(json.loads(said)["errors"]) == 3
    assert run(path, "--validate", tmp_path / "s.json", "--valid") == (0, "1,ann,5,Oslo\n")
    assert run(path, "--validate", tmp_path / "none.json")[0] == 2
    assert run(path, "--group-by", "city")[0] == 2 and run(path, "--valid")[0] == 2 and run(path, "--where", "x = 1")[0] == 2 and run(tmp_path / "none.csv")[0] == 1


def test_stream(spark, tmp_path):
    from flatsieve.streaming.scan import stream_errors, stream_lines, stream_where

    folder = tmp_path / "in"
    folder.mkdir()
    header = ["a", "b"]
    (folder / "1.csv").write_text("a,b\n1,x\n20,y\n")
    (folder / "2.csv").write_text('a,b\n3,"z,z"\n4\na,b\n')
    rows = stream_lines(spark, str(folder), header)
    for name, df in (("kept", stream_where(rows, header, "a >= 3")), ("bad", stream_errors(rows, header, {"a": {"type": "integer", "max": 10}}))):
        q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("kept").collect())) == [("20", "y"), ("3", "z,z"), ("4", ""), ("a", "b")]
    assert sorted(",".join(e["rule"] for e in r["errors"]) for r in spark.table("bad").collect()) == ["", "", "above_max", "bad_type", "too_few_fields"]
