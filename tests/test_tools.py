"""The tools of the protocol server, messages by line."""

import io
import json

import flatsieve as fs
from flatsieve import tools


def ask(*messages):
    out = io.StringIO()
    tools.serve(io.StringIO("".join((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages)), out)
    return [json.loads(line) for line in out.getvalue().splitlines()]


def call(name, **arguments):
    (got,) = ask({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    return got.get("error") or (got["result"]["isError"], got["result"]["content"][0]["text"])


def test_protocol():
    start, pong, unknown, broken, shape = ask(
        {"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": "p", "method": "ping"},
        {"jsonrpc": "2.0", "id": 2, "method": "nothing"},
        "{",
        "[]",
    )
    assert start["result"]["protocolVersion"] == "2024-11-05" and "tools" in start["result"]["capabilities"]
    assert pong == {"jsonrpc": "2.0", "id": "p", "result": {}}
    assert [x["error"]["code"] for x in (unknown, broken, shape)] == [-32601, -32700, -32600]
    (listed,) = ask({"jsonrpc": "2.0", "id": 1, "method": "tools/list"})
    by_name = {t["name"]: t["inputSchema"] for t in listed["result"]["tools"]}
    assert set(by_name) == {"scan", "schema", "count", "aggregate", "group_by", "topk", "order_by", "describe", "profile", "infer_schema", "validate"}
    assert by_name["topk"]["required"] == ["path", "column", "k"] and by_name["scan"]["properties"]["columns"] == {"type": "array"}


def test_calls(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_text("k,v\na,1\nb,2\na,x\n")
    want = {
        "scan": ({"columns": ["v"], "where": "k = a", "limit": 1}, [{"v": "1"}]),
        "schema": ({}, ["k", "v"]),
        "count": ({"where": "k = a", "negate": True}, 1),
        "aggregate": ({"column": "v"}, {"count": 2, "sum": 3.0, "min": 1.0, "max": 2.0, "avg": 1.5}),
        "group_by": ({"group_column": "k", "agg_column": "v"}, fs.group_by(path, "k", "v")),
        "topk": ({"column": "v", "k": 1}, [{"k": "b", "v": "2", "_key": 2.0}]),
        "order_by": ({"column": "v", "descending": True}, fs.order_by(path, "v", descending=True)),
        "describe": ({}, [{"column": "k", "type": "string"}, {"column": "v", "type": "string"}]),
        "profile": ({}, fs.profile(path)),
        "infer_schema": ({"required": True}, {"k": {"required": True}, "v": {"required": True}}),
        "validate": ({"schema": {"v": {"type": "integer"}}}, fs.validate_report(path, {"v": {"type": "integer"}}).as_dict()),
    }
    for name, (arguments, result) in want.items():
        failed, text = call(name, path=path, **arguments)
        assert not failed and json.loads(text) == result, name
    assert call("count", path=str(tmp_path / "no.csv"))[0] and call("scan", path=path, where="z = 1") == (True, "ScanError: UnknownColumn: z")
    assert call("count")["code"] == call("no")["code"] == -32602
