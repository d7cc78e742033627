"""The library's functions as tools of a Model Context Protocol server: ``python -m flatsieve.tools``.

One JSON-RPC message is one line of standard input, and each answer one line of standard output. A tool's
result is JSON text; what goes wrong in a tool is a result that is marked as an error.
"""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable
from typing import Any, TextIO

from . import api
from .errors import ScanError

#: The protocol's versions that are spoken, the newest first, and the codes of its errors.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE_ERROR, INVALID_REQUEST, UNKNOWN_METHOD, INVALID_PARAMS = -32700, -32600, -32601, -32602


def scan(path: str, columns: list | None = None, where: str | None = None, limit: int | None = None, negate: bool = False) -> list:
    """Matching rows of a CSV, NDJSON or JSON file by column name; negate gives those that the condition rejects. Give a limit for large files."""
    return api.scan_array(path, columns, where, limit, negate, as_dict=True)


def schema(path: str) -> list:
    """The file's column names, in order."""
    return api.schema(path)


def count(path: str, where: str | None = None, negate: bool = False) -> int:
    """How many rows match, or with negate how many don't."""
    return api.count(path, where, negate)


def aggregate(path: str, column: str, where: str | None = None) -> dict:
    """count, sum, min, max and avg of a column's numbers."""
    return api.aggregate(path, column, where)


def group_by(path: str, group_column: str, agg_column: str, where: str | None = None) -> dict:
    """The summary of one column's numbers for each value of another."""
    return api.group_by(path, group_column, agg_column, where)


def topk(path: str, column: str, k: int, where: str | None = None, descending: bool = True) -> list:
    """The k rows with the largest numbers in a column (the least, if not descending), each with that number as _key."""
    return api.topk(path, column, k, where, descending)


def order_by(path: str, column: str, where: str | None = None, descending: bool = False) -> list:
    """All matching rows by a column; for the first few alone, topk is cheaper."""
    return api.order_by(path, column, where, descending)


def describe(path: str, sample_size: int = 1000) -> list:
    """Each column's type, as the first rows suggest it."""
    return api.describe(path, sample_size)


def profile(path: str) -> dict:
    """Columns, number of rows, and the summary of each column that looks numeric."""
    return api.profile(path)


def infer_schema(path: str, sample_size: int = 1000, required: bool = False) -> dict:
    """A draft of a schema for validate, to be looked over first."""
    return api.infer_schema(path, sample_size, required)


def validate(path: str, schema: dict, max_errors: int = 100) -> dict:
    """Whole counts of rows and failed rules, and the first failures; schema maps a column to its rules (type, required, min, max, min_len, max_len, one_of)."""
    return api.validate_report(path, schema, max_errors).as_dict()


TOOLS: dict[str, Callable] = {f.__name__: f for f in (scan, schema, count, aggregate, group_by, topk, order_by, describe, profile, infer_schema, validate)}
_KINDS = {"str": "string", "int": "integer", "bool": "boolean", "list": "array", "dict": "object"}


def described(f: Callable) -> dict:
    """A tool's entry in the list: its arguments come from its signature."""
    given = inspect.signature(f).parameters.values()
    properties = {p.name: {"type": _KINDS[p.annotation.removesuffix(" | None")]} for p in given}
    needed = [p.name for p in given if p.default is p.empty]
    return {"name": f.__name__, "description": f.__doc__, "inputSchema": {"type": "object", "properties": properties, "required": needed, "additionalProperties": False}}


class Refused(Exception):
    """A request that can't be served: its code and what is said about it."""


def _call(params: dict) -> dict:
    tool = TOOLS.get(params.get("name"))
    if tool is None:
        raise Refused(INVALID_PARAMS, f"no such tool: {params.get('name')}")
    arguments = params.get("arguments") or {}
    try:
        inspect.signature(tool).bind(**arguments)
    except TypeError as e:
        raise Refused(INVALID_PARAMS, str(e)) from None
    try:
        said, failed = json.dumps(tool(**arguments), ensure_ascii=False), False
    except (ScanError, ValueError, TypeError, OSError) as e:
        said, failed = f"{type(e).__name__}: {e}", True
    return {"content": [{"type": "text", "text": said}], "isError": failed}


def _answer(method: str, params: dict) -> Any:
    if method == "initialize":
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "flatsieve", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [described(f) for f in TOOLS.values()]}
    if method == "tools/call":
        return _call(params)
    raise Refused(UNKNOWN_METHOD, f"no such method: {method}")


def respond(line: str) -> dict | None:
    """The answer to one message; None for a notification."""
    try:
        message = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not JSON"}}
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "not a request"}}
    if "id" not in message:
        return None
    head = {"jsonrpc": "2.0", "id": message["id"]}
    try:
        return head | {"result": _answer(message["method"], message.get("params") or {})}
    except Refused as e:
        return head | {"error": {"code": e.args[0], "message": e.args[1]}}


def serve(lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if line.strip() and (answer := respond(line)) is not None:
            out.write(json.dumps(answer, ensure_ascii=False) + "\n")
            out.flush()


if __name__ == "__main__":
    serve()
