"""Validation schemas, compiled to one expression: the ordered list of a row's errors."""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ScanError
from ..functions.numeric import INTEGER, num_trimmed

#: The types and rule keys of a schema, and the names of errors.
TYPES = ("any", "integer", "float", "boolean", "datetime", "string")
KEYS = ("type", "required", "min", "max", "min_len", "max_len", "one_of")
ERRORS = ("too_few_fields", "too_many_fields", "missing_required", "bad_type", "below_min", "above_max", "too_short", "too_long", "not_in_set")
ERROR = "struct<column:int,column_name:string,rule:string,value:string>"
#: A date, alone or with a time whose fraction and zone are optional; leap second 60, offsets up to 23:59.
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::(?:[0-5][0-9]|60)(?:\.[0-9]+)?)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?)?\z"
_BLANK = " \t"


@dataclass(frozen=True)
class Rule:
    column: int
    name: str
    type: str = "any"
    required: bool = False
    min: float | None = None
    max: float | None = None
    min_len: int | None = None
    max_len: int | None = None
    one_of: tuple[str, ...] = ()


def _text(v: object) -> str:
    if isinstance(v, bool) or not isinstance(v, (str, int, float)):
        raise ScanError("BadSchema: one_of takes texts and numbers")
    return v if isinstance(v, str) else json.dumps(v)


def compile_schema(schema: dict | str, header: Sequence[str]) -> list[Rule]:
    """Rules in the order of the schema's keys."""
    if isinstance(schema, str):
        try:
            schema = json.loads(schema)
        except ValueError:
            raise ScanError("BadSchema: no JSON") from None
    if not isinstance(schema, dict):
        raise ScanError("BadSchema: not an object")
    out = []
    for name, spec in schema.items():
        if not isinstance(spec, dict):
            raise ScanError(f"BadSchema: {name} is no object")
        if name not in header:
            raise ScanError(f"UnknownColumn: {name}")
        given: dict = {}
        for key, v in spec.items():
            number = isinstance(v, (int, float)) and not isinstance(v, bool)
            ok = {
                "type": v in TYPES if isinstance(v, str) else False,
                "required": isinstance(v, bool),
                "min": number,
                "max": number,
                "min_len": number and isinstance(v, int) and v >= 0,
                "max_len": number and isinstance(v, int) and v >= 0,
                "one_of": isinstance(v, list),
            }
            if not ok.get(key, False):
                raise ScanError(f"BadSchema: {name}.{key}")
            given[key] = tuple(map(_text, v)) if key == "one_of" else float(v) if key in ("min", "max") else v
        out.append(Rule(list(header).index(name), name, **given))
    return out


def _is_datetime(v: Column) -> Column:
    day = F.substring(v, 1, 10)
    return v.rlike(DATETIME) & ~day.startswith("0000") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()


def _type_fits(kind: str, v: Column) -> Column | None:
    bare = F.btrim(v, F.lit(_BLANK))
    if kind == "integer":
        return bare.rlike(INTEGER)
    if kind == "float":
        return num_trimmed(v).isNotNull()
    if kind == "boolean":
        return F.lower(bare).isin("true", "false")
    return _is_datetime(bare) if kind == "datetime" else None


def cell_errors(rule: Rule, v: Column) -> Column:
    """The names of a cell's failed rules, in order; null entries are rules that hold. An absent cell has none."""
    n, length = num_trimmed(v), F.length(v)
    fails = []
    if rule.min is not None or rule.max is not None:
        fails.append(F.when(n.isNull(), F.lit("bad_type")).when(n < (rule.min if rule.min is not None else float("-inf")), F.lit("below_min")))
        if rule.max is not None:
            fails.append(F.when(n > rule.max, F.lit("above_max")))
    if rule.min_len is not None:
        fails.append(F.when(length < rule.min_len, F.lit("too_short")))
    if rule.max_len is not None:
        fails.append(F.when(length > rule.max_len, F.lit("too_long")))
    if rule.one_of:
        fails.append(F.when(~v.isin(list(rule.one_of)), F.lit("not_in_set")))
    none = F.array().cast("array<string>")
    found = F.array(*fails) if fails else none
    fits = _type_fits(rule.type, v)
    if fits is not None:
        found = F.when(fits, found).otherwise(F.array(F.lit("bad_type")))
    blank = F.btrim(v, F.lit(" \t\r\n")) == ""
    return F.when(v.isNull(), none).when(blank, F.array(F.lit("missing_required")) if rule.required else none).otherwise(found)


def row_errors(rules: Sequence[Rule], fields: Column, width: int) -> Column:
    """``array<ERROR>``: of the row's shape first, then by rule in schema order, then by check in fixed order."""
    size = F.size(fields)
    shape = F.when(size < width, F.lit("too_few_fields")).when(size > width, F.lit("too_many_fields"))
    made = lambda column, name, rule, value: F.struct(column.cast("int").alias("column"), name.alias("column_name"), rule.alias("rule"), value.alias("value"))
    parts = [F.when(shape.isNotNull(), F.array(made(F.lit(None), F.lit(""), shape, F.lit("")))).otherwise(F.array().cast(f"array<{ERROR}>"))]
    for r in rules:
        v = F.try_element_at(fields, F.lit(r.column + 1))
        failed = F.filter(cell_errors(r, v), lambda x: x.isNotNull())
        cell = functools.partial(made, F.lit(r.column), F.lit(r.name), value=v)
        parts.append(F.transform(failed, lambda x: cell(x)))  # noqa: B023
    return F.concat(*parts)
