"""Conjunctions of column predicates: their text form, their structured form, and their expressions."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ScanError
from .numeric import literal_number, num

OPERATORS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
#: A clause's first operator; two-character ones win where both begin at one place.
_OPERATOR = re.compile(">=|<=|!=|=|>|<")
_BLANK = " \t"


@dataclass(frozen=True)
class Predicate:
    """``column op value``; for ``op`` "in", ``value`` is a tuple."""

    column: str
    op: str
    value: str | tuple[str, ...]


def parse_where(where: str) -> list[Predicate]:
    """Clauses joined by " AND ": ``col OP value`` or ``col IN (a, b)``. Values have no quotes and may hold operators.

    A clause is a list only if what follows " IN " is in parentheses; else its leftmost operator counts.
    Empty clauses are skipped; an empty list or a clause without an operator is an error.
    """
    found = []
    for clause in (c.strip(_BLANK) for c in where.split(" AND ")):
        if not clause:
            continue
        column, word, tail = clause.partition(" IN ")
        tail = tail.strip(_BLANK)
        if word and len(tail) >= 2 and tail[0] == "(" and tail[-1] == ")":
            values = tuple(v for v in (v.strip(_BLANK) for v in tail[1:-1].split(",")) if v)
            if not values:
                raise ScanError(f"bad where: empty list in {clause!r}")
            found.append(Predicate(column.strip(_BLANK), "in", values))
        elif m := _OPERATOR.search(clause):
            found.append(Predicate(clause[: m.start()].strip(_BLANK), m.group(), clause[m.end() :].strip(_BLANK)))
        else:
            raise ScanError(f"bad where: no operator in {clause!r}")
    return found


def predicates(where: str | Sequence | None) -> list[Predicate]:
    """From text, from Predicates, or from (column, op, value) tuples."""
    if where is None:
        return []
    if isinstance(where, str):
        return parse_where(where)
    out = []
    for p in where:
        p = p if isinstance(p, Predicate) else Predicate(p[0], str(p[1]).lower(), tuple(map(str, p[2])) if isinstance(p[2], (list, tuple)) else str(p[2]))
        if p.op not in OPERATORS and p.op != "in" or p.op == "in" and not p.value:
            raise ScanError(f"bad where: {p}")
        out.append(p)
    return out


def compare_text(c: Column, op: str, value: str) -> Column:
    """Numbers compare as numbers where both sides are, else both as text by bytes. Null stays null."""
    apply, number = OPERATORS[op], literal_number(value)
    as_text = apply(c, F.lit(value))
    if number is None:
        return as_text
    d = num(c)
    return F.when(d.isNotNull(), apply(d, F.lit(number))).otherwise(as_text)


def in_texts(c: Column, values: Sequence[str]) -> Column:
    """Equality with any value, by the rule of ``compare_text``; two sets, so long lists stay cheap."""
    numbers = [v for v in map(literal_number, values) if v is not None]
    words = [v for v in values if literal_number(v) is None]
    if not numbers:
        return c.isin(list(values))
    d = num(c)
    return F.when(d.isNotNull(), d.isin(numbers) | (c.isin(words) if words else F.lit(False))).otherwise(c.isin(list(values)))


def compare_typed(c: Column, kind: T.DataType, op: str, value: str) -> Column:
    """On a typed column: a plain comparison, which reaches the scan, where the literal fits the type."""
    apply, number = OPERATORS[op], literal_number(value)
    if isinstance(kind, T.StringType):
        return compare_text(c, op, value)
    if isinstance(kind, T.NumericType):
        if number is None:
            return apply(c.cast("string"), F.lit(value))
        whole = number.is_integer() and isinstance(kind, T.IntegralType) and abs(number) < 2**63
        # NaN is no number and compares as text; that is above any number's text, as it is above any number here
        return apply(c, F.lit(int(number) if whole else number))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return apply(c, F.lit(value).try_cast(kind.simpleString()))
    if isinstance(kind, T.BooleanType):
        return apply(c.cast("string"), F.lit(value.lower()))
    return apply(c.cast("string"), F.lit(value))


def compiled(found: Sequence[Predicate], field: Callable[[str], tuple[Column, T.DataType]], negate: bool = False) -> Column | None:
    """All of them as one condition, or its exact complement. None keeps every row (or, negated, isn't called for).

    The complement counts a row on which a predicate is null (an absent cell) as not matching.
    """
    parts = []
    for p in found:
        c, kind = field(p.column)
        if p.op != "in":
            parts.append(compare_typed(c, kind, p.op, p.value))
        elif isinstance(kind, T.StringType):
            parts.append(in_texts(c, p.value))
        elif isinstance(kind, T.NumericType) and all(literal_number(v) is not None for v in p.value):
            parts.append(c.isin([literal_number(v) for v in p.value]))
        else:
            parts.append(functools.reduce(operator.or_, (compare_typed(c, kind, "=", v) for v in p.value)))
    if not parts:
        return F.lit(False) if negate else None
    whole = functools.reduce(operator.and_, parts)
    return ~F.coalesce(whole, F.lit(False)) if negate else whole
