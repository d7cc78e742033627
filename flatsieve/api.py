"""Functions over paths, in the form that callers of a flat-file scanner expect."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

from .errors import ScanError
from .operators import profile as _profile
from .operators import validate as _validate
from .operators.relation import Relation, guarded
from .operators.validate import ValidationError, ValidationReport
from .sources import sinks
from .sources.readers import from_bytes, open_path

__all__ = ["ScanError", "ValidationError", "ValidationReport", "aggregate", "build_mode", "count", "describe", "group_by", "infer_schema", "order_by", "profile", "scan", "scan_array", "scan_batches", "schema", "topk", "validate", "validate_batches", "validate_iter", "validate_report", "validate_to_files"]

Where = str | Sequence | None


def _query(path, columns: Sequence[str] | None = None, where: Where = None, limit: int | None = None, negate: bool = False, **options) -> Relation:
    return open_path(path, **options).where(where, negate).select(columns).limit(limit)


def schema(path) -> list[str]:
    """Column names."""
    return list(open_path(path).header)


def scan(path, columns: Sequence[str] | None = None, where: Where = None, limit: int | None = None, negate: bool = False, **options) -> Iterator[dict]:
    """Rows as dictionaries in file order, a partition at a time. Extra fields of a row are ``col`` and their number, absent ones missing."""
    relation = _query(path, columns, where, limit, negate, **options)
    return (relation.as_dict(f) for f in relation.local())


def scan_array(path, columns: Sequence[str] | None = None, where: Where = None, limit: int | None = None, negate: bool = False, as_dict: bool | None = None, **options) -> dict[str, list] | list:
    """Whole columns by name, as wide as the header: absent fields empty, extra ones dropped.

    With ``as_dict`` a list of rows instead: dictionaries as ``scan`` gives them, or for False tuples.
    """
    relation = _query(path, columns, where, limit, negate, **options)
    if as_dict is not None:
        return [_view(relation, as_dict)(f) for f in relation.local()]
    table = guarded(relation.frame(ordered=True).toArrow)
    return {name: table.column(i).to_pylist() for i, name in enumerate(table.column_names)}


def scan_batches(path, columns: Sequence[str] | None = None, where: Where = None, limit: int | None = None, negate: bool = False, *, batch_size: int = 1024, target_bytes: int = 1 << 20, as_dict: bool = True) -> Iterator[list]:
    relation = _query(path, columns, where, limit, negate)
    return sinks.batches(map(_view(relation, as_dict), relation.local()), batch_size, target_bytes)


def _view(relation: Relation, as_dict: bool) -> Callable[[list], dict | tuple]:
    """How a row is shown: by name, or as a tuple of its fields or of the selected ones."""
    if as_dict:
        return relation.as_dict
    return tuple if relation.columns is None else lambda f: tuple(relation.as_dict(f).values())


def count(path, where: Where = None, negate: bool = False, limit: int | None = None) -> int:
    return _query(path, None, where, limit, negate).count()


def aggregate(path, column: str, where: Where = None, negate: bool = False, limit: int | None = None) -> dict:
    return guarded(_query(path, None, where, limit, negate).aggregate(column).head).asDict()


def group_by(path, group: str, column: str, where: Where = None, negate: bool = False) -> dict[str, dict]:
    """Summaries by key; the driver holds one for each key."""
    rows = guarded(_query(path, None, where, None, negate).group_by(group, column).collect)
    return {r["key"]: {k: r[k] for k in ("count", "sum", "min", "max", "avg")} for r in rows}


def topk(path, column: str, k: int, where: Where = None, descending: bool = True, negate: bool = False) -> list[dict]:
    rows = guarded(_query(path, None, where, None, negate).topk(column, k, descending).collect)
    return [dict(zip(r.__fields__, r)) for r in rows]


def order_by(path, column: str, where: Where = None, descending: bool = False, negate: bool = False) -> list[dict]:
    rows = guarded(_query(path, None, where, None, negate).order_by(column, descending).collect)
    return [dict(zip(r.__fields__, r)) for r in rows]


def describe(path, sample_size: int = 1000) -> list[dict]:
    return _profile.describe(open_path(path), sample_size)


def infer_schema(path, sample_size: int = 1000, required: bool = False) -> dict:
    return _profile.infer_schema(open_path(path), sample_size, required)


def profile(path, sample_limit: int = 1) -> dict:
    return _profile.profile(open_path(path), sample_limit)


def validate(source, schema: dict, *, mode: str = "fast", format: str | None = None) -> bool | list[dict]:
    """Fast: whether all rows pass. Full: the failed rows. ``source`` is a path or bytes (CSV unless ``format`` says otherwise)."""
    if mode not in ("fast", "full"):
        raise ValueError("mode must be 'fast' or 'full'")
    if isinstance(source, bytes):
        relation = from_bytes(source, format or "csv")
    elif format is not None:
        raise ValueError("format is only for bytes")
    elif "\0" in os.fspath(source):
        raise ValueError("path contains NUL")
    else:
        relation = open_path(source)
    return _validate.is_valid(relation, schema) if mode == "fast" else _validate.failed_rows(relation, schema)


def validate_report(path, schema: dict, max_errors: int = 100) -> ValidationReport:
    return _validate.report(open_path(path), schema, max_errors)


def validate_iter(path, schema: dict) -> Iterator[tuple[dict, list[ValidationError]]]:
    return _validate.rows_with_errors(open_path(path), schema)


def validate_batches(path, schema: dict, *, batch_size: int = 1024, target_bytes: int = 1 << 20, as_dict: bool = True) -> Iterator[list]:
    """Batches of (row, errors), the rows as dictionaries or, without ``as_dict``, tuples of their fields."""
    rows = _validate.rows_with_errors(open_path(path), schema, as_dict)
    return sinks.batches(rows, batch_size, target_bytes)


def validate_to_files(path, schema: dict, accepted_path, rejected_path) -> dict:
    return sinks.validate_to_files(open_path(path), schema, os.fspath(accepted_path), os.fspath(rejected_path))


def build_mode() -> str:
    """The engine behind these functions."""
    import pyspark

    return f"spark-{pyspark.__version__}"
