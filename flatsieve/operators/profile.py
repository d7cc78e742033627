"""What a source looks like: inferred types of a sample, a draft of a validation schema, a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import INTEGER, literal_number, num
from .relation import Relation, guarded

#: The date and time layouts that count as datetime.
DATETIMES = {
    r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z?\z": "yyyy-M-d'T'H:m:s",
    r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\z": "yyyy-M-d H:m:s",
    r"^\d{4}-\d{1,2}-\d{1,2}\z": "yyyy-M-d",
}


def _is_datetime(c: Column) -> Column:
    out = F.lit(False)
    for pattern, layout in DATETIMES.items():
        out = out | (c.rlike(pattern) & F.try_to_timestamp(F.regexp_replace(c, r"Z\z", ""), F.lit(layout)).isNotNull())
    return out


def type_of(c: Column) -> Column:
    """Aggregate: the first of boolean, integer, float, datetime that all non-empty texts fit; else string, or empty for none."""
    v = F.when(c != "", c)
    every = lambda test: F.coalesce(F.bool_and(F.when(v.isNotNull(), test)), F.lit(False))
    return (
        F.when(F.count(v) == 0, "empty")
        .when(every(F.lower(v).isin("true", "false")), "boolean")
        .when(every(v.rlike(INTEGER)), "integer")
        .when(every(num(v).isNotNull()), "float")
        .when(every(_is_datetime(v)), "datetime")
        .otherwise("string")
    )


def _named(kind: T.DataType) -> str | None:
    """A typed column's name in the same vocabulary; None where its texts decide."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    return "datetime" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else None


def describe_frame(relation: Relation, sample_size: int = 1000) -> DataFrame:
    """Rows (position, column, type), from the first ``sample_size`` rows in one pass."""
    relation, kinds = relation.sample(sample_size), []
    for i in range(len(relation.header)):
        c, named = relation.at(i), _named(relation.kind(i))
        kinds.append((F.when(F.count(c) == 0, "empty").otherwise(named) if named else type_of(F.coalesce(c.cast("string"), F.lit("")))).alias(f"t{i}"))
    found = relation.kept().agg(*kinds)
    pairs = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(h).alias("column"), F.col(f"t{i}").alias("type")) for i, h in enumerate(relation.header)))
    return found.select(F.explode(pairs).alias("p")).select("p.*")


def describe(relation: Relation, sample_size: int = 1000) -> list[dict]:
    rows = guarded(describe_frame(relation, sample_size).collect)
    return [{"column": r["column"], "type": r["type"]} for r in sorted(rows, key=lambda r: r["position"])]


def infer_schema(relation: Relation, sample_size: int = 1000, required: bool = False) -> dict:
    """A draft of a validation schema: the inferred type where it says something, and ``required`` if asked for."""
    out: dict = {}
    for found in describe(relation, sample_size):
        out[found["column"]] = ({} if found["type"] in ("string", "empty") else {"type": found["type"]}) | ({"required": True} if required else {})
    return out


def profile(relation: Relation, sample_limit: int = 1) -> dict:
    """Columns, rows, and the summary of every column whose first non-empty sampled value is a number: one pass over the data."""
    sample = relation.sample(sample_limit).dicts()
    numeric = []
    for name in relation.header:
        first = next((r[name] for r in sample if r.get(name) not in ("", None)), None)
        if literal_number(first) is not None if isinstance(first, str) else isinstance(first, (int, float)) and not isinstance(first, bool):
            numeric.append(name)
    found = guarded(relation.aggregates(numeric, F.count("*").alias("rows")).head) if numeric else {"rows": relation.count()}
    parts = ("count", "sum", "min", "max", "avg")
    return {"columns": list(relation.header), "row_count": found["rows"], "numeric_columns": {c: {p: found[f"{i}_{p}"] for p in parts} for i, c in enumerate(numeric)}}
