"""Row and cell validation against a schema: report, fast and full answers, rows with their errors, routing to files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relation import Relation, guarded, streamed
from .rules import ERRORS, compile_schema, row_errors

DEFAULT_MAX_ERRORS = 100


@dataclass(frozen=True)
class ValidationError:
    """One failed rule on one cell; ``column`` is None where the row's shape is wrong."""

    row: int
    column: int | None
    column_name: str
    rule: str
    value: str

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class ValidationReport:
    """Complete counts, and the first errors in file order up to the cap."""

    rows_total: int
    rows_valid: int
    rows_invalid: int
    errors_total: int
    truncated: bool
    counts: dict[str, int]
    errors: list[ValidationError]

    @property
    def ok(self) -> bool:
        return self.rows_invalid == 0

    def as_dict(self) -> dict:
        return asdict(self)


def checked(relation: Relation, schema: dict | str) -> DataFrame:
    """Rows (_seq, _f, errors) of a text relation."""
    if not relation.text:
        fields = F.array(*(F.coalesce(relation.df[c].cast("string"), F.lit("")) for c in relation.header))
        rows = relation.df.select(F.monotonically_increasing_id().alias("_seq"), fields.alias("_f"))
    else:
        rows = relation.df.select("_seq", "_f")
    rules = compile_schema(schema, relation.header)
    return rows.withColumn("errors", row_errors(rules, F.col("_f"), len(relation.header)))


def _numbered(rows: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` of ``rows`` with their 1-based number ``row``: partitions' sizes, a row each, give the offsets."""
    part = F.shiftright("_seq", 33)
    first = W.partitionBy(F.lit(0)).orderBy("part")
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("_seq").alias("least"))
    offsets = sizes.select("part", "least", (F.sum("n").over(first) - F.col("n")).alias("before"))
    return some.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("row", F.col("before") + F.col("_seq") - F.col("least") + 1).drop("part", "before", "least")


def error_rows(relation: Relation, schema: dict | str) -> DataFrame:
    """Rows (row, pos, column, column_name, rule, value): every error."""
    rows = checked(relation, schema)
    bad = rows.where(F.size("errors") > 0).select("_seq", "errors")
    out = _numbered(rows.select("_seq"), bad).select("row", F.posexplode("errors").alias("pos", "e"))
    return out.select("row", "pos", "e.column", "e.column_name", "e.rule", "e.value")


def report_counts(relation: Relation, schema: dict | str) -> DataFrame:
    """One row: rows_total, rows_valid, rows_invalid, errors_total and a count for each rule, in one pass."""
    rows = checked(relation, schema)
    n = F.size("errors")
    of = lambda rule: F.size(F.filter("errors", lambda e: e["rule"] == rule))
    per = [F.coalesce(F.sum(of(r)), F.lit(0)).cast("long").alias(r) for r in ERRORS]
    return rows.agg(F.count("*").alias("rows_total"), F.count_if(n == 0).alias("rows_valid"), F.count_if(n > 0).alias("rows_invalid"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("errors_total"), *per)


def first_errors(relation: Relation, schema: dict | str, n: int) -> DataFrame:
    """The first n errors in file order."""
    return error_rows(relation, schema).orderBy("row", "pos").limit(n)


def report(relation: Relation, schema: dict | str, max_errors: int | None = DEFAULT_MAX_ERRORS) -> ValidationReport:
    """``max_errors``: 0 is the default cap, None is no cap."""
    cap = DEFAULT_MAX_ERRORS if max_errors == 0 else max_errors
    c = guarded(report_counts(relation, schema).head)
    found = error_rows(relation, schema).orderBy("row", "pos")
    shown = guarded((found if cap is None else found.limit(cap)).collect) if c["errors_total"] else []
    errors = [ValidationError(r["row"], r["column"], r["column_name"], r["rule"], r["value"]) for r in shown]
    return ValidationReport(c["rows_total"], c["rows_valid"], c["rows_invalid"], c["errors_total"], c["errors_total"] > len(errors), {r: c[r] for r in ERRORS if c[r]}, errors)


def _utf8(rows: DataFrame) -> DataFrame:
    bad = F.exists("_f", lambda x: ~F.is_valid_utf8(x))
    return rows.withColumn("_f", F.when(bad, F.raise_error(F.lit("InvalidUtf8")).cast("array<string>")).otherwise(F.col("_f")))


def is_valid(relation: Relation, schema: dict | str) -> bool:
    """False from the first invalid row on; what follows it need not be read."""
    bad = checked(relation, schema).where(F.size("errors") > 0)
    return not guarded(lambda: bad.head(1))


def failed_rows(relation: Relation, schema: dict | str) -> list[dict]:
    """All failed rows in order, as {values, errors}; errors have no row numbers."""
    rows = _utf8(checked(relation, schema)).where(F.size("errors") > 0).orderBy("_seq")
    return [{"values": list(r["_f"]), "errors": [e.asDict() for e in r["errors"]]} for r in guarded(rows.collect)]


def rows_with_errors(relation: Relation, schema: dict | str, as_dict: bool = True) -> Iterator[tuple[dict | tuple, list[ValidationError]]]:
    """Every row in order, a partition at a time."""
    rows = checked(relation, schema).orderBy("_seq")
    for n, r in enumerate(streamed(rows), 1):
        fields = list(r["_f"])
        yield relation.as_dict(fields) if as_dict else tuple(fields), [ValidationError(n, e["column"], e["column_name"], e["rule"], e["value"]) for e in r["errors"]]

