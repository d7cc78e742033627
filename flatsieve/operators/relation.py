"""A lazy query over one source: filter, complement, projection, limit, count, aggregate, group, top-k, order.

Text sources keep a row's fields as they were read (``_f``, where a short row lacks its last fields,
which is not the same as their being empty) and its place in the file (``_seq``). Tables keep their
typed columns, so that conditions reach the scan. Names are resolved to positions first, exactly and by
case; the first of equal names wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ScanError
from ..functions.numeric import num
from ..functions.predicates import Predicate, compiled, predicates

_CODES = ("UnterminatedQuote", "RecordTooLarge", "TooManyFields", "NestedValueNotSupported", "InvalidJson", "InvalidUtf8")
#: Rows up to which a limit on a text source is collected at once, without reading what follows.
FEW = 100_000


def guarded(action: Callable[[], Any]) -> Any:
    """Runs an action; what the engine raises about the data or the path becomes a ScanError."""
    try:
        return action()
    except PySparkException as e:
        said = str(e)
        raise ScanError(next((c for c in _CODES if c in said), said.splitlines()[0] if said else "error")) from e
    except Exception as e:  # Py4J wraps what isn't an analysis error
        said = str(e)
        if code := next((c for c in _CODES if c in said), None):
            raise ScanError(code) from e
        raise


def streamed(df: DataFrame) -> Iterator:
    """The rows of ``df`` in its order, a partition at a time."""
    rows = guarded(df.toLocalIterator)
    while (r := guarded(lambda: next(rows, None))) is not None:
        yield r


def summary(n: Column) -> list[Column]:
    """count, sum, min, max and avg of a numeric expression; without numbers the sum is 0 and the others null."""
    d = n.cast("double")
    return [F.count(n).alias("count"), F.coalesce(F.sum(d), F.lit(0.0)).alias("sum"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("avg")]


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    header: list[str]
    text: bool
    order: list[str] | None = None
    #: For delimited text, the unparsed data lines: a bare count needs no fields.
    lines: DataFrame | None = None
    conditions: tuple[Predicate, ...] = ()
    negated: bool = False
    columns: tuple[int, ...] | None = None
    rows: int | None = None
    held: Any = field(default=None, compare=False)

    # names and fields

    def index(self, name: str) -> int:
        try:
            return self.header.index(name)
        except ValueError:
            raise ScanError(f"UnknownColumn: {name}") from None

    def at(self, i: int) -> Column:
        """The i-th field as it is; null where a text row has none."""
        return F.try_element_at("_f", F.lit(i + 1)) if self.text else self.df[self.df.columns[i]]

    def kind(self, i: int) -> T.DataType:
        return T.StringType() if self.text else self.df.schema.fields[i].dataType

    def number(self, i: int) -> Column:
        """The i-th field as a number, null where it isn't one."""
        kind = self.kind(i)
        if isinstance(kind, T.StringType):
            return num(self.at(i))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(F.abs(self.at(i)) < float("inf"), self.at(i))
        return self.at(i) if isinstance(kind, T.NumericType) else F.lit(None).cast("double")

    def _ordered_by(self) -> list[Column]:
        if self.text:
            return [F.col("_seq")]
        return [self.df[c] for c in (self.order if self.order is not None else self.header)]

    # building

    def where(self, where: str | Sequence | None, negate: bool = False) -> Relation:
        found = tuple(predicates(where))
        for p in found:
            self.index(p.column)
        return replace(self, conditions=self.conditions + found, negated=negate)

    def select(self, columns: Sequence[str] | None) -> Relation:
        return self if columns is None else replace(self, columns=tuple(map(self.index, columns)))

    def limit(self, n: int | None) -> Relation:
        return self if n is None else replace(self, rows=n)

    # running

    def _condition(self) -> Column | None:
        return compiled(self.conditions, lambda name: (self.at(self.index(name)), self.kind(self.index(name))), self.negated)

    def kept(self, ordered: bool = False) -> DataFrame:
        """The source's rows after filter and limit; a limit takes the first rows in order."""
        condition = self._condition()
        df = self.df if condition is None else self.df.where(condition)
        if self.rows is not None:
            df = df.orderBy(*self._ordered_by()).limit(self.rows)
        elif ordered:
            df = df.orderBy(*self._ordered_by())
        return df

    def frame(self, ordered: bool = False) -> DataFrame:
        """The result as a table as wide as the header or the selection: absent fields are empty, extra ones dropped."""
        which = range(len(self.header)) if self.columns is None else self.columns
        cells = [F.coalesce(self.at(i), F.lit("")) if self.text else self.at(i) for i in which]
        return self.kept(ordered).select(*(c.alias(self.header[i]) for c, i in zip(cells, which)))

    def first(self) -> dict | None:
        """The first match as a dictionary, None if there is none."""
        found = self.limit(1 if self.rows is None else min(1, self.rows)).dicts()
        return found[0] if found else None

    def as_dict(self, fields: list[str | None]) -> dict:
        """A text row's view by name: extra fields are ``col`` and their number, absent ones are left out; or the selection."""
        if self.columns is not None:
            return {self.header[i]: (fields[i] if i < len(fields) and fields[i] is not None else "") if self.text else fields[i] for i in self.columns}
        return {(self.header[i] if i < len(self.header) else f"col{i}"): v for i, v in enumerate(fields)}

    def raw(self) -> DataFrame:
        """Rows (_f) in order: all fields of a row as an array or, for tables, a struct of its columns."""
        df = self.kept(ordered=True)
        return df.select("_f") if self.text else df.select(F.struct(*(self.df[c] for c in self.df.columns)).alias("_f"))

    def few(self) -> DataFrame | None:
        """For a text source with a limit of at most FEW: its rows in order, for the driver to collect.

        Partitions follow the file, and ``collect`` of a bare limit runs them in order until it has enough.
        """
        if not self.text or self.rows is None or self.rows > FEW:
            return None
        condition = self._condition()
        return (self.df if condition is None else self.df.where(condition)).limit(self.rows)

    def local(self) -> Iterator[list]:
        """All fields of each row, in order: a partition at a time, or at once where a limit says that they are few."""
        few = self.few()
        rows = guarded(few.select("_f").collect) if few is not None else streamed(self.raw())
        return (list(r[0]) for r in rows)

    def sample(self, n: int) -> Relation:
        """The first ``n`` rows as a relation of their own; what follows them in a text source isn't read where they are few."""
        few = self.limit(n if self.rows is None else min(n, self.rows))
        rows = few.few()
        if rows is None:
            return few
        held = guarded(rows.select("_seq", "_f").collect)
        local = rows.sparkSession.createDataFrame(held, "_seq long, _f array<string>")
        return replace(few, df=local, lines=None, conditions=(), negated=False, held=self)

    def dicts(self) -> list[dict]:
        return [self.as_dict(f) for f in self.local()]

    def count(self) -> int:
        """Matching rows. Without a filter nothing is parsed."""
        if not self.conditions and not self.negated and self.lines is not None:
            n = guarded(self.lines.count)
            return n if self.rows is None else min(n, self.rows)
        if self.rows is None:
            return guarded(self.kept().count)
        condition = self._condition()
        return guarded((self.df if condition is None else self.df.where(condition)).limit(self.rows).count)

    def count_frame(self) -> DataFrame:
        condition = self._condition()
        df = self.df if condition is None else self.df.where(condition)
        return (df if self.rows is None else df.limit(self.rows)).agg(F.count("*").alias("count"))

    def aggregate(self, column: str) -> DataFrame:
        """One row: count, sum, min, max, avg of the column's numbers."""
        return self.aggregates([column]).select(*(F.col(f"0_{x}").alias(x) for x in ("count", "sum", "min", "max", "avg")))

    def aggregates(self, columns: Sequence[str], *more: Column) -> DataFrame:
        """One row for several columns in one pass: ``i_count``, ``i_sum`` and so on for the i-th, and ``more``."""
        many = [c.alias(f"{i}_{n}") for i, name in enumerate(columns) for c, n in zip(summary(self.number(self.index(name))), ("count", "sum", "min", "max", "avg"))]
        return self.kept().agg(*many, *more)

    def group_by(self, group: str, column: str) -> DataFrame:
        """A row for each text of ``group``: key, count, sum, min, max, avg. Rows without that field are skipped; empty is a key."""
        key = self.at(self.index(group))
        return self.kept().where(key.isNotNull()).groupBy((key if self.text else key.cast("string")).alias("key")).agg(*summary(self.number(self.index(column))))

    def topk(self, column: str, k: int, descending: bool = True) -> DataFrame:
        """The k rows with the largest (or least) numbers in the column, with that number as ``_key``; rows without one are left out."""
        n = self.number(self.index(column))
        rows = self.kept().where(n.isNotNull()).orderBy(n.desc() if descending else n.asc(), *self._ordered_by()).limit(k)
        return rows.select(*self._cells(), n.cast("double").alias("_key"))

    def order_by(self, column: str, descending: bool = False) -> DataFrame:
        """All rows by the column: empty or absent first, then numbers by value, then other texts by bytes; reversed if descending."""
        i = self.index(column)
        way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
        c, n = self.at(i), self.number(i)
        if isinstance(self.kind(i), T.StringType):
            c = F.coalesce(c, F.lit(""))
            tier = F.when(c == "", 0).when(n.isNotNull(), 1).otherwise(2)
            keys = [way(tier), way(n), way(c)]
        else:
            keys = [way(c)]
        return self.kept().orderBy(*keys, *self._ordered_by()).select(*self._cells())

    def _cells(self) -> list[Column]:
        which = range(len(self.header)) if self.columns is None else self.columns
        return [(F.coalesce(self.at(i), F.lit("")) if self.text else self.at(i)).alias(self.header[i]) for i in which]
