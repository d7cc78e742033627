"""Structured Streaming over a folder of delimited files: filters and validation, record by record.

Both are stateless, so they need no watermark and hold no state. Every file has the same header as its
first line.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import compiled, predicates
from ..operators.relation import Relation
from ..operators.rules import compile_schema, row_errors
from ..sources.tokenizer import tokenized


def stream_lines(spark: SparkSession, folder: str, header: Sequence[str], delimiter: str = ",") -> DataFrame:
    """Rows (_f) of all data lines. Files are split as for any scan; the line that begins a file is its header and goes."""

    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            path, start = b.column(1), b.column(2)
            apart = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1]))
            fresh = pa.concat_arrays([pa.array([last != (path[0], start[0])]), apart])
            last = path[-1], start[-1]
            yield b.filter(pc.invert(pc.and_(fresh, pc.equal(start, 0)))).select([0])

    lines = spark.readStream.text(folder, lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.mapInArrow(run, "value string").select(tokenized(F.col("value"), delimiter).alias("_f"))


def stream_where(rows: DataFrame, header: Sequence[str], where: str | Sequence | None, negate: bool = False) -> DataFrame:
    """The stream's matching rows, as wide as the header."""
    relation = Relation(rows, list(header), text=True)
    condition = compiled(predicates(where), lambda name: (relation.at(relation.index(name)), relation.kind(0)), negate)
    kept = rows if condition is None else rows.where(condition)
    return kept.select(*(F.coalesce(relation.at(i), F.lit("")).alias(h) for i, h in enumerate(header)))


def stream_errors(rows: DataFrame, header: Sequence[str], schema: dict | str) -> DataFrame:
    """The stream's rows (values, errors)."""
    return rows.select(F.col("_f").alias("values"), row_errors(compile_schema(schema, header), F.col("_f"), len(header)).alias("errors"))
