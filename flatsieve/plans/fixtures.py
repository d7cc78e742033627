"""Small files that queries of the catalogue read: made of literals, or written from a table."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import csv_line, csv_text, write_lines

_FOLDER: list[str] = []
_MADE: dict[tuple, str] = {}


def path(name: str) -> str:
    """A new path in a folder of this process, which ends with it: in the shared folder of spark.checkpoint.dir where that is a mounted one."""
    if not _FOLDER:
        spark = SparkSession.getActiveSession()
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") if spark else ""
        shared = re.sub("^file:(//)?", "", shared)
        mounted = shared and "://" not in shared
        if mounted:
            os.makedirs(shared, exist_ok=True)
        _FOLDER.append(tempfile.mkdtemp(prefix="flatsieve-", dir=shared if mounted else None))
        atexit.register(shutil.rmtree, _FOLDER[0], ignore_errors=True)
    return os.path.join(tempfile.mkdtemp(dir=_FOLDER[0]), name)


def literal(name: str, text: str) -> str:
    out = path(name)
    with open(out, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return out


def exported(df: DataFrame, key: str, format: str = "csv") -> str:
    """The table as a file in the order of ``key``; the same table is written once for a process."""
    name = (df._jdf.queryExecution().analyzed().canonicalized().toString(), tuple(df.inputFiles()), tuple(df.columns), key, format)
    if name not in _MADE:
        _MADE[name] = _export(df, key, format)
    return _MADE[name]


def _export(df: DataFrame, key: str, format: str) -> str:
    out = path(f"table.{format}")
    cells = F.array(*(F.coalesce(df[c].cast("string"), F.lit("")) for c in df.columns))
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    if format in ("csv", "tsv"):
        delimiter = "," if format == "csv" else "\t"
        write_lines(df.select(F.col(key).alias("_seq"), csv_line(cells, delimiter).alias("value")), out, csv_text(df.columns, delimiter) + "\n")
    elif format == "ndjson":
        write_lines(df.select(F.col(key).alias("_seq"), row.alias("value")), out)
    else:
        last = df.agg(F.max(key)).first()[0]
        write_lines(df.select(F.col(key).alias("_seq"), F.concat(row, F.when(F.col(key) == F.lit(last), F.lit("]")).otherwise(F.lit(","))).alias("value")), out, "[")
    return out
