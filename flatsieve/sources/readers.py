"""Relations from CSV, NDJSON and JSON-array files, bytes and tables."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ScanError
from ..operators.relation import Relation, guarded
from .tokenizer import tokenized

JSON_SUFFIXES = (".ndjson", ".jsonl", ".json")


@dataclass(frozen=True)
class InputLimits:
    """Inclusive bounds on a record; None is no bound."""

    max_record_bytes: int | None = None
    max_fields: int | None = None

    @classmethod
    def recommended(cls) -> InputLimits:
        return cls(16 * 1024 * 1024, 4096)


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (_seq, value): lines by line feed only, numbered in file order with gaps.

    Splits of one file are planned in its order, so the ids grow along the file.
    """
    return spark.read.text(path, lineSep="\n").select(F.monotonically_increasing_id().alias("_seq"), "value")


def from_csv(path: str, delimiter: str = ",", limits: InputLimits | None = None, spark: SparkSession | None = None) -> Relation:
    spark, limits = spark or session(), limits or InputLimits()
    lines = guarded(lambda: _lines(spark, path))
    first = guarded(lambda: lines.where("_seq = 0").select(tokenized(F.col("value"), delimiter, limits.max_record_bytes, limits.max_fields)).head(1))
    if not first:
        raise ScanError("EmptyFile")
    data = lines.where("_seq > 0")
    return Relation(data.select("_seq", tokenized(F.col("value"), delimiter, limits.max_record_bytes, limits.max_fields).alias("_f")), first[0][0], text=True, lines=data)


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first ``n`` bytes at most of a file, or of a folder's first file; the rest isn't read."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(fs.globStatus(p) or [])
    while found and found[0].isDirectory():
        inside = fs.listStatus(found[0].getPath())
        found = sorted((x for x in inside if x.getPath().getName()[:1] not in "._"), key=lambda x: x.getPath().getName())
    if not found:
        return b""
    stream = fs.open(found[0].getPath())
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def _first_object(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The text of the first object, and whether the file is an array.

    Only the file's beginning is read, in growing pieces, until an object is whole.
    """
    guarded(lambda: spark.read.text(path))  # a path that isn't there is an error as for any source
    sizes, decoder = [1 << 16, 1 << 20, 1 << 24, 1 << 28], json.JSONDecoder()
    for n in sizes:
        text = _head(spark, path, n).decode("utf-8", "ignore")
        body = text.lstrip("﻿ \t\r\n")
        if not body:
            raise ScanError("EmptyFile")
        array = body[0] == "["
        at = body.find("{")
        if array and at < 0 and body[1:].lstrip()[:1] == "]":
            raise ScanError("EmptyFile")
        try:
            _, end = decoder.raw_decode(body[at:]) if at >= 0 else (None, 0)
            if at >= 0:
                return body[at : at + end], array
        except ValueError:
            if len(text.encode()) < n:
                break
    raise ScanError("InvalidJson")


def _within(spark: SparkSession, path: str, array: bool, limits: InputLimits) -> None:
    """Raises for the first record beyond ``limits``: a pass of its own, up to that record, and only where there are limits.

    A line of NDJSON counts with its source bytes and all keys, an object of an array with the bytes of its compact text
    and the keys that aren't null.
    """
    if limits.max_record_bytes is None and limits.max_fields is None:
        return
    if array:
        found = spark.read.option("primitivesAsString", True).option("multiLine", True).json(path)
        named = ["`" + c.replace("`", "``") + "`" for c in found.columns if c != "_corrupt_record"]
        rows = found.select(F.to_json(F.struct(*named)).alias("value"))
    else:
        rows = spark.read.text(path, lineSep="\n")
    large = F.octet_length("value") > F.lit(limits.max_record_bytes)
    many = F.size(F.json_object_keys("value")) > F.lit(limits.max_fields)
    found = guarded(lambda: rows.select(F.when(large, "RecordTooLarge").when(many, "TooManyFields").alias("e")).where("e IS NOT NULL").head(1))
    if found:
        raise ScanError(found[0]["e"])


def _by_lines(spark: SparkSession, path: str, header: list[str]) -> list[str | None] | None:
    """The first object's values, if the file is an array with a line for each flat object: such a file is read by lines, in splits. None for any other.

    In JSON no string holds a line end. Without its strings, such a line has braces at its ends only. The first line is [ alone, or has an
    object, too, for which the values are; the last one ends with ]. One pass over the lines, of which kinds and places are told.
    """
    bare = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '"[^"]*+"', "")
    end = F.when(bare.rlike(r"^\s*\{[^\"{}\[\]]*+\}\s*$"), "}").when(bare.rlike(r"^\s*\{[^\"{}\[\]]*+\}\s*,\s*$"), ",").when(bare.rlike(r"^\s*\{[^\"{}\[\]]*+\}\s*\]\s*$"), "}]").when(bare.rlike(r"^\s*\]\s*$"), "]").otherwise("")
    first = r"^\[\s*(\{[^\"{}\[\]]*+\}\s*,)?\s*$"
    kind = F.when(F.col("_seq") == 0, F.when(bare.rlike(first), "[").otherwise("")).otherwise(end)
    lines = _lines(spark, path).select("_seq", kind.alias("kind"), F.when(F.col("_seq") == 0, F.col("value")).alias("value"))
    found = {r["kind"]: r for r in lines.groupBy("kind").agg(F.count("*").alias("n"), F.max("_seq").alias("at"), F.max("value").alias("value")).collect()}
    ends = sorted((r["at"], k, r["n"]) for k, r in found.items() if k not in ("[", ","))
    if "[" not in found or [(k, n) for _, k, n in ends] not in ([("}]", 1)], [("}", 1), ("]", 1)]) or "," in found and found[","]["at"] > ends[0][0]:
        return None
    text = found["["]["value"].strip()[1:].strip().removesuffix(",")
    try:
        raw = lambda s: s
        held = json.loads(text or "{}", parse_int=raw, parse_float=raw)
        json.dumps(held, ensure_ascii=False).encode()
    except ValueError:
        return None
    if any(isinstance(v, float) for v in held.values()):  # NaN
        return None
    return [v if v is None or isinstance(v, str) else str(v).lower() for v in map(held.get, header)]


def from_json(path: str, spark: SparkSession | None = None, limits: InputLimits | None = None) -> Relation:
    """NDJSON, or an array of objects (sniffed). The first object's keys are the header; values keep their source text.

    Values come from the file reader with a schema of strings, as other JSON functions rewrite numbers. It reads an array in one
    task, with a read of the file for each number, so arrays with a line for each flat object are read by lines (``_by_lines``).
    A missing key and null are empty; keys that the first object lacks are ignored; a nested value or
    a malformed record is an error where it is used.
    """
    spark = spark or session()
    first, array = _first_object(spark, path)
    _within(spark, path, array, limits or InputLimits())
    header = list(dict.fromkeys(k for k, _ in json.loads(first, object_pairs_hook=lambda kv: kv)))
    if not header:
        raise ScanError("InvalidJson")
    bad = "_corrupt_record"
    while bad in header:
        bad += "_"
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header] + [T.StructField(bad, T.StringType())])
    known = guarded(lambda: _by_lines(spark, path, header)) if array else None
    read = spark.read.schema(schema).option("multiLine", array and known is None).option("columnNameOfCorruptRecord", bad).option("mode", "PERMISSIVE")
    rows = guarded(lambda: (read if known is None else read.option("lineSep", "\n")).json(path))
    rows = rows.toDF(*(f"_c{i}" for i in range(len(header))), "_bad").select(F.monotonically_increasing_id().alias("_seq"), "*")
    if known is not None:  # the lines of the brackets are no objects for the reader
        rows = rows.where(~(F.coalesce(F.trim(F.regexp_replace("_bad", r"\s", "")).isin("[", "]"), F.lit(False)) & F.col("_c0").isNull()))
        rows = rows.select("_seq", *(F.when(F.col("_seq") == 0, F.lit(v).cast("string")).otherwise(F.col(f"_c{i}")).alias(f"_c{i}") for i, v in enumerate(known)), F.when(F.col("_seq") != 0, F.col("_bad")).alias("_bad"))
    # the fields carry the guards, so that pruning a column can't drop them
    value = lambda i: F.when(F.col(f"_c{i}").rlike(r"^\s*[\[{]"), F.when(F.try_parse_json(F.col(f"_c{i}")).isNotNull(), F.raise_error(F.lit("NestedValueNotSupported")).cast("string")).otherwise(F.col(f"_c{i}"))).otherwise(F.coalesce(F.col(f"_c{i}"), F.lit("")))
    fields = F.when(F.col("_bad").isNull(), F.array(*map(value, range(len(header))))).otherwise(F.raise_error(F.lit("InvalidJson")).cast("array<string>"))
    return Relation(rows.select("_seq", fields.alias("_f")), header, text=True)


def from_bytes(data: bytes, format: str = "csv", spark: SparkSession | None = None) -> Relation:
    """A source held in memory, through a temporary file on the driver (local sessions) that lives as long as the relation."""
    if format not in ("csv", "ndjson", "json"):
        raise ValueError("format must be csv, ndjson or json")
    held = tempfile.NamedTemporaryFile(suffix="." + format)  # noqa: SIM115
    held.write(data)
    held.flush()
    if not data:
        raise ScanError("EmptyFile")
    out = from_csv("file://" + held.name, spark=spark) if format == "csv" else from_json("file://" + held.name, spark=spark)
    return replace(out, held=held)


def from_table(df: DataFrame, order: list[str] | None = None) -> Relation:
    """A typed table. ``order`` names columns that together say which row is before which, for limits and ties."""
    return Relation(df, list(df.columns), text=False, order=order)


def open_path(path: str | os.PathLike, format: str | None = None, delimiter: str = ",", limits: InputLimits | None = None, spark: SparkSession | None = None) -> Relation:
    """A relation by the file's suffix or the given format; what isn't JSON is CSV."""
    path = os.fspath(path)
    local = path.removeprefix("file://")
    if "://" not in local:
        if not os.path.exists(local):
            raise ScanError(f"FileNotFound: {path}")
        if os.path.isfile(local) and os.path.getsize(local) == 0:
            raise ScanError("EmptyFile")
        path = "file://" + os.path.abspath(local)
    if format is None:
        format = "json" if path.lower().endswith(JSON_SUFFIXES) else "csv"
    return from_csv(path, delimiter, limits, spark) if format == "csv" else from_json(path, spark, limits)


def as_text(df: DataFrame) -> Relation:
    """A table's rows as a text source would give them: every value as its text, null as empty."""
    fields = F.array(*(F.coalesce(df[c].cast("string"), F.lit("")) for c in df.columns))
    return Relation(df.select(F.monotonically_increasing_id().alias("_seq"), fields.alias("_f")), list(df.columns), text=True)
