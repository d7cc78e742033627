"""Fields of a delimited line, as one expression.

A field is quoted only if its first character is a quote; two quotes inside are one, delimiters inside
are data, and text between the closing quote and the next delimiter is dropped. Elsewhere quotes are
data. A quote that isn't closed on its line is an error, raised where the fields are used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenized(line: Column, delimiter: str = ",", max_record_bytes: int | None = None, max_fields: int | None = None) -> Column:
    """``array<string>``. Lines without a quote are split plainly. The limits are inclusive."""
    line = F.regexp_replace(line, r"\r\z", "")
    d = re.escape(delimiter)
    piece = rf'{d}(?:"[^"]*+(?:""[^"]*+)*+"[^{d}]*+|(?!")[^{d}]*+)'
    whole = F.concat(F.lit(delimiter), line)
    pieces = F.regexp_extract_all(whole, F.lit(piece), 0)
    body = lambda x: F.when(F.substring(x, 2, 1) == '"', F.replace(F.regexp_extract(x, rf'^{d}"([^"]*+(?:""[^"]*+)*+)"', 1), F.lit('""'), F.lit('"'))).otherwise(F.substring(x, F.lit(2), F.length(x)))
    covered = F.length(F.array_join(pieces, "")) == F.length(whole)
    quoted = F.when(covered, F.transform(pieces, body)).otherwise(F.raise_error(F.lit("UnterminatedQuote")).cast("array<string>"))
    fields = F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, d, -1))
    if max_record_bytes is not None:
        fields = F.when(F.octet_length(line) <= max_record_bytes, fields).otherwise(F.raise_error(F.lit("RecordTooLarge")).cast("array<string>"))
    if max_fields is not None:
        fields = F.transform(F.array(fields), lambda f: F.when(F.size(f) <= max_fields, f).otherwise(F.raise_error(F.lit("TooManyFields")).cast("array<string>")))[0]
    return fields
