"""The one rule that says whether a text is a number.

Decimal digits with an optional sign, point and exponent, whole and untrimmed; what isn't finite
isn't a number. ``try_cast`` alone would trim, and take ``nan``, ``inf`` and type suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
INTEGER = r"^[+-]?[0-9]+\z"


def num(c: Column) -> Column:
    """The text as a double, null if it is no number."""
    d = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def num_trimmed(c: Column) -> Column:
    """The rule of validation, which trims spaces and tabs."""
    return num(F.btrim(c, F.lit(" \t")))


def literal_number(text: str) -> float | None:
    """The same rule on the driver."""
    import math
    import re

    if re.fullmatch(NUMBER[1:-2], text, re.ASCII) is None:
        return None
    value = float(text)
    return value if math.isfinite(value) else None
