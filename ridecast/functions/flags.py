"""Flags, unit conversion and tolerant conversion of request values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts a request may use for a boolean.
TRUE_TEXTS = ["1", "1.0", "on", "t", "true", "y", "yes"]
FALSE_TEXTS = ["0", "0.0", "off", "f", "false", "n", "no"]
# A decimal number as text: no suffix, no hexadecimal digits, no word.
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def label_flag(column: Column, label: str) -> Column:
    """1 where the text equals the label, else 0; a missing text is 0."""
    return F.coalesce(column == F.lit(label), F.lit(False)).cast("int")


def above(column: Column, threshold: float) -> Column:
    """Strictly above; a missing value is not above, as in a pandas mask."""
    return F.coalesce(column > F.lit(threshold), F.lit(False))


def bool_to_int(column: Column) -> Column:
    return column.cast("int")


def as_category(column: Column) -> Column:
    return column.cast("string")


def log_rain(column: Column) -> Column:
    return F.log1p(column)


def fixed_point(column: Column, digits: int = 6) -> Column:
    """Half-up rounding by plain arithmetic, the same in every SQL engine."""
    scale = F.lit(float(10**digits))
    return F.floor(column * scale + F.lit(0.5)) / scale


def to_boolean(text: Column) -> Column:
    """A request's boolean, or null when the text is none."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(TRUE_TEXTS), F.lit(True)).when(word.isin(FALSE_TEXTS), F.lit(False))


def to_number(text: Column) -> Column:
    """A request's number, or null when the text is none; true and false count as 1 and 0."""
    word = F.trim(text)
    number = F.when(word.rlike(_NUMBER), word.try_cast("double"))
    flag = F.when(F.lower(word) == "true", F.lit(1.0)).when(F.lower(word) == "false", F.lit(0.0))
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    return F.coalesce(finite, flag)


def to_whole_number(text: Column) -> Column:
    """A request's whole number, or null when it is none or has a fraction."""
    number = to_number(text)
    return F.when(number == F.floor(number), number).try_cast("int")
