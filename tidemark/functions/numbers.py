"""Numbers as the feeds write them, rounding, and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def lenient(text: Column, blank_as_zero: bool = True) -> Column:
    """The number, null where it is none; blank is 0 unless told otherwise."""
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0.0) if blank_as_zero else F.lit(None).cast("double")).otherwise(number)


def strict(text: Column, name: str) -> Column:
    """The number, null where blank; an error where it is negative or none."""
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    wrong = F.raise_error(F.concat(F.lit(f"{name} is not a number of 0 or more: "), text)).cast("double")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("double")).when(number >= 0, number).otherwise(wrong)


def strict_bool(text: Column, name: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"{name} is neither true nor false: "), F.coalesce(text, F.lit("null")))).cast("boolean")
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False).otherwise(wrong)


def half_up(value: Column, digits: int = 0) -> Column:
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def intensity(wait: Column) -> Column:
    return F.when(wait.isNull() | F.isnan(wait.cast("double")), "unknown").when(wait >= 60, "high").when(wait >= 30, "medium").otherwise("low")
