"""Scalar expressions whose meaning differs between SQL and dataframe code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

SEMANTICS = ("sql", "frame")


def check_semantics(semantics: str) -> str:
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}, not {semantics!r}")
    return semantics


def is_float(dtype: DataType) -> bool:
    return isinstance(dtype, (FloatType, DoubleType))


def nan_to_null(value: Column, dtype: DataType) -> Column:
    """Dataframe code counts NaN as missing."""
    return F.when(~F.isnan(value), value) if is_float(dtype) else value


def slice_text(text: Column, start: int, length: int, semantics: str = "sql") -> Column:
    """Substring from a 1-based start.

    sql: positions before 1 exist but are blank, so `(0, 2)` yields one character.
    frame: the 0-based slice `[start-1 : start-1+length]`, negative ends count from
    the back.
    """
    if check_semantics(semantics) == "sql":
        if length < 0:
            raise ValueError("negative substring length")
        first = max(start, 1)
        return F.substring(text, first, max(0, start + length - first))
    size = F.length(text)

    def bound(at: int) -> Column:
        return F.least(F.lit(at), size) if at >= 0 else F.greatest(size + at, F.lit(0))

    low, high = bound(start - 1), bound(start - 1 + length)
    return F.substring(text, low + 1, F.greatest(high - low, F.lit(0)))


def date_field(moment: Column, field: str, semantics: str = "sql") -> Column:
    """Calendar field as int. `dow` is Sunday = 0 in SQL, Monday = 0 in frames."""
    if field == "dow":
        sql = check_semantics(semantics) == "sql"
        return F.dayofweek(moment) - 1 if sql else F.weekday(moment)
    makers = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth,
        "hour": F.hour, "minute": F.minute,
    }
    return makers[field](moment)


def affine(vector: Column, scale: float, shift: float) -> Column:
    return F.transform(vector, lambda x: x * F.lit(scale) + F.lit(shift))


def elementwise(left: Column, right: Column, op: str) -> Column:
    """Element-wise `+ - * /` of two arrays of one length."""
    makers = {
        "+": lambda a, b: a + b,
        "-": lambda a, b: a - b,
        "*": lambda a, b: a * b,
        "/": lambda a, b: F.try_divide(a, b),
    }
    return F.zip_with(left, right, makers[op])


def array_slice(vector: Column, start: int, stop: int) -> Column:
    """0-based half-open slice with non-negative ends."""
    return F.slice(vector, start + 1, max(stop - start, 0))
