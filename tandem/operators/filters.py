"""Row filters. All of them are plain predicates that reach the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tandem.functions.values import check_semantics, is_float


def filter_equal(
    df: DataFrame, column: str, value: object, negate: bool = False, semantics: str = "sql"
) -> DataFrame:
    """`column = value`; negated, frames keep null rows and SQL drops them."""
    col = F.col(column)
    if not negate:
        return df.filter(col == F.lit(value))
    if check_semantics(semantics) == "sql":
        return df.filter(col != F.lit(value))
    return df.filter(~col.eqNullSafe(F.lit(value)))


def filter_all(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conditions))


def filter_any(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, conditions))


def _missing(df: DataFrame, column: str, semantics: str) -> Column:
    col = F.col(column)
    if check_semantics(semantics) == "frame" and is_float(df.schema[column].dataType):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def keep_known(df: DataFrame, column: str, semantics: str = "sql") -> DataFrame:
    """Rows with a value; frames also drop NaN."""
    return df.filter(~_missing(df, column, semantics))


def keep_missing(df: DataFrame, column: str, semantics: str = "sql") -> DataFrame:
    return df.filter(_missing(df, column, semantics))


def match_text(df: DataFrame, column: str, pattern: str, how: str = "contains") -> DataFrame:
    """`contains` takes a literal, `like` a SQL pattern, `regex` an expression (the
    dataframe default). A null never matches."""
    col = F.col(column)
    tests = {
        "contains": lambda: F.contains(col, F.lit(pattern)),
        "like": lambda: col.like(pattern),
        "regex": lambda: col.rlike(pattern),
    }
    return df.filter(tests[how]())


def on_date(df: DataFrame, column: str, day: str) -> DataFrame:
    """Rows of one calendar day; Catalyst turns this into a pushed timestamp range."""
    return df.filter(F.to_date(column) == F.lit(day).cast("date"))


def between_dates(
    df: DataFrame, column: str, first: str, last: str, semantics: str = "sql"
) -> DataFrame:
    """sql: the last day counts whole. frame: only up to its midnight."""
    if check_semantics(semantics) == "sql":
        return df.filter(
            F.to_date(column).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        )
    kind = df.schema[column].dataType
    return df.filter(F.col(column).between(F.lit(first).cast(kind), F.lit(last).cast(kind)))
