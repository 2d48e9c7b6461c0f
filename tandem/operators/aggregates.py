"""Aggregates. Every one combines map-side before its exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tandem.functions.values import check_semantics, is_float, nan_to_null


def _operand(df: DataFrame, column: str, semantics: str) -> Column:
    """The column as the dialect's aggregates see it: frames skip NaN."""
    col = F.col(column)
    if check_semantics(semantics) == "frame":
        return nan_to_null(col, df.schema[column].dataType)
    return col


def _sum(df: DataFrame, column: str, semantics: str) -> Column:
    summed = F.sum(_operand(df, column, semantics))
    return F.coalesce(summed, F.lit(0).cast("int")) if semantics == "frame" else summed


def total(df: DataFrame, column: str, semantics: str = "sql", name: str = "total") -> DataFrame:
    """Sum over the table; of nothing it is null in SQL and 0 in frames."""
    return df.agg(_sum(df, column, semantics).alias(name))


def group_total(
    df: DataFrame, key: str, column: str, semantics: str = "sql", name: str = "total"
) -> DataFrame:
    """Sum per key. Frames drop the null (and NaN) key and sort by key."""
    summed = _sum(df, column, semantics).alias(name)
    if semantics == "sql":
        return df.groupBy(key).agg(summed)
    known = df.filter(F.col(key).isNotNull())
    if is_float(df.schema[key].dataType):
        known = known.filter(~F.isnan(key))
    return known.groupBy(key).agg(summed).orderBy(key)


def conditional_total(
    df: DataFrame, condition: Column, column: str, semantics: str = "sql", name: str = "total"
) -> DataFrame:
    """Sum of the rows that meet a condition, 0 for the others."""
    value = F.sum(F.when(condition, _operand(df, column, semantics)).otherwise(0))
    value = F.coalesce(value, F.lit(0)) if semantics == "frame" else value
    return df.agg(value.alias(name))


def percentage(df: DataFrame, condition: Column, name: str = "percentage") -> DataFrame:
    """Share of rows meeting a condition, in percent; null for an empty table."""
    return df.agg(
        F.try_divide(F.count_if(condition) * F.lit(100.0), F.count(F.lit(1))).alias(name)
    )


def unique_values(
    df: DataFrame, column: str, semantics: str = "sql", position: str | None = None
) -> DataFrame:
    """Distinct values; frames list them by first appearance along `position`."""
    if check_semantics(semantics) == "sql":
        return df.select(column).distinct()
    if position is None:
        raise ValueError("frame order needs a position column")
    firsts = df.groupBy(column).agg(F.min(position).alias("first_position"))
    return firsts.orderBy("first_position")


def unique_count(
    df: DataFrame, column: str, approximate: bool = False, name: str = "n_unique", semantics: str = "sql"
) -> DataFrame:
    """Number of distinct non-null values, exact unless asked otherwise; frames leave NaN out too."""
    value = _operand(df, column, semantics)
    count = F.approx_count_distinct(value) if approximate else F.count_distinct(value)
    return df.agg(count.alias(name))


def largest(df: DataFrame, column: str, semantics: str = "sql", name: str = "largest") -> DataFrame:
    """Maximum; NaN wins in SQL and is skipped in frames."""
    return df.agg(F.max(_operand(df, column, semantics)).alias(name))


def smallest(df: DataFrame, column: str, semantics: str = "sql", name: str = "smallest") -> DataFrame:
    return df.agg(F.min(_operand(df, column, semantics)).alias(name))


def mean(df: DataFrame, column: str, semantics: str = "sql", name: str = "mean") -> DataFrame:
    return df.agg(F.avg(_operand(df, column, semantics)).alias(name))


def row_count(df: DataFrame, condition: Column, name: str = "n_rows") -> DataFrame:
    return df.filter(condition).agg(F.count(F.lit(1)).alias(name))
