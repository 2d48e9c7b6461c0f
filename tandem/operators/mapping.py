"""User functions and column arithmetic."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def apply_function(
    df: DataFrame,
    column: str,
    new_column: str,
    function: Callable,
    return_type: str | None = None,
    of_series: bool = False,
) -> DataFrame:
    """New column from a function of one column.

    Without `return_type` the function maps Column to Column and stays in the JVM. With
    it, the function maps one Python value to another and runs inside Arrow batches; it
    sees nulls and decides about them. `of_series` functions map a whole pandas Series to one of
    the same length: one call a batch instead of one a value.
    """
    if return_type is None:
        return df.withColumn(new_column, function(F.col(column)))

    @F.pandas_udf(return_type)
    def apply(values: pd.Series) -> pd.Series:
        return function(values) if of_series else pd.Series([function(v) for v in values], dtype=object)

    return df.withColumn(new_column, apply(F.col(column)))


def column_product(df: DataFrame, left: str | Column, right: str | Column, name: str) -> DataFrame:
    a = F.col(left) if isinstance(left, str) else left
    b = F.col(right) if isinstance(right, str) else right
    return df.withColumn(name, a * b)
