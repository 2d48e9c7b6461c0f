"""Named Parquet tables and SQL text over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Each named table; a missing one raises an analysis error before any job."""
    return {name: table(spark, folder, name) for name in names}


def register_views(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    for name, df in load_tables(spark, folder, names).items():
        df.createOrReplaceTempView(name)


def query_only(text: str) -> str:
    """The text as a subquery, where only a SELECT parses: DDL and writes fail."""
    return f"SELECT * FROM (\n{text.strip().rstrip(';')}\n)"


def run_sql(spark: SparkSession, folder: str, names: Iterable[str], text: str) -> DataFrame:
    """Rows of a SELECT over the named tables.

    A database table comes in the same way through the built-in reader:
    `spark.read.format("jdbc").option("query", text)`.
    """
    register_views(spark, folder, names)
    return spark.sql(query_only(text))
