"""Sorting, limits and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.functions.values import check_semantics, is_float
from tandem.session import settle


def sort_key(column: str, descending: bool = False, semantics: str = "sql", holds_nan: bool = False) -> Column:
    """Sort expression with the dialect's null place spelled out.

    SQL puts null above every value, so first when descending; frames put it, and NaN
    with it, last in both directions. `holds_nan` says that the column is of floats.
    """
    col = F.col(column)
    if check_semantics(semantics) == "sql":
        return col.desc_nulls_first() if descending else col.asc_nulls_last()
    known = F.when(~F.isnan(col), col) if holds_nan else col
    return known.desc_nulls_last() if descending else known.asc_nulls_last()


def sort_rows(
    df: DataFrame, column: str, descending: bool = True, semantics: str = "sql",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    floats = is_float(df.schema[column].dataType)
    return df.orderBy(sort_key(column, descending, semantics, floats), *tiebreak)


def first_rows(df: DataFrame, n: int, order: Sequence[Column] = ()) -> DataFrame:
    """First n rows; with an order this is a top-k that never sorts the whole table."""
    return (df.orderBy(*order) if order else df).limit(n)


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    name: str = "position",
    weight: str | None = None,
) -> tuple[DataFrame, int]:
    """Number rows 0.. along `order` without a single-partition window.

    Rows are range-partitioned and sorted, and each partition's count is added to the
    later ones. `order` should be total. With `weight`, a row takes that many places
    and `name` is its first. Also returns the number of places in all.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Range bounds come from a sample, so both uses below must read one stored result.
    # The id holds the partition number above bit 33 and the row's place below it.
    stored = settle(ranged.withColumn("_id", local)).withColumn(
        "_part", F.shiftright("_id", 33)
    )
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # One row per partition: bounded by the shuffle setting, not by the data.
    sizes = stored.groupBy("_part").agg(size.alias("n")).orderBy("_part").collect()
    starts, seen = [], 0
    for row in sizes:
        starts.append((row["_part"], seen))
        seen += int(row["n"])
    offsets = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    placed = stored.join(offsets, "_part")
    if weight is None:
        inside = F.col("_id") - F.shiftleft("_part", 33)
    else:
        before = Window.partitionBy("_part").orderBy("_id").rowsBetween(
            Window.unboundedPreceding, -1
        )
        inside = F.coalesce(F.sum(weight).over(before), F.lit(0))
    numbered = placed.withColumn(name, F.col("_start") + inside)
    return numbered.drop("_part", "_start", "_id"), seen
