"""What is done already, and the record of past runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem.session import settle


def skip_done(pending: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pending work without the keys that have an output."""
    return pending.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_stats(stats: DataFrame, path: str, run_time: str | None = None) -> None:
    """Add metric rows to the record of their (source, target) pair.

    The run time is passed in, so the same run writes the same rows. The folder and
    its layout come into being with the first write. `stats` is computed once for each call, so
    settle what several records are made of; `compact_stats` merges the files of many runs.
    """
    if run_time is not None:
        stats = stats.withColumn("run_time", F.lit(run_time).cast("timestamp_ntz"))
    # Few rows: one file per pair and run instead of one per pair, run and task.
    one_each = stats.repartition("source", "target")
    one_each.write.mode("append").partitionBy("source", "target").parquet(path)


def compact_stats(spark: SparkSession, path: str) -> None:
    """One file for each pair instead of one for each pair and run; the rows stay the same.

    Written from a stored copy, pair by pair in place of the old files. One writer at a time.
    """
    rows = settle(read_stats(spark, path))
    (rows.repartition("source", "target").sortWithinPartitions("source", "target", "run_time").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("source", "target").parquet(path))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
