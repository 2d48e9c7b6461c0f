"""Session settings and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from measured sizes, so no operator has to guess a broadcast;
# the skew rules split hot join partitions at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Plans here have many expressions; recording a Python call site for each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "tandem", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above and any further ones."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _private_dir() -> str:
    return tempfile.mkdtemp(prefix="tandem-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by `spark.checkpoint.dir`.

    A private temporary folder is made only where the setting is missing and the
    master is local, where driver and executors share one disk anyway.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _private_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute `df` once and read it back from the shared folder from then on.

    Used where two consumers must see the very same rows (partition numbers, model
    answers), also after executors are lost. Parquet rather than a checkpoint file, so
    that a consumer of few columns reads only those.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def _package_archive() -> str:
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tandem-package-")) / "tandem"
    return shutil.make_archive(str(target), "zip", package.parent, package.name)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers.

    Does what `spark-submit --py-files` does, for sessions started without it.
    """
    archive = _package_archive()
    if not any(Path(f).name == Path(archive).name for f in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(archive)
