"""Runs over folders of prompt files that go on where they stopped.

The prompt files are a stream of files read once each: Structured Streaming's checkpoint says which
have been taken up, and an output folder for each model and file says which are done. So a
run that was stopped and started again asks no prompt of a finished file a second time, and files
that were added meanwhile are answered by the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tandem.sources.progress import skip_done

KEYS = ["model", "prompt_file"]
FILES_AT_ONCE = 16
TASKS_A_FILE = 8

# Adds answers to rows of prompts; gets the rows and the model's name.
Answer = Callable[[DataFrame, str], DataFrame]


def file_below(path: Column, folder: str) -> Column:
    """A file's path below `folder`, without its last extension."""
    plain = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    below = F.substring_index(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), f"{plain}/", -1)
    return F.regexp_replace(below, r"\.[^./]*$", "")


def finished(spark: SparkSession, output: str) -> DataFrame:
    """(model, prompt_file) of all outputs there are; reads folder names alone."""
    schema = ", ".join(f"{k} string" for k in KEYS)
    try:
        return spark.read.schema(schema).parquet(output).select(*KEYS).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def answer_files(
    spark: SparkSession, prompts: str, schema: str, output: str, checkpoint: str, models: Mapping[str, Answer],
    files_at_once: int = FILES_AT_ONCE, pattern: str = "*.json*",
) -> int:
    """Answer all prompt files below `prompts` that are not answered yet; returns how many batches it took.

    `prompts` holds JSON lines of `schema`, in any depth of folders. The answers are Parquet
    files below `output`, in one folder for each model and file, which appears when it is whole and is
    replaced as a whole if it is written again. A run that stops in a batch leaves the batch to the
    next run, which skips the models and files whose folder is there. Files are taken as they are when
    first seen; a changed file needs a new name.
    """
    def answer(batch: DataFrame, number: int) -> None:
        for model, ask in models.items():
            todo = skip_done(batch.withColumn("model", F.lit(model)), finished(batch.sparkSession, output), KEYS)
            if not todo.isEmpty():
                # Dealt out before the calls: a file is answered by several tasks, and nothing is shuffled afterwards.
                dealt = todo.repartition(*KEYS, F.pmod(F.xxhash64(*batch.columns), F.lit(TASKS_A_FILE)))
                (ask(dealt, model).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy(*KEYS).parquet(output))
        taken.append(number)

    taken: list[int] = []
    files = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option(
        "maxFilesPerTrigger", files_at_once).json(prompts)
    named = files.withColumn("prompt_file", file_below(F.col("_metadata.file_path"), prompts))
    run = named.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return len(taken)


def read_answers(spark: SparkSession, output: str) -> DataFrame:
    """All answers, with model and prompt_file as text."""
    found = spark.read.parquet(output).schema
    # Names of folders are text, also where they look like numbers.
    text = StructType([StructField(f.name, StringType()) if f.name in KEYS else f for f in found.fields])
    return spark.read.schema(text).parquet(output)
