"""Scoring of prediction files: pair by line, judge, and keep one set of rows per run.

A run is a file of predictions, one line for each line of the ground truth; folder, model, version
and direction come from its path. Case log and accuracy are stored by run and written over for the runs
that were scored again, so scoring twice leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tandem.functions.text import clean_prediction
from tandem.plans.evaluation import MISMATCH, PASSED, accuracy, logs_run, run_metadata
from tandem.plans.runs import file_below
from tandem.session import settle
from tandem.sources.jsonl import read_numbered

RUN = ["run", "folder", "model", "version", "source", "target"]

# Outcome of a prediction line that could not be read: an execution error, as of any other broken answer.
BROKEN_LINE = "failed: broken line"

# Judges paired rows (truth and prediction as structs): the outcome text.
Judge = Callable[[Column, Column], Column]


def same_text(truth: str, prediction: str) -> Judge:
    """Passed where the cleaned prediction is the truth's text."""
    def judge(t: Column, p: Column) -> Column:
        same = clean_prediction(p[prediction]).eqNullSafe(clean_prediction(t[truth]))
        return F.when(same, F.lit(PASSED[1])).otherwise(F.lit(MISMATCH))

    return judge


def paired_cases(
    spark: SparkSession, truth: str, truth_schema: str, predictions: str, prediction_schema: str, domain: str,
    pattern: str = "*.json*",
) -> DataFrame:
    """One row for each prediction line of every run, with the truth line of the same number.

    Columns: those of `RUN`, path, line_no, ground_truth and prediction (structs; the truth null where it
    has no such line), broken (whether the prediction is no readable line) and n_truth (lines
    of the truth). Runs without any line do not show. The truth must be readable throughout.
    """
    known, unreadable = read_numbered(spark, truth, truth_schema, pattern)
    if not unreadable.isEmpty():
        raise ValueError(f"the ground truth has broken lines: {unreadable.first()}")
    known = known.select("line_no", F.struct(*known.columns[2:]).alias("ground_truth"))
    rows, bad = read_numbered(spark, predictions, prediction_schema, pattern)
    made = rows.select("file", "line_no", F.struct(*rows.columns[2:]).alias("prediction"), F.lit(False).alias("broken"))
    none = F.lit(None).cast(made.schema["prediction"].dataType)
    made = made.unionByName(bad.select("file", "line_no", none.alias("prediction"), F.lit(True).alias("broken")))
    facts = run_metadata(F.col("file"), domain)
    return made.join(known, "line_no", "left").select(
        file_below(F.col("file"), predictions).alias("run"), *(facts[c].alias(c) for c in RUN[1:]), F.col("file").alias("path"),
        "line_no", "ground_truth", "prediction", "broken", F.lit(known.count()).alias("n_truth"))


def judged(cases: DataFrame, judge: Judge) -> DataFrame:
    """Paired cases with result and passed; lines beyond the truth's last are not judged and go."""
    pairs = cases.where("ground_truth IS NOT NULL")
    result = F.when(F.col("broken"), F.lit(BROKEN_LINE)).otherwise(judge(F.col("ground_truth"), F.col("prediction")))
    return pairs.withColumn("result", result).withColumn("passed", F.col("result").isin(*PASSED))


def score_files(
    spark: SparkSession, truth: str, truth_schema: str, predictions: str, prediction_schema: str, domain: str,
    judge: Judge, output: str, pattern: str = "*.json*",
) -> None:
    """Score every run below `predictions`; see `read_scores` for what is kept below `output`.

    Rows of a run replace those of an earlier scoring of the same run, and no others. The case log
    holds the runs that are logged, all their cases; the accuracy has one row per run.
    """
    paired = settle(paired_cases(spark, truth, truth_schema, predictions, prediction_schema, domain, pattern))
    scored = settle(judged(paired, judge))
    alone = paired.groupBy("run").agg(
        (F.max("n_truth") - F.count("ground_truth")).alias("n_truth_only"),
        F.count_if(F.col("ground_truth").isNull()).alias("n_prediction_only"))
    log = scored.where(logs_run(F.col("path"), domain)).select(
        *RUN, "line_no", "ground_truth", "prediction", "passed", F.col("result").alias("error_result"))
    totals = accuracy(scored, RUN).join(alone, "run")
    for name, rows in (("cases", log), ("accuracy", totals)):
        (rows.repartition("run", F.pmod(F.xxhash64("model", *([] if name == "accuracy" else ["line_no"])), F.lit(8)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{output}/{name}"))


def read_scores(spark: SparkSession, output: str, name: str) -> DataFrame:
    """`accuracy` (one row a run) or `cases` (the log) of all runs scored so far."""
    found = spark.read.parquet(f"{output}/{name}").schema
    text = StructType([StructField(f.name, StringType()) if f.name == "run" else f for f in found.fields])
    return spark.read.schema(text).parquet(f"{output}/{name}")
