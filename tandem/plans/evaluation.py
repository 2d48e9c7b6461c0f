"""Scoring: pairing, result normalisation and comparison, accuracy."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType,
)

from tandem.functions.text import base_name
from tandem.operators.ordering import number_rows
from tandem.session import settle

# Outcome texts.
PASSED = ("passed", "correct")
MISMATCH = "Assertion failed: mismatch"
EXECUTION_PREFIXES = ("failed:", "Execution failed:")
ASSERTION_PREFIX = "Assertion failed:"
TIMED_OUT = "timed out"

# Lines put before a TensorFlow test program.
QUIET_TENSORFLOW = (
    "import os\nos.environ['TF_CPP_MIN_LOG_LEVEL'] = '3'\n"
    "from absl import logging\nlogging.set_verbosity(logging.ERROR)\n"
)

# Small amount added before rounding, and digits kept.
ROUNDING_OFFSET = 1e-10
DIGITS = 1

# Places of a result in one digest, and digests under one of the next level.
RANGE_PLACES, RANGES_AT_ONCE = 4096, 1024

# Path parts of the runs whose cases are logged, and parts that veto it.
LOGGED_RUNS = {
    "query": (("zero_shot", "rag", "intent"), ()),
    "library": (("zero_shot", "rag", "intent"), ()),
    "framework": (("zero_shot",), ("zero_shot_cot",)),
}

# Path parts that give a run's (source, target); else the reverse pair.
RUN_DIRECTIONS = {
    "query": (("postgresql_to_pandas",), ("PostgreSQL", "Pandas")),
    "library": (("numpy_to_pandas", "np_to_pd"), ("numpy", "pandas")),
    "framework": (("pytorch_to_tensorflow", "py_to_tf"), ("pytorch", "tensorflow")),
}


def pair(truth: DataFrame, predictions: DataFrame, key: str = "item_id") -> DataFrame:
    """Ground truth with its prediction, by item."""
    return truth.join(predictions, key)


def pairing_report(truth: DataFrame, predictions: DataFrame, key: str = "item_id") -> DataFrame:
    """One row: items paired, and items either side has alone."""
    left = truth.groupBy(key).agg(F.count(F.lit(1)).alias("n_truth"))
    right = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("n_prediction"))
    both = left.join(right, key, "full")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return both.agg(
        count(F.col("n_truth") * F.col("n_prediction"))("n_paired"),
        count(F.when(F.col("n_prediction").isNull(), F.col("n_truth")))("n_truth_only"),
        count(F.when(F.col("n_truth").isNull(), F.col("n_prediction")))("n_prediction_only"),
    )


def framework_program(
    target: Column, library: Column, start: Column, solution: Column, test: Column
) -> Column:
    """Test program text: set-up, solution, then each test case on its own line."""
    quiet = F.when(target == "tensorflow", F.lit(QUIET_TENSORFLOW)).otherwise(F.lit(""))
    lines = F.concat(
        F.array(library, start, solution, test["setup_code"]),
        F.coalesce(test["test_cases"], F.array().cast("array<string>")),
    )
    texts = F.transform(lines, lambda line: F.concat(F.coalesce(line, F.lit("")), F.lit("\n")))
    return F.concat(quiet, F.array_join(texts, ""))


@F.pandas_udf(StringType())
def python_literal(values: pd.Series) -> pd.Series:
    """Text as Python source writes it; the escapes have no built-in counterpart."""
    return values.map(repr, na_action="ignore")


def library_program(test: Column, start: Column, solution: Column) -> Column:
    """Test program text: the solution goes in as a quoted string."""
    second = F.when(F.contains(test, F.lit("test_string(")), F.lit("test_string(code)\n"))
    return F.concat(
        start, F.lit("\n"), test, F.lit("\ncode = "), python_literal(solution),
        F.lit("\ntest_execution(code)\n"), F.coalesce(second, F.lit("\n")),
    )


def _normal(value: Column, dtype: DataType, digits: int) -> Column:
    if isinstance(dtype, (NumericType, BooleanType)):
        return F.round(value.cast("double") + F.lit(ROUNDING_OFFSET), digits)
    if isinstance(dtype, DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(value, ".SSSSSS")
        return F.concat(whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction))
    return value


def normalise(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Cells as they are compared: numbers and booleans rounded doubles, dates ISO text."""
    return df.select(
        *[_normal(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in df.schema.fields]
    )


def positional(df: DataFrame) -> DataFrame:
    """Columns by place: `_c0`, `_c1`, ... whatever they were called."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def align_types(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Make cells of unlike types comparable, and never equal unless both are null."""
    sides = [left, right]
    for name in left.columns:
        kinds = [side.schema[name].dataType for side in sides]
        if kinds[0] == kinds[1]:
            continue
        for i, kind in enumerate(kinds):
            tagged = F.concat(F.lit(f"{kind.simpleString()}:"), F.col(name).cast("string"))
            sides[i] = sides[i].withColumn(name, tagged)
    return sides[0], sides[1]


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows two results do not share, order aside, with `surplus` = left minus right.

    Empty means equal as bags. One shuffle: both sides are counted in one grouping,
    with partial counts first, so equal rows collapse before they travel. NaN equals
    NaN and null equals null.
    """
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    counted = signed.groupBy(*left.columns).agg(F.sum("_sign").alias("surplus"))
    return counted.filter(F.col("surplus") != 0)


def _runs(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Equal rows as one run with its first place and length.

    Ties of the declared order go by the remaining cells, so equal rows are neighbours
    and a run of any length is a single row.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    ties = [F.col(c).asc_nulls_last() for c in df.columns]
    return number_rows(counted, [*order, *ties], "start", weight="n")[0]


def _xor_of(*cells: str | Column) -> list[Column]:
    """Two independent hashes of rows, joined so that neither order of arrival nor partitions matter."""
    return [F.bit_xor(F.xxhash64(F.lit(seed), *cells)).alias(f"h{seed}") for seed in (0, 1)]


def range_digests(runs: DataFrame, places: int) -> DataFrame:
    """One row for each `places` places of a numbered result: range, h0 and h1.

    A run belongs to the range it starts in, and its digest holds its place, length and cells, so two
    results have the same digests where they are the same list.
    """
    return runs.groupBy(F.floor(F.col("start") / places).alias("range")).agg(*_xor_of(*runs.columns))


def differing_ranges(left: DataFrame, right: DataFrame, fan: int) -> DataFrame:
    """Ranges whose digests two sides (`range_digests`) do not share, by a tree of two levels.

    Digests of `fan` ranges are compared first, and single ranges only below those that differ.
    """
    def tops(side: DataFrame) -> DataFrame:
        return side.groupBy(F.floor(F.col("range") / fan).alias("top")).agg(*_xor_of("range", "h0", "h1"))

    def unequal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        both = a.withColumnsRenamed({"h0": "l0", "h1": "l1"}).join(b, key, "full")
        return both.where(~(F.col("l0").eqNullSafe(F.col("h0")) & F.col("l1").eqNullSafe(F.col("h1")))).select(key)

    open_tops = unequal(tops(left), tops(right), "top")
    below = [side.join(open_tops, F.floor(side["range"] / fan) == open_tops["top"], "left_semi") for side in (left, right)]
    return unequal(*below, "range")


def differing_runs(
    left: DataFrame, right: DataFrame,
    left_order: Sequence[Column], right_order: Sequence[Column],
    places: int = RANGE_PLACES, fan: int = RANGES_AT_ONCE,
) -> DataFrame:
    """Places where two results, each in its own declared order, do not agree.

    Empty means equal as lists. Rows hold the run's start and, for each side, its
    length and cells (null where the side has no run starting there).

    Each side is sorted by itself. What the sides are compared by first are digests of
    ranges of places; only the runs of ranges that differ meet cell by cell, so equal
    results exchange digests alone.
    """
    sides = [settle(_runs(df, order)) for df, order in ((left, left_order), (right, right_order))]
    digests = [settle(range_digests(runs.select("start", "n", *left.columns), places)) for runs in sides]
    ranges = settle(differing_ranges(*digests, fan))
    # The lowest and highest range reach the scans, which are sorted by place.
    low, high = ranges.agg(F.min("range"), F.max("range")).first()
    near = F.lit(False) if low is None else F.col("start").between(low * places, (high + 1) * places - 1)

    def side(runs: DataFrame, tag: str) -> DataFrame:
        open_runs = runs.where(near).withColumn("range", F.floor(F.col("start") / places)).join(ranges, "range", "left_semi")
        return open_runs.select("start", F.struct("n", *left.columns).alias(tag))

    both = side(sides[0], "l").join(side(sides[1], "r"), "start", "full")
    cells = ["n", *left.columns]
    return both.filter(~F.col("l").eqNullSafe(F.col("r"))).select(
        "start",
        *[F.col(f"l.{c}").alias(f"left_{c}") for c in cells],
        *[F.col(f"r.{c}").alias(f"right_{c}") for c in cells],
    )


def classify(result: Column) -> Column:
    """Outcome text to passed, execution_error, assertion_error, timeout or other."""
    failed = F.lit(False)
    for prefix in EXECUTION_PREFIXES:
        failed = failed | F.startswith(result, F.lit(prefix))
    return (
        F.when(result.isin(*PASSED), F.lit("passed"))
        .when(failed, F.lit("execution_error"))
        .when(F.startswith(result, F.lit(ASSERTION_PREFIX)), F.lit("assertion_error"))
        .when(result == TIMED_OUT, F.lit("timeout"))
        .otherwise(F.lit("other"))
    )


def accuracy(cases: DataFrame, keys: Sequence[str], passed: str = "passed", result: str = "result") -> DataFrame:
    """Cases, errors of each kind and accuracy in percent per run (null if empty)."""
    kind = classify(F.col(result))
    n, good = F.count(F.lit(1)), F.count_if(F.col(passed))
    return cases.groupBy(*keys).agg(
        n.alias("n_cases"),
        good.alias("n_passed"),
        F.count_if(kind == "execution_error").alias("execution_errors"),
        F.count_if(kind == "timeout").alias("timeouts"),
        F.count_if(kind == "assertion_error").alias("assertion_errors"),
        (n - good).alias("total_errors"),
        F.try_divide(good * F.lit(100.0), n).alias("accuracy"),
    )


def failures(cases: DataFrame) -> DataFrame:
    """Failing cases only: ground truth, prediction and the error."""
    return cases.filter(~F.col("passed")).select(
        "ground_truth", "prediction", F.col("result").alias("error_result")
    )


def logs_run(path: Column, domain: str) -> Column:
    """Whether a run's cases are logged, by the parts of its path."""
    wanted, vetoes = LOGGED_RUNS[domain]
    log = F.lit(False)
    for part in wanted:
        log = log | F.contains(path, F.lit(part))
    for part in vetoes:
        log = log & ~F.contains(path, F.lit(part))
    return log


def case_log(cases: DataFrame, domain: str, path: str = "path") -> DataFrame:
    """Every case of the runs that are logged, passed or not."""
    return cases.filter(logs_run(F.col(path), domain)).select(
        "model", "source", "target", "ground_truth", "prediction", "passed",
        F.col("result").alias("error_result"),
    )


def run_metadata(path: Column, domain: str) -> Column:
    """Struct of folder, model, prompt version, source and target from a result path."""
    folder = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    name = base_name(path)
    first = F.split_part(name, F.lit("_"), F.lit(1))
    if domain == "query":
        model, version = first, F.split_part(name, F.lit("_"), F.lit(2))
    else:
        model, version = F.concat(first, F.lit("_"), name), name
    parts, (a, b) = RUN_DIRECTIONS[domain]
    forward = F.lit(False)
    for part in parts:
        forward = forward | F.contains(path, F.lit(part))
    return F.struct(
        folder.alias("folder"),
        model.alias("model"),
        version.alias("version"),
        F.when(forward, F.lit(a)).otherwise(F.lit(b)).alias("source"),
        F.when(forward, F.lit(b)).otherwise(F.lit(a)).alias("target"),
    )
