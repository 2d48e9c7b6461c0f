"""Score candidate SQL against reference SQL by running both over the tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tandem.operators.ordering import number_rows
from tandem.plans.evaluation import (
    MISMATCH, TIMED_OUT, align_types, differing_rows, normalise, positional,
)
from tandem.sources.tables import query_only, register_views

# Seconds per pair and pairs in flight.
TIME_LIMIT = 30.0
PAIRS_AT_ONCE = 8

# Spark's names of the steps that hand rows on in the order they come.
KEEP_ORDER = ("SubqueryAlias", "Project", "GlobalLimit", "LocalLimit", "Offset", "WithCTE")

OUTCOME = "pair_id long, passed boolean, result string"


def order_of(df: DataFrame) -> list[tuple[int | None, bool, bool]]:
    """The order a query's rows come in, as Spark's analysis of its text has it; empty for none.

    For each sort key the output column's place from 1 (None for a key that is none), whether it
    ascends, and whether nulls come first.
    """
    plan = df._jdf.queryExecution().analyzed()
    output = plan.output()
    while plan.nodeName() in KEEP_ORDER:
        plan = plan.plan() if plan.nodeName() == "WithCTE" else plan.child()
    if plan.nodeName() != "Sort" or not getattr(plan, "global")():
        return []
    ordering = plan.order()
    ids = [output.apply(i).exprId() for i in range(output.size())]
    keys = []
    for i in range(ordering.size()):
        key = ordering.apply(i)
        column = key.child()
        named = column.getClass().getSimpleName() == "AttributeReference"
        at = next((n for n, own in enumerate(ids, 1) if named and own.equals(column.exprId())), None)
        keys.append((at, key.isAscending(), key.nullOrdering().sql() == "NULLS FIRST"))
    return keys


def _sort_key(place: int, ascending: bool, nulls_first: bool) -> Column:
    col = F.col(f"_c{place - 1}")
    if ascending:
        return col.asc_nulls_first() if nulls_first else col.asc_nulls_last()
    return col.desc_nulls_first() if nulls_first else col.desc_nulls_last()


def _comes_in(rows: DataFrame, places: list[int], keys: list[Column]) -> bool:
    """Whether rows (with `_id` rising as they come out) come out in the order of `keys`.

    Rows with equal keys are one range of ids; the ranges, in order, must not overlap.
    """
    ranges = rows.groupBy(*[f"_c{p}" for p in places]).agg(F.min("_id").alias("_from"), F.max("_id").alias("_to"))
    placed = number_rows(ranges, keys, "_at")[0]
    after = placed.select((F.col("_at") - 1).alias("_at"), F.col("_from").alias("_next"))
    return placed.join(after, "_at").where("_to >= _next").isEmpty()


def _matches(spark: SparkSession, case: Mapping) -> bool:
    raw = [spark.sql(query_only(case[name])) for name in ("reference_sql", "candidate_sql")]
    sides = [normalise(positional(df)) for df in raw]
    if len(sides[0].columns) != len(sides[1].columns):
        return False
    if not differing_rows(*align_types(*sides)).isEmpty():
        return False
    order = order_of(raw[0])
    if not order:
        return True
    if not order_of(raw[1]):
        return False
    if case.get("order_by"):
        order = [(abs(p), p > 0, p > 0) for p in case["order_by"]]  # nulls where Spark puts them
    if any(place is None for place, _, _ in order):
        raise ValueError("give order_by: a sort key is no output column of the reference")
    keys = [_sort_key(*key) for key in order]
    places = list(dict.fromkeys(place - 1 for place, _, _ in order))
    # The candidate's rows in its own order: a sorted result has rising ids from end to end.
    return _comes_in(positional(raw[1]).withColumn("_id", F.monotonically_increasing_id()), places, keys)


def score_pair(spark: SparkSession, case: Mapping, seconds: float = TIME_LIMIT) -> tuple:
    """Outcome of one pair; errors and the time limit become result texts.

    The pair's jobs form a group, and the watcher cancels that group alone. A task stops
    at its next batch of rows.
    """
    context = spark.sparkContext
    group = f"pair-{uuid.uuid4().hex}"
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        # Repeated, as a pair past its time may be between two jobs.
        wait = seconds
        while not done.wait(wait):
            late.set()
            context.cancelJobGroup(group)
            wait = 0.5

    context.setJobGroup(group, f"SQL pair {case['pair_id']}", True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        same = _matches(spark, case)
        outcome = (same, "correct" if same else MISMATCH)
    except Exception as error:  # any failure of the pair is its result
        outcome = (False, f"Execution failed: {error}")
    finally:
        done.set()
        watcher.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)
    if late.is_set():
        outcome = (False, TIMED_OUT)
    return (case["pair_id"], *outcome)


def score_pairs(
    spark: SparkSession,
    folder: str,
    tables: Iterable[str],
    cases: Iterable[Mapping],
    seconds: float = TIME_LIMIT,
    at_once: int = PAIRS_AT_ONCE,
) -> DataFrame:
    """One row per trusted pair: pair_id, passed, result.

    A case has pair_id, reference_sql and candidate_sql. Order counts where the reference's rows
    are ordered, as Spark's analysis of the text says: the candidate's must be ordered too, and come
    out in the reference's order, ties aside. `order_by` (1-based places, negative for descending) names that
    order where it is no list of output columns. Only SELECT text runs. Each pair is
    a distributed job that returns a single bit; the driver holds texts and outcomes.
    """
    register_views(spark, folder, tables)
    run = inheritable_thread_target(spark)(lambda case: score_pair(spark, case, seconds))
    with ThreadPoolExecutor(at_once) as pool:
        outcomes = list(pool.map(run, cases))
    return spark.createDataFrame(outcomes, OUTCOME)
