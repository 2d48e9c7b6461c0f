"""Batches, retries and prompt building."""

import pytest
from pyspark.sql import functions as F

from tandem.functions.text import INVALID
from tandem.plans import inference as I, prompts as P
from tandem.plans.templates import OPERATIONS, TEMPLATES, VERSIONS


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 10, 13])
def test_last_batch_takes_the_remainder(spark, n, size=5):
    out = I.number_batches(spark.range(n), "id", size)
    got = sorted((r["id"], r["batch_no"]) for r in out.collect())
    full = max(n // size, 1)
    assert got == [(i, min(i // size, full - 1)) for i in range(n)]


def test_only_invalid_rows_are_asked_again(spark):
    def load_flaky():
        """Fails on the first call for some prompts, on every call for others."""
        calls = {}

        def model(prompts):
            out = []
            for p in prompts:
                calls[p] = calls.get(p, 0) + 1
                bad = p.startswith("never") or (p.startswith("late") and calls[p] < 3)
                out.append("" if bad else f"{p} after {calls[p]}")
            return out

        return model

    texts = ["fine 1", "late 1", "never 1", None]
    df = spark.createDataFrame([(t,) for t in texts], "prompt string").coalesce(1)
    got = [r["response"] for r in I.batch_infer(df, load_flaky, tries=4).collect()]
    assert got == ["fine 1 after 1", "late 1 after 3", INVALID, INVALID]


@pytest.mark.parametrize("failures, expected", [(1, ["a!", "b!"]), (3, [INVALID, INVALID])])
def test_a_raising_call_is_one_try(spark, failures, expected):
    def load():
        calls = []

        def model(prompts):
            calls.append(prompts)
            if len(calls) <= failures:
                raise TimeoutError("busy")
            return [p + "!" for p in prompts]

        return model

    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    got = [r["response"] for r in I.batch_infer(df, load, tries=3, pause=0).collect()]
    assert got == expected


def slow(log, failing=()):
    """Answers late calls first, fails some calls once, and writes down how many were under way."""
    def load():
        import threading
        import time
        import uuid

        lock, state = threading.Lock(), {"now": 0, "most": 0, "seen": {}}

        def model(prompts):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                calls = state["seen"][prompts[0]] = state["seen"].get(prompts[0], 0) + 1
            time.sleep(0.15 if int(prompts[0].split()[1]) % 20 < 10 else 0.02)
            with lock:
                state["now"] -= 1
                (log / f"{uuid.uuid4().hex}").write_text(str(state["most"]))
            if prompts[0] in failing and calls == 1:
                raise TimeoutError("busy")
            return ["" if p.endswith("never") or (p.endswith("late") and calls < 2) else f"{p}!" for p in prompts]

        return model

    return load


@pytest.mark.parametrize("in_flight", [1, 4])
def test_calls_in_flight(spark, tmp_path, in_flight):
    """Order is kept, rows are asked again by themselves, and no more calls than allowed are under way."""
    texts = [None if i == 33 else f"p {i} " + ("late" if i % 17 == 3 else "never" if i % 23 == 5 else "x") for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, prompt string").coalesce(1)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "15")
    try:
        out = I.batch_infer(df, slow(tmp_path, {"p 20 x", "p 40 x"}), batch_rows=5, tries=3, pause=0, in_flight=in_flight)
        got = [(r["item_id"], r["response"]) for r in out.collect()]
    finally:
        spark.conf.set(limit, before)
    assert got == [(i, INVALID if t is None or t.endswith("never") else f"{t}!") for i, t in enumerate(texts)]
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) == in_flight


def test_a_broken_call_in_flight_fails_the_job(spark):
    df = spark.createDataFrame([(f"p {i}",) for i in range(40)], "prompt string").coalesce(1)
    with pytest.raises(Exception, match="zip"):
        I.batch_infer(df, lambda: lambda prompts: ["one"], batch_rows=3, in_flight=4).collect()


def test_answer_count_must_match(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    with pytest.raises(Exception, match="zip"):
        I.batch_infer(df, lambda: lambda prompts: ["one"]).collect()


def test_all_prompts_without_a_shuffle(spark, capsys):
    items = spark.createDataFrame(
        [(1, "SELECT 1", "result = 1", "pg {x}", "df")],
        "item_id long, SQL string, pandas_query string, postgresql_schema string, pandas_schema string")
    out = P.build_prompts(items, "query")
    rows = {(r["version"], r["direction"]): r["prompt"] for r in out.collect()}
    assert len(rows) == 2 * len(VERSIONS)
    to_frame = rows["zero_shot_complete", "postgresql_to_pandas"]
    assert "SELECT 1" in to_frame and "df" in to_frame and "`result`" in to_frame and to_frame.endswith("```Python\n")
    to_sql = rows["rag", "pandas_to_postgresql"]
    assert "pg {x}" in to_sql and "[GUIDELINES]" in to_sql and "`result`" not in to_sql and to_sql.endswith("```SQL\n")
    assert all(name in rows["rag_op_identify", "postgresql_to_pandas"] for name in OPERATIONS)
    assert "[INTENT]" in rows["intent", "postgresql_to_pandas"]
    out.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_fifteen_templates():
    assert [len(t) for t in TEMPLATES.values()] == [5, 5, 5]
    assert all("[APIs]" in TEMPLATES[d]["rag"] for d in ("library", "framework"))


def test_schema_lookup_keeps_items_of_unknown_databases(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, db_path string")
    schemas = spark.createDataFrame([("a", "text")], "db_path string, pandas_schema string")
    out = P.attach_schemas(items, schemas)
    assert {r["item_id"]: r["pandas_schema"] for r in out.collect()} == {1: "text", 2: ""}


def test_whole_chain(spark):
    guide = spark.createDataFrame(
        [(1, "Sorting", "ORDER BY", "sort_values")], "line_no long, operation string, postgreSQL string, pandas string")
    items = spark.createDataFrame(
        [(i, f'["Sorting", "x{i}"]', f"do {i}: [GUIDELINES]") for i in range(5)],
        "item_id long, identify_prompt string, translate_prompt string")
    load = lambda: lambda prompts: [f"```\n{p}\n```" for p in prompts]
    out = I.retrieve_and_translate(items, guide, load)
    assert sorted((r["item_id"], r["code"]) for r in out.collect()) == [
        (i, f"do {i}: 1. Sorting:\nPostgreSQL Solution: ORDER BY\nPandas Solution: sort_values") for i in range(5)]
