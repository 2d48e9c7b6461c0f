"""Normalisation, comparison, outcomes and SQL pairs."""

import datetime as dt
import decimal
import time

import pytest
from pyspark.sql import functions as F

from tandem.plans import evaluation as E
from tandem.plans.sql_pairs import score_pair, score_pairs
from tandem.sources.tables import query_only

FOLDER = "/root/testdata/sf0.001"
NAN = float("nan")


def test_normalise(spark):
    df = spark.createDataFrame(
        [(1, True, 2.25, decimal.Decimal("3.149"), dt.date(2024, 1, 2), "x", [1.26]), (None,) * 7],
        "a int, b boolean, c double, d decimal(9,3), e date, f string, g array<double>",
    ).withColumn("t", F.lit("2024-01-02 03:04:05.5").cast("timestamp_ntz")).withColumn(
        "u", F.lit("2024-01-02").cast("timestamp_ntz"))
    first, second = E.normalise(df).collect()
    assert tuple(first) == (
        1.0, 1.0, 2.3, 3.1, "2024-01-02", "x", [1.26], "2024-01-02T03:04:05.500000", "2024-01-02T00:00:00")
    assert tuple(second)[:7] == (None,) * 7


def frames(spark, left, right, schema="_c0 string, _c1 double"):
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def test_bag_comparison(spark):
    same = frames(spark, [("a", NAN), ("b", None), ("a", NAN)], [("b", None), ("a", NAN), ("a", NAN)])
    assert E.differing_rows(*same).isEmpty()
    other = frames(spark, [("a", 1.0), ("a", 1.0)], [("a", 1.0), ("b", None)])
    got = {(r["_c0"], r["surplus"]) for r in E.differing_rows(*other).collect()}
    assert got == {("a", 1), ("b", -1)}


def test_list_comparison(spark):
    rows = [("a", 2.0), ("b", 1.0), ("b", 1.0), ("c", 3.0)]
    left, right = frames(spark, rows, rows[::-1])
    by_name, by_value = [F.col("_c0")], [F.col("_c1")]
    assert E.differing_runs(left, right, by_name, by_name).isEmpty()
    wrong = {r["start"] for r in E.differing_runs(left, right, by_name, by_value).collect()}
    assert wrong == {0, 1, 2}
    longer = frames(spark, rows, rows + [("d", 1.0)])
    extra = E.differing_runs(*longer, by_name, by_name).collect()
    assert [(r["start"], r["left_n"], r["right__c0"]) for r in extra] == [(4, None, "d")]


@pytest.mark.parametrize("places, fan", [(1, 1), (3, 2), (4096, 1024)])
def test_list_comparison_by_digests(spark, places, fan):
    """Whatever the size of ranges: one cell, one missing row, ties, copies and another order."""
    rows = [(i % 7, f"t{i}", None if i % 5 == 0 else i / 2) for i in range(60)] + [(3, "copy", 1.0)] * 30
    schema, key = "a int, b string, c double", [F.col("a").desc()]
    left = spark.createDataFrame(rows, schema)
    differing = lambda right, order=key: {
        r["start"] for r in E.differing_runs(left, spark.createDataFrame(right, schema), key, order, places, fan).collect()}
    assert differing(rows[::-1]) == set()  # ties of the order may come in any
    assert len(differing([(a, b, 99.0 if b == "t30" else c) for a, b, c in rows])) == 1
    assert differing(rows[:-1]) and differing(rows, [F.col("a").asc()])
    sizes = E._runs(left, key).where("b = 'copy'").collect()
    assert [(r["n"], r["start"] in differing(rows[:-1])) for r in sizes] == [(30, True)]
    assert {0} <= differing([]) and len(differing([])) == 61


def test_only_digests_of_equal_results_meet(spark):
    left = spark.range(10_000).select(F.col("id").alias("a"))
    runs = [E._runs(df, [F.col("a")]).select("start", "n", "a") for df in (left, left.withColumn("a", F.when(F.col("a") == 4321, -1).otherwise(F.col("a"))))]
    digests = [E.range_digests(r, 64) for r in runs]
    assert digests[0].count() == 157 and E.differing_ranges(digests[0], digests[0], 8).isEmpty()
    changed = E.range_digests(runs[0].withColumn("a", F.when(F.col("a") == 4321, -1).otherwise(F.col("a"))), 64)
    assert [r["range"] for r in E.differing_ranges(digests[0], changed, 8).collect()] == [4321 // 64]


def test_unlike_types_differ_unless_null(spark):
    left = spark.createDataFrame([("1.0", None)], "_c0 string, _c1 string")
    right = spark.createDataFrame([(1.0, None)], "_c0 double, _c1 double")
    a, b = E.align_types(left, right)
    assert not E.differing_rows(a, b).isEmpty()
    assert E.differing_rows(*E.align_types(left.select("_c1"), right.select("_c1"))).isEmpty()


@pytest.mark.parametrize("text,kind", [
    ("passed", "passed"), ("correct", "passed"), ("failed: x", "execution_error"),
    ("Execution failed: x", "execution_error"), ("Assertion failed: mismatch", "assertion_error"),
    ("timed out", "timeout"), ("timed out late", "other"), ("has failed: x", "other"),
])
def test_classify(spark, text, kind):
    assert spark.range(1).select(E.classify(F.lit(text))).first()[0] == kind


def test_pairing_report(spark):
    truth = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    made = spark.createDataFrame([(2,), (3,), (4,), (5,)], "item_id long")
    assert tuple(E.pairing_report(truth, made).first()) == (2, 1, 2)
    assert E.pair(truth, made).count() == 2


def test_program_text(spark):
    texts = ["plain", "it's", 'both \' and "', "tab\t\\ \n é \x00 \u2028", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row, text in zip(df.select(E.library_program(F.lit("T"), F.lit("S"), F.col("t"))).collect(), texts):
        assert row[0] == f"S\nT\ncode = {text!r}\ntest_execution(code)\n\n"
    both = E.library_program(F.lit("def test_string(x)"), F.lit(""), F.lit("y"))
    assert spark.range(1).select(both).first()[0].endswith("test_execution(code)\ntest_string(code)\n")


def test_framework_program(spark):
    test = F.struct(F.lit("up").alias("setup_code"), F.array(F.lit("a"), F.lit("b")).alias("test_cases"))
    make = lambda target: spark.range(1).select(
        E.framework_program(F.lit(target), F.lit("lib"), F.lit("start"), F.lit("sol"), test)).first()[0]
    assert make("pytorch") == "lib\nstart\nsol\nup\na\nb\n"
    assert make("tensorflow") == E.QUIET_TENSORFLOW + "lib\nstart\nsol\nup\na\nb\n"


def test_run_metadata_and_log_rule(spark):
    path = F.lit("out/zero_shot/gpt_v1_postgresql_to_pandas.jsonl")
    ask = lambda c: spark.range(1).select(c).first()[0]
    assert tuple(ask(E.run_metadata(path, "query"))) == ("zero_shot", "gpt", "v1", "PostgreSQL", "Pandas")
    name = "gpt_v1_postgresql_to_pandas.jsonl"
    assert tuple(ask(E.run_metadata(path, "library"))) == ("zero_shot", f"gpt_{name}", name, "pandas", "numpy")
    assert tuple(ask(E.run_metadata(F.lit("x_y.jsonl"), "query")))[:3] == ("", "x", "y.jsonl")
    for text, query, framework in (("a/zero_shot/", True, True), ("a/zero_shot_cot/", True, False), ("a/rag/", True, False), ("a/b/", False, False)):
        assert ask(E.logs_run(F.lit(text), "query")) is query
        assert ask(E.logs_run(F.lit(text), "framework")) is framework


def test_accuracy_roll_up(spark):
    cases = spark.createDataFrame(
        [("m", True, "passed"), ("m", False, "timed out"), ("m", False, "failed: x"), ("m", False, "odd")],
        "model string, passed boolean, result string")
    assert tuple(E.accuracy(cases, ["model"]).first()) == ("m", 4, 1, 1, 1, 0, 3, 25.0)


def test_sql_pairs(spark):
    cases = [
        ("SELECT 1", "SELECT 1.0", None, True, "correct"),
        ("SELECT o_orderkey FROM orders ORDER BY 1", "SELECT o_orderkey FROM orders ORDER BY 1 DESC;", None, False, E.MISMATCH),
        ("SELECT n_regionkey r, n_name FROM nation ORDER BY r", "SELECT n_regionkey, n_name FROM nation ORDER BY 1, 2 DESC", None, True, "correct"),
        ("SELECT n_regionkey FROM nation ORDER BY 1", "SELECT n_regionkey FROM nation", None, False, E.MISMATCH),
        ("SELECT '1'", "SELECT 1", None, False, E.MISMATCH),
        ("SELECT n_name FROM nation /* ORDER BY ( */", "SELECT n_name FROM nation -- order by n_name", None, True, "correct"),
        ("SELECT n_name AS `order by (x` FROM nation", "SELECT n_name FROM nation", None, True, "correct"),
        ("SELECT nullif(n_regionkey, 2) AS r FROM nation ORDER BY r NULLS LAST",
         "SELECT nullif(n_regionkey, 2) FROM nation ORDER BY 1", None, False, E.MISMATCH),
        ("SELECT nullif(n_regionkey, 2) AS r FROM nation ORDER BY r DESC",
         "SELECT nullif(n_regionkey, 2) AS z FROM nation ORDER BY z DESC NULLS LAST LIMIT 100", None, True, "correct"),
        ("SELECT n_name FROM nation ORDER BY n_regionkey", "SELECT n_name FROM nation ORDER BY n_regionkey, 1", None, False, "Execution failed: give order_by"),
        ("SELECT n_name FROM nation ORDER BY length(n_name), n_name", "SELECT n_name FROM nation ORDER BY 1", [1], True, "correct"),
        ("SELECT n_name, n_nationkey FROM nation", "SELECT n_name, n_nationkey FROM nation", [1, -2], True, "correct"),
        ("SELECT 1", "CREATE TABLE t (x INT)", None, False, "Execution failed:"),
        ("SELECT 1", "SELECT raise_error('bad cell')", None, False, "Execution failed:"),
    ]
    texts = [dict(pair_id=i, reference_sql=c[0], candidate_sql=c[1], order_by=c[2]) for i, c in enumerate(cases)]
    got = {r["pair_id"]: r for r in score_pairs(spark, FOLDER, ["orders", "nation"], texts).collect()}
    for i, (_, _, _, passed, result) in enumerate(cases):
        assert got[i]["passed"] is passed and got[i]["result"].startswith(result)
    assert "bad cell" in got[13]["result"]


def test_slow_pair_times_out_alone(spark):
    slow = "SELECT sum(id % 7) FROM range(100000000000000)"
    start = time.time()
    case = dict(pair_id=1, reference_sql=slow, candidate_sql=slow)
    assert score_pair(spark, case, seconds=3) == (1, False, "timed out")
    assert time.time() - start < 60
    assert spark.range(5).count() == 5


def test_query_only_rejects_statements(spark):
    for text in ("DROP TABLE x", "INSERT INTO t VALUES (1)", "SELECT 1; DROP TABLE x"):
        with pytest.raises(Exception):
            spark.sql(query_only(text))


def test_sql_pairs_with_duplicate_and_odd_names(spark):
    from tandem.plans.sql_pairs import score_pair

    case = {"pair_id": 1, "reference_sql": "SELECT 1 AS x, 2 AS x", "candidate_sql": "SELECT 1 AS `a``b`, 2 AS c"}
    assert score_pair(spark, case)[1]
