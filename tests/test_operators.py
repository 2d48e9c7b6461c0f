"""Relational operations on small frames; frame semantics are checked against pandas."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.functions import values as V
from tandem.operators import aggregates as A, filters as S, joins as J, mapping as M, ordering as O

NAN = float("nan")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def nulls(pdf):
    """pandas rows as plain Python values, every kind of missing value as None."""
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else int(v)
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (4, "e")], "k long, l string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (5, "w")], "k long, r string")


@pytest.mark.parametrize("how", ["inner", "left", "right"])
@pytest.mark.parametrize("salt", [1, 3])
def test_frame_joins_follow_pandas(left, right, how, salt):
    got = J.join_on(left, right, "k", how=how, semantics="frame", salt=salt)
    want = left.toPandas().astype({"k": "Int64"}).merge(
        right.toPandas().astype({"k": "Int64"}), on="k", how=how)
    assert got.columns == ["k", "l", "r"]
    assert rows(got) == nulls(want)


@pytest.mark.parametrize("how", ["inner", "left", "right"])
@pytest.mark.parametrize("salt", [1, 3])
def test_sql_joins_with_and_without_salt(spark, left, right, how, salt):
    other = right.withColumnRenamed("k", "k2")
    left.createOrReplaceTempView("l")
    other.createOrReplaceTempView("r")
    want = spark.sql(f"SELECT * FROM l {how} JOIN r ON l.k = r.k2")
    got = J.join_on(left, other, "k", "k2", how, salt=salt)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_null_keys_are_spread_in_outer_joins(spark):
    big = spark.range(400).select(F.lit(None).cast("long").alias("k"), "id")
    small = spark.range(3).select(F.col("id").alias("k2"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = J.join_on(big, small, "k", "k2", "left").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in sizes) == 400 and max(r["count"] for r in sizes) < 200


@pytest.mark.parametrize("how", ["left", "right"])
def test_outer_joins_read_the_columns_that_are_used(spark, capsys, how):
    orders, lines = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("orders", "lineitem"))
    J.join_on(lines, orders, "l_orderkey", "o_orderkey", how, salt=2).select("l_quantity", "o_totalprice").explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_functions_of_a_series(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.5,)], "v double")
    got = M.apply_function(df, "v", "w", lambda v: v.fillna(0) * 2, "double", of_series=True)
    assert sorted(r["w"] for r in got.collect()) == [0.0, 2.0, 5.0]


def test_frame_join_suffixes(spark):
    a = spark.createDataFrame([(1, 10)], "k long, v long")
    b = spark.createDataFrame([(1, 20)], "k long, v long")
    assert J.join_on(a, b, "k", semantics="frame").columns == ["k", "v_x", "v_y"]


def test_membership(left, right):
    assert rows(J.keep_members(left, "k", right, "k").select("l")) == [("a",), ("b",), ("c",)]
    assert rows(J.keep_members(left, "k", right, "k", semantics="frame").select("l")) == [
        ("a",), ("b",), ("c",), ("d",)]
    assert rows(J.keep_members(left, "k", right, "k", negate=True).select("l")) == [("d",), ("e",)]


def test_join_group_total_on_a_hot_key(spark):
    facts = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"), "id")
    groups = spark.range(1000).select(F.col("id").alias("g"), (F.col("id") % 3).alias("name"))
    got = dict(rows(J.join_group_total(facts, "k", "id", groups, "g", "name")))
    want = {}
    for i in range(1000):
        key = 7 if i < 400 else i
        want[key % 3] = want.get(key % 3, 0) + i
    assert got == want


def test_filters_and_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None)], "id long, v double")
    ids = lambda out: [r[0] for r in rows(out.select("id"))]
    assert ids(S.keep_known(df, "v")) == [1, 2]
    assert ids(S.keep_known(df, "v", "frame")) == [1]
    assert ids(S.keep_missing(df, "v")) == [3]
    assert ids(S.keep_missing(df, "v", "frame")) == [2, 3]
    assert ids(S.filter_equal(df, "v", 1.0, negate=True, semantics="frame")) == [2, 3]


def test_date_range_ends(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-01-06 00:00:00', timestamp_ntz'2024-01-06 10:00:00')) AS t")
    assert S.between_dates(df, "t", "2024-01-05", "2024-01-06").count() == 2
    assert S.between_dates(df, "t", "2024-01-05", "2024-01-06", "frame").count() == 1


def test_date_filters_reach_the_scan(spark, capsys):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    S.on_date(events, "ts", "2024-01-05").select("event_id").explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_aggregates_of_nothing_and_of_nan(spark):
    empty = spark.createDataFrame([], "v double")
    assert A.total(empty, "v").first()[0] is None
    assert A.total(empty, "v", "frame").first()[0] == 0
    assert A.percentage(empty, F.col("v") > 0).first()[0] is None
    assert A.conditional_total(empty, F.lit(True), "v", "frame").first()[0] == 0
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (3.0,)], "v double")
    for op in (A.total, A.largest, A.mean):
        assert math.isnan(op(df, "v").first()[0])
    series = df.toPandas()["v"]
    assert A.total(df, "v", "frame").first()[0] == series.sum()
    assert A.largest(df, "v", "frame").first()[0] == series.max()
    assert A.smallest(df, "v", "frame").first()[0] == series.min()
    assert A.mean(df, "v", "frame").first()[0] == series.mean()


def test_group_total_keys(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", None)], "k string, v long")
    assert rows(A.group_total(df, "k", "v")) == sorted([("a", 3), ("b", 1), (None, 2)], key=repr)
    assert [tuple(r) for r in A.group_total(df, "k", "v", "frame").collect()] == [("a", 3), ("b", 1)]


def test_sort_places_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v long")
    order = lambda out: [r[0] for r in out.collect()]
    assert order(O.sort_rows(df, "v")) == [None, 3, 1]
    assert order(O.sort_rows(df, "v", semantics="frame")) == [3, 1, None]
    assert order(O.sort_rows(df, "v", descending=False)) == [1, 3, None]


def test_unique_values_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "p long, v string")
    assert [r["v"] for r in A.unique_values(df, "v", "frame", "p").collect()] == ["b", "a", None]
    assert A.unique_count(df, "v").first()[0] == 2


def test_top_k_does_not_sort_everything(spark, capsys):
    O.first_rows(spark.range(100), 3, [F.col("id").desc()]).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


@pytest.mark.parametrize("start,length", [(1, 3), (0, 2), (-1, 3), (-2, 1), (3, 0), (4, 9), (-9, 12)])
def test_slices(spark, start, length):
    texts = ["", "a", "abcdef", "éßü☃x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(V.slice_text(F.col("t"), start, length, "frame")).collect()]
    assert got == [None if t is None else t[start - 1 : start - 1 + length] for t in texts]
    got = [r[0] for r in df.select(V.slice_text(F.col("t"), start, length)).collect()]
    first = max(start, 1)
    end = max(start + length, first)
    assert got == [None if t is None else t[first - 1 : end - 1] for t in texts]


def test_user_function_sees_nulls(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    out = M.apply_function(df, "t", "n", lambda v: -1 if v is None else len(v), "long")
    assert [r["n"] for r in out.collect()] == [1, -1]


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    row = df.select(
        V.affine(F.col("v"), 2.0, 1.0), V.elementwise(F.col("v"), F.col("v"), "*"),
        V.array_slice(F.col("v"), 1, 3)).first()
    assert [list(x) for x in row] == [[3.0, 5.0, 7.0], [1.0, 4.0, 9.0], [2.0, 3.0]]


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_number_rows(spark, n):
    df = spark.range(n).select(((F.col("id") * 37) % 101).alias("v"))
    numbered, total = O.number_rows(df, [F.col("v").desc()])
    got = [(r["position"], r["v"]) for r in numbered.orderBy("position").collect()]
    assert total == n
    assert got == list(enumerate(sorted((i * 37 % 101 for i in range(n)), reverse=True)))


def test_number_rows_with_weights(spark):
    df = spark.range(50).select("id", (F.col("id") % 4).alias("w"))
    numbered, total = O.number_rows(df, [F.col("id")], "start", weight="w")
    start, want = 0, []
    for i in range(50):
        want.append((i, start))
        start += i % 4
    assert total == start
    assert rows(numbered.select("id", "start")) == sorted(want, key=repr)


def test_frames_and_nan(spark):
    from tandem.operators.aggregates import unique_count
    from tandem.operators.joins import join_group_total
    from tandem.operators.ordering import sort_rows

    nan = float("nan")
    values = spark.createDataFrame([(2.0,), (nan,), (None,), (5.0,)], "v double")
    for descending, want in ((True, [5.0, 2.0]), (False, [2.0, 5.0])):
        got = [r["v"] for r in sort_rows(values, "v", descending, "frame").collect()]
        assert got[:2] == want and all(v is None or v != v for v in got[2:])
    assert [unique_count(values, "v", semantics=s).first()[0] for s in ("sql", "frame")] == [3, 2]
    facts = spark.createDataFrame([(1, 2.0), (1, nan), (2, 1.0)], "k int, v double")
    groups = spark.createDataFrame([(1, 7.0), (2, nan)], "k int, g double")
    got = join_group_total(facts, "k", "v", groups, "k", "g", "frame").collect()
    assert [tuple(r) for r in got] == [(7.0, 2.0)]


def test_text_nan_is_a_word(spark):
    from tandem.operators.ordering import sort_rows

    rows = spark.createDataFrame([("a",), ("NaN",), ("z",)], "v string")
    assert [r["v"] for r in sort_rows(rows, "v", True, "frame").collect()] == ["z", "a", "NaN"]
