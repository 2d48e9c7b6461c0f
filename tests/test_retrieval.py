"""Guide lookup, nearest neighbours and slots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.plans import neighbours as N, retrieval as R


def brute(queries, corpus, k):
    best = []
    for qid, group, q in queries:
        found = sorted(
            (float(np.linalg.norm(np.array(q, dtype=np.float64) - np.array(v, dtype=np.float64))), did)
            for did, other, v in corpus if other == group)
        best += [(qid, rank + 1, did, round(dist, 9)) for rank, (dist, did) in enumerate(found[:k])]
    return sorted(best)


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("block_rows", [4, 2048])
def test_nearest_is_exact_with_ties_and_a_hot_group(spark, k, block_rows):
    rng = np.random.default_rng(5)
    vec = lambda: [float(x) for x in rng.integers(0, 3, 6).astype(np.float32)]
    group = lambda i: "hot" if i % 3 else f"g{i % 5}"
    corpus = [(i, group(i), vec()) for i in range(60)] + [(100, "one", vec())]
    queries = [(i, group(i + 1), vec()) for i in range(40)] + [(100, "one", vec()), (101, "none", vec())]
    schema = "id long, grp_name string, embedding array<float>"
    got = R.nearest(
        spark.createDataFrame(queries, schema), spark.createDataFrame(corpus, schema),
        "grp_name", "id", "id", k=k, block_rows=block_rows)
    rows = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["distance"], 9)) for r in got.collect())
    assert rows == brute(queries, corpus, k)


SCHEMA = "id long, grp_name string, embedding array<float>"


def by_balls(spark, queries, corpus, k, block_rows):
    q, d = (N.balls(spark.createDataFrame(rows, SCHEMA), "grp_name", "id", "embedding", size)
            for rows, size in ((queries, max(1, block_rows // 4)), (corpus, block_rows)))
    found = N.nearest_by_balls(q, d, k)
    rows = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["distance"], 9)) for r in found.rows.collect())
    return rows, found, d


@pytest.mark.parametrize("k, block_rows", [(1, 6), (3, 2), (2, 2048)])
def test_balls_find_the_same_with_ties_copies_and_a_hot_group(spark, k, block_rows):
    rng = np.random.default_rng(8)
    vec = lambda: [float(x) for x in rng.integers(0, 3, 4)]
    group = lambda i: "hot" if i % 3 else f"g{i % 5}"
    corpus = [(i, group(i), vec()) for i in range(90)] + [(200 + i, "hot", [1.0] * 4) for i in range(40)] + [(100, "one", vec())]
    queries = [(i, group(i + 1), vec()) for i in range(50)] + [(100, "one", vec()), (101, "none", vec())]
    rows, _, index = by_balls(spark, queries, corpus, k, block_rows)
    assert rows == brute(queries, corpus, k)
    assert sorted(i for r in index.collect() for i in r["ids"]) == sorted(i for i, _, _ in corpus)


def test_far_balls_are_never_met(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 50, (30, 8))
    vec = lambda: [float(np.float32(x)) for x in centres[rng.integers(30)] + rng.normal(0, 1, 8)]
    corpus = [(i, "a" if i % 4 else "b", vec()) for i in range(1500)]
    queries = [(i, "a" if i % 3 else "b", vec()) for i in range(300)]
    rows, found, index = by_balls(spark, queries, corpus, 2, 24)
    assert [r[:3] for r in rows] == [r[:3] for r in brute(queries, corpus, 2)]
    assert index.count() > 60 and index.selectExpr("max(n)").first()[0] <= 48
    assert found.pairs_met < 0.2 * found.pairs_all


ODD_VECTORS = [None, [], [1.0, None, 0.0], [float("nan"), 0.0, 0.0], [0.0, float("inf"), 1.0], [0.0, 1.0]]


@pytest.mark.parametrize("k", [1, 2])
def test_vectors_without_a_distance_spoil_nothing(spark, k):
    good = [(i, "g", [float(i), 0.0, 1.0]) for i in range(5)]
    odd = [(10 + i, "g", v) for i, v in enumerate(ODD_VECTORS)] + [(30, None, [1.0, 0.0, 1.0])]
    want = brute(good, good, k)
    for queries, corpus in ((good + odd, good), (good, good + odd), (good + odd, good + odd[:5])):
        df = [spark.createDataFrame(rows, SCHEMA) for rows in (queries, corpus)]
        got = R.nearest(*df, "grp_name", "id", "id", k=k).collect()
        assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["distance"], 9)) for r in got) == want
        assert by_balls(spark, queries, corpus, k, 2)[0] == want
    pair = [(1, "g", [0.0, 1.0]), (2, "g", [5.0, 1.0, 1.0])]
    assert by_balls(spark, pair, good + [(9, "g", [3.0, 1.0])], 1, 2)[0] == brute(pair[:1], [(9, "g", [3.0, 1.0])], 1) + brute(pair[1:], good, 1)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.nearest(none, none, "grp_name", "id", "id").count() == 0
    rows, found, _ = by_balls(spark, [(1, "g", [1.0])], [], 1, 4)
    assert rows == [] and found.pairs_all == 0


GUIDE = [
    (1, "Sorting", "ORDER BY", "sort_values"), (2, " sorting", "no", "no"),
    (3, "Left Join", "LEFT JOIN", "merge"), (4, "Row Count", "COUNT(*)", "shape[0]"),
]
ANSWERS = [
    (1, '["Left Join", "sorting", "Sorting"]'), (2, "Nothing"), (3, ""), (4, "row count ,LEFT JOIN"), (5, None),
]


def test_guidelines(spark):
    guide = spark.createDataFrame(GUIDE, "line_no long, operation string, postgreSQL string, pandas string")
    answers = spark.createDataFrame(ANSWERS, "item_id long, response string")
    entry = lambda n, name, sql, frame: f"{n}. {name}:\nPostgreSQL Solution: {sql}\nPandas Solution: {frame}"
    want = {
        1: entry(1, "Left Join", "LEFT JOIN", "merge") + "\n\n" + entry(2, "Sorting", "ORDER BY", "sort_values"),
        2: "", 3: "", 5: "",
        4: entry(1, "Row Count", "COUNT(*)", "shape[0]") + "\n\n" + entry(2, "Left Join", "LEFT JOIN", "merge"),
    }
    out = R.add_guidelines(answers, guide, "item_id", "response")
    assert {r["item_id"]: r["guidelines"] for r in out.collect()} == want


def test_each_row_has_the_text_of_its_own_list_whatever_the_guide_size(spark):
    answers = spark.createDataFrame([(1, '["A"]'), (1, '["B"]'), (None, '["A"]'), (None, None)], "item_id long, response string")
    texts = []
    for size in (512, 513):
        rows = [(1, "A", "sa", "pa"), (2, "B", "sb", "pb"), *((i, f"op{i}", "s", "p") for i in range(3, size + 1))]
        guide = spark.createDataFrame(rows, "line_no long, operation string, postgreSQL string, pandas string")
        out = R.add_guidelines(answers, guide, "item_id", "response").collect()
        texts.append(sorted((str(r["item_id"]), str(r["response"]), r["guidelines"]) for r in out))
    a, b = ("1. A:\nPostgreSQL Solution: sa\nPandas Solution: pa", "1. B:\nPostgreSQL Solution: sb\nPandas Solution: pb")
    assert texts[0] == texts[1] == [("1", '["A"]', a), ("1", '["B"]', b), ("None", "None", ""), ("None", '["A"]', a)]


def test_a_hot_operation_goes_to_several_tasks(spark):
    guide = spark.createDataFrame(GUIDE, "line_no long, operation string, postgreSQL string, pandas string")
    hot = spark.range(1000).select("id", F.lit("sorting").alias("operation"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = R.keyword_join(hot, guide).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) < 600


def test_last_value_first_position(spark):
    hits = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "a", "z")], "i long, p long, n string, v string")
    out = R.last_by_name(hits, "i", "n", F.col("v"), "p")
    assert sorted((r["n"], r["position"], r["value"]) for r in out.collect()) == [("a", 0, "z"), ("b", 1, "y")]


def test_document_list_has_no_separator(spark):
    hits = spark.createDataFrame([(1, 1, "f", "doc f "), (1, 0, "g", "doc g")], "i long, position long, name string, text string")
    out = R.numbered_list(hits, "i", "position", F.struct("name", "text"), "document")
    assert out.first()["text"] == "1.g:\n doc g2.f:\n doc f"


def test_slot_is_literal(spark):
    prompts = spark.createDataFrame([(1, "[APIs] $1 [APIs]"), (2, "[APIs]")], "item_id long, prompt string")
    texts = spark.createDataFrame([(1, "a\\b$0")], "item_id long, text string")
    out = R.fill_slot(prompts, texts, "item_id", "[APIs]")
    assert {r["item_id"]: r["prompt"] for r in out.collect()} == {1: "a\\b$0 $1 a\\b$0", 2: ""}


def test_operations_of_one_block_are_many_tasks(spark):
    """Responses of one input task are dealt out before they fan out; repeated and null ids too."""
    lists = spark.createDataFrame([(i if i % 3 else None, f'["a{i}", "b", "a{i}"]') for i in range(200)], "i long, r string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = R.explode_operations(lists, "i", "r").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r["task"] for r in rows}) > 1 and len({r["task"] for r in rows if r["i"] is None}) > 1
    want = [(i if i % 3 else -1, p, o) for i in range(200) for p, o in enumerate((f"a{i}", "b"))]
    assert sorted((-1 if r["i"] is None else r["i"], r["position"], r["operation"]) for r in rows) == sorted(want)


def test_balls_travel_in_bundles(spark, monkeypatch):
    """What is left after the first ball comes as bundles of many balls, not as a row with vectors for each pair of balls."""
    calls = []
    bundles = N._bundles
    monkeypatch.setattr(N, "_bundles", lambda of, side, *more: calls.append(side) or bundles(of, side, *more))
    rng = np.random.default_rng(12)
    rows = [(i, "g", [float(x) for x in rng.integers(0, 4, 6)]) for i in range(150)]
    for size in (4096, 20):  # one bundle, and several that meet several
        monkeypatch.setattr(N, "BUNDLE_ROWS", size)
        got, found, _ = by_balls(spark, rows, rows, 2, 8)
        assert got == brute(rows, rows, 2) and found.pairs_met <= found.pairs_all
    assert calls == ["q", "d"] * 2
