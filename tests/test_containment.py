"""Substring joins against brute force."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandem.operators import containment as C
from tandem.operators.containment import contain_join, table_mentions

WORDS = ["a", "ab", "abc", "b", "ba", "cab", "", "ça", "x.y"]


def random_texts(seed, n, longest):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("seed, settings", [(1, {}), (2, {}), (3, {"cells": 4, "most_bits": 32})])
def test_contain_join_is_exact(spark, seed, settings):
    """Also with a sketch and a filter that tell nothing apart."""
    texts = random_texts(seed, 60, 12) + [None, "the hot text", "", "ab " * 400] * 5
    items = random_texts(seed + 10, 40, 5) + ["hot", "hot", "e hot t", "zz", "", None, "ç", "ab " * 60, "b ab ab a"]
    got = contain_join(
        spark.createDataFrame(list(enumerate(texts)), "doc long, body string"), "doc", "body",
        spark.createDataFrame(list(enumerate(items)), "item string, passage string"), "item", "passage", **settings)
    want = {
        (d, str(i)) for d, t in enumerate(texts) for i, p in enumerate(items)
        if t is not None and p is not None and p in t
    }
    pairs = [tuple(r) for r in got.collect()]
    assert got.columns == ["doc", "item"] and len(pairs) == len(set(pairs))
    assert set(pairs) == want


def test_keys_are_rare_in_the_texts(spark):
    """The frequent words of an item are not looked up: only what surrounds its rarest piece leaves the scan."""
    texts = spark.createDataFrame([(i, f"common words everywhere {i}") for i in range(300)], "doc long, body string")
    items = spark.createDataFrame([(1, "common words everywhere 17"), (2, "words everywhere 299")], "item long, passage string")
    plain = texts.select("body").selectExpr("CAST(body AS BINARY) AS text")
    named = items.selectExpr("item AS item_id", "CAST(passage AS BINARY) AS item")
    keyed = C._keys(named, 8, C._sketch(plain, 8, C.SKETCH_CELLS), "bigint")
    found = {r["item_id"]: int(r["key"]).to_bytes(8, "little", signed=True).decode() for r in keyed.collect()}
    assert "17" in found[1] and "299" in found[2]
    assert sorted(map(tuple, contain_join(texts, "doc", "body", items, "item", "passage").collect())) == [
        (i, 1) for i in (17, *range(170, 180))] + [(299, 2)]


def test_nothing_to_join(spark):
    texts = spark.createDataFrame([(1, "a"), (2, None)], "doc long, body string")
    items = spark.createDataFrame([], "item long, passage string")
    assert contain_join(texts, "doc", "body", items, "item", "passage").count() == 0
    assert contain_join(texts.limit(0), "doc", "body", spark.createDataFrame([(1, "a")], items.schema), "item", "passage").count() == 0


def test_table_mentions(spark):
    names = ["race", "races", "results", "Race"]
    catalogue = spark.createDataFrame(
        [("f", n, i) for i, n in enumerate(names)] + [("g", "race", 0)], "db_id string, table_name string, ordinal long")
    texts = spark.createDataFrame(
        [(1, "f", "SELECT * FROM races"), (2, "f", "select Race, results"), (3, "g", "x"), (4, "h", "race")],
        "id long, db_id string, sql string")
    got = table_mentions(texts, catalogue).select("id", "ordinal", "table_name").orderBy("id", "ordinal")
    assert [tuple(r) for r in got.collect()] == [
        (1, 0, "race"), (1, 1, "races"), (2, 2, "results"), (2, 3, "Race")]


def test_table_mentions_of_a_large_catalogue(spark):
    catalogue = spark.range(1000).select(
        F.lit("d").alias("db_id"), F.concat(F.lit("t"), "id").alias("table_name"), F.col("id").alias("ordinal"))
    texts = spark.createDataFrame([(1, "d", "from t999 join t5")], "id long, db_id string, sql string")
    got = {r["table_name"] for r in table_mentions(texts, catalogue).collect()}
    assert got == {f"t{i}" for i in range(1000) if f"t{i}" in "from t999 join t5"}


@pytest.mark.parametrize("slice_bytes", [7, 64, 1 << 20])
def test_slices_of_a_batch_lose_no_place(monkeypatch, slice_bytes):
    """Rows are looked at a few at a time, a long one in turns: the same pieces and surroundings as all at once."""
    monkeypatch.setattr(C, "SLICE_BYTES", slice_bytes)
    texts = [t.encode() for t in random_texts(5, 40, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["text_id", "text"]).slice(3)
    whole = C._pieces(*C._bytes_of(batch.column("text")), 4)
    seen, rows, before = [], [], 0
    for own, data, offsets in C._slices(iter([batch]), "text"):
        assert len(data) <= slice_bytes or own.num_rows == 1
        rows += own.column("text_id").to_pylist()
        for value, at in C._windows(data, offsets, 4):
            assert len(value) <= slice_bytes
            seen += zip(value.tolist(), (at + before).tolist())
        before += len(data)
    assert rows == list(range(3, len(texts))) and seen == list(zip(*map(np.ndarray.tolist, whole)))


def test_memory_of_a_batch_is_bounded():
    """A batch of many texts takes no memory in proportion to all its bytes."""
    texts = [f"text {i} ".encode() * 2_000 for i in range(2_000)]  # some 20 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    del texts
    tracemalloc.start()
    for _, data, offsets in C._slices(iter([batch]), "text"):
        for value, _ in C._windows(data, offsets, 8):
            C._scattered(value, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
