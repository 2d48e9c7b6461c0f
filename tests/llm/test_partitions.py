"""Substring removal with far more partitions than work, and on texts of a very short period."""

from collections import Counter
from hashlib import sha256

import pytest

from tandem.llm import anchors, lz_dedup, suffix_dedup


@pytest.fixture(params=["1", "200", "1000"])
def partitions(spark, request):
    """Spark's default is 200: most partitions of a small table have no rows at all."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield int(request.param)
    spark.conf.set(name, before)


def by_words(rows, width=50):
    least = {}
    texts = [(i, t.split()) for i, t in rows]
    for i, w in texts:
        for j in range(len(w) - width + 1):
            key = tuple(w[j:j + width])
            least[key] = min(least.get(key, i), i)
    for i, w in texts:
        gone = {k for j in range(len(w) - width + 1) if least[tuple(w[j:j + width])] < i for k in range(j, j + width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), sha256(kept.encode()).hexdigest()


def by_bytes(rows, width=200):
    seen = Counter(t[j:j + width] for _, t in rows for j in range(len(t) - width + 1))
    for i, t in rows:
        gone = {k for j in range(len(t) - width + 1) if seen[t[j:j + width]] > 1 for k in range(j, j + width)}
        kept = "".join(x for k, x in enumerate(t) if k not in gone)
        yield i, len(t), len(gone), sum(k - 1 not in gone for k in gone), sha256(kept.encode()).hexdigest()


def two_rows():
    passage = " ".join(f"shared{j}" for j in range(60))
    return [(1, f"one begins here {passage} and ends"), (2, f"the other {passage} goes on another way")]


def test_two_rows_that_share_a_passage(spark, partitions):
    rows = two_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(by_bytes(rows))
    got = lz_dedup.without_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(by_words(rows))


def test_rows_that_share_nothing(spark, partitions):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}.{j}" for j in range(80))) for i in range(3)], "doc_id long, text string")
    assert {r["n_removed"] for r in suffix_dedup.without_repeats(docs).collect()} == {0}
    assert {r["n_removed"] for r in lz_dedup.without_passages(docs).collect()} == {0}


@pytest.mark.parametrize("output_bytes", [1_000, 4 << 20])
def test_texts_of_a_short_period(spark, monkeypatch, output_bytes):
    """Also where the segments of one text leave the task in many batches."""
    monkeypatch.setattr(anchors, "OUTPUT_BYTES", output_bytes)
    rows = [(1, "ab" * 4_000), (2, "x " * 3_000), (3, "start " + "ab" * 300 + " end"), (4, "a" * 2_500), (5, "p q r " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(by_bytes(rows))
    got = lz_dedup.without_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(by_words(rows))
