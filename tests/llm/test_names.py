"""Tables with columns that are called like those the operators and stages use inside or add."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tandem.llm import decontamination, jaccard_join, mixing, quality_cnn, quality_rules, resharding, token_counts, toxicity

ODD = ["leak_key", "shard", "old", "block", "nth", "mix", "place", "score", "n_tokens", "rules", "size", "source_size", "own", "slot",
       "group", "row", "uid", "held", "before", "__mix", "__draw", "__nth", "__bytes", "__owner", "__text_key", "__quality", "Leak"]
ROWS = [(i, f"word {i % 5} and so on {'x ' * (i % 7)}", "s" if i % 3 else None) for i in range(30)] + [(None, None, "t"), (3, "", "s")]


@pytest.fixture(scope="module")
def odd_docs(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in ODD)
    return spark.createDataFrame([(*r, *(f"{c} {i}" for c in ODD)) for i, r in enumerate(ROWS)], schema).repartition(2)


def whole(df):
    return Counter(map(tuple, df.collect()))


def test_rows_stay_whole(spark, odd_docs, tmp_path):
    rows = whole(odd_docs)
    benchmark = spark.createDataFrame([(1, "nothing of that kind")], "item_id long, text string")
    clean = decontamination.decontaminated(odd_docs, benchmark)
    assert clean.columns == odd_docs.columns and whole(clean) == rows
    leaks = spark.createDataFrame([(1, "word 2 and so on")], "item_id long, text string")
    clean = decontamination.decontaminated(odd_docs, leaks)
    assert clean.columns == odd_docs.columns and whole(clean) == Counter({k: n for k, n in rows.items() if "word 2" not in (k[1] or "")})
    single = jaccard_join.one_of_each(odd_docs)
    assert single.columns == odd_docs.columns and not whole(single) - rows
    taken = mixing.mixed(odd_docs)
    assert taken.columns == odd_docs.columns and set(whole(taken)) <= set(rows)


def test_added_columns_replace(spark, odd_docs, tmp_path):
    keep = [c for c in odd_docs.columns if c != "place"]
    placed = resharding.reshard(odd_docs, F.pmod(F.xxhash64("text"), F.lit(3)), 3, 4)
    assert placed.columns == [*keep, "place"]
    cells = [f"`{c}`" for c in keep]
    assert whole(placed.select(*cells)) == whole(odd_docs.select(*cells))
    touched = resharding.rewrite(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(r["shard"] for r in back.collect()) == Counter(r["place"]["shard"] for r in placed.collect() if r["place"]["shard"] in touched)
    copied = mixing.with_copies(odd_docs)
    assert copied.columns == [*(c for c in odd_docs.columns if c != "mix"), "mix"]
    empty = token_counts.build([])
    for scored, name in ((toxicity.with_toxicity(odd_docs, toxicity.train([])), "score"), (quality_rules.quality_rules(odd_docs), "rules"),
                         (quality_cnn.with_score(odd_docs, quality_cnn.new_network()), "score"),
                         (token_counts.with_token_count(odd_docs, empty), "n_tokens")):
        before = [c for c in odd_docs.columns if c != name]
        cells = [f"`{c}`" for c in before]
        assert scored.columns == [*before, name] and whole(scored.select(*cells)) == whole(odd_docs.select(*cells))


def test_stages(spark, odd_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "word 2 and so on")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd_docs, str(tmp_path))
        assert got.columns == odd_docs.columns and set(whole(got)) <= set(whole(odd_docs)), name
    last = corpus_pipeline.STAGES[-1][1](spark, odd_docs, str(tmp_path))
    assert last.count() == len(ROWS) and last.columns[-3:] == ["size", "shard", "slot"] and len(set(last.columns)) == len(last.columns)
